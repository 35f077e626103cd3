"""References to CI actions, container images, posts and pinned packages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telltale.functions._cols import ColumnLike, col


def slash_count(value: ColumnLike) -> Column:
    return F.regexp_count(col(value), F.lit("/"))


def strip_marker(line: ColumnLike) -> Column:
    """The payload of a ``uses:`` line: no diff marker, no list dash, single spaces."""
    unmarked = F.regexp_replace(col(line), r"^[+-]", "")
    collapsed = F.trim(F.regexp_replace(unmarked, r"\s+", " "))
    return F.trim(F.regexp_replace(collapsed, r"^(- )?uses:", ""))


def parse_action_ref(line: ColumnLike) -> Column:
    """``org/repo[/dir…]@ref [# comment]`` as struct(org, repo, dir, ref).

    The reference part is split off first, so a slash inside it never reaches
    the directory. Absent parts are NULL.
    """
    spec = F.regexp_replace(strip_marker(line), r"\s*#.*$", "")
    name = F.split(F.substring_index(spec, "@", 1), "/")
    deeper = F.array_join(F.slice(name, F.lit(3), F.greatest(F.size(name) - 2, F.lit(0))), "/")
    return F.struct(
        F.when(F.size(name) > 1, name[0]).alias("org"),
        F.when(F.size(name) > 1, name[1]).otherwise(name[0]).alias("repo"),
        F.nullif(deeper, F.lit("")).alias("dir"),
        F.nullif(F.trim(F.regexp_extract(spec, r"@(.*)$", 1)), F.lit("")).alias("ref"),
    )


def is_pinned_ref(ref: ColumnLike) -> Column:
    """A full commit id rather than a movable tag or branch."""
    return F.coalesce(col(ref).rlike(r"^[0-9a-f]{40}$"), F.lit(False))


def post_url(file: ColumnLike, base: str) -> Column:
    """``2024-01-31-some-title.md`` → ``<base>some-title``."""
    parts = F.split(F.regexp_replace(col(file), r"\.md$", ""), "-")
    slug = F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), "-")
    return F.concat(F.lit(base), slug)


def markdown_item(title: ColumnLike, url: ColumnLike, blurb: ColumnLike) -> Column:
    return F.concat(
        F.lit("1. ["), col(title), F.lit("]("), col(url), F.lit("):  "), col(blurb)
    )


def parse_image_ref(ref: ColumnLike) -> Column:
    """struct(registry, repo, tag); a registry is a first part that looks like a host."""
    value = F.substring_index(F.trim(col(ref)), "@", 1)
    tag = F.nullif(F.regexp_extract(F.substring_index(value, "/", -1), r":([^:]+)$", 1), F.lit(""))
    path = F.regexp_replace(value, r":[^:/]+$", "")
    registry = F.nullif(
        F.regexp_extract(path, r"^((?:[^/]*[.:][^/]*)|localhost)/", 1), F.lit("")
    )
    repo = F.when(registry.isNull(), path).otherwise(
        F.regexp_replace(path, r"^[^/]*/", "")
    )
    return F.struct(registry.alias("registry"), repo.alias("repo"), tag.alias("tag"))


def strip_ref_prefix(image: ColumnLike, n: int = 2) -> Column:
    """Drop the first ``n`` slash-separated parts; a value without a slash stays whole."""
    parts = F.split(col(image), "/")
    rest = F.array_join(F.slice(parts, F.lit(n + 1), F.greatest(F.size(parts) - n, F.lit(0))), "/")
    return F.when(F.contains(col(image), F.lit("/")), rest).otherwise(col(image))


def parse_pin(line: ColumnLike) -> Column:
    """``name==version`` as struct(name, version); version NULL when not pinned."""
    text = F.trim(F.regexp_replace(col(line), r"#.*$", ""))
    parts = F.split(text, "==", 2)
    return F.struct(
        F.trim(parts[0]).alias("name"),
        F.when(F.size(parts) > 1, F.trim(parts[1])).alias("version"),
    )
