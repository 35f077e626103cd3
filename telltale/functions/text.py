"""Scalar text helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from telltale.functions._cols import ColumnLike, col

# Fixed value: the public identifier form, with a plain or a non-breaking hyphen.
CVE_PATTERN = "CVE[-‑][0-9]{4}[-‑][0-9]{4,}"

# What the counting game answers.
FIZZ, BUZZ, FIZZBUZZ, NEITHER = "fizz", "buzz", "fizzbuzz", "no fizzbuzz for you!"


def fizzbuzz(n: ColumnLike) -> Column:
    value = col(n)
    return (
        F.when(value % 15 == 0, F.lit(FIZZBUZZ))
        .when(value % 3 == 0, F.lit(FIZZ))
        .when(value % 5 == 0, F.lit(BUZZ))
        .otherwise(F.lit(NEITHER))
    )


def is_number(value: ColumnLike) -> Column:
    """Whether the text reads as an integer of any size; NULL reads as no."""
    return F.coalesce(col(value).rlike(r"^\s*[+-]?\d+(_\d+)*\s*$"), F.lit(False))


def human_size(size: ColumnLike) -> Column:
    """Powers of 1000, one decimal below ten, otherwise a whole number (half to even)."""
    value = col(size)
    units = ["B", "kB", "MB", "GB", "TB", "PB", "EB"]
    out = None
    for power in range(len(units) - 1, -1, -1):
        base = 1000**power
        scaled = F.floor(value / F.lit(float(base)) * 10 + F.lit(0.5)) / F.lit(10.0)
        whole = F.concat(F.bround(scaled, 0).cast("bigint").cast("string"), F.lit(" " + units[power]))
        small = F.concat(F.format_string("%.1f", scaled), F.lit(" " + units[power]))
        shown = whole if power == 0 else F.when(scaled < 10, small).otherwise(whole)
        out = (F if out is None else out).when(value >= (base if power else 0), shown)
    return out


def extract_ids(text: ColumnLike, pattern: str) -> Column:
    """Every match in the whole text; U+2011 in a match becomes a plain hyphen."""
    find = lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    folded = F.transform(find(col(text)), lambda m: F.replace(m, F.lit("‑"), F.lit("-")))
    return F.when(F.contains(col(text), F.lit("‑")), folded).otherwise(find(col(text)))


def extract_cve_ids(text: ColumnLike) -> Column:
    return extract_ids(text, CVE_PATTERN)


def split_evidence(cell: ColumnLike) -> Column:
    """Link texts of a markdown cell."""
    return F.regexp_extract_all(col(cell), F.lit(r"\[([^\]]*)\]\("), F.lit(1))


def _last_wins(entries: Column) -> Column:
    """Map of (key, value) structs in which a repeated key keeps its last value.

    Sorted by key and place, an entry counts if another key, or none, follows it.
    """
    placed = F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value")))
    ordered = F.array_sort(F.filter(placed, lambda e: e["key"].isNotNull()))
    following = F.slice(ordered, 2, F.size(ordered))
    paired = F.zip_with(ordered, following, lambda e, after: F.struct(e.alias("e"), after["key"].alias("after")))
    last = F.filter(paired, lambda p: p["after"].isNull() | (p["after"] != p["e"]["key"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["e"]["key"], p["e"]["value"])))


def pairs_to_map(pairs: ColumnLike) -> Column:
    """``[["k","v"],…]`` → map."""
    return _last_wins(
        F.transform(
            col(pairs),
            lambda p: F.struct(F.get(p, F.lit(0)).alias("key"), F.get(p, F.lit(1)).alias("value")),
        )
    )


def kv_string_to_map(value: ColumnLike, pair_sep: str = ",", kv_sep: str = "=") -> Column:
    """``k=v,k=v`` → map; empty pieces are skipped, a repeated key keeps its last value."""
    pieces = F.filter(F.split(col(value), re.escape(pair_sep)), lambda p: p != "")

    def entry(piece: Column) -> Column:
        halves = F.split(piece, re.escape(kv_sep), 2)
        return F.struct(halves[0].alias("key"), F.get(halves, F.lit(1)).alias("value"))

    return _last_wins(F.transform(pieces, entry))


def glob_to_regex(glob: str) -> str:
    """Path glob as an anchored pattern: ``**`` crosses folders, ``*`` and ``?`` do not."""
    out, rest = "", glob
    while rest:
        if rest.startswith("**/"):
            out, rest = out + "(.*/)?", rest[3:]
        elif rest.startswith("**"):
            out, rest = out + ".*", rest[2:]
        elif rest[0] == "*":
            out, rest = out + "[^/]*", rest[1:]
        elif rest[0] == "?":
            out, rest = out + "[^/]", rest[1:]
        else:
            out, rest = out + re.escape(rest[0]), rest[1:]
    return f"^{out}$"


def url_host(url: ColumnLike) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def url_path(url: ColumnLike) -> Column:
    return F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^?#]*)", 1)
