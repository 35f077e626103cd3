"""What became of every line: each format names the kind of a line, and none is lost without a count.

A ``*_kinds`` function gives the lines with ``kind`` and ``accepted``: accepted lines are what the format's parser reads
or knows to skip, such as headings and blank lines; the others are rejects. ``route`` writes both in one pass and counts
them in the same pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from telltale.operators.ordered import carry_forward, line_block
from telltale.sources import lines as L


def _with_kind(lines: DataFrame, kind: Column, rejects: list[str]) -> DataFrame:
    blank = F.trim(F.coalesce("line", F.lit(""))) == ""
    named = lines.withColumn("kind", F.when(blank, F.lit("blank")).otherwise(kind))
    return named.select("path", "line_no", "line", "kind", (~F.col("kind").isin(*rejects)).alias("accepted"))


def trace_kinds(lines: DataFrame) -> DataFrame:
    """call; rejected: unfinished, resumed, trailer or signal, no call."""
    fits = F.coalesce(F.col("line").rlike(L.TRACE), F.lit(False))
    return _with_kind(lines, F.when(fits, F.lit("call")).otherwise(L.trace_reason()), ["unfinished", "resumed", "trailer or signal", "no call"])


def capability_kinds(lines: DataFrame) -> DataFrame:
    """heading, table head, rule and row; rejected: row without a heading above it, and other."""
    line = F.col("line")
    kind = (
        F.when(line.startswith("## ") & line.rlike(L.HEADING), F.lit("heading"))
        .when(~line.startswith("|"), F.lit("other"))
        .when(line.rlike(L.TABLE_ROW), F.lit("row"))
        .when(line.rlike(L.TABLE_HEAD), F.lit("table head"))
        .when(line.rlike(r"^\|[-:| ]+\|?\s*$"), F.lit("rule"))
        .otherwise(F.lit("other"))
    )
    named = _with_kind(lines, kind, ["other"])
    named = named.withColumn("_heading", F.when(F.col("kind") == "heading", F.lit(True)))
    placed = carry_forward(named, ["path"], ["line_no"], "_heading", "_under", line_block("line_no"))
    alone = (F.col("kind") == "row") & F.col("_under").isNull()
    placed = placed.withColumns({"accepted": F.col("accepted") & ~alone, "kind": F.when(alone, F.lit("row without heading")).otherwise(F.col("kind"))})
    return placed.drop("_heading", "_under")


def tls_kinds(lines: DataFrame) -> DataFrame:
    """section, protocol, suite, client head, client, setting and continuation; rejected: what stands before the first
    section, and other."""
    patterns = [
        ("section", L.SECTION),
        ("protocol", L.PROTOCOL),
        ("suite", L.SUITE),
        ("client head", L.CLIENT_HEAD),
        ("client", L.CLIENT),
        ("continuation", L.CONTINUED),
        ("setting", L.SETTING),
    ]
    kind = reduce(lambda so_far, p: so_far.when(F.col("line").rlike(p[1]), F.lit(p[0])), patterns, F).otherwise(F.lit("other"))
    named = _with_kind(lines, kind, ["other"]).withColumn("_section", F.when(F.col("kind") == "section", F.lit(True)))
    placed = carry_forward(named, ["path"], ["line_no"], "_section", "_in", line_block("line_no"))
    banner = F.col("kind").isin("setting", "continuation") & F.col("_in").isNull()
    placed = placed.withColumns({"accepted": F.col("accepted") & ~banner, "kind": F.when(banner, F.lit("before a section")).otherwise(F.col("kind"))})
    return placed.drop("_section", "_in")


def diff_kinds(lines: DataFrame) -> DataFrame:
    """old, new, hunk, changed and context; rejected: other."""
    named = L._diff_kinds(lines).withColumn("kind", F.coalesce("_kind", F.lit("other")))
    return named.select("path", "line_no", "line", "kind", (F.col("kind") != "other").alias("accepted"))


def domain_kinds(lines: DataFrame) -> DataFrame:
    """host; rejected: no host."""
    parsed = F.lower(F.trim("line")).rlike(L.HOST_NAME)
    return _with_kind(lines, F.when(parsed, F.lit("host")).otherwise(F.lit("no host")), ["no host"])


def image_ref_kinds(lines: DataFrame) -> DataFrame:
    """reference, and lines of a script outside its arrays; rejected: no reference."""
    named = L._image_ref_words(lines)
    bare = F.trim(F.regexp_replace("line", "(^|\\s)#.*$", "")).rlike(r"^[)]?$")
    kind = (
        F.when(F.size("_refs") > 0, F.lit("reference"))
        .when(F.col("_place") == "script", F.lit("script"))
        .when(bare | F.col("line").rlike(L.ARRAY_START), F.lit("blank"))
        .otherwise(F.lit("no reference"))
    )
    return _with_kind(named, kind, ["no reference"])


def accounts(kinds: DataFrame) -> DataFrame:
    """(kind, accepted, n) and a last row ``all`` with every line, which the others add up to."""
    each = kinds.groupBy("kind", "accepted").agg(F.count(F.lit(1)).alias("n"))
    return each.unionByName(each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("all").alias("kind"), F.lit(None).cast("boolean").alias("accepted"), "n"))


def route(kinds: DataFrame, path: str) -> dict[str, int]:
    """Write the lines by ``accepted`` in one pass; how many there were, were accepted and rejected."""
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("lines"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected")]
    kinds.observe(seen, *counts).write.partitionBy("accepted").parquet(path)
    return dict(seen.get)
