"""Sinks. Files are written by all tasks; nothing is gathered first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.operators.ordered import row_index
from telltale.operators.sets import ordered_union
from telltale.sources.pointer import remove_folder
from telltale.sources.published import current, read_version, switch_to, write_beside


def append_event(df: DataFrame, path: str, required: list[str]) -> None:
    """Append events; incomplete ones go to the quarantine partition ``accepted=false``.

    One pass writes both, and a reader of accepted events never opens the others.
    """
    complete = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in required))
    df.withColumn("accepted", complete).write.mode("append").partitionBy("accepted").parquet(path)


def report_lines(header: list[str], sections: list[tuple[str, DataFrame]], order: list[str], text: str) -> DataFrame:
    """Titled sections below a header, separated by rules, as (ordinal, part, line_no, text).

    Section rows keep their order through ``line_key``, a struct of the order
    columns with their own types (the same in every section), so the report is
    sorted by range and never gathered. NULLs come first; for a descending
    order give a column that ascends, such as the negative.
    """
    spark = sections[0][1].sparkSession
    key = F.struct(*order)
    key_type = sections[0][1].select(key.alias("k")).schema["k"].dataType

    def fixed(lines: list[str]) -> DataFrame:
        rows = spark.createDataFrame(list(enumerate(lines)), "part int, text string")
        return rows.select("part", F.lit(None).cast(key_type).alias("line_key"), "text")

    parts = [fixed(header)]
    for title, body in sections:
        parts.append(fixed(["", "---", "", f"## {title}", ""]))
        parts.append(body.select(F.lit(0).alias("part"), key.alias("line_key"), F.col(text).alias("text")))
    return ordered_union(parts)


def write_report(report: DataFrame, path: str) -> None:
    """Text files whose name order is the report order."""
    report.repartitionByRange("ordinal", "part", "line_key").sortWithinPartitions(
        "ordinal", "part", "line_key"
    ).select("text").write.mode("overwrite").text(path)


def numbered_report(report: DataFrame) -> DataFrame:
    """(line_no, text) with the lines numbered from 1 in report order, through blocks like any long order."""
    order = ["ordinal", "part", "line_key"]
    return row_index(report, [], order, "line_no").select("line_no", "text")


def with_empty_fallback(df: DataFrame, fallback: DataFrame) -> DataFrame:
    """``df``, or the fallback rows when it is empty.

    Whether it is empty is a subquery that stops at the first row; nothing is written and nothing runs until the result
    is asked for.
    """
    found = df.limit(1).select(F.lit(1).alias("found")).agg(F.count("found").alias("found"))
    return df.unionByName(fallback.select(*df.columns).filter(found.scalar() == 0))


def replace_section(text: Column, start: str, end: str, new: str) -> Column:
    """The text with the lines between the first two marker lines replaced; raises when a marker is missing."""
    pattern = section_pattern(start, end)
    body = "$1" + new.replace("\\", "\\\\").replace("$", "\\$") + "$2"
    missing = F.raise_error(F.lit(f"no section between {start!r} and {end!r}")).cast("string")
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, body)).otherwise(missing)


def section_pattern(start: str, end: str) -> str:
    quoted = ["\\Q" + marker.replace("\\E", "\\E\\\\E\\Q") + "\\E" for marker in (start, end)]
    return rf"(?ms)\A(.*?^{quoted[0]}[ \t]*\r?\n).*?(^{quoted[1]}[ \t]*\r?$)"


def has_section(text: Column, start: str, end: str) -> Column:
    return text.rlike(section_pattern(start, end))


def content_digest(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Row count and order-free digest per group: the sum of 60-bit row hashes.

    Values enter with their length, so no two rows have the same text to hash.
    """
    sized = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    row = F.concat(*(F.coalesce(sized(F.col(c).cast("string")), F.lit("-")) for c in columns))
    number = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(number).cast("string").alias("digest")
    )


def changed(new: DataFrame, old: DataFrame, columns: list[str]) -> bool:
    """Whether two tables differ as multisets of rows, up to hash collisions."""
    return content_digest(new, [], columns).first() != content_digest(old, [], columns).first()


def write_if_changed(new: DataFrame, spark: SparkSession, path: str, columns: list[str]) -> bool:
    """Publish ``new`` at ``path`` unless the version in force has the same rows; read it with ``read_published``.

    The rows are computed once, into a version beside the one in force, and
    their digest is taken from there. The pointer keeps it, so the next call
    reads nothing of the old version. Equal content is removed again.
    """
    version = write_beside(new, path)
    found = content_digest(read_version(spark, path, version), [], columns).first()
    digest = {"columns": columns, "n_rows": found["n_rows"], "digest": found["digest"]}
    pointer = current(spark, path) or {}
    if pointer.get("content") == digest:
        remove_folder(spark, f"{path}/{version}")
        return False
    switch_to(spark, path, version, content=digest)
    return True
