"""Rankings, carried state and line groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telltale.operators.aggs import last_per_group
from telltale.operators.ordered import carry_forward, previous, running_sum, segments
from telltale.session import cut

# This package's own ordering of findings; the weights are a design decision.
SEVERITY_WEIGHT, KEV_WEIGHT, MAX_LOCATIONS = 100, 50, 49


def bucket_index(df: DataFrame, by: list[str], ts: str, width: str = "15 minutes") -> DataFrame:
    """Adds the time bucket with its forward and reverse dense index from 0.

    Ranks are taken over the distinct buckets of a group, whose number is set
    by the time range and not by the number of rows. They are written, few as
    they are, so the query itself reads the rows once and joins the ranks to them.
    """
    bucketed = df.withColumn("bucket", F.window(F.col(ts), width)["start"])
    asc = W.partitionBy(*by).orderBy("bucket")
    desc = W.partitionBy(*by).orderBy(F.col("bucket").desc())
    ranked = (
        bucketed.select(*by, "bucket")
        .distinct()
        .withColumn("bucket_index", F.row_number().over(asc) - 1)
        .withColumn("bucket_reverse_index", F.row_number().over(desc) - 1)
    )
    return bucketed.join(cut(ranked), [*by, "bucket"], "inner")


def impact_score(severity: Column, in_kev: Column, locations: Column) -> Column:
    """severity·100 + catalog hit·50 + up to 49 distinct locations: a number to show.

    Rank by (severity, catalog hit, locations) instead, which tells 50 locations from 5,000.
    """
    return (
        severity * SEVERITY_WEIGHT
        + F.when(in_kev, F.lit(KEV_WEIGHT)).otherwise(F.lit(0))
        + F.least(locations, F.lit(MAX_LOCATIONS))
    )


def top_per_group(df: DataFrame, by: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    """The leading ``n`` rows per group.

    Spark turns the rank filter into a group limit that runs before the
    shuffle, so each task sends at most ``n`` rows per group.
    """
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def briefing(df: DataFrame, by: list[str], order: list, headlines: int = 3, extra: int = 5) -> DataFrame:
    """Headlines first, then a fixed number of further points."""
    ranked = top_per_group(df, by, order, headlines + extra)
    part = F.when(F.col("rank") <= headlines, F.lit("headline")).otherwise(F.lit("extra"))
    return ranked.withColumn("part", part)


def carry_heading(
    df: DataFrame, by: list[str], order: list[str], heading: str, name: str, block: Column | None = None
) -> DataFrame:
    """Attach the last heading to the rows below it."""
    return carry_forward(df, by, order, heading, name, block)


def merge_continuations(
    df: DataFrame, by: list[str], line_no: str, text: str, is_start: Column, block: Column | None = None
) -> DataFrame:
    """Join lines that continue an entry to the line that starts it.

    Lines before the first start form an entry of their own with start NULL.
    Rows come as (by, start_line, position, n_lines, text), see ``glue_lines``.
    """
    marked = df.withColumn("_start", F.when(is_start, F.col(line_no)))
    started = carry_forward(marked, by, [line_no], "_start", "start_line", block)
    return glue_lines(started, [*by, "start_line"], line_no, text).drop("first_line")


def glue_lines(df: DataFrame, by: list[str], line_no: str, text: str, most_bytes: int | None = None) -> DataFrame:
    """Each entry's trimmed lines in order, with the first of them: rows (by, position, n_lines, first_line, text).

    An entry is one row at position 0; one of more than ``most_bytes`` bytes is several, each with the byte at which it
    begins, every line counted with a blank.
    """
    size = F.octet_length(F.trim(text)) + 1
    placed = segments(df.select(*by, line_no, text), by, [line_no], size, most_bytes)
    return (
        placed.groupBy(*by, "_segment")
        .agg(
            F.min("_at").alias("position"),
            F.count(F.lit(1)).alias("n_lines"),
            F.min_by(text, line_no).alias("first_line"),
            F.expr(f"listagg(trim(`{text}`), ' ') WITHIN GROUP (ORDER BY `{line_no}`)").alias("text"),
        )
        .drop("_segment")
    )


def previous_version(
    df: DataFrame, by: list[str], order: list[str], value: str, failed: Column
) -> DataFrame:
    """Adds the value one version back, and the value in force: one step back after a failure."""
    out = previous(df, by, order, value, "previous_value")
    return out.withColumn(
        "effective_value", F.when(failed, F.col("previous_value")).otherwise(F.col(value))
    )


def latest_record(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The newest row per key."""
    values = [c for c in df.columns if c not in by]
    return last_per_group(df, by, order, values).select(*df.columns)


def cumulative_size(df: DataFrame, by: list[str], pos: str, size: str, block: Column | None = None) -> DataFrame:
    return running_sum(df, by, [pos], size, "cumulative_size", block)


def flag_ambiguous(df: DataFrame, by: list[str], is_table: Column) -> DataFrame:
    """Tables per heading; anything but one leaves the assignment open.

    ``df`` holds the headings themselves and their table headers, each with its
    heading in ``by``, so one aggregation also finds headings without a table.
    """
    counted = df.groupBy(*by).agg(F.count_if(is_table).alias("n_tables"))
    return counted.withColumn("ambiguous", F.col("n_tables") != 1)
