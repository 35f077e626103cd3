"""Aggregations. Each one combines map-side, so a hot group ships one partial row per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telltale.functions import risk_level, token_rate
from telltale.operators.ordered import segments

NS = 1e9


def benchmark_summary(
    df: DataFrame,
    by: list[str],
    prompt_count: str,
    prompt_ns: str,
    eval_count: str,
    eval_ns: str,
) -> DataFrame:
    """Totals and ratio-of-sums rates per model; a mean of per-run rates would overweigh short runs."""
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.sum(prompt_count).alias("total_prompt_tokens"),
        F.sum(prompt_ns).alias("total_prompt_ns"),
        F.sum(eval_count).alias("total_eval_tokens"),
        F.sum(eval_ns).alias("total_eval_ns"),
    )
    return (
        out.withColumn("prompt_rate", token_rate("total_prompt_tokens", "total_prompt_ns"))
        .withColumn("eval_rate", token_rate("total_eval_tokens", "total_eval_ns"))
        .withColumn(
            "total_rate",
            token_rate(
                F.col("total_prompt_tokens") + F.col("total_eval_tokens"),
                F.col("total_prompt_ns") + F.col("total_eval_ns"),
            ),
        )
        .withColumn("avg_eval_tokens", F.col("total_eval_tokens") / F.col("n_runs"))
    )


def run_count(df: DataFrame, by: list[str]) -> DataFrame:
    """Runs per group; an empty input has no groups and so no rows."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"))


def histogram(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def error_rate(df: DataFrame, by: list[str], errno: str) -> DataFrame:
    """Calls, failures and their ratio."""
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_calls"), F.count(errno).alias("n_failed")
    )
    return out.withColumn("error_rate", F.col("n_failed") / F.col("n_calls"))


def file_risk(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """A file is as risky as its worst behavior."""
    out = df.groupBy(*by).agg(
        F.max(score).alias("risk_score"), F.count(F.lit(1)).alias("n_behaviors")
    )
    return out.withColumn("risk_level", risk_level("risk_score"))


def severity_counts(df: DataFrame, severity: str) -> DataFrame:
    """Counts per severity and the grand total in a row of its own."""
    return df.rollup(severity).agg(
        F.count(F.lit(1)).alias("n"), F.grouping(severity).cast("int").alias("is_total")
    )


def size_totals(df: DataFrame, by: list[str], size: str, source_size: Column) -> DataFrame:
    """Total size, total source size and the shrink ratio between them."""
    out = df.groupBy(*by).agg(
        F.sum(size).alias("total_size"), F.sum(source_size).alias("source_size")
    )
    return out.withColumn(
        "shrink_ratio", F.try_divide(F.col("source_size").cast("double"), F.col("total_size").cast("double"))
    )


def size_by_type(df: DataFrame, kind: str, size: str) -> DataFrame:
    return df.groupBy(kind).agg(F.sum(size).alias("total_size"), F.count(F.lit(1)).alias("n"))


def weighted_score(df: DataFrame, by: list[str], score: Column, weight: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(score * weight).alias("weighted_score"))


def distinct_ids(df: DataFrame, by: list[str], item: str) -> DataFrame:
    """Distinct items per group as a count with the least and greatest item.

    The members themselves come as rows from ``distinct_pairs``; one array per
    group would put a hot group into a single value.
    """
    return df.groupBy(*by).agg(
        F.count_distinct(item).alias("n_distinct"),
        F.count(item).alias("n_rows"),
        F.min(item).alias("min_item"),
        F.max(item).alias("max_item"),
    )


def distinct_pairs(df: DataFrame, by: list[str], item: str) -> DataFrame:
    return df.select(*by, item).filter(F.col(item).isNotNull()).distinct()


def last_per_group(df: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The row with the greatest order key per group, as one combinable aggregate."""
    row = F.max_by(F.struct(*order, *(v for v in values if v not in order)), F.struct(*order))
    return df.groupBy(*by).agg(row.alias("_last")).select(*by, "_last.*")


def concat_in_order(
    df: DataFrame, by: list[str], seq: str, text: str, delimiter: str = "", most_bytes: int | None = None
) -> DataFrame:
    """Texts joined in sequence order, as rows (by, position, n, text).

    A row holds about ``most_bytes`` bytes at most (a longer single text stays whole); ``position`` is the byte at which
    it begins in the whole, each text counted with a delimiter. So an ordinary group is one row at position 0, and an
    oversized one is read back in the order of its positions, whatever its sequence numbers are.
    """
    glue = delimiter.replace("\\", "\\\\").replace("'", "\\'")
    size = F.octet_length(text) + F.lit(len(delimiter.encode()))
    placed = segments(df.select(*by, seq, text), by, [seq], size, most_bytes)
    return (
        placed.groupBy(*by, "_segment")
        .agg(
            F.min("_at").alias("position"),
            F.count(F.lit(1)).alias("n"),
            F.expr(f"listagg(`{text}`, '{glue}') WITHIN GROUP (ORDER BY `{seq}`)").alias("text"),
        )
        .drop("_segment")
    )


def elapsed_stats(df: DataFrame, by: list[str], footer: str) -> DataFrame:
    """Least, mean and greatest of the ``[0185s]`` figure in scan footers."""
    seconds = F.regexp_extract(F.col(footer), r"\[([0-9]+)s\]", 1).try_cast("bigint")
    return (
        df.withColumn("_s", seconds)
        .groupBy(*by)
        .agg(
            F.count("_s").alias("n_scans"),
            F.min("_s").alias("min_seconds"),
            F.avg("_s").alias("avg_seconds"),
            F.max("_s").alias("max_seconds"),
        )
    )


def build_times(df: DataFrame, by: list[str], seconds: Column) -> DataFrame:
    """Sum, mean and range of build durations per run."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_builds"),
        F.sum(seconds).alias("total_seconds"),
        F.avg(seconds).alias("avg_seconds"),
        F.min(seconds).alias("min_seconds"),
        F.max(seconds).alias("max_seconds"),
    )


def inventory_totals(df: DataFrame, by: list[str], total: Column, parts: dict[str, Column]) -> DataFrame:
    """Fleet sums of the parts, with a flag that they add up to the reported total."""
    out = df.groupBy(*by).agg(
        F.sum(total).alias("total"), *(F.sum(c).alias(name) for name, c in parts.items())
    )
    added = None
    for name in parts:
        added = F.col(name) if added is None else added + F.col(name)
    return out.withColumn("consistent", F.col("total") == added)
