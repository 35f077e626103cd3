"""Throughput and defaulting of model-run metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telltale.functions._cols import ColumnLike, col


def token_rate(count: ColumnLike, duration_ns: ColumnLike) -> Column:
    """Tokens per second; NULL when the duration is zero."""
    return F.try_divide(col(count).cast("double"), col(duration_ns) / F.lit(1e9))


def sentinel_to_zero(count: ColumnLike) -> Column:
    """-1 stands for "not provided" and counts as no tokens."""
    return F.when(col(count) == -1, F.lit(0)).otherwise(col(count))


def default_missing(value: ColumnLike, default) -> Column:
    return F.coalesce(col(value), F.lit(default))


def fmt2(value: ColumnLike) -> Column:
    """Two decimals, rounded on the exact binary value as C and Python do.

    ``format_string('%.2f')`` rounds the shortest decimal form half up instead,
    which turns 1.005 into 1.01.
    """
    return F.call_function("format_number", col(value), F.lit("0.00"))
