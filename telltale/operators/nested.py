"""Arrays, maps and nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_structs(df: DataFrame, array: Column | str, keep: list[str]) -> DataFrame:
    """Array of structs to rows, one column per field.

    Pass a computed array as the expression itself: given as a projected
    column, Spark would compute it once more to filter out empty ones.
    """
    return df.select(*keep, F.inline(array))


def explode_map(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.explode(column).alias("key", "value"))


def explode_optional(df: DataFrame, array: str, keep: list[str], name: str) -> DataFrame:
    """Array to rows; a row without children stays, with NULL."""
    return df.select(*keep, F.explode_outer(array).alias(name))


def array_facts(df: DataFrame, array: str, wanted: list[str]) -> DataFrame:
    """Adds the size, whether the first wanted value is in, and how many wanted values are."""
    wanted_array = F.array(*(F.lit(w) for w in wanted))
    return (
        df.withColumn("n_items", F.size(array))
        .withColumn("has_first", F.array_contains(F.col(array), wanted[0]))
        .withColumn("n_wanted", F.size(F.array_intersect(F.col(array), wanted_array)))
    )


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")
