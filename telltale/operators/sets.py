"""Set operations, ordered unions and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def derive_allowlist(df: DataFrame, name: str, action: str = "SCMP_ACT_ALLOW") -> DataFrame:
    """One profile rule per distinct name, with its JSON form, in name order."""
    rule = F.to_json(F.struct(F.array(F.col(name)).alias("names"), F.lit(action).alias("action")))
    return df.select(name).distinct().withColumn("rule", rule).orderBy(name)


def compare_sets(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Where each distinct name occurs: ``only_first``, ``only_second`` or ``common``.

    A tagged union and one aggregation replace three set operations.
    """
    tagged = a.select(on, F.lit(1).alias("_side")).unionByName(b.select(on, F.lit(2).alias("_side")))
    sides = tagged.groupBy(on).agg(F.min("_side").alias("_lo"), F.max("_side").alias("_hi"))
    where = (
        F.when(F.col("_lo") != F.col("_hi"), F.lit("common"))
        .when(F.col("_lo") == 1, F.lit("only_first"))
        .otherwise(F.lit("only_second"))
    )
    return sides.select(on, where.alias("side"))


def only_in_first(a: DataFrame, b: DataFrame, name: str = "n_extra") -> DataFrame:
    """Multiset difference as distinct rows with the number of copies left over.

    ``exceptAll`` would expand those copies again, and a row that makes up a
    third of the data would come out of a single task.
    """
    tagged = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    left = tagged.groupBy(*a.columns).agg(F.sum("_n").alias(name))
    return left.filter(F.col(name) > 0)


def ordered_union(parts: list[DataFrame], name: str = "ordinal") -> DataFrame:
    """Report parts one below the other, with their place as a column."""
    placed = [p.withColumn(name, F.lit(i)) for i, p in enumerate(parts, start=1)]
    return reduce(lambda a, b: a.unionByName(b), placed)


def dedup_rerun(df: DataFrame, keys: list[str], first_by: str | None = None) -> DataFrame:
    """Drop rows that a repeated load appended again.

    Where the copies differ outside the keys, such as in a generated id,
    ``first_by`` names the column whose least value is kept; otherwise which
    copy stays is open.
    """
    if first_by is None:
        return df.dropDuplicates(keys)
    rest = [first_by, *(c for c in df.columns if c not in keys and c != first_by)]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), first_by).alias("_first"))
    return kept.select(*keys, "_first.*").select(*df.columns)


def latest_n(df: DataFrame, order: list, n: int) -> DataFrame:
    """Top ``n`` by order: each task keeps ``n`` rows, only those are merged."""
    return df.orderBy(*order).limit(n)
