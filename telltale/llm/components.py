"""Connected components by alternating stars, each round cut by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.session import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _stars(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the least neighbour of u, u itself included: one aggregation and an equi-join."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """node and component, the smallest node reachable, for every node of the edges (a, b).

    Large stars hang all larger neighbours of a node on the least of them, small stars the node itself and its smaller
    ones; edges stay as many as nodes or fewer, and a chain's length halves. Null ends are dropped. Hot nodes are
    only ever joined on, so a partition with one can be split.
    """
    now = cut(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        starred = _stars(large)
        small = starred.select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = small.union(starred.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = cut(small.where("a <> b").distinct())
        before, mark = mark, _mark(now)
        if before == mark:
            break
    grown = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return grown.union(now.select("b", F.col("b").alias("component")).distinct())
