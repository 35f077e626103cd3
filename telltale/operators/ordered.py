"""Ordered scans over groups of any size.

A plain window puts a whole group into one task, which fails once a single
file, user or table holds a third of the data. These operators work in blocks:

1. One aggregation gives what each (group, block) adds, combined before the
   shuffle, so one small row per block and task moves. A window over these few
   rows turns them into what came before each block, and what is not nothing is
   written to the shared folder. Where no group has two blocks, that is no row.
2. The rows are shuffled once by (group, block) and scanned by a window inside
   each; what came before is joined on the partitioning the window needed, or
   not at all if there is nothing to add.

So the source is read once by the query itself and once, when the operator is
called, for the blocks' sums. No step relies on the optimizer to find out that
two branches are alike.

Blocks are either given as a column that never decreases along the order (line
numbers cut every N lines), or made from the order itself by ``range_blocks``.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telltale.session import cut, fresh_path

BLOCK = "_block"
GROUP = "_group"
LINES_PER_BLOCK = 1 << 16
ROWS_PER_BLOCK = 1 << 20
#: Bytes of text that are glued into one value, about.
SEGMENT_BYTES = 16 << 20


def line_block(line_no: str, lines: int = LINES_PER_BLOCK) -> Column:
    """Block id of a line number or of any other position that is unique per group."""
    return F.expr(f"`{line_no}` div {lines}")


def range_blocks(df: DataFrame, by: list[str], order: list[str], rows: int | None = None) -> DataFrame:
    """``df`` with a ``_block`` column: about ``rows`` rows each that follow each other by (by, order).

    The number of blocks comes from the number of rows, not from the session,
    and the bounds from Spark's sample, so a hot group is split. The blocks are
    written once, as buckets of their number: later windows inside a block find
    its rows together and need no second shuffle.
    """
    spark = df.sparkSession
    blocks = max(1, math.ceil(df.count() / (rows or ROWS_PER_BLOCK)))
    placed = df.repartitionByRange(blocks, *by, *order).withColumn(BLOCK, F.spark_partition_id())
    name = f"telltale_blocks_{uuid.uuid4().hex}"
    writer = placed.write.bucketBy(blocks, BLOCK).option("path", fresh_path(spark, "blocks"))
    writer.format("parquet").saveAsTable(name)
    written = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only the name goes, the data stay in their folder
    return written


class _Blocks:
    """The rows with their group and block, and how what came before a block gets to its rows."""

    def __init__(self, df: DataFrame, by: list[str], order: list[str], block: Column | None):
        self.ranged = block is None
        rows = range_blocks(df, by, order) if self.ranged else df.withColumn(BLOCK, block)
        # a struct is never NULL itself, so groups compare with a plain equality, NULL ones too
        self.rows = rows.withColumn(GROUP, F.struct(*by) if by else F.struct(F.lit(0)))
        self.scan = W.partitionBy(GROUP, BLOCK).orderBy(*order)
        self.upto = self.scan.rowsBetween(W.unboundedPreceding, 0)
        self.blocks = W.partitionBy(GROUP).orderBy(BLOCK)
        self.earlier = self.blocks.rowsBetween(W.unboundedPreceding, -1)
        self.order = F.struct(*order)

    def sums(self, *columns: Column) -> DataFrame:
        """One row per group and block."""
        return self.rows.groupBy(GROUP, BLOCK).agg(*columns)

    def add(self, local: DataFrame, before: DataFrame, something: Column) -> DataFrame:
        """``local`` with ``_before``, NULL where ``something`` does not hold for what came before."""
        told = cut(before.filter(something).select(F.col(GROUP).alias("_told"), F.col(BLOCK).alias("_told_block"), "_before"))
        if told.isEmpty():
            return local.withColumn("_before", F.lit(None).cast(told.schema["_before"].dataType)).drop(GROUP, BLOCK)
        same = F.col(BLOCK) == F.col("_told_block")
        if not self.ranged:
            joined = local.join(told, (F.col(GROUP) == F.col("_told")) & same, "left")
        else:
            # only the first group of a block began in an earlier one, so a block is told one thing at most
            joined = local.join(told, same, "left")
            joined = joined.withColumn("_before", F.when(F.col(GROUP) == F.col("_told"), F.col("_before")))
        return joined.drop(GROUP, BLOCK, "_told", "_told_block")


def running_sum(
    df: DataFrame, by: list[str], order: list[str], value: str, name: str, block: Column | None = None
) -> DataFrame:
    """Cumulative sum of ``value`` along ``order`` within ``by``."""
    cols = [*df.columns, name]
    blocks = _Blocks(df, by, order, block)
    sums = blocks.sums(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(blocks.earlier))
    local = blocks.rows.withColumn("_local", F.sum(value).over(blocks.upto))
    out = blocks.add(local, before, F.col("_before").isNotNull())
    total = (
        F.when(F.col("_local").isNull(), F.col("_before"))
        .when(F.col("_before").isNull(), F.col("_local"))
        .otherwise(F.col("_local") + F.col("_before"))
    )
    return out.withColumn(name, total).select(*cols)


def row_index(
    df: DataFrame, by: list[str], order: list[str], name: str, block: Column | None = None
) -> DataFrame:
    """Dense row number from 1 along ``order`` within ``by`` (or over the whole table)."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_sum(one, by, order, "_one", name, block).drop("_one")


def carry_forward(
    df: DataFrame,
    by: list[str],
    order: list[str],
    value: str | list[str],
    name: str | list[str],
    block: Column | None = None,
) -> DataFrame:
    """The last non-null ``value`` seen so far, this row included; several values share one scan."""
    values, names = ([value], [name]) if isinstance(value, str) else (value, name)
    cols = [c for c in df.columns if c not in names] + names
    n = range(len(values))
    blocks = _Blocks(df, by, order, block)
    last = [F.max_by(v, F.when(F.col(v).isNotNull(), blocks.order)).alias(f"_v{i}") for i, v in enumerate(values)]
    so_far = F.struct(*(F.last(f"_v{i}", ignorenulls=True).over(blocks.earlier).alias(f"v{i}") for i in n))
    before = blocks.sums(*last).withColumn("_before", so_far)
    local = blocks.rows.select("*", *(F.last(v, ignorenulls=True).over(blocks.upto).alias(f"_l{i}") for i, v in enumerate(values)))
    out = blocks.add(local, before, F.coalesce(*(F.when(F.col(f"_before.v{i}").isNotNull(), F.lit(True)) for i in n), F.lit(False)))
    carried = {n: F.coalesce(f"_l{i}", f"_before.v{i}") for i, n in enumerate(names)}
    return out.withColumns(carried).select(*cols)


def counts_since(
    df: DataFrame, by: list[str], order: list[str], mark: str, counts: list[str], names: list[str], block: Column | None = None
) -> DataFrame:
    """The last non-null ``mark``, this row included, and the sums of ``counts`` over the rows after it, up to this one.

    Before the first mark the sums are NULL. What a block adds depends on where
    in it the last mark stands, so the blocks' sums come from a window too, over
    the columns named here and the groups with rows in a block behind one with a
    mark. Mostly there are none.
    """
    cols = [*(c for c in df.columns if c not in (mark, *names)), mark, *names]
    n = range(len(counts))
    blocks = _Blocks(df, by, order, block)
    at_mark = lambda m, sums: F.when(m.isNotNull(), F.struct(m.alias("m"), *(s.alias(f"c{i}") for i, s in enumerate(sums))))

    def scanned(rows: DataFrame) -> DataFrame:
        summed = rows.select("*", *(F.sum(c).over(blocks.upto).alias(f"_c{i}") for i, c in enumerate(counts)))
        marked = summed.withColumn("_at", at_mark(F.col(mark), [F.col(f"_c{i}") for i in n]))
        return marked.withColumn("_last", F.last("_at", ignorenulls=True).over(blocks.upto)).drop("_at")

    local, here = scanned(blocks.rows), F.col("_last").isNotNull()
    marked = F.min(F.when(F.col(mark).isNotNull(), F.col(BLOCK))) < F.max(BLOCK)
    split = cut(blocks.rows.groupBy(GROUP).agg(marked.alias("split")).filter("split").select(GROUP))
    if split.isEmpty():
        since = {name: F.when(here, F.col(f"_c{i}") - F.col(f"_last.c{i}")) for i, name in enumerate(names)}
        return local.withColumns({mark: F.col("_last.m"), **since}).select(*cols)
    narrow = scanned(blocks.rows.select(GROUP, BLOCK, *order, mark, *counts).join(split, GROUP, "left_semi"))
    after = F.lead(F.lit(1)).over(blocks.scan)
    ends = narrow.withColumn("_after", after).filter(F.col("_after").isNull())
    sums = [F.coalesce(F.sum(f"_c{i}").over(blocks.earlier), F.lit(0)).alias(f"_s{i}") for i in n]
    ends = ends.select(GROUP, BLOCK, "_last", *sums)
    whole = at_mark(F.col("_last.m"), [F.col(f"_last.c{i}") + F.col(f"_s{i}") for i in n])
    carried = F.last(whole, ignorenulls=True).over(blocks.earlier)
    before = ends.withColumn("_before", F.struct(carried.alias("at"), *(F.col(f"_s{i}").alias(f"s{i}") for i in n)))
    out = blocks.add(local, before, F.col("_before.at").isNotNull())
    since = {
        name: F.when(here, F.col(f"_c{i}") - F.col(f"_last.c{i}")).otherwise(
            F.col(f"_c{i}") + F.col(f"_before.s{i}") - F.col(f"_before.at.c{i}")
        )
        for i, name in enumerate(names)
    }
    return out.withColumns({mark: F.coalesce("_last.m", "_before.at.m"), **since}).select(*cols)


def previous(
    df: DataFrame, by: list[str], order: list[str], value: str, name: str, block: Column | None = None
) -> DataFrame:
    """``value`` of the row one step earlier; NULL for the first row of a group."""
    cols = [*df.columns, name]
    blocks = _Blocks(df, by, order, block)
    boxed = F.struct(F.col(value).alias("v"))
    last = blocks.sums(F.max_by(boxed, blocks.order).alias("_end"))
    before = last.withColumn("_before", F.lag("_end").over(blocks.blocks))
    local = blocks.rows.withColumn("_local", F.lag(boxed).over(blocks.scan))
    out = blocks.add(local, before, F.col("_before").isNotNull())
    return out.withColumn(name, F.coalesce("_local", "_before")["v"]).select(*cols)


def segments(df: DataFrame, by: list[str], order: list[str], size: Column, most: int | None = None) -> DataFrame:
    """``df`` with ``_at``, the bytes of its group before a row, and ``_segment``, which rows of about ``most`` bytes share.

    ``size`` gives the bytes of a row. Groups that stay below ``most`` are one segment and need no running sum; only the
    others, if there are any, go through the blocks.
    """
    most = most or SEGMENT_BYTES
    key = F.struct(*by)
    sized = df.withColumn("_size", F.coalesce(size.cast("bigint"), F.lit(0)))
    large = cut(sized.groupBy(key.alias("_large")).agg(F.sum("_size").alias("n")).filter(F.col("n") >= most).select("_large"))
    if large.isEmpty():
        return sized.withColumns({"_at": F.lit(0).cast("bigint"), "_segment": F.lit(0).cast("bigint")})
    keyed = sized.withColumn("_key", key)
    whole = keyed.join(large, F.col("_key") == F.col("_large"), "left_anti").withColumn("_at", F.lit(0).cast("bigint"))
    split = keyed.join(large, F.col("_key") == F.col("_large"), "left_semi")
    split = running_sum(split, ["_key"], order, "_size", "_upto").withColumn("_at", F.col("_upto") - F.col("_size")).drop("_upto")
    return whole.unionByName(split).drop("_key").withColumn("_segment", F.expr(f"_at div {most}"))
