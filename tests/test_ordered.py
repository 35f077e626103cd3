"""Blocked scans against plain windows, with a hot group, NULL keys and NULL values."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telltale.operators import ordered, quality


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "c"])
        rows.append((key, i // 7, i, rng.choice([None, 1, 2, 3])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t int, id bigint, v int")


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_BLOCK", 300)


@pytest.mark.parametrize("lines", [None, 64, 1 << 16], ids=["range", "lines", "one block"])
def test_scans_equal_plain_windows(table, rows, lines):
    block = lines and ordered.line_block("id", lines)
    by, order = ["k"], ["t", "id"]
    w = W.partitionBy("k").orderBy("t", "id")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    cases = [
        (ordered.running_sum(table, by, order, "v", "r", block), F.sum("v").over(upto)),
        (ordered.carry_forward(table, by, order, "v", "r", block), F.last("v", True).over(upto)),
        (ordered.previous(table, by, order, "v", "r", block), F.lag("v").over(w)),
        (ordered.row_index(table, by, order, "r", block), F.row_number().over(w)),
    ]
    for got, plain in cases:
        assert rows(got, "id", "r") == rows(table.withColumn("r", plain), "id", "r")


def test_two_values_in_one_scan(table, rows):
    w = W.partitionBy("k").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    df = table.withColumn("s", F.when(F.col("v") == 2, F.col("id")))
    got = ordered.carry_forward(df, ["k"], ["id"], ["v", "s"], ["x", "y"], ordered.line_block("id", 100))
    want = df.withColumns({"x": F.last("v", True).over(w), "y": F.last("s", True).over(w)})
    assert rows(got, "id", "x", "y") == rows(want, "id", "x", "y")


def test_a_hot_group_is_spread_over_blocks(table):
    blocked = ordered.range_blocks(table, ["k"], ["t", "id"])
    sizes = {r["_block"]: r["count"] for r in blocked.groupBy("_block").count().collect()}
    hot = blocked.filter("k = 'hot'").select("_block").distinct().count()
    assert hot >= 2 and max(sizes.values()) < 1000


@pytest.mark.parametrize("partitions", [2, 40])
def test_block_size_does_not_depend_on_the_session(spark, table, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        blocked = ordered.range_blocks(table, ["k"], ["t", "id"])
        assert blocked.select("_block").distinct().count() == 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_written_blocks_are_not_shuffled_again(spark, table):
    """The scan of a block and the join with what came before it find its rows together."""
    for setting in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(setting, "-1")
    try:
        plan = ordered.previous(table, ["k"], ["t", "id"], "v", "r")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Bucketed: true" in plan
        shuffles = [line for line in plan.splitlines() if "Exchange" in line]
        assert len(shuffles) == 1 and "_told_block" in shuffles[0]
    finally:
        for setting in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(setting)


def test_global_number_is_dense(table):
    got = [r["n"] for r in quality.surrogate_id(table, ["id"], "n").orderBy("id").collect()]
    assert got == list(range(1, 3001))


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, id bigint, v int")
    assert ordered.running_sum(df, ["k"], ["id"], "v", "r").count() == 0
    assert ordered.previous(df, ["k"], ["id"], "v", "r", ordered.line_block("id")).count() == 0
