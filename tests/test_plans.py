"""What the physical plans look like, and how they hold with a hot key."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from telltale.operators import filters, joins, ordered, windows
from telltale.queries import QUERIES
from telltale.sources.tables import table

SF = "/root/testdata/sf0.001"
STREAMS = {"webhook_ingest", "arrival_stamp", "latest_from_sink", "last_chunk_stream", "change_trigger",
           "rollback_stream", "bucket_counts_stream"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(entry_module.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(filters.cert_expired(table(spark, SF, "orders"), "o_orderdate", "1996-03-01 00:00:00").select("o_orderkey"))
    assert "LessThan(o_orderdate" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text


def test_top_per_group_limits_before_the_shuffle(spark):
    top = windows.top_per_group(table(spark, SF, "lineitem"), ["l_returnflag"], [F.desc("l_quantity"), "l_orderkey"], 5)
    assert plan(top).count("WindowGroupLimit") == 2


def test_latest_keeps_top_rows_per_task(spark):
    assert "TakeOrderedAndProject" in plan(entry_module.queries()["latest_events"](spark, SF))


@pytest.fixture
def no_broadcast(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def test_a_hot_join_key_is_split(spark, no_broadcast):
    """Without any broadcast, a key with a third of the rows is spread over tasks and nothing is lost."""
    n = 60_000
    calls = spark.range(0, n, 1, 16).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000).alias("rule"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )
    rules = spark.range(5000).select(F.col("id").alias("rule"), F.concat(F.lit("r"), "id").alias("name"))
    joined = joins.with_rule(calls, rules, "rule")
    assert len(joined.collect()) == n
    assert "skew=true" in plan(joined)


@pytest.mark.parametrize("name", ["snapshot_diff", "top_findings", "previous_version", "blocklist_suffix", "image_layers", "tls_settings"])
def test_results_do_not_depend_on_broadcasts(spark, no_broadcast, name):
    from oracle import connect, difference

    out = difference(entry_module.queries()[name](spark, SF), connect(SF), entry_module.oracle_sql()[name])
    assert out == ""


BLOCKED = ["capability_md", "ambiguous_headings", "carry_heading", "tls_suites", "tls_settings", "diff_reader", "cumulative_size", "previous_version", "surrogate_id"]


@pytest.mark.parametrize("name", BLOCKED)
def test_blocked_scans_read_their_source_once(spark, no_broadcast, name):
    """In whatever session: no branch of the plan reads the source again, so none has to be found alike and shared."""
    df = entry_module.queries()[name](spark, SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    sources = [scan for scan in final.splitlines() if "FileScan" in scan and SF in scan]
    assert len(sources) <= 1 and "ReusedExchange" not in final


def test_a_scan_over_several_blocks_shuffles_its_rows_once(spark, no_broadcast):
    lines = table(spark, SF, "lineitem").select("l_returnflag", F.col("l_orderkey").alias("line_no"), "l_linenumber", "l_suppkey")
    out = ordered.running_sum(lines, ["l_returnflag"], ["line_no", "l_linenumber"], "l_suppkey", "total", F.expr("line_no div 500"))
    text = plan(out)
    assert "SortMergeJoin" in text and text.count("FileScan") == 2
    assert len([x for x in text.splitlines() if "Exchange hashpartitioning" in x and "_told" not in x]) == 1
