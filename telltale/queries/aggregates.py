"""Aggregations over whole tables. Money is summed as decimals, so sums do not depend on order."""

from __future__ import annotations

from pyspark.sql import functions as F

from telltale import functions as T
from telltale.operators import aggs
from telltale.queries.registry import query

_RUN = "CAST(l_quantity AS BIGINT) AS pc, CAST(l_linenumber AS BIGINT) * 250000000 AS pn, CAST(round(l_extendedprice) AS BIGINT) AS ec, CAST(round(l_tax * 100) AS BIGINT) * 1000000000 AS en"


@query(
    f"""
    SELECT *, tp / nullif(pn / 1e9, 0) AS prompt_rate, te / nullif(en / 1e9, 0) AS eval_rate,
           (tp + te) / nullif((pn + en) / 1e9, 0) AS total_rate, te / n_runs AS avg_eval_tokens
    FROM (SELECT l_returnflag, l_linestatus, count(*) AS n_runs, CAST(sum(pc) AS BIGINT) AS tp, CAST(sum(pn) AS BIGINT) AS pn,
                 CAST(sum(ec) AS BIGINT) AS te, CAST(sum(en) AS BIGINT) AS en
          FROM (SELECT l_returnflag, l_linestatus, {_RUN} FROM lineitem) GROUP BY ALL)
    """,
    headline=True,
)
def benchmark_summary(t):
    """O-A1: flag and status stand for the model."""
    runs = t.lineitem.select(
        "l_returnflag",
        "l_linestatus",
        F.col("l_quantity").cast("bigint").alias("pc"),
        (F.col("l_linenumber").cast("bigint") * 250000000).alias("pn"),
        F.round("l_extendedprice").cast("bigint").alias("ec"),
        (F.round(F.col("l_tax") * 100).cast("bigint") * 1000000000).alias("en"),
    )
    out = aggs.benchmark_summary(runs, ["l_returnflag", "l_linestatus"], "pc", "pn", "ec", "en")
    return out.withColumnsRenamed(
        {"total_prompt_tokens": "tp", "total_prompt_ns": "pn", "total_eval_tokens": "te", "total_eval_ns": "en"}
    )


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n_runs FROM orders GROUP BY ALL")
def run_count(t):
    """O-A2."""
    return aggs.run_count(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("SELECT event_type AS syscall, count(*) AS n FROM events GROUP BY ALL")
def syscall_histogram(t):
    """O-A3."""
    return aggs.histogram(t.events.select(F.col("event_type").alias("syscall")), ["syscall"])


@query(
    """
    SELECT user_id, count(*) AS n_calls, count(*) FILTER (event_type = 'error') AS n_failed,
           count(*) FILTER (event_type = 'error') / count(*) AS error_rate
    FROM events GROUP BY ALL
    """
)
def error_rate(t):
    """O-A4 per caller."""
    errno = F.when(F.col("event_type") == "error", F.lit("ENOENT"))
    return aggs.error_rate(t.events.select("user_id", errno.alias("errno")), ["user_id"], "errno")


@query(
    """
    SELECT event_type AS syscall, CASE event_type WHEN 'error' THEN 'ENOENT' WHEN 'signup' THEN 'EINPROGRESS' END AS errno, count(*) AS n
    FROM events GROUP BY ALL
    """
)
def errno_histogram(t):
    """O-A4 by call and errno."""
    errno = F.when(F.col("event_type") == "error", "ENOENT").when(F.col("event_type") == "signup", "EINPROGRESS")
    return aggs.histogram(t.events.select(F.col("event_type").alias("syscall"), errno.alias("errno")), ["syscall", "errno"])


@query(
    """
    SELECT user_id, max(s) AS risk_score, count(*) AS n_behaviors,
           CASE max(s) WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' END AS risk_level
    FROM (SELECT user_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 ELSE 1 END AS s
          FROM events) GROUP BY ALL
    """
)
def file_risk(t):
    """O-A5: every event of a user is a behavior."""
    level = F.expr("CASE event_type WHEN 'view' THEN 'LOW' WHEN 'click' THEN 'MEDIUM' WHEN 'error' THEN 'HIGH' ELSE 'LOW' END")
    behaviors = t.events.select("user_id", T.risk_score(level).alias("score"))
    return aggs.file_risk(behaviors, ["user_id"], "score")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY ALL", headline=True)
def rule_histogram(t):
    """O-A6."""
    return aggs.histogram(t.lineitem, ["l_partkey"])


@query(
    """
    SELECT o_orderpriority, count(*) AS n, CAST(grouping(o_orderpriority) AS INTEGER) AS is_total
    FROM orders GROUP BY ROLLUP (o_orderpriority)
    """
)
def severity_counts(t):
    """O-A7."""
    return aggs.severity_counts(t.orders, "o_orderpriority")


@query(
    """
    SELECT l_suppkey, s AS total_size, q AS source_size, q::DOUBLE / nullif(s::DOUBLE, 0) AS shrink_ratio
    FROM (SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s,
                 CAST(sum(CAST(l_quantity AS BIGINT) * l_linenumber) AS BIGINT) AS q FROM lineitem GROUP BY ALL)
    """
)
def size_totals(t):
    """O-A8."""
    sized = t.lineitem.select("l_suppkey", F.col("l_quantity").cast("bigint").alias("size"), "l_linenumber")
    return aggs.size_totals(sized, ["l_suppkey"], "size", F.col("size") * F.col("l_linenumber"))


@query("SELECT p_type, CAST(sum(p_size) AS BIGINT) AS total_size, count(*) AS n FROM part GROUP BY ALL")
def size_by_type(t):
    """O-A9."""
    return aggs.size_by_type(t.part, "p_type", "p_size")


@query(
    """
    SELECT l_orderkey, CAST(sum(CAST(l_quantity AS DECIMAL(10,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS weighted_score
    FROM lineitem GROUP BY ALL
    """
)
def weighted_score(t):
    """O-A10: quantity is the score, discount the weight."""
    score, weight = F.col("l_quantity").cast("decimal(10,2)"), F.col("l_discount").cast("decimal(4,2)")
    out = aggs.weighted_score(t.lineitem, ["l_orderkey"], score, weight)
    return out.withColumn("weighted_score", F.col("weighted_score").cast("double"))


@query(
    """
    SELECT o_custkey, count(DISTINCT o_orderdate) AS n_distinct, count(*) AS n_rows, min(o_orderdate) AS min_item,
           max(o_orderdate) AS max_item
    FROM orders GROUP BY ALL
    """
)
def distinct_ids(t):
    """O-A11, counted."""
    return aggs.distinct_ids(t.orders, ["o_custkey"], "o_orderdate")


@query("SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def distinct_pairs(t):
    """O-A11, listed."""
    return aggs.distinct_pairs(t.orders, ["o_custkey"], "o_orderpriority")


@query(
    """
    SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type, arg_max(props, ts) AS props FROM events GROUP BY ALL
    """
)
def last_match(t):
    """O-A12."""
    return aggs.last_per_group(t.events, ["user_id"], ["ts"], ["event_type", "props"])


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY ALL")
def last_chunk(t):
    """O-A13."""
    return aggs.last_per_group(t.conversations, ["conv_id"], ["turn"], ["role", "text"])


@query(
    """
    SELECT conv_id, CAST(min(b) AS BIGINT) AS position, count(*) AS n, string_agg(text, chr(10) ORDER BY turn) AS text
    FROM (SELECT *, sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - strlen(text) - 1 AS b FROM conversations)
    GROUP BY conv_id, b // 1500
    """
)
def concat_in_order(t):
    """O-A14: whole texts, in rows of about 1,500 bytes, so that many conversations have several."""
    return aggs.concat_in_order(t.conversations, ["conv_id"], "turn", "text", "\n", 1500)


@query(
    """
    SELECT event_type, count(*) AS n_scans, min(s) AS min_seconds, avg(s) AS avg_seconds, max(s) AS max_seconds
    FROM (SELECT event_type, CAST(round(value) AS BIGINT) AS s FROM events) GROUP BY ALL
    """
)
def elapsed_stats(t):
    """O-A15: footers built from event values."""
    footer = F.format_string("Done 2024-01-01 00:00:00 [%04ds] -->> host:443 <<--", F.round("value").cast("bigint"))
    return aggs.elapsed_stats(t.events.select("event_type", footer.alias("footer")), ["event_type"], "footer")


@query(
    """
    SELECT o_orderstatus, count(*) AS n_builds, CAST(sum(s) AS BIGINT) AS total_seconds, avg(s) AS avg_seconds,
           min(s) AS min_seconds, max(s) AS max_seconds
    FROM (SELECT o_orderstatus, CAST(round(o_totalprice) AS BIGINT) AS s FROM orders) GROUP BY ALL
    """
)
def build_times(t):
    """O-A16."""
    return aggs.build_times(t.orders, ["o_orderstatus"], F.round("o_totalprice").cast("bigint"))


@query(
    """
    SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS running,
           CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS paused, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS stopped,
           true AS consistent
    FROM orders GROUP BY ALL
    """
)
def inventory_totals(t):
    """O-A17: status stands for the container state."""
    is_status = lambda s: F.when(F.col("o_orderstatus") == s, F.lit(1)).otherwise(F.lit(0))
    parts = {"running": is_status("O"), "paused": is_status("P"), "stopped": is_status("F")}
    return aggs.inventory_totals(t.orders, ["o_orderpriority"], F.lit(1), parts)
