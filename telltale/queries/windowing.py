"""Windows, carried state and top-k over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from telltale.operators import sets, windows
from telltale.operators.ordered import line_block
from telltale.queries.registry import query


@query(
    """
    SELECT event_id, user_id, b AS bucket,
           CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY b) - 1 AS INTEGER) AS bucket_index,
           CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY b DESC) - 1 AS INTEGER) AS bucket_reverse_index
    FROM (SELECT *, time_bucket(INTERVAL '15 minutes', ts) AS b FROM events)
    """
)
def bucket_index(t):
    """O-W1."""
    return windows.bucket_index(t.events.select("event_id", "user_id", "ts"), ["user_id"], "ts").drop("ts")


@query(
    """
    SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, score, CAST(rank AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_linenumber DESC, hit DESC, l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank
          FROM (SELECT *, l_linenumber * 100 + CASE WHEN hit THEN 50 ELSE 0 END + least(CAST(l_quantity AS INTEGER), 49) AS score
                FROM (SELECT *, l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40) AS hit FROM lineitem)))
    WHERE rank <= 5
    """,
    headline=True,
)
def top_findings(t):
    """O-W2: the documented score, five findings per flag."""
    kev = t.part.filter("p_size > 40").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("hit"))
    scored = t.lineitem.join(kev, "l_partkey", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    scored = scored.withColumn("score", windows.impact_score(F.col("l_linenumber"), F.col("hit"), F.col("l_quantity").cast("int")))
    order = [F.desc("l_linenumber"), F.desc("hit"), F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    top = windows.top_per_group(scored, ["l_returnflag"], order, 5)
    return top.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "score", "rank")


@query(
    """
    SELECT conv_id, turn, last_value(CASE WHEN role <> 'assistant' THEN text END IGNORE NULLS)
             OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading
    FROM conversations
    """,
)
def carry_heading(t):
    """O-W3: what is not an answer is a heading; blocks of turns split a hot conversation."""
    turns = t.conversations.select(
        "conv_id", "turn", F.when(F.col("role") != "assistant", F.col("text")).alias("mark")
    )
    out = windows.carry_heading(turns, ["conv_id"], ["turn"], "mark", "heading", line_block("turn"))
    return out.select("conv_id", "turn", "heading")


@query(
    """
    SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
             OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_signup
    FROM events
    """,
    headline=True,
)
def carry_by_range(t):
    """O-W3 where the order is a time: blocks come from a range partitioning."""
    events = t.events.select(
        "user_id", "event_id", "ts", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("mark")
    )
    out = windows.carry_heading(events, ["user_id"], ["ts"], "mark", "last_signup")
    return out.select("user_id", "event_id", "last_signup")


@query(
    """
    SELECT conv_id, start AS start_line, 0::BIGINT AS position, count(*) AS n_lines, string_agg(trim(text, ' '), ' ' ORDER BY turn) AS text
    FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS)
             OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS start FROM conversations)
    GROUP BY ALL
    """
)
def merge_continuations(t):
    """O-W4: answers continue the question above them."""
    turns = t.conversations.select("conv_id", "turn", "role", "text")
    is_start = F.col("role") == "user"
    return windows.merge_continuations(turns, ["conv_id"], "turn", "text", is_start, line_block("turn"))


@query(
    """
    SELECT o_custkey, o_orderkey, p AS previous_value, CASE WHEN o_orderstatus = 'F' THEN p ELSE o_orderpriority END AS effective_value
    FROM (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)
    """,
    headline=True,
)
def previous_version(t):
    """O-W5: orders in state F are failures and fall back one version."""
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    out = windows.previous_version(
        orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderpriority", F.col("o_orderstatus") == "F"
    )
    return out.select("o_custkey", "o_orderkey", "previous_value", "effective_value")


@query(
    """
    SELECT event_id, user_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 1
    """
)
def latest_record(t):
    """O-W6."""
    events = t.events.select("event_id", "user_id", "ts", "event_type")
    return windows.latest_record(events, ["user_id", "event_type"], ["ts", "event_id"])


@query(
    """
    SELECT conv_id, turn, CAST(sum(len(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS cumulative_size FROM conversations
    """
)
def cumulative_size(t):
    """O-W7 along positions that are unique per group."""
    turns = t.conversations.select("conv_id", "turn", F.length("text").cast("bigint").alias("size"))
    return windows.cumulative_size(turns, ["conv_id"], "turn", "size", line_block("turn")).drop("size")


@query(
    """
    SELECT l_suppkey, l_shipdate, n, CAST(sum(n) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) AS BIGINT) AS cumulative_size
    FROM (SELECT l_suppkey, l_shipdate, count(*) AS n FROM lineitem GROUP BY ALL)
    """
)
def cumulative_by_range(t):
    """O-W7 along dates, with blocks from a range partitioning."""
    daily = t.lineitem.groupBy("l_suppkey", "l_shipdate").agg(F.count(F.lit(1)).alias("n"))
    return windows.cumulative_size(daily, ["l_suppkey"], "l_shipdate", "n")


# --- sorts, limits, top-k ---------------------------------------------------


@query(
    """
    SELECT event_id, ts, user_id, event_type, json_extract_string(props, '$.k') AS k FROM events ORDER BY ts DESC, event_id DESC LIMIT 5
    """,
    headline=True,
)
def latest_events(t):
    """O-S16, O-P10, O-L1: the latest five, with a tie-break."""
    from telltale.functions import json_path

    events = t.events.select("event_id", "ts", "user_id", "event_type", json_path("props", "k").alias("k"))
    return sets.latest_n(events, [F.desc("ts"), F.desc("event_id")], 5)


_FILE = "'2024-' || lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0') || '-01-doc-' || doc_id || '.md'"


@query(f"SELECT {_FILE} AS file FROM documents ORDER BY file DESC LIMIT 3")
def latest_posts(t):
    """O-L2: file names sort by date."""
    month = F.lpad((1 + F.col("doc_id") % 12).cast("string"), 2, "0")
    file = F.concat(F.lit("2024-"), month, F.lit("-01-doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return sets.latest_n(t.documents.select(file.alias("file")), [F.desc("file")], 3)


@query("SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS path, text FROM documents ORDER BY path LIMIT 20")
def first_files(t):
    """O-L3: the first twenty by path."""
    path = F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return sets.latest_n(t.documents.select(path.alias("path"), "text"), ["path"], 20)


@query(
    """
    SELECT l_returnflag, l_orderkey, l_linenumber, CAST(rank AS INTEGER) AS rank, CASE WHEN rank <= 3 THEN 'headline' ELSE 'extra' END AS part
    FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem)
    WHERE rank <= 8
    """
)
def briefing(t):
    """O-L4."""
    lines = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"]
    return windows.briefing(lines, ["l_returnflag"], order).drop("l_partkey", "l_extendedprice")


@query("SELECT p_partkey, p_size AS bits, 'x' || printf('%x', p_partkey) AS hexcode FROM part ORDER BY bits DESC, hexcode")
def suites_by_strength(t):
    """O-L5: a full sort, which Spark does by range."""
    hexcode = F.concat(F.lit("x"), F.lower(F.hex("p_partkey")))
    return t.part.select("p_partkey", F.col("p_size").alias("bits"), hexcode.alias("hexcode")).orderBy(
        F.desc("bits"), "hexcode"
    )
