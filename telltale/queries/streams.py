"""Streaming operators run over whole tables as file streams, then read back as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from telltale import streaming as S
from telltale.operators.windows import previous_version
from telltale.queries.registry import query


def _payload():
    """A webhook body per event; errors lack the repository name."""
    owner = F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("login"))
    name = F.when(F.col("event_type") != "error", F.col("event_type"))
    return F.to_json(F.struct(F.struct(owner.alias("owner"), name.alias("name")).alias("repository")))


def _ingested(t):
    """Every seventh event is delivered twice."""
    stream = S.stream_table(t.spark, t.sf_dir, "events")
    copies = F.explode(F.when(F.col("event_id") % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    # Event time has to be a timestamp with zone for a watermark.
    sent = stream.select("*", copies.alias("copy")).withColumns({"payload": _payload(), "ts": F.col("ts").cast("timestamp")})
    rows = S.run_available(S.ingest_webhooks(sent, "payload", "ts", ["event_id"], once_by="event_id"))
    return rows.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp_ntz"))


_INGEST_SQL = """
    SELECT event_id, 'u' || user_id AS username, CASE WHEN event_type <> 'error' THEN event_type END AS target_repo,
           ts AS event_timestamp, event_type <> 'error' AS accepted FROM events
"""


@query(_INGEST_SQL, headline=True)
def webhook_ingest(t):
    """O-T1."""
    return _ingested(t)


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN ts ELSE ts + INTERVAL 3 SECOND END AS event_timestamp FROM events")
def arrival_stamp(t):
    """O-T2: views carry their own time, the rest is stamped three seconds later on arrival."""
    stream = S.stream_table(t.spark, t.sf_dir, "events").withColumn("arrived", F.col("ts") + F.expr("INTERVAL 3 SECONDS"))
    own = F.when(F.col("event_type") == "view", F.col("ts"))
    return S.run_available(S.stamp_arrival(stream, "arrived", own).select("event_id", "event_timestamp"))


@query(f"SELECT * FROM ({_INGEST_SQL}) WHERE accepted ORDER BY event_timestamp DESC, event_id DESC LIMIT 5")
def latest_from_sink(t):
    """O-T3."""
    return S.latest_from_sink(_ingested(t).filter("accepted"), [F.desc("event_timestamp"), F.desc("event_id")])


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY ALL")
def last_chunk_stream(t):
    """O-T4 in update mode."""
    chunks = S.stream_table(t.spark, t.sf_dir, "conversations")
    return S.run_available(S.last_chunk(chunks, ["conv_id"], "turn", ["role", "text"]), keys=["conv_id"])


@query(
    """
    SELECT page_id, kind, path FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1) AS path,
           CASE WHEN starts_with(url, 'https') THEN 'opened' ELSE 'closed' END AS kind FROM pages)
    WHERE kind = 'opened' AND regexp_matches(path, '^(en|fr)/')
    """
)
def change_trigger(t):
    """O-T5: secure pages are opened changes of their path."""
    from telltale.functions import url_path

    kind = F.when(F.col("url").startswith("https"), F.lit("opened")).otherwise(F.lit("closed"))
    pages = S.stream_table(t.spark, t.sf_dir, "pages").select("page_id", kind.alias("kind"), url_path("url").alias("path"))
    return S.run_available(S.change_trigger(pages, "kind", ["opened", "reopened"], "path", ["en/**", "fr/**"]))


@query(
    """
    SELECT o_custkey, o_orderkey, p AS previous_value, CASE WHEN o_orderstatus = 'F' THEN p ELSE o_orderpriority END AS effective_value
    FROM (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)
    """
)
def rollback_stream(t):
    """O-T6."""
    orders = S.stream_table(t.spark, t.sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus"
    )
    out = S.rollback_stream(
        orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderpriority", F.col("o_orderstatus") == "F"
    )
    return out.select("o_custkey", "o_orderkey", "previous_value", "effective_value")


_BUCKET_SQL = "SELECT time_bucket(INTERVAL '15 minutes', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL"


@query(_BUCKET_SQL)
def bucket_counts(t):
    """O-T7 as a batch."""
    return S.bucket_counts(t.events, "ts", ["event_type"])


@query(_BUCKET_SQL)
def bucket_counts_stream(t):
    """O-T7 as a stream; the hour of lateness is this package's choice."""
    # Event time has to be a timestamp with zone for a watermark.
    events = S.stream_table(t.spark, t.sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = S.bucket_counts(events, "ts", ["event_type"], late="1 hour")
    out = S.run_available(counts, keys=["bucket", "event_type"])
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(
    """
    SELECT user_id, event_id, p AS previous_value, CASE WHEN event_type = 'error' THEN p ELSE props END AS effective_value
    FROM (SELECT *, lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
    """
)
def rollback_batch(t):
    """O-T6 as a batch over events: errors fall back one version."""
    events = t.events.select("user_id", "event_id", "ts", "event_type", "props")
    out = previous_version(events, ["user_id"], ["ts", "event_id"], "props", F.col("event_type") == "error")
    return out.select("user_id", "event_id", "previous_value", "effective_value")
