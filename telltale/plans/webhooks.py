"""Webhook payloads → event table → latest events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.operators.sets import dedup_rerun, latest_n
from telltale.streaming.events import ingest_webhooks


def latest_webhooks(payloads: DataFrame, payload: str, arrival: str, key: str, n: int = 5) -> DataFrame:
    """The newest accepted events, each delivery counted once."""
    events = ingest_webhooks(payloads, payload, arrival, [key]).filter("accepted").drop("accepted")
    once = dedup_rerun(events, [key])
    return latest_n(once, [F.desc("event_timestamp"), F.desc(key)], n)
