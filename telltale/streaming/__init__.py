"""Structured Streaming forms of the event operators."""

from telltale.streaming.events import (
    bucket_counts,
    change_trigger,
    ingest_webhooks,
    last_chunk,
    latest_from_sink,
    rollback_stores,
    rollback_stream,
    stamp_arrival,
)
from telltale.streaming.run import run_available, stream_table
from telltale.streaming.store import EpochStore

__all__ = [
    "EpochStore",
    "bucket_counts",
    "change_trigger",
    "ingest_webhooks",
    "last_chunk",
    "latest_from_sink",
    "rollback_stores",
    "rollback_stream",
    "run_available",
    "stamp_arrival",
    "stream_table",
]
