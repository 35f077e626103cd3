"""JSON, base64 and digest helpers for telemetry payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telltale.functions._cols import ColumnLike, col


def json_path(payload: ColumnLike, path: str) -> Column:
    """Value at a dotted path such as ``repository.owner.login``; NULL if absent."""
    return F.get_json_object(col(payload), "$." + path)


def json_project(payload: ColumnLike, fields: list[str]) -> Column:
    """The same object with only ``fields`` kept."""
    schema = ", ".join(f"`{name}` string" for name in fields)
    return F.to_json(F.from_json(col(payload), schema))


def decode_json_payload(payload: ColumnLike, schema: str) -> Column:
    """base64 → UTF-8 → typed JSON; NULL for text that is not base64."""
    return F.from_json(F.call_function("try_to_binary", col(payload), F.lit("base64")).cast("string"), schema)


def payload_digest_matches(payload: ColumnLike, digest: ColumnLike) -> Column:
    """Whether sha256 of the decoded payload is the recorded hex digest."""
    decoded = F.call_function("try_to_binary", col(payload), F.lit("base64"))
    return F.sha2(decoded, 256) == F.lower(col(digest))


def _since_epoch(seconds: Column) -> Column:
    """UTC wall time without zone, whatever the session's time zone."""
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def epoch_to_ts(seconds: ColumnLike) -> Column:
    """Epoch seconds, as number or text, to a UTC timestamp without zone."""
    return _since_epoch(col(seconds).try_cast("bigint"))


def offset_to_ts(text: ColumnLike) -> Column:
    """ISO text with an offset to a UTC timestamp without zone; digits beyond microseconds are cut."""
    micros = F.unix_micros(F.try_to_timestamp(col(text))).cast("decimal(20,0)")
    return _since_epoch(micros / F.lit(1000000))


def embedded_json(text: ColumnLike, path: str, as_type: str = "string") -> Column:
    """Value inside JSON that travels as text within another field."""
    return F.try_variant_get(F.try_parse_json(col(text)), path, as_type)


def fenced_json(text: ColumnLike, schema: str) -> Column:
    """Parse the first fenced ``json`` block of a document; NULL when there is none."""
    return F.from_json(F.nullif(F.regexp_extract(col(text), r"(?s)```json(.*?)```", 1), F.lit("")), schema)


def build_response(role: ColumnLike, content: ColumnLike, model: ColumnLike) -> Column:
    """A nested chat-style document from flat columns."""
    message = F.struct(col(role).alias("role"), col(content).alias("content"))
    return F.to_json(
        F.struct(col(model).alias("model"), F.array(F.struct(message.alias("message"))).alias("choices"))
    )


def response_content(payload: ColumnLike) -> Column:
    return F.get_json_object(col(payload), "$.choices[0].message.content")
