"""Webhook, response and change-event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from telltale.operators.aggs import last_per_group
from telltale.operators.filters import changed_path_match, event_type_in
from telltale.operators.ordered import previous
from telltale.operators.sets import latest_n
from telltale.session import cut, fresh_path
from telltale.streaming.store import FAN, EpochStore

LOGIN, REPO = "repository.owner.login", "repository.name"


def stamp_arrival(df: DataFrame, arrival: str, payload_time: Column | None = None) -> DataFrame:
    """Event time is the arrival stamp, or the payload's own time where it has one."""
    stamp = F.col(arrival)
    return df.withColumn("event_timestamp", stamp if payload_time is None else F.coalesce(payload_time, stamp))


PAYLOAD = "repository struct<owner:struct<login:string>,name:string>"


def ingest_webhooks(
    df: DataFrame, payload: str, arrival: str, keep: list[str], once_by: str | None = None, late: str = "1 hour"
) -> DataFrame:
    """(username, target_repo, event_timestamp, accepted) per payload.

    Works on a stream and on a batch. A payload without one of the names is
    kept with ``accepted`` false, for the quarantine sink.

    ``once_by`` names the id of a delivery. A delivery that comes again is
    dropped before the sink, also in a later batch or after a restart: a stream
    keeps the ids in its state until the arrival times are ``late`` past them.
    So that the state ends, Spark also drops what arrives with a stamp further
    back than that; stamps are set on arrival, which keeps them close.
    """
    if once_by is not None:
        seen = df.withWatermark(arrival, late).dropDuplicatesWithinWatermark if df.isStreaming else df.dropDuplicates
        df = seen([once_by])
    # filters on the names don't pass a generator, so the payload is parsed once
    parsed = F.explode_outer(F.array(F.from_json(F.col(payload), PAYLOAD))).alias("_p")
    out = stamp_arrival(df.select("*", parsed), arrival).select(
        *keep, F.col(f"_p.{LOGIN}").alias("username"), F.col(f"_p.{REPO}").alias("target_repo"), "event_timestamp"
    )
    return out.withColumn("accepted", F.col("username").isNotNull() & F.col("target_repo").isNotNull())


def latest_from_sink(sink: DataFrame, order: list, n: int = 5) -> DataFrame:
    """The latest rows of what a stream has written so far."""
    return latest_n(sink, order, n)


def last_chunk(df: DataFrame, by: list[str], seq: str, values: list[str]) -> DataFrame:
    """The final chunk of every response; only that one carries the metrics."""
    return last_per_group(df, by, [seq], values)


def change_trigger(df: DataFrame, column: str, types: list[str], paths: str, globs: list[str], **equals) -> DataFrame:
    """Stateless filter on event type, fixed columns and changed paths."""
    return changed_path_match(event_type_in(df, column, types, **equals), paths, globs)


def bucket_counts(df: DataFrame, ts: str, by: list[str], width: str = "15 minutes", late: str | None = None) -> DataFrame:
    """Rows per tumbling bucket.

    ``late`` sets a watermark when ``df`` is a stream, so that closed buckets
    leave the state; how late is late is this package's choice.
    """
    source = df.withWatermark(ts, late) if late else df
    return (
        source.groupBy(F.window(F.col(ts), width).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("bucket"), *by, "n")
    )


def rollback_stream(
    stream: DataFrame,
    by: list[str],
    order: list[str],
    value: str,
    failed: Column,
    path: str | None = None,
    late: str | int | None = None,
    fan: int = FAN,
) -> DataFrame:
    """Value in force after every event: one version back where the event is a failure.

    Versions may come in any order, in any split into micro-batches: the result
    is that of ``previous_version`` over all of them. A version that comes
    between two earlier ones gives the later one a new predecessor, so that one
    is written again; the sink keeps the newest row per version. (by, order)
    identifies a version, and one that comes again replaces itself.

    ``late`` (an interval for times, a number for numbers, on the first order
    column) bounds the state: a version further behind the newest one of the
    epochs before goes to the rejects, which are counted, and of the versions
    behind it only the newest per key is kept. Without it all versions are kept.

    Each micro-batch is fixed first, put among the versions of its keys and goes
    through the blocked lag, so a hot key is spread over tasks.
    """
    spark = stream.sparkSession
    base = path or fresh_path(spark, "rollback")
    stores = rollback_stores(spark, base, stream, by, order, value, late, fan)
    version = [*by, *order]
    kind = stream.schema[order[0]].dataType.simpleString()

    def step(batch: DataFrame, epoch: int) -> None:
        if stores["state"].has(epoch):
            return
        notes = stores["state"].notes()
        rows = cut(batch.dropDuplicates(version))
        horizon = _horizon(notes, kind, late)
        if horizon is not None:
            behind = F.coalesce(F.col(order[0]) < horizon, F.lit(False))
            late_rows, rows = rows.filter(behind), rows.filter(~behind)
            stores["rejects"].commit(epoch, late_rows)
            notes["rejected"] = notes.get("rejected", 0) + late_rows.count()
        known = stores["state"].read_keys(rows.select(*by))
        again = [F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in version]
        known = known.join(rows.select(*(F.col(c).alias(f"_n_{c}") for c in version)), again, "left_anti")
        both = rows.withColumn("_new", F.lit(True)).unionByName(known.withColumn("_new", F.lit(False)))
        lagged = previous(both.withColumn("_v", F.struct(F.col(value).alias("value"), "_new")), by, order, "_v", "_before")
        met = lagged.filter(F.col("_new") | F.col("_before._new")).withColumn("previous_value", F.col("_before.value"))
        effective = F.when(failed, F.col("previous_value")).otherwise(F.col(value))
        stores["out"].commit(epoch, met.withColumn("effective_value", effective))
        newest = rows.agg(F.max(order[0]).alias("m")).select(F.greatest("m", F.lit(notes.get("newest")).cast(kind)).cast("string")).first()[0]
        # the state goes last: until it has the epoch, a retry does the same again
        stores["state"].commit(epoch, rows, notes | {"newest": newest})

    query = (
        stream.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", f"{base}/offsets")
        .foreachBatch(step)
        .start()
    )
    query.awaitTermination()
    return stores["out"].read()


def _horizon(notes: dict, kind: str, late: str | int | None) -> Column | None:
    """What lies before it is too late."""
    if late is None or notes.get("newest") is None:
        return None
    newest = F.lit(notes["newest"]).cast(kind)
    return newest - (F.expr(f"INTERVAL {late}") if isinstance(late, str) else F.lit(late))


def rollback_stores(
    spark: SparkSession, base: str, stream: DataFrame, by: list[str], order: list[str], value: str, late: str | int | None, fan: int
) -> dict[str, EpochStore]:
    """The sink, the versions kept as state, and the rejected ones (their number is in the state's notes)."""
    version, schema = [*by, *order], stream.schema
    kind = schema[order[0]].dataType.simpleString()

    def prune(rows: DataFrame, notes: dict) -> DataFrame:
        horizon = _horizon(notes, kind, late)
        if horizon is None:
            return rows
        behind = F.coalesce(F.col(order[0]) < horizon, F.lit(True))
        rest = [c for c in rows.columns if c not in by]
        newest = last_per_group(rows.filter(behind), by, order, rest).select(*rows.columns)
        return rows.filter(~behind).unionByName(newest)

    made = schema[value]
    out = StructType([*schema.fields]).add("previous_value", made.dataType).add("effective_value", made.dataType)
    return {
        "out": EpochStore(spark, f"{base}/out", out, version, fan),
        "state": EpochStore(spark, f"{base}/state", schema, version, fan, prune),
        "rejects": EpochStore(spark, f"{base}/rejects", schema, None, fan),
    }
