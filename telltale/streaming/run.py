"""Run a stream over what is available and read its sink back as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from telltale.session import fresh_path
from telltale.sources.tables import table
from telltale.streaming.store import FAN, EpochStore


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table folder as a file stream; a Kafka topic takes the same place in production."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def run_available(
    stream: DataFrame,
    out: str | None = None,
    checkpoint: str | None = None,
    keys: list[str] | None = None,
    fan: int = FAN,
) -> DataFrame:
    """Process everything available, then return the sink as a batch table.

    Without ``keys`` the stream appends to files. With ``keys`` it runs in
    update mode into an ``EpochStore``: the newest row per key is read back, a
    retried epoch changes nothing, and the files do not pile up with the epochs.
    """
    spark = stream.sparkSession
    out = out or fresh_path(spark, "sink")
    checkpoint = checkpoint or fresh_path(spark, "offsets")
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if keys is None:
        writer.outputMode("append").format("parquet").start(out).awaitTermination()
        return spark.read.schema(stream.schema).option("basePath", out).parquet(out)
    store = EpochStore(spark, out, stream.schema, keys, fan)
    writer.outputMode("update").foreachBatch(lambda batch, epoch: store.commit(epoch, batch)).start().awaitTermination()
    return store.read()
