"""Sharding by jump consistent hashing: a stable key and the number of shards decide, no table of the ring is kept.

Going from ``n`` to ``n + 1`` shards a row either stays where it is or moves into the new shard.

Rows keep gapless slots within their shard, in the order of their keys. Slots are numbered in two levels: positions
within range partitions, and the running counts of the partitions before, so no shard passes through one task.

Defined cases. A null or empty text has size 1 and checksum 0; texts of any length are measured whole. A null key is hashed as the text ``null`` and sorts
first. Repeated rows go to one shard and get slots of their own; which of two equal rows comes first makes no
difference to the result. An empty table gives an empty result. Extra columns are neither read nor kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telltale.llm.common import mixed, per_batch
from telltale.session import cut
from telltale.sources.tables import table

SHARDS = 8
_STEP = np.uint64(2862933555777941757)


def stable_key(ids: pa.Array) -> np.ndarray:
    """64 bits from an id: spread integers, hashed text for the rest."""
    if pa.types.is_integer(ids.type) and not ids.null_count:
        return mixed(ids.cast(pa.int64()).to_numpy(zero_copy_only=False).astype(np.uint64))
    texts = ids.cast(pa.string()).to_pylist()
    whole = pa.types.is_integer(ids.type)
    return np.array(
        [
            int(mixed(np.array([int(t) & (2**64 - 1)], np.uint64))[0])
            if whole and t is not None
            else xxhash.xxh3_64_intdigest("null" if t is None else t)
            for t in texts
        ],
        np.uint64,
    )


def jump(key: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key: jumps from candidate to candidate until the next would be beyond the last shard."""
    key = key.copy()
    shard = np.zeros(len(key), np.int64)
    open_ = np.arange(len(key))
    ahead = np.zeros(len(key), np.int64)
    while len(open_):
        shard[open_] = ahead[open_]
        key[open_] = key[open_] * _STEP + np.uint64(1)
        draw = (key[open_] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[open_] = ((shard[open_] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        open_ = open_[ahead[open_] < shards]
    return shard


def assign_shards(rows: DataFrame, key: str, shards: int, out: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """``rows`` with the shard of each row, and its shard if there were one more."""
    at = rows.columns.index(key)

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = stable_key(batch.column(at))
            batch = batch.append_column(out, pa.array(jump(keys, shards).astype(np.int32)))
            return batch.append_column(grown, pa.array(jump(keys, shards + 1).astype(np.int32)))

        return step

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return per_batch(rows, f"{schema}, {out} int, {grown} int", start, most_rows=10_000)


def gapless_slots(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, … within each group, in the given order.

    Rows are range-partitioned by group and order, so equal partitions however few groups there are; each partition
    numbers its rows as they stream by. The numbered rows are written once, which fixes the partitions; the counts
    per partition and group, a few rows per partition, give the offsets.
    """

    def number(batches):
        met: dict = {}
        for batch in batches:
            groups = batch.column(at).to_pylist()
            position = []
            for g in groups:
                position.append(met.get(g, 0))
                met[g] = position[-1] + 1
            yield batch.append_column("slot_position", pa.array(position, pa.int64()))

    sorted_rows = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    sorted_rows = sorted_rows.withColumn("slot_block", F.spark_partition_id())
    at = sorted_rows.columns.index(group)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema)
    fixed = cut(sorted_rows.mapInArrow(number, f"{schema}, slot_position long"))
    before = Window.partitionBy(group).orderBy("slot_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        fixed.groupBy(group, "slot_block")
        .agg(F.count(F.lit(1)).alias("rows_here"))
        .select(group, "slot_block", F.coalesce(F.sum("rows_here").over(before), F.lit(0)).alias("slot_offset"))
    )
    placed = fixed.join(offsets, [group, "slot_block"])
    return placed.withColumn("slot", F.col("slot_offset") + F.col("slot_position")).select(*rows.columns, "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Where every document goes: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = gapless_slots(assign_shards(rows, "doc_id", shards), "shard", "doc_id", "text_crc32", "size")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def _jump_sql(shards: int) -> str:
    """The jumps, written out: ``shards`` of them are always enough, as each goes to a higher candidate."""
    wrap = "18446744073709551616"
    step = (
        f"CASE WHEN s.j >= {shards} THEN s ELSE {{'k': (s.k * 2862933555777941757 + 1) % {wrap}, 'b': s.j, "
        f"'j': floor((s.j + 1) * (2147483648.0::DOUBLE / ((((s.k * 2862933555777941757 + 1) % {wrap}) >> 33) + 1)))::HUGEINT}} END"
    )
    out = "{'k': key, 'b': 0::HUGEINT, 'j': 0::HUGEINT}"
    for i in range(shards):
        out = f"(SELECT {step} FROM (SELECT {out} AS s) AS t{i})"
    return f"({out}).b::INTEGER"


def _mix_sql(x: str) -> str:
    """A round of ``mixed`` in 128-bit arithmetic."""
    wrap = 1 << 64
    high, low = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

    def times(a: str, m: int) -> str:  # in halves, as a full product would not fit 127 bits
        return f"((({a} >> 32) * {m & 0xFFFFFFFF} + ({a} & 4294967295) * {m >> 32}) % 4294967296 * 4294967296 + ({a} & 4294967295) * {m & 0xFFFFFFFF}) % {wrap}"

    one = f"SELECT xor({x}, {x} >> 30) AS a"
    two = f"SELECT {times('a', high)} AS b FROM ({one})"
    three = f"SELECT xor(b, b >> 27) AS c FROM ({two})"
    four = f"SELECT {times('c', low)} AS d FROM ({three})"
    return f"(SELECT xor(d, d >> 31) FROM ({four}))"


_CRC_TABLE_SQL = """(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
  lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(0, 256)) AS i)))"""

OP10_SQL = f"""
WITH crc_table AS (SELECT {_CRC_TABLE_SQL} AS t),
keyed AS (
  SELECT doc_id, coalesce(text, '') AS text, {_mix_sql("(doc_id::HUGEINT % 18446744073709551616)")} AS key FROM documents),
sized AS (
  SELECT doc_id, key, (octet_length(encode(text)) + 1)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'),
      lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)::BIGINT AS text_crc32
  FROM keyed, crc_table),
placed AS (SELECT *, {_jump_sql(SHARDS)} AS shard, {_jump_sql(SHARDS + 1)} AS grown_shard FROM sized)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1)::BIGINT AS slot, grown_shard
FROM placed
"""
