"""What several of the operators share: held-out rows, bounded samples, words and hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on, at most. The choice is by hash, so it is the same on every run.
SAMPLE_ROWS = 20_000
#: Words whose hashes or scores a task remembers before it starts over.
MEMO_WORDS = 800_000


def held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn from; rows without an id are among them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hash of the key: a top-k, so nothing grows with the input."""
    return rows.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(most)


def one_per_key(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """Rows without a null key, reduced to one per key by the largest value, so a join with it never multiplies."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(v).alias(v) for v in values])


def halved(batch: pa.RecordBatch, most_rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces that are small in rows and bytes; a single row is as large as it is."""
    if batch.num_rows > 1 and (batch.num_rows > most_rows or batch.nbytes > most_bytes):
        half = batch.num_rows // 2
        yield from halved(batch.slice(0, half), most_rows, most_bytes)
        yield from halved(batch.slice(half), most_rows, most_bytes)
    elif batch.num_rows:
        yield batch


def per_batch(
    df: DataFrame,
    schema: str,
    start: Callable[[], Callable[[pa.RecordBatch], dict | pa.RecordBatch]],
    most_rows: int = 4_000,
    most_bytes: int = 16 << 20,
) -> DataFrame:
    """Map Arrow batches to columns. ``start`` runs once in each task and gives the function for its batches.

    Batches are halved until they are small in rows and bytes, so that what a task holds in Python stays bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for piece in halved(batch, most_rows, most_bytes):
                out = step(piece)
                yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out

    return df.mapInArrow(run, schema)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


class WordHashes:
    """64-bit hashes of words, remembered by word."""

    def __init__(self):
        self._known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self._known
        if len(known) > MEMO_WORDS:
            known.clear()
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([known[w] for w in words], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs_of_words(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words, in text order; fewer words make one run, no word none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    size = min(width, n)
    runs = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        runs = mixed(runs * np.uint64(0x9E3779B97F4A7C15) + words[j : n - size + 1 + j])
    return runs


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs."""
    return np.unique(runs_of_words(words, width))


def bit_filter(places: DataFrame, size: int) -> np.ndarray:
    """``size`` bits, a multiple of 32,768, those at the ``at`` of any row set: as large whatever the number of rows."""
    words = places.groupBy(F.expr("bitmap_bucket_number(at + 1)").alias("word"))
    words = words.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at + 1))").alias("bits")).collect()
    flags = np.zeros(size // 8, np.uint8)
    for r in words:
        begin = (r["word"] - 1) * 4_096  # buckets of 32,768 values, counted from 1 as the values are
        flags[begin : begin + 4_096] |= np.frombuffer(r["bits"], np.uint8)
    return flags


def has_bit(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
