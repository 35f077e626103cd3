"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents are cut into pieces no longer than the longest permitted sequence. Within a packing group pieces are taken
from long to short; each goes to the open bin that it leaves the least room in. When none has room, the bin size is
opened whose cost is least: the part of it that would stay empty, were it filled with the pieces still to come, largest
first. Of equal costs the shortest length wins, so an exact fit does. At the end each bin is changed for the shortest
permitted length that holds what is in it.

Groups hold about PIECES_PER_GROUP pieces, dealt by hash; they are packed independently, each in one task with a few
numbers per piece. More documents make more groups, not larger ones; a group wastes at most its last bins. Texts are
never moved: the result says which words of which document go where.

Defined cases. A null or empty text, or one without a word, has no piece and no row. Documents longer than the longest
sequence are cut, nothing is dropped. Repeated rows are packed one by one. An empty table gives an empty result. Ties
go to the smaller id, then to the earlier piece; among bins to the one opened first. A null id sorts first. Only id
and text are read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.llm.common import per_batch, raw_texts
from telltale.session import cut
from telltale.sources.tables import table

#: Permitted lengths of sequences, in words.
LENGTHS = (256, 512, 1_024, 2_048)
PIECES_PER_GROUP = 4_000


def unfilled(room: int, sizes: np.ndarray, ends: list[int], first: int) -> int:
    """What stays of a room when the pieces from ``first`` on, which descend, go into it largest first as long as they fit.

    ``ends[i]`` is where the run of pieces of the size of piece i ends, so equal pieces are taken at once.
    """
    n = len(sizes)
    while room and first < n:
        # the first piece that fits; the sizes descend
        first += int(np.searchsorted(-sizes[first:], -room))
        if first == n:
            break
        size = int(sizes[first])
        room -= size * min(room // size, ends[first] - first)
        first = ends[first]
    return room


def pack_pieces(sizes: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, place in the bin and bin length of each piece; ``sizes`` descend and none exceeds the longest length."""
    lengths = tuple(sorted(lengths))
    n = len(sizes)
    bins, places = np.zeros(n, np.int64), np.zeros(n, np.int64)
    ends = np.searchsorted(-sizes, -sizes, side="right").tolist() if n else []
    smallest = int(sizes[-1]) if n else 0
    room: list[tuple[int, int]] = []  # open bins by room, then number; full ones are dropped
    used: list[int] = []
    for i in range(n):
        size = int(sizes[i])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, number = room.pop(at)
        else:
            # the part that would stay empty; of equal ones the shortest, so an exact fit wins
            fitting = [c for c in lengths if c >= size]
            left = min(fitting, key=lambda c: (unfilled(c - size, sizes, ends, i + 1) / c, c))  # noqa: B023
            number = len(used)
            used.append(0)
        bins[i], places[i] = number, used[number]
        used[number] += size
        if left - size >= smallest:
            insort(room, (left - size, number))
    final = np.array([next(c for c in lengths if c >= u) for u in used], np.int64)
    return bins, places, final[bins] if n else bins


def pieces_of(docs: DataFrame, longest: int) -> DataFrame:
    """id, piece, first_word and n_words: whole texts, cut every ``longest`` words."""

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            n = np.array([len(t.split()) for t in raw_texts(batch.column(1))], np.int64)
            pieces = -(-n // longest)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = piece * longest
            return {
                "id": batch.column(0).take(pa.array(row)),
                "piece": pa.array(piece.astype(np.int32)),
                "first_word": pa.array(first),
                "n_words": pa.array(np.minimum(n[row] - first, longest)),
            }

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return per_batch(rows, "id long, piece int, first_word long, n_words long", start)


def best_fit(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, first_word, n_words, pack_group, bin, bin_offset, bin_length."""
    longest = max(lengths)
    pieces = cut(pieces_of(docs, longest))
    groups = max(1, -(-pieces.count() // per_group))
    # the place in the written pieces tells equal ones apart, so repeated or missing ids are spread as well
    place = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    group = F.pmod(F.xxhash64("id", "piece", *place), F.lit(groups)).cast("int")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "id", "piece"], ascending=[False, True, True], kind="stable", na_position="first")
        bins, places, final = pack_pieces(rows["n_words"].to_numpy(), lengths)
        return rows.assign(bin=bins, bin_offset=places, bin_length=final)

    columns = "id long, piece int, first_word long, n_words long, pack_group int"
    out = pieces.withColumn("pack_group", group).groupBy("pack_group")
    out = out.applyInPandas(pack, f"{columns}, bin long, bin_offset long, bin_length long")
    return out.withColumnRenamed("id", "doc_id")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"))
