"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors become integers, ``floor(1024 * x)``. With the means and deviations of equal segments of two vectors,
``sum of length * ((mean - mean)^2 + (deviation - deviation)^2)`` bounds their squared distance from below, and more
segments bound it more closely; a bound on the distance is one on the inner product, as
``2 q.c = |q|^2 + |c|^2 - d^2``. Candidates are dropped from coarse to fine as soon as they can't reach the k-th best
score, and the exact scores of the survivors decide.

Candidates stay where they are read: they are packed into blocks of like vectors (by the signs of a few segment means,
then by length), and each block is passed once over a chunk of query blocks. A chunk holds about CHUNK_BYTES of queries,
whatever their number, and goes to all tasks; more queries make more chunks, each one more pass over the candidates, and
no block is ever shuffled. Within a task the k-th best score of every query is carried from block to block. The least and
greatest statistics of a block bound the products with all of it: a query whose carried score is higher skips the block.
The query set is a stated part of the rows; all rows are searched.

Defined cases. A vector that is null, empty, or holds a null or non-finite component takes no part. Only vectors of a
query's own length are its candidates. Rows with a null id take no part. Rows that repeat an id are candidates and
queries one by one, and none is a candidate of its own id; equal scores go to the smaller id. An empty table gives an
empty result. A query without any candidate has no row. Scores must fit 64 bits. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telltale.session import cut
from telltale.sources.tables import table

SCALE = 1_024
QUERY_BLOCK = 256
CANDIDATE_BLOCK = 2_048
#: Bytes of packed queries that go to the tasks at a time.
CHUNK_BYTES = 16 << 20
#: Segments by whose means like vectors are put together, and whose statistics bound a block.
LIKE = 4
#: Blocks that are put in order for a query block.
TOGETHER = 16
#: Numbers of segments, coarse to fine.
LEVELS = (1, 4, 16)
_EXACT = float(1 << 53)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and ``v``, the integer components, of the rows that take part."""
    v = F.col(vector_col)
    whole = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))), F.lit(False))
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(v) > 0) & whole)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def pack(rows: DataFrame, size: int, label: str) -> DataFrame:
    """Blocks of up to ``size`` vectors of one length: dim, ids and components as bytes, in the narrowest integers that
    hold them. Made within partitions, from the batches as they come."""

    def run(batches):
        for batch in batches:
            vectors = batch.column(1)
            dims = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("<i8")
            starts = np.concatenate([[0], np.cumsum(dims)[:-1]])
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                at = at[like_order(flat[starts[at][:, None] + np.arange(dim)])]
                for i in range(0, len(at), size):
                    part = at[i : i + size]
                    matrix = flat[starts[part][:, None] + np.arange(dim)]
                    kind = next(t for t in ("<i2", "<i4", "<i8") if t == "<i8" or _holds(t, matrix))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "dim": pa.array([int(dim)], pa.int32()),
                            f"{label}_ids": pa.array([ids[part].tobytes()], pa.binary()),
                            f"{label}_kind": pa.array([kind], pa.string()),
                            f"{label}_rows": pa.array([matrix.astype(kind).tobytes()], pa.binary()),
                        }
                    )

    return rows.mapInArrow(run, f"dim int, {label}_ids binary, {label}_kind string, {label}_rows binary")


def _holds(kind: str, matrix: np.ndarray) -> bool:
    limits = np.iinfo(kind)
    return bool(matrix.min() >= limits.min and matrix.max() <= limits.max)


def unpack(row: dict, label: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{label}_ids"], "<i8")
    return ids, np.frombuffer(row[f"{label}_rows"], row[f"{label}_kind"]).reshape(len(ids), -1).astype(np.int64)


def statistics(matrix: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and deviations of each segment, and the lengths of the segments."""
    dim = matrix.shape[1]
    edges = np.linspace(0, dim, min(segments, dim) + 1).astype(int)
    length = np.diff(edges).astype(float)
    mean = np.add.reduceat(matrix, edges[:-1], axis=1) / length
    square = np.add.reduceat(matrix * matrix, edges[:-1], axis=1) / length
    return mean, np.sqrt(np.maximum(square - mean * mean, 0.0)), length


def like_order(matrix: np.ndarray) -> np.ndarray:
    """An order in which vectors stand beside like ones."""
    mean, _, _ = statistics(matrix.astype(float), LIKE)
    cell = (mean > 0) @ (1 << np.arange(mean.shape[1]))
    return np.lexsort((np.square(matrix.astype(float)).sum(1), cell))


def features(matrix: np.ndarray, segments: int) -> np.ndarray:
    """Statistics whose product bounds that of the vectors from above: as |v|^2 is the sum of length * (mean^2 +
    deviation^2), the bound on the distance is one on the product."""
    mean, deviation, length = statistics(matrix, segments)
    root = np.sqrt(length)
    return np.concatenate([mean * root, deviation * root], axis=1)


def exact(queries: np.ndarray, candidates: np.ndarray, wide: bool) -> np.ndarray:
    """Integer inner products: in doubles while they are exact, else in 64-bit integers."""
    if wide:
        return candidates.astype(np.int64) @ queries.astype(np.int64)
    return (candidates @ queries).astype(np.int64)


class QueryBlock:
    """Queries of one length with their statistics, and the best k of what they have met so far."""

    def __init__(self, number: int, ids: np.ndarray, matrix: np.ndarray, k: int):
        self.number, self.ids, self.matrix, self.k = number, ids, matrix, k
        self.float = matrix.astype(float)
        dim = matrix.shape[1]
        self.levels = [features(self.float, s) for s in LEVELS if s < dim]
        self.like = features(self.float, LIKE)
        self.largest = float(np.abs(matrix).max())
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
        #: The k-th best score so far of each query.
        self.least = np.full(len(ids), -np.inf)

    def reach(self, block: CandidateBlock) -> np.ndarray:
        """For each query a bound of its products with all of a block."""
        low, high = block.box
        return np.maximum(self.like * low, self.like * high).sum(1)

    def meet_all(self, blocks: list[CandidateBlock]) -> int:
        """Blocks that may reach furthest first, so that the others can be skipped; how many looks that took."""
        return sum(self.meet(block) for block in sorted(blocks, key=lambda b: -self.reach(b).max()))

    def meet(self, block: CandidateBlock) -> int:
        """Take what is better from a block; how many queries looked into it."""
        largest = self.largest * block.largest * self.matrix.shape[1]
        wide, slack = largest >= _EXACT, 1e-9 * largest + 0.5  # more than what rounding can take from a bound
        looking = np.flatnonzero(self.reach(block) + slack >= self.least)
        for i in looking.tolist():
            left = np.flatnonzero(block.ids != self.ids[i])
            least = self.least[i]
            for own, theirs in zip(self.levels, block.levels, strict=True):
                if len(left) <= 4 * self.k:
                    break
                bound = theirs[left] @ own[i]
                if least == -np.inf:  # exact scores of the most promising give the first threshold
                    first = left[np.argpartition(-bound, self.k - 1)[: self.k]]
                    least = exact(self.matrix[i] if wide else self.float[i], (block.matrix if wide else block.float)[first], wide).min()
                left = left[bound + slack >= least]
            if len(left):
                self._take(i, block.ids[left], exact(self.matrix[i] if wide else self.float[i], (block.matrix if wide else block.float)[left], wide))
        return len(looking)

    def _take(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = (np.concatenate(x) for x in zip(self.found[i], (ids, scores), strict=True))
        best = np.lexsort((ids, -scores))[: self.k]
        self.found[i] = ids[best], scores[best]
        if len(best) == self.k:
            self.least[i] = scores[best[-1]]


class CandidateBlock:
    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix, self.float = ids, matrix, matrix.astype(float)
        self.largest = float(np.abs(matrix).max())
        self.levels = [features(self.float, s) for s in LEVELS if s < matrix.shape[1]]
        like = features(self.float, LIKE)
        self.box = like.min(0), like.max(0)


def chunks_of(query_blocks: DataFrame) -> DataFrame:
    """Query blocks with the number of their chunk; the window is over a few numbers per QUERY_BLOCK queries."""
    size = F.octet_length("q_rows") + F.octet_length("q_ids")
    sizes = query_blocks.select("q_block", size.alias("size"))
    before = F.sum("size").over(Window.orderBy("q_block").rowsBetween(Window.unboundedPreceding, -1))
    numbered = sizes.select("q_block", F.floor(F.coalesce(before, F.lit(0)) / CHUNK_BYTES).cast("int").alias("chunk"))
    return query_blocks.join(numbered, "q_block")


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from two results of ``usable``. The query blocks and the candidate blocks are written
    once, which fixes them; results have at most k rows per query and task."""
    spark = queries.sparkSession
    query_blocks = cut(pack(queries, QUERY_BLOCK, "q").withColumn("q_block", F.monotonically_increasing_id()))
    query_blocks = cut(chunks_of(query_blocks))
    blocks = cut(pack(candidates, CANDIDATE_BLOCK, "c")).select("dim", "c_ids", "c_kind", "c_rows")
    names = ("q_block", "place", "query_id", "vec_id", "score")
    schema = ", ".join(f"{n} long" for n in names)
    near = spark.createDataFrame([], schema)
    for number in range((query_blocks.agg(F.max("chunk")).first()[0] or 0) + 1):
        chunk = query_blocks.where(F.col("chunk") == number).select("q_block", "q_ids", "q_kind", "q_rows")
        near = near.union(blocks.mapInArrow(_pass(spark.sparkContext.broadcast(chunk.toArrow().to_pylist()), k, names), schema))
    ranked = Window.partitionBy("q_block", "place").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return near.select("query_id", "rank", "vec_id", "score")


def _pass(shared, k: int, names: tuple[str, ...]):
    """One pass of a task's candidate blocks over a chunk of query blocks."""

    def run(batches):
        by_dim: dict[int, list[QueryBlock]] | None = None
        for batch in batches:
            if by_dim is None:
                by_dim = {}
                for row in shared.value:
                    ids, matrix = unpack(row, "q")
                    by_dim.setdefault(matrix.shape[1], []).append(QueryBlock(row["q_block"], ids, matrix, k))
            for i in range(0, batch.num_rows, TOGETHER):
                blocks: dict[int, list[CandidateBlock]] = {}
                for row in batch.slice(i, TOGETHER).to_pylist():
                    if row["dim"] in by_dim:
                        blocks.setdefault(row["dim"], []).append(CandidateBlock(*unpack(row, "c")))
                for dim, own in blocks.items():
                    for queries in by_dim[dim]:
                        queries.meet_all(own)
        for queries in (q for own in (by_dim or {}).values() for q in own):
            parts = [
                np.stack([np.full(len(ids), x, np.int64) for x in (queries.number, i, queries.ids[i])] + [ids, scores], axis=1)
                for i, (ids, scores) in enumerate(queries.found)
            ]
            rows = np.concatenate(parts)
            yield pa.RecordBatch.from_pydict({n: pa.array(np.ascontiguousarray(rows[:, j])) for j, n in enumerate(names)})

    return run


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors.where(F.col("id") % 100 == 0), vectors, 10)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
