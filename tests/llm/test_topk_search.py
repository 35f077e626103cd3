import math
import random

import numpy as np
from pyspark.sql import functions as F

from telltale.llm import topk_search as s


def plain(rows, k, every):
    usable = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v, *_ in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, v in usable:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v))
            out += [(q, rank, i, -score) for rank, (score, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def search(spark, rows, k, every, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, score string")
    vectors = s.usable(df.repartition(3), "vec_id", "embedding")
    return sorted(tuple(r) for r in s.top_k(vectors.where(f"id % {every} = 0"), vectors, k).collect())


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(s, "QUERY_BLOCK", 7)
    monkeypatch.setattr(s, "CANDIDATE_BLOCK", 60)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(24)], "x") for i in range(300)]
    rows += [(1_000 + i, rows[3][1], "x") for i in range(40)]  # ties
    rows += [(2_000 + i, [0.0] * 24, "x") for i in range(20)]
    assert search(spark, rows, 10, 20, "double") == plain(rows, 10, 20)


def test_several_chunks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(s, "QUERY_BLOCK", 3)
    monkeypatch.setattr(s, "CHUNK_BYTES", 400)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(rng.choice([8, 8, 5]))], "x") for i in range(200)]
    blocks = s.pack(s.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), "vec_id", "embedding"), 3, "q")
    assert s.chunks_of(blocks.withColumn("q_block", F.monotonically_increasing_id())).agg(F.max("chunk")).first()[0] > 5
    assert search(spark, rows, 4, 5, "double") == plain(rows, 4, 5)


def test_blocks_out_of_reach_are_skipped():
    """Of blocks of like vectors a query looks into few, and misses nothing in the others."""
    rng = np.random.default_rng(5)
    centres = np.repeat(rng.normal(0, 300, (40, 4)), 4, axis=1)
    matrix = np.concatenate([rng.normal(0, 4, (500, 16)) + c for c in centres]).astype(np.int64)
    ids = np.arange(len(matrix))
    order = s.like_order(matrix)
    blocks = [s.CandidateBlock(ids[part], matrix[part]) for part in np.split(order, 40)]
    looked = asked = 0
    for begin in range(0, len(matrix), 2_000):  # like queries are in one block too
        queries = s.QueryBlock(0, ids[begin : begin + 5], matrix[begin : begin + 5], 10)
        looked += queries.meet_all(blocks)
        asked += len(blocks) * len(queries.ids)
        for i, q in enumerate(queries.ids):
            best = sorted((-int(x), int(j)) for j, x in zip(ids, matrix @ matrix[q], strict=True) if j != q)[:10]
            assert [(-int(x), int(j)) for j, x in zip(*queries.found[i], strict=True)] == best
    assert looked < 0.4 * asked


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        *[(0, [1.0, 2.0], "a"), (1, None, "a"), (2, [nan, 1.0], "a"), (3, [1.0, None], "a"), (4, [inf, 1.0], "a"), (5, [], "a")],
        *[(None, [1.0, 1.0], "a"), (6, [1.0], None), (7, [-1.0, 0.5], "a"), (8, [3.0, 0.25], "a"), (9, [3.0, 0.25], "a")],
        *[(10, [1e6, 1e6], "a"), (12, [1.0, 1.0, 1.0], "a")],
    ]
    got = search(spark, rows, 2, 2, "double")
    assert got == plain(rows, 2, 2)
    assert search(spark, rows[:0], 2, 2) == []
    assert search(spark, rows[:1], 2, 2) == []


def test_wide_scores_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-(2**18), 2**18)) for _ in range(6)], "x") for i in range(60)]
    assert search(spark, rows, 5, 10, "double") == plain(rows, 5, 10)
