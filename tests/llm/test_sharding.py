import random
import zlib

import numpy as np
import pyarrow as pa

from telltale.llm import sharding as s


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jumps():
    rng = random.Random(1)
    keys = [rng.randrange(2**64) for _ in range(3_000)] + [0, 1, 2**64 - 1]
    for shards in (1, 2, 8, 9, 100):
        assert s.jump(np.array(keys, np.uint64), shards).tolist() == [plain_jump(k, shards) for k in keys]


def test_only_the_new_shard_gets_rows():
    keys = s.stable_key(pa.array(range(50_000)))
    for n in range(1, 12):
        a, b = s.jump(keys, n), s.jump(keys, n + 1)
        assert set(b[a != b]) <= {n}
        assert abs((a != b).mean() - 1 / (n + 1)) < 0.01


def test_keys_with_nulls_equal_those_without():
    a, b = s.stable_key(pa.array([5, None, -7])), s.stable_key(pa.array([5, 0, -7]))
    assert a[0] == b[0] and a[2] == b[2]
    assert len(set(s.stable_key(pa.array(["a", None, "b"])).tolist())) == 3


def check_slots(rows):
    for shard in range(s.SHARDS):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_table(spark, texts):
    rows = s.op10(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    check_slots(rows)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], s.SHARDS)


def test_odd_rows(odd_docs, no_docs):
    rows = s.shard_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    check_slots(rows)
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (1, 2)} == {(1, 0)}
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) == 1
    assert s.shard_documents(no_docs).collect() == []
