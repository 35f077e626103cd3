import random

import pytest

from telltale.llm import ngram_join as j
from telltale.llm.components import components
from telltale.llm.queries import DEALT_QUERIES

SPACES = " \t\n\x0b\x0c\r"


def plain_set(text, width):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else "\n" if c in SPACES else c for c in text or "")
    words = [w for w in lower.split("\n") if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_classes(texts, width, percent):
    """All pairs, and the smallest id of each class."""
    sets = {i: plain_set(t, width) for i, t in texts.items()}
    home = {i: i for i in texts}

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a]) >= percent * len(sets[b]) >= percent * percent * len(sets[a]) / 100:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    home[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def as_dict(df):
    return {r["id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_documents_of_the_table(spark, texts):
    rows = DEALT_QUERIES["op4_ngram_join"](spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == plain_classes(texts, 4, 85)


@pytest.mark.parametrize("percent, block", [(80, 1_000), (85, 3)])
def test_chains_and_borders(spark, percent, block, monkeypatch):
    """Copies at every distance, around the threshold too; in chains whose ends don't link; over several tiles."""
    monkeypatch.setattr(j, "BLOCK", block)
    rng = random.Random(5)
    texts, at = {}, 0
    for _ in range(6):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 8, 30, 80, 200]))]
        for _ in range(14):
            texts[at] = " ".join(words)
            at += 1
            for _ in range(rng.choice([0, 1, 1, 2])):
                words = words[:]
                words[rng.randrange(len(words))] = f"x{rng.randrange(500)}"
    passage = " ".join(f"p{i}" for i in range(30))
    for k in range(12):
        texts[at] = passage + " " + " ".join(f"v{rng.randrange(5_000)}" for _ in range(4 + 3 * k))
        at += 1
    df = spark.createDataFrame([(i * 7 % 1_009, t) for i, t in texts.items()], "doc_id long, text string").repartition(5)
    want = plain_classes({i * 7 % 1_009: t for i, t in texts.items()}, 4, percent)
    assert as_dict(j.near_duplicates(df, 4, percent)) == want


def test_bitmaps_bound_the_overlap():
    rng = random.Random(1)
    shingles = j.shingler(3)
    for _ in range(50):
        a = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 400))]
        b = a[: rng.randrange(len(a)) + 1] + [f"w{rng.randrange(60)}" for _ in range(rng.randrange(40))]
        x, y = shingles(" ".join(a).encode()), shingles(" ".join(b).encode())
        p, q = (int.from_bytes(j.bitmap(s), "little") for s in (x, y))
        size = 8 * len(j.bitmap(x)), 8 * len(j.bitmap(y))
        while size[0] != size[1]:
            half = max(size) // 2
            if size[0] > size[1]:
                p, size = (p >> half) | (p & ((1 << half) - 1)), (half, size[1])
            else:
                q, size = (q >> half) | (q & ((1 << half) - 1)), (size[0], half)
        common = len(set(x.tolist()) & set(y.tolist()))
        assert common <= (len(x) + len(y) - (p ^ q).bit_count()) // 2


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 50), (None, 3), (7, None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 50, 50: 50}


def plain_rows(rows, width, percent):
    """Per row its set's size and the smallest id of its component, row by row and without regard to ids."""
    classes = plain_classes({i: t for i, (_, t) in enumerate(rows)}, width, percent)
    members = {}
    for i, (_, home) in classes.items():
        members.setdefault(home, []).append(rows[i][0])
    least = {home: min((x for x in ids if x is not None), default=None) for home, ids in members.items()}
    return sorted([(rows[i][0], n, least[home]) for i, (n, home) in classes.items()], key=repr)


def test_repeated_and_missing_ids(spark):
    """Each row by its own text: no link is lost, and no clean row leaves."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, b), (9, b + " more"), (12, "one " + a), (None, b), (None, "alone and without an id"), (5, a), (7, ""), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, j.near_duplicates(df).collect()), key=repr)
    assert got == plain_rows(rows, 5, 80) and (9, 27, 5) in got and (12, 27, 5) in got
    one = sorted(map(tuple, j.one_of_each(df).collect()), key=repr)
    assert one == sorted([(5, a), (5, b), (None, "alone and without an id"), (7, ""), (7, None)], key=repr)


def test_random_rows_with_repeated_ids(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.choice([2, 9, 40]))]
        for _ in range(6):
            texts.append(" ".join(words))
            words = words[:]
            words[rng.randrange(len(words))] = f"x{rng.randrange(60)}"
    rows = [(rng.choice([None, *range(25)]), t) for t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, j.near_duplicates(df, 3, 80).collect()), key=repr) == plain_rows(rows, 3, 80)


def test_odd_rows(odd_docs, no_docs):
    rows = j.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    got = {(r["id"], r["n_shingles"], r["component_id"]) for r in rows}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 6, 5), (6, 6, 5), (None, 0, None)} <= got
    assert j.near_duplicates(no_docs).collect() == []
    one = j.one_of_each(odd_docs)
    assert one.schema == odd_docs.schema
    assert sorted(r["doc_id"] or 0 for r in one.collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 8]
    assert j.one_of_each(no_docs).collect() == []
