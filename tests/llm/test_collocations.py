import random
import re
from collections import Counter, defaultdict

import pytest

from telltale.llm import collocations as C

SF = "/root/testdata/sf0.001"


def plain(docs, least=30, top=2_000):
    """By definition: all phrases of all pieces, whole."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for width in range(1, 5):
                counts[lang].update(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in candidates.items():
            for width in range(2, len(p)):
                for i in range(len(p) - width + 1):
                    if 100 * a >= 80 * f[p[i : i + width]]:
                        covered.add(p[i : i + width])
        rows = []
        for p, a in candidates.items():
            if p not in covered:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def made(rng, n):
    vocabulary = [f"w{i}" for i in range(40)] + ["Ä", "b-c", "\x1c", "漢字", "É"]
    set_phrases = [[rng.choice(vocabulary) for _ in range(rng.randint(2, 7))] for _ in range(30)]
    docs = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 30)):
            words += rng.choice(set_phrases) if rng.random() < 0.5 else [rng.choice(vocabulary)]
            words.append(rng.choice(["", "", "", "", ".", "!\n", "\t", "; "]))
        text = "".join(w if w in (".", "!\n", "; ") else f"{rng.choice([' ', ' ', '  '])}{rng.choice([w, w.upper()])}" for w in words)
        docs.append((rng.choice(["en", "en", "de", None, "", "und", "x y"]), text))
    return docs


@pytest.mark.parametrize(("least", "top"), [(3, 3), (2, 2_000), (4, 1)])
def test_against_all_phrases(spark, least, top):
    docs = made(random.Random(least * 100 + top), 400)
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, lang string, text string")
    got = sorted(map(tuple, C.collocations(df, least, top).collect()))
    assert got == plain(docs, least, top)


def test_several_rounds(spark, monkeypatch):
    """A threshold that is far too high at first, and filters that hit nearly always, give the same rows."""
    docs = made(random.Random(1), 300)
    df = spark.createDataFrame(docs, "lang string, text string")
    monkeypatch.setattr(C, "RANKS", (0.2, 1, 3))
    want = plain(docs, 3, 10)
    assert sorted(map(tuple, C.collocations(df, 3, 10).collect())) == want


def test_query_against_all_phrases(spark, docs):
    want = plain([(r["lang"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, C.op11(spark, SF).collect())) == want and want


def test_bounds_are_admissible():
    """A prefix's bound is never below the score of what it begins."""
    docs = made(random.Random(9), 200)
    f = Counter()
    for _, text in docs:
        words = text.lower().split()
        for width in range(1, 5):
            f.update(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    for p, a in f.items():
        if len(p) > 2:
            score = min(2_000_000 * a // (f[p[:k]] + f[p[k:]]) for k in range(1, len(p)))
            for width in range(2, len(p)):
                q = f[p[:width]]
                assert 2_000_000 * q // (f[p[:1]] + q) >= score


def test_products_beyond_64_bits(spark):
    big = 4_600_000_000_000_000_000
    known = spark.createDataFrame([("en", "x", big), ("en", "y", big - 1)], "lang string, phrase string, f long")
    pair = spark.createDataFrame([("en", "x y", big - 2)], "lang string, phrase string, f long")
    row = C.scored(pair, 2, known).first()
    assert row["score"] == 2_000_000 * (big - 2) // (2 * big - 1)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    assert sorted(map(tuple, C.collocations(odd_docs, 2, 50).collect())) == plain(rows, 2, 50)
    assert C.collocations(no_docs).collect() == []
    blank = spark.createDataFrame([(None, None), ("en", ""), ("en", " .,\t")], "lang string, text string")
    assert C.collocations(blank, 1).collect() == []
