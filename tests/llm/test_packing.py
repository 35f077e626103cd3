from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from telltale.llm import packing as p


def check_bins(sizes, bins, places, final, lengths):
    held = defaultdict(list)
    for s, b, at, c in zip(sizes, bins, places, final, strict=True):
        held[b].append((at, s, c))
    for parts in held.values():
        parts.sort()
        end = 0
        for at, s, _ in parts:
            assert at == end
            end += s
        cap = {c for *_, c in parts}
        assert cap == {next(x for x in sorted(lengths) if x >= end)}  # the shortest that holds it


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_bins_are_gapless_and_as_short_as_possible(sizes):
    sizes = np.array(sorted(sizes, reverse=True), np.int64)
    check_bins(sizes, *p.pack_pieces(sizes, (16, 32, 64)), (16, 32, 64))


def plain_unfilled(room, rest):
    """Largest first, piece by piece, each once."""
    for size in rest:
        if size <= room:
            room -= size
    return room


def plain_best_fit(sizes, lengths):
    """The same choices with a search over all open bins."""
    bins = []
    for i, s in enumerate(sizes):
        open_ = [(c - u, k) for k, (c, u) in enumerate(bins) if c - u >= s]
        if open_:
            k = min(open_)[1]
        else:
            bins.append((min((c for c in lengths if c >= s), key=lambda c: (plain_unfilled(c - s, sizes[i + 1 :]) / c, c)), 0))
            k = len(bins) - 1
        bins[k] = (bins[k][0], bins[k][1] + s)
    return sorted(u for _, u in bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_choices_equal_a_plain_search(sizes):
    sizes = np.array(sorted(sizes, reverse=True), np.int64)
    bins, _, _ = p.pack_pieces(sizes, (16, 32, 64))
    got = sorted(np.bincount(bins, sizes).astype(int).tolist())
    assert got == plain_best_fit(sizes.tolist(), (16, 32, 64))


def test_lengths_are_weighed_together():
    bins, _, final = p.pack_pieces(np.array([100, 60]), (64, 128, 256))
    assert bins.tolist() == [0, 0] and final.tolist() == [256, 256] or final.tolist() == [128, 64]
    assert p.pack_pieces(np.array([60]), (64, 128))[2].tolist() == [64]


def test_every_length_is_opened_and_none_is_wasted():
    """Sizes around one of the lengths: all are opened, and less stays empty than with the longest alone."""
    sizes = np.sort(np.random.default_rng(0).integers(250, 521, 4_000))[::-1].astype(np.int64)
    filled = {}
    for lengths in (p.LENGTHS, p.LENGTHS[-1:]):
        bins, _, final = p.pack_pieces(sizes, lengths)
        used = np.bincount(bins, sizes)
        filled[lengths] = sizes.sum() / sum(next(c for c in p.LENGTHS if c >= u) for u in used)
        if len(lengths) > 1:
            assert set(final.tolist()) == set(p.LENGTHS)
    assert filled[p.LENGTHS] > filled[p.LENGTHS[-1:]] + 0.01


def test_equal_pieces_without_ids_are_spread(spark):
    df = spark.range(3_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("five words are in this").alias("text"))
    rows = p.best_fit(df, (8, 16), per_group=500).groupBy("pack_group").count().collect()
    assert len(rows) == 6 and max(r["count"] for r in rows) < 700


def test_every_word_is_packed_once(docs, texts):
    rows = p.best_fit(docs, (64, 128, 256), per_group=50).collect()
    words = defaultdict(list)
    groups = defaultdict(list)
    for r in rows:
        words[r["doc_id"]].append((r["first_word"], r["n_words"]))
        groups[r["pack_group"]].append(r)
    for i, text in texts.items():
        end = 0
        for first, n in sorted(words[i]):
            assert first == end and 0 < n <= 256
            end += n
        assert end == len(text.encode().split())
    for rs in groups.values():
        check_bins(*([r[c] for r in rs] for c in ("n_words", "bin", "bin_offset", "bin_length")), (64, 128, 256))
    filled = sum(r["n_words"] for r in rows)
    assert filled > 0.9 * sum({(r["pack_group"], r["bin"]): r["bin_length"] for r in rows}.values())


def test_odd_rows(odd_docs, no_docs):
    rows = p.best_fit(odd_docs).collect()
    assert {r["doc_id"] for r in rows} == {4, 5, 6, None, 7, 8}
    assert sum(r["n_words"] for r in rows if r["doc_id"] == 4) == 40_001
    assert sum(r["doc_id"] == 5 for r in rows) == 2
    assert p.best_fit(no_docs).collect() == []
