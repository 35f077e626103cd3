"""The whole pipeline against plain Python over the same learned models, and the queries with SQL against it."""

import numpy as np
import pytest
from oracle import connect, difference

import corpus_pipeline
from telltale.llm import language_id, packing, quality_rules
from telltale.llm.queries import DEALT_ORACLES, DEALT_QUERIES
from test_ngram_join import plain_classes
from test_quality_rules import plain_verdict

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(DEALT_ORACLES))
def test_query_matches_sql(spark, name):
    assert difference(DEALT_QUERIES[name](spark, SF), connect(SF), DEALT_ORACLES[name]) == ""


def test_pipeline_equals_plain_steps(spark, docs, labels, texts):
    rules = quality_rules.fit_rules(docs, labels)
    left = {i: t for i, t in texts.items() if plain_verdict(rules, t)[1]}
    kept = docs.where(docs.doc_id.isin(list(left)))
    table = language_id.WordTable(language_id.fit_known(kept))
    langs, scores, _, _ = language_id.label_batch(table, list(left.values()))
    left = {i: t for (i, t), lang, s in zip(left.items(), langs, scores, strict=True) if lang != "und" and s >= 0.5}
    left = {i: left[i] for i, (_, home) in plain_classes(left, 5, 80).items() if i == home}
    sizes = []
    for i, t in left.items():
        n = len(t.encode().split())
        sizes += [(i, p, min(2_048, n - 2_048 * p)) for p in range(-(-n // 2_048))]
    sizes.sort(key=lambda x: (-x[2], x[0], x[1]))
    bins, places, final = packing.pack_pieces(np.array([x[2] for x in sizes]), packing.LENGTHS)
    want = sorted((i, p, n, b, at, c) for (i, p, n), b, at, c in zip(sizes, bins, places, final, strict=True))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["n_words"], r["bin"], r["bin_offset"], r["bin_length"]) for r in rows) == want


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for given in (odd_docs, no_docs):
        now = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.schema == given.schema
        assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() >= 0
