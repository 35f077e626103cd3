import math
import re
import zlib

from telltale.llm import toxicity as t


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    rows = t.op5(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("toxic IS NOT NULL").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    caught = [r["predicted"] for r in held if r["toxic"]]
    clean = [r["predicted"] for r in held if not r["toxic"]]
    assert sum(caught) > 0.85 * len(caught) and sum(clean) < 0.01 * len(clean)


def fitted():
    bad = ["Fine words here. You are a nasty fool. More fine words."] * 20
    good = ["Fine words here. You are a good friend. More fine words."] * 30
    return t.fit(bad + good, [1] * 20 + [0] * 30)


def test_offending_sentences_are_found(spark):
    model = fitted()
    df = spark.createDataFrame([(1, "All is well. That nasty fool! Bye."), (2, "A good friend."), (3, None)], "doc_id long, text string")
    rows = t.offending_sentences(df, model).collect()
    assert [(r["doc_id"], r["sentence_no"], r["sentence"]) for r in rows] == [(1, 1, "That nasty fool")]
    scores = {r["doc_id"]: r["predicted"] for r in t.score_documents(df, model).collect()}
    assert scores == {1: 1, 2: 0, 3: 0}


def test_noisy_or():
    scorer = t.Scorer(fitted())
    _, z = scorer.sentence_logits("nasty day. fool of a day.")
    p = 1 / (1 + 2.718281828459045**-z)
    assert abs(scorer.document("nasty day. fool of a day.") - (1 - (1 - p[0]) * (1 - p[1]))) < 1e-9


def plain_score(model, text):
    """By definition: words one by one, sentences one by one; the score, and the first worst sentence."""
    clean, worst = 1.0, None
    for number, part in enumerate(p for p in re.split(r"[.!?\n]+", text or "") if p.strip()):
        z = model.bias
        for word in part.split():
            letters = "".join(c for c in word.lower() if c.isalpha())
            grams = {"w" + letters} if letters else set()
            grams |= {"<" + letters[:n] for n in (3, 4, 5, 6) if len(letters) > n} | {letters[-n:] + ">" for n in (3, 4, 5) if len(letters) > n}
            z += sum(model.weights[zlib.crc32(g.encode()) % t.BUCKETS] for g in grams)
        chance = 1 / (1 + math.exp(-z))
        clean *= 1 - chance
        if worst is None or chance > worst[1]:
            worst = (number, chance, part.strip())
    return 1 - clean, worst


def test_query_against_plain_scores(spark, docs, labels):
    model = t.fit_labelled(docs, labels)
    rows = {r["doc_id"]: r for r in t.op5(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == docs.count()
    for r in docs.collect():
        score, worst = plain_score(model, r["text"])
        got = rows[r["doc_id"]]
        assert abs(got["score"] - score) < 1e-4 and (abs(score - 0.5) < 1e-4 or got["predicted"] == (score >= 0.5))
        if worst is None:
            assert got["worst_no"] is None and got["worst_sentence"] is None
        else:
            assert abs(got["worst_score"] - worst[1]) < 1e-4
            if got["worst_no"] == worst[0]:
                assert got["worst_sentence"] == worst[2]
    assert {r["worst_no"] for r in rows.values()} > {0}


def test_the_sample_is_bounded_in_bytes(spark, docs, labels):
    few = t.fit_labelled(docs, labels, fit_bytes=1)
    assert few.weights.max() == 0.0  # no text fits, so nothing is learned
    assert t.fit_labelled(docs, labels).weights.max() > 0.0


def test_odd_rows(odd_docs, no_docs, no_labels, labels):
    model = t.fit_labelled(no_docs, labels)
    rows = t.score_documents(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(r["score"] < 0.5 for r in rows)
    assert all(r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert t.score_documents(no_docs, t.fit_labelled(odd_docs, no_labels)).collect() == []
    assert t.Scorer(fitted()).document("nasty fool. " * 50_000) == 1.0
