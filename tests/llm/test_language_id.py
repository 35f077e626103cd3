import gc
import itertools
import random
import time
import tracemalloc
import weakref
import zlib

import numpy as np

from telltale.llm import language_id as g


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    rows = g.op9(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.98 * len(held)


def test_paths_equal_trying_all():
    rng = np.random.default_rng(1)
    for _ in range(40):
        lengths = rng.integers(0, 6, 5)
        scores = -rng.random((int(lengths.sum()), 3)).astype(np.float32) * 4
        path = g.best_paths(scores, lengths, 1.5)
        at = 0
        for n in lengths:
            part = scores[at : at + n].astype(float)
            value = lambda p, part=part: sum(part[i, x] for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:], strict=False))
            if n:
                best = max(value(p) for p in itertools.product(range(3), repeat=int(n)))
                assert abs(value(path[at : at + n].tolist()) - best) < 1e-4
            at += n


def plain_label(model, text):
    """By definition: the values of all paths word by word, with whole paths; the language with most letters."""
    words = text.split()
    scored = [model.word_scores(w) for w in words]
    if not sum(n for _, n in scored):
        return "und", 0.0
    k = len(model.languages)
    best = [(0.0, ())] * k
    for score, _ in scored:
        top = max(range(k), key=lambda i: best[i][0])
        jump = best[top][0] - g.SWITCH
        best = [((jump, best[top][1]) if v < jump else (v, p)) for v, p in best]
        best = [(v + float(score[i]), (*p, i)) for i, (v, p) in enumerate(best)]
    path = max(best, key=lambda b: b[0])[1]
    letters = [sum(n for (_, n), x in zip(scored, path, strict=True) if x == i) for i in range(k)]
    top = max(range(k), key=lambda i: letters[i])
    return model.languages[top], letters[top] / sum(letters)


def test_query_against_all_values(spark, docs):
    """Every short text of the table by plain values over the same model."""
    model = g.fit_known(docs)
    rows = {r["doc_id"]: r for r in g.op9(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == docs.count()
    for r in docs.collect():
        if len(r["text"]) < 4_000:
            lang, score = plain_label(model, r["text"])
            got = rows[r["doc_id"]]
            assert got["lang_pred"] == lang and abs(got["score"] - score) < 1e-9 and got["n_spans"] >= 1


def test_three_hundred_languages():
    names = [f"l{i:03d}" for i in range(300)]
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{x}" for x in "abcdefgh") for i in range(300)]
    table = g.fit(texts, names).words()
    langs, scores, _, _ = g.label_batch(table, texts)
    assert langs == names and scores.min() == 1.0


def test_long_texts_go_through_in_segments(monkeypatch):
    rng = np.random.default_rng(2)
    model = small_model()
    words = [w for v in (["the", "cat", "went"], ["der", "hund", "sind"], ["собака", "12"]) for w in rng.choice(v, 700)]
    table = model.words()
    ids = table.ids([*words, *reversed(words)])
    whole = g.best_paths(table.scores[ids], np.array([len(ids)]))
    for size in (1, 7, 64, 5_000):
        monkeypatch.setattr(g, "SEGMENT", size)
        assert g.long_path(table, ids).tolist() == whole.tolist()


def test_a_very_long_text_stays_small():
    text = "the cat went " * 300_000
    model = small_model()
    g.label_batch(model.words(), ["the"])
    tracemalloc.start()
    langs, scores, _, _ = g.label_batch(model.words(), [text])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert langs == ["en"] and scores[0] == 1.0 and most < 120 << 20


def test_words_end_where_the_script_changes():
    assert g.words_of("漢字かなкошка abc, déjà") == ["漢字", "かな", "кошка", "abc,", "déjà"]
    zh, ja = "这个东西我们已经看过了没有问题" * 4, "これはとても大切なことですから" * 4
    model = g.fit([zh, ja] * 3, ["zh", "ja"] * 3)
    langs, scores, paths, words = g.label_batch(model.words(), [zh + ja])
    assert len(set(paths[0].tolist())) == 2 and 0.4 < scores[0] < 0.6


def small_model():
    en = "the cat and the dog went with this thing to the other house where they thought that it was right"
    de = "der hund und die katze sind nicht mit dem anderen haus wo sie dachten dass es richtig war über schön"
    ru = "кошка и собака пошли вместе домой где они думали что это было правильно"
    return g.fit([en, de, ru] * 3, ["en", "de", "ru"] * 3)


def test_new_words_are_scored_together_as_each_by_itself(monkeypatch):
    rng = random.Random(3)
    letters = "aàßéÉzİΣσςαжЖ漢字かน가ǅⅣⒶ½١27'._-^$🙂𐐀"
    odd = ["".join(rng.choices(letters, k=rng.choice([1, 2, 5, 9, 700]))) for _ in range(400)]
    odd += ["ΑΣ", "ΑΣ.", "İ", "^a$", "12", "don't", "thé" * 2_000]
    for k in (1, 2, 3, 40):
        model = g.fit([" ".join(rng.choices(odd, k=40)) for _ in range(2 * k)], [f"l{i % k}" for i in range(2 * k)])
        each = [model.word_scores(w) for w in odd]
        for points, many in ((1, 7), (1 << 16, 512)):
            monkeypatch.setattr(g, "POINTS_AT_ONCE", points)
            monkeypatch.setattr(g, "MANY_RUNS", many)
            table = g.WordTable(model)
            ids = table.ids(odd)
            assert all(np.array_equal(table.scores[i], score) and table.letters[i] == n for i, (score, n) in zip(ids, each, strict=True))


def test_many_new_words_take_less_time_than_one_by_one():
    rng = random.Random(4)
    words = list({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(40_000)})
    model = g.fit([" ".join(words[:5_000])] * 2, ["en", "de"])
    table = model.words()
    began = time.process_time()
    for w in words:
        model.word_scores(w)
    one_by_one, began = time.process_time() - began, time.process_time()
    table.ids(words)
    assert time.process_time() - began < one_by_one / 2


def test_words_go_with_their_model():
    model = small_model()
    g.label_batch(model.words(), ["the cat"])
    gone = weakref.ref(model.words())
    gc.disable()
    try:
        del model
        assert gone() is None
    finally:
        gc.enable()


def test_words_of_a_batch_are_not_held():
    texts = ["the cat went with " * 250] * 1_000
    table = small_model().words()
    tracemalloc.start()
    langs, _, _ = g.labels_of(table, texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert langs == ["en"] * 1_000 and most < 40 << 20  # the words alone take 50


def test_spans_and_scripts(spark):
    text = "the cat and the other thing went with this dog " * 3 + "der hund und die katze sind nicht mit dem haus " * 3 + "кошка и собака 12 !"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = g.language_spans(df, small_model()).orderBy("span_no").collect()
    assert [(r["lang"], r["n_words"]) for r in rows] == [("en", 30), ("de", 30), ("ru", 5)]
    assert g.script_of("я") == "cyrillic" and g.script_of("漢") == "han" and g.script_of("é") == "latin"
    assert small_model().word_scores("собака")[0].argmax() == 2 and small_model().word_scores("123")[1] == 0


def test_odd_rows(odd_docs, no_docs):
    rows = g.identify(odd_docs.select("doc_id", "text"), small_model(), ["doc_id"]).collect()
    assert len(rows) == odd_docs.count()
    assert {(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] in (1, 2, 3, 8)} == {("und", 0.0)}
    nothing = g.identify(odd_docs, g.fit_known(no_docs), odd_docs.columns, "p", "s").collect()
    assert {r["p"] for r in nothing} == {"und"}
    kept = g.keep_identified(odd_docs)
    assert kept.schema == odd_docs.schema and not {1, 2, 3, 8} & {r["doc_id"] for r in kept.collect()}
    assert g.keep_identified(no_docs).collect() == []
