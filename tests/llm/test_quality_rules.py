import zlib

import numpy as np
import pytest

from telltale.llm import quality_rules as q


def plain_counts(text):
    """The base columns, word by word."""
    spaces = " \t\n\x0b\x0c\r"
    split = lambda s: [w for w in "".join("\n" if c in spaces else c for c in s).split("\n") if w]
    words = split(text or "")
    covered = set()
    for i in range(len(words) - 2):
        if any(words[i : i + 3] == words[j : j + 3] for j in range(len(words) - 2) if j != i):
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    n_symbols = sum(c in "#*$%&|<>" for c in text or "") if words else 0
    return len(words), sum(map(len, words)), n_symbols, dup, len(covered)


@pytest.mark.parametrize(
    "text",
    [
        None,
        "",
        " \n ",
        "a b c a b c a b c",
        "a a a a a",
        "x y\nx y\n \n \nx y \né\x85é & <b>",
        "one two three four one two three five\r\none two",
        "a b c d b c d e",
    ],
)
def test_base_counts(text):
    assert q.count_text((text or "").encode())[:5] == plain_counts(text)


def test_base_counts_of_documents(texts):
    for text in list(texts.values())[:40]:
        if len(text) < 3_000:
            assert q.count_text(text.encode())[:5] == plain_counts(text)


def holds(rule, counts):
    c = dict(zip(q.COUNTS + q.MORE_COUNTS, map(float, counts), strict=True))
    x = {
        "n_words": c["n_words"],
        "word_length": c["word_chars"] / c["n_words"],
        "symbol_rate": c["n_symbols"] / c["n_words"],
        "dup_line_share": c["n_dup_lines"] / c["n_lines"],
        "repeat_share": c["n_repeat_words"] / c["n_words"],
        "distinct_share": c["n_distinct_words"] / c["n_words"],
        "upper_share": c["n_upper"] / max(c["n_letters"], 1),
        "letter_share": c["n_letters"] / c["word_chars"],
        "digit_share": c["n_digits"] / c["word_chars"],
        "mark_rate": c["n_marks"] / c["n_words"],
    }
    return all(x[k.feature] >= k.value if k.above else x[k.feature] <= k.value for k in rule)


def plain_verdict(rules, text):
    counts = q.count_text((text or "").encode())
    n, repeat = counts[0], counts[4]
    base = n < 50 or 100 * repeat > 50 * n
    return base, not base and not any(holds(r, counts) for r in rules)


RULES = [
    (q.Condition("symbol_rate", True, 0.15),),
    (q.Condition("distinct_share", False, 0.5), q.Condition("n_words", False, 4000.0)),
]


def test_verdicts_follow_the_rules(spark, docs, labels, texts, monkeypatch):
    monkeypatch.setattr(q, "fit_rules", lambda *a: RULES)
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in q.quality_rules(docs, labels).collect()}
    assert got == {i: plain_verdict(RULES, t) for i, t in texts.items()}
    kept = {r["doc_id"] for r in q.keep_good(docs, labels).collect()}
    assert kept == {i for i, (_, k) in got.items() if k}


def test_rules_are_learned():
    rng = np.random.default_rng(1)
    x = rng.random((3_000, len(q.FEATURES)))
    y = (x[:, 2] > 0.8) | ((x[:, 6] > 0.7) & (x[:, 0] < 0.4))
    rules = q.learn_rules(x, y)
    got = np.zeros(len(y), bool)
    for rule in rules:
        got |= np.all([c.holds(x) for c in rule], axis=0)
    assert (got == y).mean() > 0.98
    assert q.learn_rules(x, np.zeros(len(y), bool)) == [] == q.learn_rules(x[:0], y[:0])
    ties = np.zeros((60, len(q.FEATURES)))
    assert q.learn_rules(ties, np.arange(60) % 2 == 0) == []


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.1"
    out = q.op1(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("quality IS NOT NULL").collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    bad = [r for r in held if r["quality"] == 0]
    good = [r for r in held if r["quality"] == 1 and not r["base_failed"]]
    assert sum(not r["kept"] for r in bad) > 0.9 * len(bad)
    assert sum(r["kept"] for r in good) > 0.98 * len(good)


def test_odd_rows(odd_docs, no_docs, labels, no_labels):
    out = q.quality_rules(odd_docs, no_labels)
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    assert all(r["n_words"] == 0 and r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert q.quality_rules(no_docs, labels).collect() == []
    kept = q.keep_good(odd_docs, no_labels)
    assert kept.columns == odd_docs.columns and kept.schema == odd_docs.schema
    assert q.keep_good(no_docs, no_labels).collect() == []
