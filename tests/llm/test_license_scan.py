import random
import re

import pytest

from telltale.llm import license_scan as L

SF = "/root/testdata/sf0.001"
EVERY = [(label, notice) for label, notices in L.NOTICES.items() for notice in notices]


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def least_edits(notice, words):
    """The least edit distance of the notice to any run of words, by the full table."""
    text, far = " " + " ".join(words) + " ", 10**6
    column = list(range(len(notice) + 1))  # a match that begins at this place
    best, now = far, [far] * (len(notice) + 1)
    for at, c in enumerate(text):
        if at and text[at] == " ":
            best = min(best, now[-1])
        begun = column if at and text[at - 1] == " " else [far] * (len(notice) + 1)
        before = [min(a, b) for a, b in zip(now, begun, strict=True)]
        now = [before[0] + 1]
        for i, want in enumerate(notice):
            now.append(min(before[i] + (want != c), before[i + 1] + 1, now[i] + 1))
    return best


def plain_scan(text):
    words, found, base = plain_words(text), [], set()
    for phrase, label in L.PHRASES.items():
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        found += at
        base |= {label} if at else set()
    labels, score = set(base), float(bool(found))
    for label, notice in EVERY:
        edits = least_edits(notice, words) if words else 10**6
        if edits <= L.edits_of(len(notice)):
            labels.add(label)
            score = max(score, 1 - edits / len(notice))
    join = lambda x: ",".join(sorted(x))
    return (len(words), len(found), min(found, default=None), max(found, default=None), join(base), join(labels), score)


def damaged(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(["", "", "x", " ", "é", "q" + text[at], "\n# "]) + text[at + 1 :]
    return text


def made(rng):
    parts = []
    for _ in range(rng.randint(1, 4)):
        parts.append(" ".join(rng.choice(["the", "license", "mit", "public", "general", "of", "Ütopia", "2", "apache"]) for _ in range(rng.randint(0, 6))))
        _, notice = rng.choice(EVERY)
        parts.append(damaged(rng, rng.choice([notice, notice.upper(), notice.replace(" ", "\n * ", 2)]), rng.randint(0, 8)))
    return rng.choice([" ", ". ", ""]).join(parts)


def test_against_edit_distances():
    rng, scanner = random.Random(1), L.Scanner(L.NOTICES, L.PHRASES)
    for text in [made(rng) for _ in range(120)] + ["", " ", "mit license mit license", "mit mit license", "license " * 40, "the mit licence"]:
        got = scanner.scan(text.encode())
        assert tuple(got.values())[:7] == plain_scan(text), text
        for span in got["spans"]:
            inside = plain_words(text[span["begin"] : span["end"]])
            assert least_edits(span["notice"], inside) == span["edits"] <= L.edits_of(len(span["notice"]))


def test_query_against_plain_search(spark, texts):
    for r in L.op13(spark, SF).collect():
        text = texts[r["doc_id"]]
        want = plain_scan(text) if len(text) < 1_500 or "licen" in text.lower() and len(text) < 6_000 else None
        assert r["n_words"] == len(plain_words(text))
        if want:
            assert tuple(r)[1:8] == want


def test_every_place_has_a_span():
    scanner = L.Scanner(L.NOTICES, L.PHRASES)
    notice = "released under the mit license"
    text = "\n".join(["Released under the MIT License.", "// Relaesed under the MIT-Licence!"] * 30)
    spans = [s for s in scanner.scan(text.encode())["spans"] if s["notice"] == notice]
    assert [s["edits"] for s in spans] == [0, 3] * 30
    assert {text[s["begin"] : s["end"]] for s in spans} == {"Released under the MIT License", "Relaesed under the MIT-Licence"}


def test_pieces_cover_a_notice():
    for _, notice in EVERY:
        pieces = L.pieces_of(notice)
        assert "".join(p for _, p in pieces) == notice and len(pieces) == L.edits_of(len(notice)) + 1
        assert all(notice[a:].startswith(p) and len(p) >= 4 for a, p in pieces)


@pytest.mark.parametrize("notice", ["MIT", "a,b c", "", "abc"])
def test_notices_are_plain_words(notice):
    with pytest.raises(ValueError):
        L.Scanner({"x": [notice]}, {})


def test_odd_rows(odd_docs, no_docs):
    rows = L.license_notices(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r, source in zip(sorted(rows, key=repr), sorted(rows, key=repr), strict=True):
        assert r == source
    empty = [r for r in rows if r["doc_id"] in (1, 2, 3)]
    assert all(tuple(r)[1:8] == (0, 0, None, None, "", "", 0.0) for r in empty)
    assert L.license_notices(no_docs).collect() == []
    assert all(r["n_base"] == 0 for r in L.license_notices(odd_docs, {}, {}).collect())
