"""License scan: exact phrases, and fuzzy search for the wording of short license notices.

A text is taken as its words with single spaces between them, so line breaks, comment marks and punctuation don't matter.
A notice of n characters may differ from the text in ``edits_of(n)`` = k characters. Cut into k + 1 pieces, one piece of it
must stand in the text as it is (pigeonhole); one automaton finds the pieces of all notices in one pass over the whole
text. Where a piece is found, each run of words around it that is long enough goes through the regex library's
bounded-error matching, under rising bounds, which gives its edits. (Whole runs, as a bounded search inside a longer text
was seen to miss some.) So the search is exact: no place within k edits is missed, and texts without a piece cost one pass.

Notices and phrases are a parameter, of a size that fits a task; the scan is one pass without a shuffle.

Defined cases. A null or empty text has no words and no places. Places of a phrase may overlap; spans of one notice don't,
those with the fewest edits go first, then those further left. Repeated rows are scanned alike, each on its own. A text of
any length is scanned whole; windows are bounded by the notice, not by the text. Only id and text are read. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from telltale.llm.common import per_batch
from telltale.sources.tables import table

#: Phrases whose words stand one after the other, and the label each gives.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Wordings of public license notices, as lower-case words, by label.
NOTICES = {
    "agpl": ["gnu affero general public license"],
    "apache": [
        "apache license",
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license",
        "software distributed under the license is distributed on an as is basis",
    ],
    "boost": ["distributed under the boost software license version 1 0"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification",
        "redistributions of source code must retain the above copyright notice",
        "redistributions in binary form must reproduce the above copyright notice",
        "licensed under the bsd license",
    ],
    "cc": ["licensed under cc by", "creative commons attribution", "licensed under a creative commons"],
    "cc0": ["has waived all copyright and related or neighboring rights to this work"],
    "epl": ["eclipse public license"],
    "gpl": [
        "general public license",
        "licensed under the gnu general public license",
        "you can redistribute it and or modify it under the terms of the gnu",
        "as published by the free software foundation either version",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose"],
    "lgpl": ["gnu lesser general public license", "gnu library general public license"],
    "mit": [
        "mit license",
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy",
        "the above copyright notice and this permission notice shall be included in all copies",
    ],
    "mpl": ["subject to the terms of the mozilla public license", "mozilla public license"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "zlib": ["this notice may not be removed or altered from any source distribution"],
}
#: Windows of text whose verdicts a task remembers.
MEMO_WINDOWS = 100_000
_WORD = re.compile(rb"[^ ]+")
_AS_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def edits_of(length: int) -> int:
    """Edits allowed in a notice of so many characters: one in ten, one at least and five at most."""
    return min(5, max(1, length // 10))


def pieces_of(notice: str) -> list[tuple[int, str]]:
    """``edits_of`` + 1 pieces of a notice, as even as can be, with their places."""
    n = edits_of(len(notice)) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, notices: dict[str, list[str]], phrases: dict[str, str]):
        self.notices = [(label, notice) for label in sorted(notices) for notice in notices[label]]
        for _, notice in self.notices:
            if not re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", notice) or len(notice) < 4:
                raise ValueError(f"not a notice of plain words: {notice!r}")
        self.edits = [edits_of(len(notice)) for _, notice in self.notices]
        #: For each notice a pattern for each bound on the edits; the first that matches has as many as its bound.
        self._patterns = [
            [regex.compile(f"(?:{notice}){{e<={bound}}}") for bound in range(k + 1)]
            for (_, notice), k in zip(self.notices, self.edits, strict=True)
        ]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, (_, notice) in enumerate(self.notices):
            for place, piece in pieces_of(notice):
                seeds.setdefault(piece, []).append((number, place))
        self._automaton = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self._automaton.add_word(piece, (len(piece), places))
        if seeds:
            self._automaton.make_automaton()
        self._seeded = bool(seeds)
        self.phrases = [(f" {phrase} ".encode(), label) for phrase, label in phrases.items()]
        self._known: dict[tuple[int, str], list[tuple[int, int, int]]] = {}

    def places(self, plain: bytes) -> tuple[list[int], set[str]]:
        """Where the phrases' words begin, counted in words, and the labels of the phrases found."""
        found, labels = [], set()
        for phrase, label in self.phrases:
            at, counted, words = plain.find(phrase), 0, -1
            while at >= 0:
                words += plain.count(b" ", counted, at + 1)
                counted = at + 1
                found.append(words)
                labels.add(label)
                at = plain.find(phrase, at + 1)
        return found, labels

    def _in_window(self, number: int, window: str) -> list[tuple[int, int, int]]:
        """Begin, end and edits of every run of words in a window that is the notice within its bound."""
        known = self._known.get((number, window))
        if known is not None:
            return known
        out, (bounds, n, k) = [], (self._patterns[number], len(self.notices[number][1]), self.edits[number])
        spaces = [i for i, c in enumerate(window) if c == " "]
        for before in spaces:
            for after in spaces[bisect_left(spaces, before + 1 + n - k) : bisect_right(spaces, before + 1 + n + k)]:
                run = window[before + 1 : after]
                if bounds[-1].fullmatch(run):
                    out.append((before + 1, after, next(e for e, bound in enumerate(bounds) if bound.fullmatch(run))))
        if len(self._known) >= MEMO_WINDOWS:
            self._known.clear()
        self._known[number, window] = out
        return out

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """Number of the notice, begin, end and edits of every match in a text of words between single spaces."""
        if not self._seeded:
            return []
        begins: dict[int, set[int]] = {}
        for last, (size, places) in self._automaton.iter(text):
            for number, place in places:
                begins.setdefault(number, set()).add(last - size + 1 - place)
        out = []
        for number, starts in begins.items():
            n, k, met = len(self.notices[number][1]), self.edits[number], set()
            for low, high in self._runs(sorted(starts), k):
                begin = max(0, low - k - 1)
                window = text[begin : high + n + k + 1]
                met.update((begin + a, begin + b, e) for a, b, e in self._in_window(number, window))
            taken: list[tuple[int, int, int]] = []
            for a, b, e in sorted(met, key=lambda m: (m[2], m[0], m[1])):
                at = bisect_left(taken, (a, b, e))
                if (not at or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                    taken.insert(at, (a, b, e))
            out += [(number, a, b, e) for a, b, e in taken]
        return out

    @staticmethod
    def _runs(starts: list[int], k: int) -> Iterator[tuple[int, int]]:
        """Starts that lie within k of each other are one window."""
        low = high = starts[0]
        for start in starts[1:]:
            if start - low > k:
                yield low, high
                low = start
            high = start
        yield low, high

    def scan(self, text: bytes) -> dict:
        """Columns of one text; spans are in characters of the text as it is."""
        even = text.translate(_AS_WORDS)
        words = even.split()
        plain = b" " + b" ".join(words) + b" "
        found, labels = self.places(plain)
        joined = plain.decode("utf-8", "surrogatepass")
        matches = self.spans(joined) if words else []
        score, spans = float(bool(found)), []
        if matches:
            ends = [m.span() for m in _WORD.finditer(even)]
            in_chars = lambda at: len(text[:at].decode("utf-8", "surrogatepass"))
            for number, a, b, edits in matches:
                label, notice = self.notices[number]
                first, last = joined.count(" ", 0, a) - 1, joined.count(" ", 0, b) - 1
                spans.append(
                    {"label": label, "notice": notice, "begin": in_chars(ends[first][0]), "end": in_chars(ends[last][1]), "edits": edits}
                )
                score = max(score, 1 - edits / len(notice))
        return {
            "n_words": len(words),
            "n_base": len(found),
            "first_word": min(found, default=None),
            "last_word": max(found, default=None),
            "base_labels": ",".join(sorted(labels)),
            "labels": ",".join(sorted(labels | {s["label"] for s in spans})),
            "score": score,
            "spans": spans,
        }


_COLUMNS = {
    "n_words": pa.int64(),
    "n_base": pa.int64(),
    "first_word": pa.int64(),
    "last_word": pa.int64(),
    "base_labels": pa.string(),
    "labels": pa.string(),
    "score": pa.float64(),
    "spans": pa.list_(
        pa.struct([("label", pa.string()), ("notice", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
    ),
}
SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, notice: string, begin: long, end: long, edits: int>>"
)


def license_notices(
    docs: DataFrame,
    notices: dict[str, list[str]] | None = None,
    phrases: dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: its id, the phrases found, the labels, the best similarity as ``score``, and ``spans``: label,
    notice, begin and end in characters, and edits of each fuzzy match."""
    kind = docs.schema[id_col].dataType.simpleString()
    notices, phrases = NOTICES if notices is None else notices, PHRASES if phrases is None else phrases

    def start():
        scan = Scanner(notices, phrases).scan

        def step(batch: pa.RecordBatch) -> dict:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            rows = [scan(t or b"") for t in texts]
            return {id_col: batch.column(0)} | {c: pa.array([r[c] for r in rows], t) for c, t in _COLUMNS.items()}

        return step

    return per_batch(docs.select(id_col, text_col), f"`{id_col}` {kind}, {SCHEMA}", start)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_notices(table(spark, sf_dir, "documents"))
