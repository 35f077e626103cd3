"""Language identification by script ranges and a Viterbi path over the words of each text.

The script of a word's first letter narrows its candidate languages; the letters of the word give each of them a score
(character runs, learned per language). A Viterbi path over the words, which pays for every change of language, labels
spans of mixed text; the language with most letters on the path is the document's. Words end at white space and where the
script changes; those of scripts written without white space are runs of a few letters.

Texts up to ``SEGMENT`` words advance together, a word of each per step. A longer one goes through alone, a segment at a
time with the value of every language carried over; on the way back each segment is gone through again from the values
kept at its start, so what a text of any length takes besides its words is a segment's scores.

Defined cases. A null text, or one without a letter, is ``und`` with score 0. Words without letters continue the span
they stand in. Ties go to the language that sorts first. Repeated rows are labelled alike, each on its own; an empty
table gives an empty result. With nothing to learn from every text is ``und``. Null languages and null ids take no
part in learning. Texts of any length are labelled whole.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.llm.common import bounded_sample, held_out, per_batch
from telltale.sources.tables import table

#: Documents of each language that the scores are fitted on, and bytes of all of them, in expectation; chosen by hash.
#: Longer texts than FIT_TEXT_BYTES are not among them.
FIT_ROWS_PER_LANGUAGE = 1_000
FIT_BYTES, FIT_TEXT_BYTES = 16 << 20, 256 << 10
#: Words of a segment of a long text, and scores that short texts advance with at a time.
SEGMENT, SCORES_AT_ONCE = 1 << 16, 8_000_000
#: Code points of new words that are scored together, for sixteen languages or fewer, and character runs from which on a word
#: is summed up by itself.
POINTS_AT_ONCE, MANY_RUNS = 1 << 16, 512
#: Words whose scores a task remembers before it starts over; to score one again costs less than the memory of more.
KEPT_WORDS = 300_000
#: Letters of a word in a script without white space.
RUN = 6
UNKNOWN = "und"
#: What a change of language between two words costs, in nats.
SWITCH = 12.0
_LETTER = re.compile(r"[^\W\d_]")
_LETTERS = re.compile(r"[^\W\d_]+")

#: Where ranges of scripts begin, by code point, and the script from there on.
SCRIPT_RANGES = (
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "devanagari"),
    (0x0980, "other indic"),
    (0x0E00, "thai"),
    (0x0E80, "other asian"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2C80, "other"),
    (0x3040, "kana"),
    (0x3100, "other asian"),
    (0x3400, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "latin"),
    (0xFB1D, "hebrew"),
    (0xFB50, "arabic"),
    (0xFF00, "latin"),
    (0xFF66, "kana"),
    (0xFFA0, "other"),
    (0x20000, "han"),
)
_STARTS = [start for start, _ in SCRIPT_RANGES]


UNSPACED = frozenset(["han", "kana", "thai"])


def _pieces_pattern() -> re.Pattern:
    """One alternative for each script: all it has in a row, or a few letters."""
    ranges: dict[str, str] = {}
    for (start, script), after in zip(SCRIPT_RANGES, [*_STARTS[1:], 0x110000], strict=True):
        ranges[script] = ranges.get(script, "") + f"{re.escape(chr(start))}-{re.escape(chr(after - 1))}"
    return re.compile("|".join(f"(?:(?!\\s)[{r}]){f'{{1,{RUN}}}' if s in UNSPACED else '+'}" for s, r in ranges.items()))


_PIECES = _pieces_pattern()
_BEYOND_LATIN = re.compile("[^\x00-\u036f]")


def words_of(text: str) -> list[str]:
    return _PIECES.findall(text) if _BEYOND_LATIN.search(text) else text.split()


def script_of(letter: str) -> str:
    return SCRIPT_RANGES[bisect_right(_STARTS, ord(letter)) - 1][1]


def word_grams(word: str) -> list[str]:
    """The runs of one to four characters of the lower-cased letters, ends marked."""
    grams: list[str] = []
    for letters in _LETTERS.findall(word.lower()):
        marked = f"^{letters}$"
        grams += [marked[i : i + n] for n in (1, 2, 3, 4) for i in range(len(marked) - n + 1)]
    return grams


@dataclass
class LanguageModel:
    languages: list[str]
    #: The character runs met in learning, and for each its log probability by language, less the mean over them.
    runs: dict[str, int]
    weights: np.ndarray
    #: For each script the languages that are written in it.
    scripts: dict[str, list[bool]]
    _words: WordTable | None = None

    def words(self) -> WordTable:
        """The table of words scored so far. A worker process keeps the model, and with it the table, over its tasks."""
        if self._words is None:
            self._words = WordTable(self)
        return self._words

    def word_scores(self, word: str) -> tuple[np.ndarray, int]:
        """A score for each language, and how many letters the word has."""
        n = len(_LETTER.findall(word))
        if not n or not self.languages:
            return np.zeros(len(self.languages), np.float32), n
        at = self.runs.get
        known = [i for g in word_grams(word) if (i := at(g)) is not None]
        score = self.weights[known].sum(0) / 4.0  # every letter is in about four runs
        narrowed = self.scripts.get(script_of(_LETTER.search(word).group()))
        if narrowed is not None and any(narrowed) and not all(narrowed):
            score = np.where(narrowed, score, score.min() - SWITCH)
        return (score - score.max()).astype(np.float32), n


def fit(texts: list[str], langs: list[str], least_share: float = 0.005) -> LanguageModel:
    """Counts of character runs per language, smoothed; a language uses a script if ``least_share`` of its letters do."""
    languages = sorted(set(langs))
    at = {name: i for i, name in enumerate(languages)}
    words: list[dict[str, int]] = [{} for _ in languages]
    for text, lang in zip(texts, langs, strict=True):
        seen = words[at[lang]]
        for w in words_of(text):
            seen[w] = seen.get(w, 0) + 1
    runs: dict[str, int] = {}
    letters: dict[str, np.ndarray] = {}
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i, seen in enumerate(words):
        grams, times = array("i"), array("i")
        for w, n in seen.items():
            ids = [runs.setdefault(g, len(runs)) for g in word_grams(w)]
            grams.extend(ids)
            times.extend([n] * len(ids))
            if first := _LETTER.search(w):
                letters.setdefault(script_of(first.group()), np.zeros(len(languages)))[i] += n
        found.append((np.array(grams, np.int64), np.array(times, float)))
    weights = np.zeros((len(runs), len(languages)), np.float32)
    if languages:
        counts = np.stack([np.bincount(g, t, len(runs)) for g, t in found], axis=1)
        share = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * len(runs)))
        weights = (share - share.mean(1, keepdims=True)).astype(np.float32)
    total = sum(letters.values()) if letters else np.ones(len(languages))
    scripts = {s: [bool(x) for x in n >= least_share * np.maximum(total, 1)] for s, n in letters.items()}
    return LanguageModel(languages, runs, weights, scripts)


def fit_known(docs: DataFrame, per_language: int = FIT_ROWS_PER_LANGUAGE, most_bytes: int = FIT_BYTES) -> LanguageModel:
    """Fit on documents with a language outside the held-out fold, chosen by hash: about ``per_language`` of each and
    about ``most_bytes`` of text, shared among the languages."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.withColumn("_size", F.octet_length("text")).where(F.col("_size") <= FIT_TEXT_BYTES)
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("size")).collect()  # a row per language
    if not counts:
        return fit([], [])
    chosen = F.lit(False)
    for r in sorted(counts, key=lambda r: r["lang"]):
        share = min(per_language / r["n"], most_bytes / len(counts) / max(r["size"], 1))
        chosen = F.when(F.col("lang") == r["lang"], F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).otherwise(chosen)
    rows = bounded_sample(known.where(chosen).select("doc_id", "text", "lang"), "doc_id", 2 * per_language * len(counts)).toArrow()
    return fit(rows.column(1).to_pylist(), rows.column(2).to_pylist())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class WordScorer:
    """``LanguageModel.word_scores`` for many words at once, equal to the last bit.

    The words are laid end to end. A character run is found by the run without its last character, which was met in learning
    as well, and that character: a search in one sorted column of such pairs for each length. A word's weights are added in
    the order of ``word_grams``, those of all words side by side.
    """

    def __init__(self, model: LanguageModel):
        runs, k = model.runs, len(model.languages)
        self.weights, self.n_runs = model.weights, len(runs)
        self.most_points = max(1_024, POINTS_AT_ONCE * 16 // max(16, k))
        ids = np.fromiter(runs.values(), np.int32, len(runs))
        lasts = _points("".join(g[-1] for g in runs))
        single = np.fromiter((len(g) == 1 for g in runs), bool, len(runs))
        #: By code point: the run that is this character alone, and whether it is a letter (0: not looked at yet, 1: no).
        self.alone = np.full(0x110000, -1, np.int32)
        self.alone[lasts[single]] = ids[single]
        self.kinds = np.zeros(0x110000, np.uint8)
        shorter = np.fromiter((runs[g[:-1]] for g in runs if len(g) > 1), np.int64, int((~single).sum()))
        pairs = shorter * self.n_runs + self.alone[lasts[~single]]
        order = np.argsort(pairs)
        self.pairs = np.append(pairs[order], np.iinfo(np.int64).max)
        self.longer = np.append(ids[~single][order], np.int32(-1))
        #: The languages that each script range leaves a word; all, if the script says nothing.
        self.left = np.ones((len(SCRIPT_RANGES), k), bool)
        for i, (_, script) in enumerate(SCRIPT_RANGES):
            if any(model.scripts.get(script, ())):
                self.left[i] = model.scripts[script]

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of scores, and the number of letters, for each of the words; none of them has a line end."""
        points = _points("\n".join(words))
        places = np.flatnonzero(self._letters(points))
        word = np.cumsum(points == 10)[places]
        letters = np.bincount(word, minlength=len(words)).astype(np.int32)
        if not self.left.shape[1]:
            return np.zeros((len(words), 0), np.float32), letters
        score = self._sums(*self._known_runs(words), len(words)) / np.float32(4.0)  # every letter is in about four runs
        score[letters == 0] = 0
        some = word[firsts := np.flatnonzero(np.diff(word, prepend=-1))]
        left = self.left[np.searchsorted(_STARTS, points[places[firsts]], side="right") - 1]
        least = score[some].min(1, keepdims=True) - np.float32(SWITCH)
        score[some] = np.where(left, score[some], least)
        return score - score.max(1, keepdims=True), letters

    def _letters(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds[points]
        if not kinds.all():
            for c in np.unique(points[kinds == 0]).tolist():
                self.kinds[c] = 2 if _LETTER.match(chr(c)) else 1
            kinds = self.kinds[points]
        return kinds == 2

    def _known_runs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The runs of all words that were met in learning, in the order of ``word_grams``, and the word of each."""
        points = _points("\n".join(words).lower())  # a line end is for lower-casing what the end of a text is
        places = np.flatnonzero(self._letters(points))
        part = np.cumsum(np.diff(places, prepend=-2) > 1) - 1  # letters in a row
        word = np.cumsum(points == 10)[places[np.flatnonzero(np.diff(part, prepend=-1))]]
        size = np.bincount(part) + 2  # with the marks of both ends
        begin = np.cumsum(size) - size
        alone = np.full(int(size.sum()), self.alone[ord("^")], np.int32)
        alone[np.arange(len(places)) + 2 * part + 1] = self.alone[points[places]]
        alone[begin + size - 1] = self.alone[ord("$")]
        part = np.repeat(np.arange(len(size)), size)
        count = 4 * size - 6  # size, size - 1, size - 2 and size - 3 runs of one to four characters
        to = np.cumsum(count) - count - begin
        runs = np.full(int(count.sum()), -1, np.int32)
        found = alone
        for n in (1, 2, 3, 4):
            if n > 1:
                found = self._longer(found[:-1], alone[n - 1 :])
            at = np.flatnonzero(found >= 0)
            runs[at + to[part[at]]] = found[at]
            to += size - n + 1
        met = runs >= 0
        return runs[met], np.repeat(word, count)[met]

    def _longer(self, runs: np.ndarray, lasts: np.ndarray) -> np.ndarray:
        """The runs that are one character longer, or -1. None goes beyond a mark, as no run met in learning does."""
        out = np.full(len(runs), -1, np.int32)
        at = np.flatnonzero((runs >= 0) & (lasts >= 0))
        pairs = runs[at].astype(np.int64) * self.n_runs + lasts[at]
        place = np.searchsorted(self.pairs, pairs)
        out[at] = np.where(self.pairs[place] == pairs, self.longer[place], -1)
        return out

    def _sums(self, runs: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """The sum of the weights of each word's runs: the next run of every word per step, words with many runs by themselves."""
        count = np.bincount(word, minlength=n)
        order = np.argsort(-count, kind="stable")
        begin, count = (np.cumsum(count) - count)[order], count[order]
        total = np.zeros((n, self.weights.shape[1]), np.float32)
        steps = min(int(count[0]), MANY_RUNS) if n else 0
        active = np.searchsorted(-count, -np.arange(steps), side="left")  # words with more runs than each step
        for step, some in enumerate(active.tolist()):
            total[:some] += self.weights[runs[begin[:some] + step]]
        for i in range(int(np.searchsorted(-count, -MANY_RUNS, side="left"))):
            for at in range(int(begin[i]) + MANY_RUNS, int(begin[i] + count[i]), self.most_points):
                rows = self.weights[runs[at : min(at + self.most_points, int(begin[i] + count[i]))]]
                total[i] = np.concatenate([total[i][None], rows]).sum(0)
        out = np.empty_like(total)
        out[order] = total
        return out


class _Numbers(dict):
    """Numbers words in the order in which they are first met, and keeps those not scored yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class WordTable:
    """Scores of the words met so far, a row each; starts over beyond KEPT_WORDS.

    It does not hold the model, which holds it: both go as soon as a worker process lets go of the model.
    """

    def __init__(self, model: LanguageModel):
        self.languages = model.languages
        self._scorer = WordScorer(model)
        self._clear()

    def _clear(self) -> None:
        self.known = _Numbers()
        self.scores = np.zeros((1024, len(self.languages)), np.float32)
        self.letters = np.zeros(1024, np.int32)

    def ids(self, words: list[str]) -> np.ndarray:
        return self.ids_of([words])[0]

    def ids_of(self, texts: Iterable[list[str]]) -> list[np.ndarray]:
        """The rows of the words of each text. What is new in all of them is scored together, a bounded piece at a time."""
        number = self.known.__getitem__
        ids = [np.fromiter(map(number, words), np.int32, len(words)) for words in texts]
        new, self.known.new = self.known.new, []
        begin = len(self.known) - len(new)
        while len(self.letters) < len(self.known):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        pieces = np.cumsum([len(w) + 1 for w in new]) // self._scorer.most_points
        for some in np.split(np.arange(len(new)), np.flatnonzero(np.diff(pieces)) + 1):
            if len(some):
                rows = slice(begin + int(some[0]), begin + int(some[-1]) + 1)
                self.scores[rows], self.letters[rows] = self._scorer(new[some[0] : some[-1] + 1])
        return ids

    def start(self) -> None:
        """Call before a batch: ids stay valid within one."""
        if len(self.known) > KEPT_WORDS:
            self._clear()


def best_paths(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """For documents laid end to end, the best language of every word.

    ``scores`` has a row per word. All documents advance by one word per step, the longest first, so a step is a few
    array operations over those that are not at their end.
    """
    kind = np.int16 if scores.shape[1] < 1 << 15 else np.int32
    out = np.zeros(len(scores), kind)
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(order, lengths[np.arange(len(order))], len(order)).astype(np.int64))])[:-1]
    starts = starts[order]
    steps = int(lengths[0]) if len(lengths) else 0
    if not steps or not scores.shape[1]:
        return out
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # documents longer than each step
    value = scores[starts[: active[0]]].astype(np.float64)
    tops: list[np.ndarray] = [value.argmax(1).astype(kind)]
    moved: list[np.ndarray] = [np.zeros(value.shape, bool)]
    final = np.zeros((len(lengths), scores.shape[1]))
    for t in range(1, steps):
        n = active[t]
        if n < len(value):
            final[n : len(value)] = value[n:]
            value, top = value[:n], tops[-1][:n]
        else:
            top = tops[-1]
        jump = value[np.arange(n), top][:, None] - switch
        changed = value < jump
        value = np.where(changed, jump, value) + scores[starts[:n] + t]
        value -= value.max(1, keepdims=True)
        moved.append(changed)
        tops.append(value.argmax(1).astype(kind))
    final[: len(value)] = value
    state = final.argmax(1).astype(kind)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        here = state[:n]
        out[starts[:n] + t] = here
        if t:
            came = moved[t][np.arange(n), here]
            state[:n] = np.where(came, tops[t - 1][:n], here)
    return out


def _advance(value: np.ndarray, scores: np.ndarray, switch: float, steps: list | None = None) -> np.ndarray:
    """The values after the words of ``scores``; ``steps`` gets for each word the best language before it and which
    languages were reached from there."""
    for row in scores:
        top = int(value.argmax())
        jump = value[top] - switch
        changed = value < jump
        if steps is not None:
            steps.append((top, changed))
        value = np.where(changed, jump, value) + row
        value -= value.max()
    return value


def long_path(table_: WordTable, ids: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of every word of one text, a segment at a time."""
    k = table_.scores.shape[1]
    out = np.zeros(len(ids), np.int32)
    if not k or not len(ids):
        return out
    # before the first word a change costs nothing that matters: all languages stand alike
    value, at_start = np.zeros(k), []
    for begin in range(0, len(ids), SEGMENT):
        at_start.append(value)
        value = _advance(value, table_.scores[ids[begin : begin + SEGMENT]], switch)
    state = int(value.argmax())
    for number in range(len(at_start) - 1, -1, -1):
        begin = number * SEGMENT
        part = ids[begin : begin + SEGMENT]
        steps: list[tuple[int, np.ndarray]] = []
        _advance(at_start[number], table_.scores[part], switch, steps)
        for t in range(len(part) - 1, -1, -1):
            out[begin + t] = state
            top, changed = steps[t]
            state = top if changed[state] else state
    return out


def paths_of(table_: WordTable, ids: list[np.ndarray]) -> list[np.ndarray]:
    """The best path of each text; short ones go together, a bounded number of scores at a time."""
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(ids)
    most = max(SEGMENT, SCORES_AT_ONCE // max(1, table_.scores.shape[1]))
    group: list[int] = []
    held = 0

    def settle() -> None:
        lengths = np.array([len(ids[i]) for i in group], np.int64)
        path = best_paths(table_.scores[np.concatenate([ids[i] for i in group])], lengths)
        for i, part in zip(group, np.split(path, np.cumsum(lengths)[:-1]), strict=True):
            out[i] = part

    for i, own in enumerate(ids):
        if len(own) > SEGMENT:
            out[i] = long_path(table_, own)
            continue
        if group and held + len(own) > most:
            settle()
            group, held = [], 0
        group.append(i)
        held += len(own)
    if group:
        settle()
    return out


def label_batch(table_: WordTable, texts: list[str]) -> tuple[list[str], np.ndarray, list[np.ndarray], list[list[str]]]:
    """``labels_of``, and the words."""
    return *labels_of(table_, texts), [words_of(t) for t in texts]


def labels_of(table_: WordTable, texts: list[str]) -> tuple[list[str], np.ndarray, list[np.ndarray]]:
    """Language and score of each text, and the path over its words, which are held for one text at a time."""
    table_.start()
    names = table_.languages
    ids = table_.ids_of(map(words_of, texts))
    paths = paths_of(table_, ids)
    langs, score = [], np.zeros(len(texts))
    for i, (own, path) in enumerate(zip(ids, paths, strict=True)):
        weight = np.bincount(path, table_.letters[own], max(1, len(names)))
        total, best = weight.sum(), int(weight.argmax())
        known = bool(names) and total > 0
        langs.append(names[best] if known else UNKNOWN)
        score[i] = weight[best] / total if known else 0.0
    return langs, score, paths


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], lang: str = "lang_pred", score: str = "score", spans: str | None = None) -> DataFrame:
    """The columns ``keep`` of every row with its language, the share of its letters that are in it, and, if ``spans`` names
    a column, how many spans of one language it has."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a bounded sample's character runs
    fields = [docs.schema[c] for c in keep]
    at = keep.index("text") if "text" in keep else len(keep)

    def start():
        known = shared.value.words()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            langs, share, paths = labels_of(known, texts)
            out = batch.select(list(range(len(keep)))).append_column(lang, pa.array(langs, pa.string())).append_column(score, pa.array(share))
            if spans is None:
                return out
            changes = [int(np.count_nonzero(np.diff(path))) + 1 if len(path) else 0 for path in paths]
            return out.append_column(spans, pa.array(changes, pa.int32()))

        return step

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    rows = docs.select(*[f"`{c}`" for c in keep], *([] if "text" in keep else ["text"]))
    schema = f"{schema}, {lang} string, {score} double" + (f", {spans} int" if spans else "")
    return per_batch(rows, schema, start, most_bytes=8 << 20)


def language_spans(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per span of words in one language: doc_id, span_no, lang, first_word, n_words (words as ``words_of`` gives them)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def start():
        known = shared.value.words()

        def step(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            _, _, paths = labels_of(known, texts)
            rows: list[tuple] = []
            for i, path in enumerate(paths):
                cuts = np.flatnonzero(np.diff(path)) + 1
                edges = [0, *cuts.tolist(), len(path)] if len(path) else [0]
                for j, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((i, j, shared.value.languages[path[a]] if shared.value.languages else UNKNOWN, a, b - a))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            return {
                "doc_id": batch.column(0).take(pa.array(cols[0], pa.int64())),
                "span_no": pa.array(cols[1], pa.int32()),
                "lang": pa.array(cols[2], pa.string()),
                "first_word": pa.array(cols[3], pa.int32()),
                "n_words": pa.array(cols[4], pa.int32()),
            }

        return step

    schema = f"doc_id {kind}, span_no int, lang string, first_word int, n_words int"
    return per_batch(docs.select("doc_id", "text"), schema, start, most_bytes=8 << 20)


def keep_identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """Documents of a known language that has at least ``least_score`` of their letters; all columns stay as they are."""
    model = fit_known(docs)
    lang, score = "lang_pred", "lang_score"
    while lang in docs.columns or score in docs.columns:
        lang, score = lang + "_", score + "_"
    out = identify(docs, model, docs.columns, lang, score)
    good = (F.col(lang) != UNKNOWN) & (F.col(score) >= least_score)
    return out.where(good).select(*[f"`{c}`" for c in docs.columns])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit_known(docs), ["doc_id"], spans="n_spans")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_spans")
