"""Phrase collocations: the phrases of two to four words whose words belong together most, per language.

A phrase of a occurrences scores floor(2000000 a / (l + r)) at its worst cut into parts of l and r occurrences. Phrases are
grown word by word, best first. A phrase that begins with the prefix q, found f(q) times, and with the word w has a <= f(q),
and its cut after w has r >= a; so it scores floor(2000000 f(q) / (f(w) + f(q))) at most, and a longer prefix never has a
higher bound (branch and bound). One round:

1. Single words and pairs are counted, pairs only of words that are frequent themselves.
2. The score of each language's pair at some rank is the round's threshold. Triples are counted whose prefix has a bound
   of the threshold or more, and those that hold a pair with such a score, as they decide whether the pair survives.
3. So are phrases of four words, and triples that their cuts need.
4. Every phrase that scores the threshold or more is now known, and so is whether it survives: a longer phrase with 0.8 of
   its occurrences holds one that is longer by a single word with as many. Where at least ``top`` survive, the language is
   settled, ties included; for the others the threshold falls to the pair of a far lower rank, at last to zero, and a
   further round expands the rest of the frontier.

Each count is one pass over the whole texts and one aggregation, with partial sums before the shuffle. What the passes
have to count is told to them in bit filters of FILTER_BITS bits over hashed phrases, whatever the input; a false hit is
only counted without need. Thresholds stay a table with a row per language, and a language's ranks come from a histogram
of scores, of a million rows at most.

Defined cases. A null or empty text has no words; a null language is ``und`` and one with rows called so. Pieces end at the
text's end. Repeated rows count each time. Texts of any length count whole. Scores and comparisons are in decimals of 38
digits. Only text and language are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telltale.llm.common import bit_filter, halved, has_bit, mixed, per_batch, raw_texts
from telltale.session import cut
from telltale.sources.tables import table

#: Occurrences that make a phrase a candidate, phrases returned per language.
LEAST, TOP = 30, 2_000
#: Per cent of a phrase's occurrences that a longer phrase must have to replace it.
COVERED = 80
SCALE = 2_000_000
#: Ranks among the pairs whose score is the threshold of the rounds, as multiples of the number returned.
RANKS = (2, 16)
FILTER_BITS = 1 << 25
#: Bytes of text that a task counts at a time, and rows of a batch that it gives out.
BATCH_BYTES, OUT_ROWS = 6 << 20, 1 << 16
#: A-Z to a-z; what ends a piece to a line feed; tabs to spaces.
_EVEN = bytes(c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


class Words:
    """The words of one language's texts: a number for each, -1 where a piece ends, and what the numbers mean."""

    def __init__(self, lang: str, texts: list[bytes]):
        even = b"\n".join(texts).translate(_EVEN).replace(b"\n", b" \n ")
        found = pc.split_pattern(pa.array([even], pa.large_string()), " ").flatten().dictionary_encode()
        codes, words = found.indices.to_numpy(), found.dictionary
        empty, ends = pc.index(words, "").as_py(), pc.index(words, "\n").as_py()
        codes = codes[codes != empty] if empty >= 0 else codes
        self.codes = np.where(codes == ends, -1, codes).astype(np.int64)
        self.words = words
        self._lang = lang
        self._hashes: np.ndarray | None = None

    def hashes(self) -> np.ndarray:
        """By place; where a piece ends, that of the last word, which no one asks for."""
        if self._hashes is None:
            by_number = word_hashes(self._lang, self.words.to_pylist())
            self._hashes = by_number[self.codes]
        return self._hashes

    def runs(self, width: int) -> list[slice]:
        n = max(len(self.codes) - width + 1, 0)
        return [slice(i, i + n) for i in range(width)]

    def within(self, width: int) -> np.ndarray:
        """Places where a run of so many words lies in one piece."""
        return np.logical_and.reduce([self.codes[s] >= 0 for s in self.runs(width)])

    def grams(self, width: int) -> np.ndarray:
        return gram_hashes([self.hashes()[s] for s in self.runs(width)])

    def counts(self, width: int, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The distinct runs at the places chosen, as phrases, and how often they stand there."""
        columns = [self.codes[s][at] for s in self.runs(width)]
        key = columns[0]
        for column in columns[1:]:
            key = np.unique(key, return_inverse=True)[1] * len(self.words) + column
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        parts = [self.words.take(pa.array(c[first])) for c in columns]
        return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())), times


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for w in words], np.uint64)


def gram_hashes(words: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(words[0]), len(words), np.uint64)
    for word in words:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + word)
    return out


def places(hashes: np.ndarray) -> np.ndarray:
    """The bit of the filters that stands for each."""
    return (hashes >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


def filter_of(phrases: DataFrame) -> np.ndarray:
    """The bits of (lang, phrase) rows, all of one number of words."""

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            out = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.append(word_hashes(lang, phrase.split(" ")))
            return {"at": pa.array(places(gram_hashes(list(np.array(out).T))), pa.int64())}

        return step

    return bit_filter(per_batch(phrases.select("lang", "phrase"), "at long", start), FILTER_BITS)


Counter = Callable[[Words], Iterator[tuple[pa.Array, np.ndarray]]]


def counted(docs: DataFrame, count: Callable[[], Counter], least: int) -> DataFrame:
    """lang, phrase and how often it occurs, from ``least`` on, of the phrases that ``count`` gives for a batch of words.
    An empty phrase stands for all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = count()
        for whole in batches:
            for batch in halved(whole, 20_000, BATCH_BYTES):
                langs, numbers = np.unique(np.array(["und" if v is None else v for v in batch.column(0).to_pylist()], object), return_inverse=True)
                texts = raw_texts(batch.column(1))
                for number, lang in enumerate(langs):
                    words = Words(lang, [texts[i] for i in np.flatnonzero(numbers == number)])
                    for phrases, times in counts(words):
                        for at in range(0, len(times), OUT_ROWS):
                            part = phrases[at : at + OUT_ROWS].cast(pa.string())
                            columns = [pa.repeat(pa.scalar(lang, pa.string()), len(part)), part, pa.array(times[at : at + OUT_ROWS], pa.int64())]
                            yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f"])

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, phrase string, f long")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    def count():
        def counts(words: Words):
            at = words.within(1)
            yield words.counts(1, at)
            if at.any():
                yield pa.array([""], pa.large_string()), np.array([at.sum()])

        return counts

    # the empty phrase has to stay, however few words a language has
    return counted(docs, count, 1).where((F.col("f") >= least) | (F.col("phrase") == ""))


def pair_counts(docs: DataFrame, words: DataFrame, least: int) -> DataFrame:
    frequent = docs.sparkSession.sparkContext.broadcast(filter_of(words.where("phrase <> ''")))

    def count():
        def counts(words: Words):
            known = has_bit(frequent.value, places(gram_hashes([words.hashes()])))
            known &= words.codes >= 0
            a, b = words.runs(2)
            yield words.counts(2, known[a] & known[b])

        return counts

    return counted(docs, count, least)


def triple_counts(docs: DataFrame, filters: dict[str, np.ndarray], least: int) -> DataFrame:
    """Triples of frequent pairs that begin with an expanded pair or hold one that has to be settled."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def count():
        def counts(words: Words):
            frequent, chosen = chosen_triples(words, shared.value)
            yield words.counts(3, frequent & chosen)

        return counts

    return counted(docs, count, least)


def chosen_triples(words: Words, filters: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """By place: whether both pairs of a triple are frequent, and whether the first count of triples takes it."""
    pairs = places(words.grams(2))
    inside = words.within(2)
    frequent = has_bit(filters["frequent"], pairs) & inside
    settle = has_bit(filters["settle"], pairs) & inside
    expand = has_bit(filters["expand"], pairs) & inside
    return frequent[:-1] & frequent[1:], expand[:-1] | settle[:-1] | settle[1:]


def longest_counts(docs: DataFrame, filters: dict[str, np.ndarray], least: int) -> DataFrame:
    """Phrases of four that begin with an expanded triple or hold one that has to be settled, and the triples that the
    cuts of the former need, unless the first count of triples had them."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def count():
        def counts(words: Words):
            filters = shared.value
            frequent, had = chosen_triples(words, filters)
            wanted = has_bit(filters["needed"], places(words.grams(2)))[:-1]
            yield words.counts(3, frequent & wanted & ~had)
            triples = places(words.grams(3))
            settle = has_bit(filters["settle3"], triples) & frequent
            expand = has_bit(filters["expand3"], triples) & frequent
            yield words.counts(4, frequent[:-1] & frequent[1:] & (expand[:-1] | settle[:-1] | settle[1:]))

        return counts

    return counted(docs, count, least)


def words_in(phrase: str) -> Column:
    return F.length(phrase) - F.length(F.replace(F.col(phrase), F.lit(" "), F.lit(""))) + 1


def share(part: str, whole: str) -> Column:
    """floor(SCALE part / whole) of sums of longs, in decimals."""
    return F.expr(f"(cast({SCALE} as decimal(7,0)) * cast({part} as decimal(20,0))) div cast({whole} as decimal(21,0))")


def scored(phrases: DataFrame, width: int, known: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r and score at the worst cut, of phrases of so many words all of whose parts are known."""
    at = lambda k: F.struct(
        F.lit(k).alias("k"), F.substring_index("phrase", " ", k).alias("left"), F.substring_index("phrase", " ", k - width).alias("right")
    )
    rows = phrases.select("lang", "phrase", F.col("f").alias("a"), F.inline(F.array(*(at(k) for k in range(1, width)))))
    rows = rows.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    rows = rows.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = share("a", "(cast(l as decimal(20,0)) + r)")
    worst = rows.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.count("k").alias("cuts"))
    return worst.where(F.col("cuts") == width - 1).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def expanded(prefixes: DataFrame, words: DataFrame, thresholds: DataFrame) -> DataFrame:
    """lang and phrase of the prefixes whose bound reaches their language's threshold."""
    first = words.select("lang", F.col("phrase").alias("first"), F.col("f").alias("of_first"))
    rows = prefixes.withColumn("first", F.substring_index("phrase", " ", 1)).join(first, ["lang", "first"])
    rows = rows.withColumn("bound", share("f", "(cast(of_first as decimal(20,0)) + f)"))
    return rows.join(thresholds, "lang").where("bound >= threshold").select("lang", "phrase")


def thresholds_at(pairs: DataFrame, langs: DataFrame, rank: int | None) -> DataFrame:
    """lang and the score of its pair at a rank; 0 where it has fewer pairs, or without a rank."""
    if rank is None:
        return langs.withColumn("threshold", F.lit(0).cast("long"))
    scores = pairs.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("lang").orderBy(F.desc("score")))
    at = scores.withColumn("upto", upto).where(F.col("upto") >= rank).groupBy("lang").agg(F.max("score").alias("threshold"))
    return langs.join(at, "lang", "left").select("lang", F.coalesce("threshold", F.lit(0).cast("long")).alias("threshold"))


def survivors(candidates: DataFrame, longer: DataFrame) -> DataFrame:
    """Candidates that no phrase longer by one word covers."""
    parts = longer.select(
        "lang",
        "f",
        F.explode(
            F.array(
                F.expr("substring(phrase, locate(' ', phrase) + 1)"),
                F.expr("substring(phrase, 1, length(phrase) - locate(' ', reverse(phrase)))"),
            )
        ).alias("phrase"),
    )
    most = parts.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    rows = candidates.join(most, ["lang", "phrase"], "left")
    covered = F.expr(f"cast(100 as decimal(3,0)) * cast(most as decimal(20,0)) >= cast({COVERED} as decimal(3,0)) * cast(a as decimal(20,0))")
    return rows.where(~F.coalesce(covered, F.lit(False))).drop("most")


def expand_round(docs: DataFrame, words: DataFrame, pairs: DataFrame, scores: DataFrame, thresholds: DataFrame, least: int) -> DataFrame:
    """The surviving phrases at or above their language's threshold."""

    def above(rows: DataFrame) -> DataFrame:
        return rows.join(thresholds, "lang").where("score >= threshold").drop("threshold")

    filters = {
        "frequent": filter_of(pairs),
        "expand": filter_of(expanded(pairs, words, thresholds)),
        "settle": filter_of(above(scores)),
    }
    triples = cut(triple_counts(docs, filters, least))
    scores3 = cut(scored(triples, 3, words.union(pairs)))
    expand3 = cut(expanded(triples, words, thresholds))
    needed = expand3.select("lang", F.substring_index("phrase", " ", -2).alias("phrase"))
    more = {"settle3": filter_of(above(scores3)), "expand3": filter_of(expand3), "needed": filter_of(needed)}
    found = cut(longest_counts(docs, filters | more, least))
    longest = found.where(words_in("phrase") == 4)
    begun = expand3.withColumnRenamed("phrase", "begun")
    reached = longest.withColumn("begun", F.substring_index("phrase", " ", 3)).join(begun, ["lang", "begun"], "left_semi").drop("begun")
    known = words.union(pairs).union(triples).union(found.where(words_in("phrase") == 3))
    candidates = above(scores).union(above(scores3)).union(above(scored(reached, 4, known)))
    return survivors(candidates, triples.union(longest))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best surviving phrases."""
    words = cut(word_counts(docs, least))
    totals = words.where("phrase = ''").select("lang", F.col("f").alias("n"))
    words = words.where("phrase <> ''")
    pairs = cut(pair_counts(docs, words, least))
    scores = cut(scored(pairs, 2, words))
    todo, best = scores.select("lang").distinct(), None
    for multiple in (*RANKS, None):
        thresholds = cut(thresholds_at(scores, todo, multiple and multiple * top))
        alive = cut(expand_round(docs, words, pairs, scores, thresholds, least))
        numbers = thresholds.join(alive.groupBy("lang").agg(F.count(F.lit(1)).alias("alive")), "lang", "left")
        numbers = cut(numbers.withColumn("settled", (F.col("threshold") == 0) | F.coalesce(F.col("alive") >= top, F.lit(False))))
        kept = alive.join(numbers.where("settled").select("lang"), "lang", "left_semi")
        best = kept if best is None else best.union(kept)
        todo = numbers.where("NOT settled").select("lang")
        if todo.isEmpty():
            break
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ranked = ranked.join(totals, "lang").withColumn("rank", F.col("rank").cast("long"))
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
