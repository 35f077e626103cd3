"""Quality rules: text statistics, and an ordered list of threshold rules learned by sequential covering.

``text_statistics`` reduces each whole text to a row of numbers. ``learn_rules`` grows conjunctions of thresholds on a
bounded sample of labelled rows, prunes each on rows it was not grown on, takes out what it covers and goes on with
the rest. ``verdict`` writes the list as one ordered ``CASE WHEN``, so applying it is a plain projection.

Defined cases. A null or empty text, or one without a word, has zero statistics and fails the base rule. Texts of any
length are counted whole. Of rules with equal worth the one grown first goes first. Repeated rows are judged alike, each on
its own. An empty table gives an empty result. Without labels of both kinds no rule is
learned and only the base rule rejects. Nulls in the label columns take no part. Other columns are passed through by
``with_quality``; columns of its own names are replaced by its own.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.llm.common import SAMPLE_ROWS, bounded_sample, held_out, one_per_key, per_batch, raw_texts
from telltale.sources.tables import table

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_COUNTS = ("n_lines", "n_distinct_words", "n_upper", "n_letters", "n_digits", "n_marks")
FEATURES = (
    "n_words",
    "word_length",
    "symbol_rate",
    "dup_line_share",
    "repeat_share",
    "distinct_share",
    "upper_share",
    "letter_share",
    "digit_share",
    "mark_rate",
)
_MARKS = b".,;:!?"
_SPACES = b" \t\n\x0b\x0c\r"


def _byte_set(chars: bytes) -> np.ndarray:
    return np.frombuffer(chars, np.uint8)


def _repeated(words: list[bytes]) -> tuple[int, int]:
    """Words that lie in a three-word window found twice or more, and how many distinct words there are."""
    ids: dict[bytes, int] = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    n, kinds = len(words), len(ids)
    if n < 4 or kinds == n:
        return 0, kinds
    pairs = code[:-1] * kinds + code[1:]
    if kinds > 1_000_000:  # a product of three would not fit 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * kinds + code[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum()), kinds


def count_text(text: bytes) -> tuple[int, ...]:
    """The values of COUNTS and MORE_COUNTS of one text."""
    words = text.split()  # of bytes: at exactly the six ASCII spaces
    if not words:
        return (0,) * (len(COUNTS) + len(MORE_COUNTS))
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    follow = hist[128:192].sum()  # bytes that continue a code point
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeat, kinds = _repeated(words)
    upper, lower = hist[65:91].sum(), hist[97:123].sum()
    return (
        len(words),
        int(len(text) - follow - hist[_byte_set(_SPACES)].sum()),
        int(hist[_byte_set(SYMBOLS)].sum()),
        len(lines) - len(set(lines)),
        repeat,
        len(lines),
        kinds,
        int(upper),
        int(upper + lower + hist[192:256].sum()),
        int(hist[48:58].sum()),
        int(hist[_byte_set(_MARKS)].sum()),
    )


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts per row of ``docs``: its id, COUNTS and MORE_COUNTS."""
    names = COUNTS + MORE_COUNTS

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            rows = np.array([count_text(t) for t in raw_texts(batch.column(1))], np.int64).reshape(-1, len(names))
            return {id_col: batch.column(0)} | {n: pa.array(rows[:, i]) for i, n in enumerate(names)}

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return per_batch(docs.select(id_col, text_col), f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names), start)


def feature_columns(prefix: str = "") -> dict[str, Column]:
    """Rates computed from the counts (fields of a struct, if ``prefix`` names one); texts without words have none."""
    c = {n: F.col(prefix + n).cast("double") for n in COUNTS + MORE_COUNTS}
    return {
        "n_words": c["n_words"],
        "word_length": c["word_chars"] / c["n_words"],
        "symbol_rate": c["n_symbols"] / c["n_words"],
        "dup_line_share": c["n_dup_lines"] / c["n_lines"],
        "repeat_share": c["n_repeat_words"] / c["n_words"],
        "distinct_share": c["n_distinct_words"] / c["n_words"],
        "upper_share": c["n_upper"] / F.greatest(c["n_letters"], F.lit(1.0)),
        "letter_share": c["n_letters"] / c["word_chars"],
        "digit_share": c["n_digits"] / c["word_chars"],
        "mark_rate": c["n_marks"] / c["n_words"],
    }


@dataclass(frozen=True)
class Condition:
    """``feature >= value``, or ``<=``."""

    feature: str
    above: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, FEATURES.index(self.feature)]
        return column >= self.value if self.above else column <= self.value

    def column(self, features: dict[str, Column]) -> Column:
        column = features[self.feature]
        return column >= F.lit(self.value) if self.above else column <= F.lit(self.value)


Rule = tuple[Condition, ...]


def _covers(rule: Iterable[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for condition in rule:
        out &= condition.holds(x)
    return out


def _best(x: np.ndarray, y: np.ndarray) -> tuple[float, Condition | None]:
    """The condition with the largest gain of information about the covered positives, over all thresholds."""
    p0, n0 = int(y.sum()), int((~y).sum())
    before = np.log2(p0 / (p0 + n0))
    best, found = 1e-9, None
    for f, name in enumerate(FEATURES):
        order = np.argsort(x[:, f], kind="stable")
        v, hit = x[order, f], y[order]
        last = np.append(v[1:] != v[:-1], True)  # the last row of each value
        p, n = np.cumsum(hit), np.cumsum(~hit)
        for above in (False, True):
            if above:  # rows from the first of a value on
                first = np.append(True, v[1:] != v[:-1])
                pp, nn, at = (p0 - p + hit)[first], (n0 - n + ~hit)[first], v[first]
            else:
                pp, nn, at = p[last], n[last], v[last]
            ok = pp > 0
            gain = np.where(ok, pp * (np.log2(np.maximum(pp, 1) / np.maximum(pp + nn, 1)) - before), 0.0)
            i = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[i] > best:
                near = at[i - 1] if above and i else at[i + 1] if not above and i + 1 < len(at) else at[i]
                best, found = float(gain[i]), Condition(name, above, float((at[i] + near) / 2))
    return best, found


def learn_rules(
    x: np.ndarray,
    y: np.ndarray,
    max_rules: int = 24,
    max_conditions: int = 5,
    min_precision: float = 0.95,
    min_cover: int = 8,
) -> list[Rule]:
    """Rules for the rows where ``y`` is true, in the order they are to be tried.

    ``max_rules`` and ``max_conditions`` bound the model, not the data. Every third row is kept for pruning. A rule
    stays if, over the rows not yet covered, at least ``min_precision`` of what it covers is positive.
    """
    rules: list[Rule] = []
    prune = np.arange(len(y)) % 3 == 2
    left = np.ones(len(y), bool)
    while len(rules) < max_rules:
        grow_x, grow_y = x[left & ~prune], y[left & ~prune]
        rule: list[Condition] = []
        inside = np.ones(len(grow_y), bool)
        while len(rule) < max_conditions and grow_y[inside].any() and not grow_y[inside].all():
            _, condition = _best(grow_x[inside], grow_y[inside])
            if condition is None:
                break
            rule.append(condition)
            inside &= condition.holds(grow_x)
        if not rule:
            break
        prune_x, prune_y = x[left & prune], y[left & prune]

        def worth(k: int, rule=rule, px=prune_x, py=prune_y) -> float:
            got = _covers(rule[:k], px)
            p, n = int((got & py).sum()), int((got & ~py).sum())
            return (p - n) / (p + n + 2)

        kept = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
        covered = _covers(rule[:kept], x) & left
        good, unseen = int((covered & y).sum()), covered & prune
        if covered.sum() < min_cover or good < min_precision * covered.sum():
            break
        if unseen.any() and (unseen & y).sum() < min_precision * unseen.sum():
            break
        rules.append(tuple(rule[:kept]))
        left &= ~covered
        if not y[left].any():
            break
    return rules


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """True where no rule rejects: the ordered list as one conditional expression over the counts."""
    features = feature_columns(prefix)
    out = None
    for rule in rules:
        holds = rule[0].column(features)
        for condition in rule[1:]:
            holds = holds & condition.column(features)
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed(prefix: str = "") -> Column:
    """Too few words, or more than half of them repeated."""
    words = F.col(prefix + "n_words")
    return (words < 50) | (100 * F.col(prefix + "n_repeat_words") > 50 * words)


def fit_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn from at most ``sample_rows`` labelled documents outside the held-out fold (quality 0 is to be rejected)."""
    known = bounded_sample(one_per_key(labels.where("quality IS NOT NULL"), "doc_id", "quality"), "doc_id", sample_rows)
    known = F.broadcast(known.where(~held_out(F.col("doc_id"))))  # at most sample_rows ids and labels
    texts = docs.select("doc_id", "text").join(known.select("doc_id"), "doc_id", "left_semi")
    rows = (
        text_statistics(texts)
        .where("n_words > 0")
        .join(known, "doc_id")
        .select("doc_id", *[c.alias(f"f_{n}") for n, c in feature_columns().items()], (F.col("quality") == 0).alias("bad"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
        .collect()
    )
    if not rows:
        return []
    x = np.array([[r[f"f_{n}"] for n in FEATURES] for r in rows], float)
    return learn_rules(x, np.array([r["bad"] for r in rows], bool))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: id, counts, ``base_failed`` and ``kept``."""
    rules = fit_rules(docs, labels)
    stats = text_statistics(docs).withColumn("base_failed", base_failed())
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    The counts are attached to the rows themselves, without a join, so repeated or null ids never multiply rows.
    """
    rules, columns, names = fit_rules(docs, labels), docs.columns, COUNTS + MORE_COUNTS
    own = "quality_counts"
    while own in columns:
        own += "_"
    at = columns.index("text")

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = np.array([count_text(t) for t in raw_texts(batch.column(at))], np.int64).reshape(-1, len(names))
            counts = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(names))], list(names))
            return batch.append_column(own, counts)

        return step

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    struct = ", ".join(f"{n}: bigint" for n in names)
    out = per_batch(docs, ", ".join([*schema, f"{own} struct<{struct}>"]), start)
    return out.where(~base_failed(f"{own}.") & verdict(rules, f"{own}.")).select(*[f"`{c}`" for c in columns])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
