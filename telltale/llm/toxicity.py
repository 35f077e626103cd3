"""Toxicity by multiple-instance learning: documents carry labels, sentences are what is scored.

A sentence has probability ``sigmoid(bias + sum of its word weights)``; a document is toxic unless all of its sentences
are clean: ``1 - prod(1 - p)`` (noisy-or). Both are trained together from the documents' labels only. A word's weight
is the sum over the word itself and its first and last letters, so inflected forms share what is learned. The same
sentence scores then say where the offending sentences are.

Defined cases. A null or empty text has no sentence and scores 0. Rows are scored one by one, repeated rows alike. An
empty table gives an empty result. Without labels of both kinds every sentence has the prior's score. Null labels and
null ids take no part in learning. Texts of any length
are scored whole; of equally bad sentences the first is the worst. Columns beside id and text are neither read nor kept.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telltale.llm.common import MEMO_WORDS, bounded_sample, held_out, one_per_key, per_batch
from telltale.sources.tables import table

#: Documents the weights are fitted on, at most (chosen by hash among the labelled ones).
FIT_ROWS = 7_000
#: Bytes of their texts, about; longer texts than FIT_TEXT_BYTES are not among them.
FIT_BYTES, FIT_TEXT_BYTES = 32 << 20, 128 << 10
BUCKETS = 1 << 18
_SENTENCE = re.compile(r"[.!?\n]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """Buckets of the letters of a word: whole, its beginnings and its ends. A word without letters has none."""
    letters = "".join(_LETTERS.findall(word.lower()))
    if not letters:
        return []
    grams = {"w" + letters}
    for n in (3, 4, 5, 6):
        if len(letters) > n:
            grams.add("<" + letters[:n])
            if n < 6:
                grams.add(letters[-n:] + ">")
    return [zlib.crc32(g.encode()) % BUCKETS for g in sorted(grams)]


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if not s.isspace() and s]


@dataclass
class SentenceModel:
    weights: np.ndarray
    bias: float
    _scorer: Scorer | None = None

    def scorer(self) -> Scorer:
        """A worker process keeps the model, and with it the words scored so far, over its tasks."""
        if self._scorer is None:
            self._scorer = Scorer(self)
        return self._scorer

    def word_score(self, word: str) -> float:
        features = word_features(word)
        return float(self.weights[features].sum()) if features else 0.0


class Scorer:
    """Scores texts with a model; word scores are remembered, up to MEMO_WORDS of them."""

    def __init__(self, model: SentenceModel):
        self.model, self._known = model, {}

    def sentence_logits(self, text: str) -> tuple[list[str], np.ndarray]:
        found, out, known = sentences(text), [], self._known
        if len(known) > MEMO_WORDS:
            known.clear()
        for sentence in found:
            words = sentence.split()
            try:
                out.append(sum([known[w] for w in words]))
            except KeyError:
                for w in words:
                    if w not in known:
                        known[w] = self.model.word_score(w)
                out.append(sum([known[w] for w in words]))
        return found, np.array(out, float) + self.model.bias

    def document(self, text: str) -> float:
        _, z = self.sentence_logits(text)
        return float(-np.expm1(-np.logaddexp(0.0, z).sum())) if len(z) else 0.0


def fit(texts: list[str], toxic: list[int], steps: int = 120, rate: float = 0.1, sparsity: float = 2e-5) -> SentenceModel:
    """Projected gradient descent on the noisy-or likelihood over whole documents.

    With ``S = sum log(1 + exp(z))`` over its sentences a document is clean with probability ``exp(-S)``. Weights are
    evidence for toxicity and never negative: a clean sentence has the bias alone, however many words it has, and
    clean words in it can't outweigh an offending one. ``sparsity`` keeps words of single documents near zero.
    """
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return SentenceModel(np.zeros(BUCKETS), -8.0)
    kinds: dict[str, int] = {}
    tokens, sizes, doc_of = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for sentence in sentences(text):
            before = len(tokens)
            tokens.extend([kinds.setdefault(w, len(kinds)) for w in sentence.split()])
            sizes.append(len(tokens) - before)
            doc_of.append(d)
    features, counts = array("i"), array("i")
    for w in kinds:
        before = len(features)
        features.extend(word_features(w))
        counts.append(len(features) - before)
    kinds.clear()
    token, feature = np.array(tokens, np.int32), np.array(features, np.int32)
    where = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    word = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    n_words, n_sentences, n, doc_of = len(counts), len(sizes), len(y), np.array(doc_of, np.int32)
    del tokens, features, sizes, counts
    weights, bias = np.full(BUCKETS, 0.01), -6.0
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for step in range(1, steps + 1):
        u = np.bincount(word, weights[feature], n_words)
        z = np.bincount(where, u[token], n_sentences) + bias
        s = np.bincount(doc_of, np.logaddexp(0.0, z), n)
        slope = np.where(y > 0, -1.0 / np.expm1(np.clip(s, 1e-3, 500)), 1.0)
        dz = np.clip(slope, -50, None)[doc_of] / (1.0 + np.exp(-np.clip(z, -30, 30))) / n
        du = np.bincount(token, dz[where], n_words)
        g = np.bincount(feature, du[word], BUCKETS) + sparsity
        gb = dz.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        weights = np.maximum(weights - scale * m / (np.sqrt(v) + 1e-6), 0.0)
        bias -= scale * mb / (np.sqrt(vb) + 1e-9)
    return SentenceModel(weights, float(bias))


def fit_calibrated(texts: list[str], toxic: list[int]) -> SentenceModel:
    """A fit whose bias suits words that it was not fitted on.

    On its own documents a fit is surer than on others, as it knows their words. So a first fit leaves every fifth
    document out, the bias is raised by what predicts those best, and the fit to all documents takes over the raise.
    """
    model = fit(texts, toxic)
    if len(set(toxic)) < 2 or len(set(toxic[::5])) < 2:
        return model
    rest = [i for i in range(len(texts)) if i % 5]
    part = fit([texts[i] for i in rest], [toxic[i] for i in rest])
    scorer = Scorer(part)
    logits = [scorer.sentence_logits(t)[1] for t in texts[::5]]
    y = np.array(toxic[::5], bool)

    def right(raised: float) -> float:
        total = np.array([np.logaddexp(0.0, z + raised).sum() for z in logits])
        found = total >= np.log(2.0)  # noisy-or of one half or more
        return 2.0 * (found & y).sum() / max(1, found.sum() + y.sum())

    raises = np.arange(0.0, 6.01, 0.25)
    scores = np.array([right(r) for r in raises])
    model.bias += float(np.median(raises[scores == scores.max()]))
    return model


def fit_labelled(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> SentenceModel:
    """Fit on at most ``fit_rows`` labelled documents outside the held-out fold, chosen by hash, of ``fit_bytes`` bytes."""
    known = one_per_key(labels.where("toxic IS NOT NULL"), "doc_id", "toxic").where(~held_out(F.col("doc_id")))
    known = bounded_sample(known, "doc_id", fit_rows)  # at most fit_rows ids: a proven bound for the broadcast
    size = F.octet_length("text")
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").where(size <= FIT_TEXT_BYTES).join(F.broadcast(known), "doc_id")
    chosen = bounded_sample(texts.withColumn("size", size), "doc_id", fit_rows)
    # at most fit_rows rows by now; those that the bytes suffice for, in the order of the hash
    upto = F.sum("size").over(W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0))
    rows = chosen.withColumn("upto", upto).where(F.col("upto") <= fit_bytes).select("text", "toxic").toArrow()
    return fit_calibrated(rows.column(0).to_pylist(), rows.column(1).to_pylist())


def score_documents(docs: DataFrame, model: SentenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``score`` and ``predicted`` of every row, and of the sentence most likely to be toxic its number from 0, its
    score and its text (NULL without a sentence)."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(SentenceModel(model.weights.astype(np.float32), model.bias))

    def start():
        scorer = shared.value.scorer()

        def step(batch: pa.RecordBatch) -> dict:
            texts = batch.column(1).to_pylist()
            score, number, worst, sentence = np.zeros(len(texts)), [], [], []
            for i, text in enumerate(texts):
                parts, z = scorer.sentence_logits(text or "")
                if not len(parts):
                    number.append(None)
                    worst.append(None)
                    sentence.append(None)
                    continue
                top = int(z.argmax())
                # noisy-or: one minus the chance that no sentence is toxic
                score[i] = -np.expm1(-np.logaddexp(0.0, z).sum())
                number.append(top)
                worst.append(float(1.0 / (1.0 + np.exp(-np.clip(z[top], -700, 700)))))
                sentence.append(parts[top].strip())
            score = np.clip(score, 0.0, 1.0)
            predicted = pa.array((score >= 0.5).astype(np.int32))
            return {
                id_col: batch.column(0),
                "score": pa.array(score),
                "predicted": predicted,
                "worst_no": pa.array(number, pa.int32()),
                "worst_score": pa.array(worst, pa.float64()),
                "worst_sentence": pa.array(sentence, pa.string()),
            }

        return step

    schema = f"`{id_col}` {kind}, score double, predicted int, worst_no int, worst_score double, worst_sentence string"
    return per_batch(docs.select(id_col, text_col), schema, start)


def offending_sentences(docs: DataFrame, model: SentenceModel, least: float = 0.5) -> DataFrame:
    """One row per sentence scored ``least`` or more: doc_id, its number in the text, the sentence and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(SentenceModel(model.weights.astype(np.float32), model.bias))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def start():
        scorer = shared.value.scorer()

        def step(batch: pa.RecordBatch) -> dict:
            at, number, found, scores = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                parts, z = scorer.sentence_logits(text or "")
                p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
                for j in np.flatnonzero(p >= least):
                    at.append(i)
                    number.append(int(j))
                    found.append(parts[j].strip())
                    scores.append(float(p[j]))
            return {
                "doc_id": batch.column(0).take(pa.array(at, pa.int64())),
                "sentence_no": pa.array(number, pa.int32()),
                "sentence": pa.array(found, pa.string()),
                "score": pa.array(scores, pa.float64()),
            }

        return step

    schema = f"doc_id {kind}, sentence_no int, sentence string, score double"
    return per_batch(docs.select("doc_id", "text"), schema, start)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_labelled(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    more = ["worst_no", "worst_score", "worst_sentence"]
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", *more)
