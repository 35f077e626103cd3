"""From raw documents to packed training sequences: quality rules, language, near duplicates, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read again as the next one's
``docs``. All but the last return the columns of ``docs``.

Defined cases. Rows without a text, or with an empty one, fail the base rule of the first stage and go. Texts of any length
are taken whole; the last stage cuts them into pieces and loses no word. Of near duplicates the row with the smallest id
stays, ids before none; rows that repeat id and text are one, rows with one id and different texts each count by their own.
Columns with names that a stage uses for itself pass through unharmed. Empty tables go through all stages and give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from telltale.llm import language_id, ngram_join, packing, quality_rules
from telltale.session import cut
from telltale.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one language in at least half of their letters."""
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five words, similarity 0.8)."""
    return ngram_join.one_of_each(docs, width=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences."""
    return packing.best_fit(docs)


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", pack),
]

#: Two stages are learned, one is iterative and one is greedy; a brute-force version checks ``run`` instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
