"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from telltale.llm import (
    collocations,
    conversation_repair,
    html_text,
    language_id,
    license_scan,
    ngram_join,
    packing,
    quality_rules,
    sharding,
    token_counts,
    tokens,
    topk_search,
    toxicity,
)

DEALT_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.op1,
    "op2_html_text": html_text.op2,
    "op3_best_fit_packing": packing.op3,
    "op4_ngram_join": ngram_join.op4,
    "op5_toxicity": toxicity.op5,
    "op6_byte_bpe": tokens.op6,
    "op7_topk_search": topk_search.op7,
    "op8_token_counts": token_counts.op8,
    "op9_language_id": language_id.op9,
    "op10_sharding": sharding.op10,
    "op11_collocations": collocations.op11,
    "op12_conversation_repair": conversation_repair.op12,
    "op13_license_scan": license_scan.op13,
}
DEALT_ORACLES: dict[str, str] = {
    "op7_topk_search": topk_search.OP7_SQL,
    "op10_sharding": sharding.OP10_SQL,
}
