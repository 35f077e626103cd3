"""Model runs → totals and weighted rates per model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from telltale.functions import default_missing, fmt2, sentinel_to_zero
from telltale.operators.aggs import benchmark_summary
from telltale.operators.filters import skip_list


def model_benchmark(runs: DataFrame, skip: list[str]) -> DataFrame:
    """``runs``: (model, prompt_eval_count, prompt_eval_duration, eval_count, eval_duration), ns.

    The skip list is applied at the scan, before anything is summed.
    """
    kept = skip_list(runs, "model", skip)
    clean = kept.withColumn("prompt_eval_count", sentinel_to_zero(default_missing("prompt_eval_count", 0)))
    for name in ("prompt_eval_duration", "eval_count", "eval_duration"):
        clean = clean.withColumn(name, default_missing(name, 0))
    out = benchmark_summary(
        clean, ["model"], "prompt_eval_count", "prompt_eval_duration", "eval_count", "eval_duration"
    )
    for name in ("prompt_rate", "eval_rate", "total_rate"):
        out = out.withColumn(f"{name}_text", fmt2(name))
    return out
