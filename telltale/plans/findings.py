"""Findings → ranked report, joined with the exploited-vulnerability catalog and with logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.functions import extract_cve_ids
from telltale.operators.windows import impact_score, top_per_group
from telltale.session import cut
from telltale.sources.sinks import report_lines


def rank_findings(findings: DataFrame, kev: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most impactful rules per scan.

    ``findings``: (scan, rule_id, severity, message, uri). Rules are first
    reduced to (scan, rule, CVE id) with their severity and then met with the
    catalog, so the join moves distinct ids and not findings.
    """
    keys = ["scan", "rule_id"]
    facts = findings.groupBy(*keys).agg(
        F.max("severity").alias("severity"), F.count_distinct("uri").alias("locations")
    )
    ids = findings.select(*keys, F.explode(extract_cve_ids("message")).alias("cve_id")).distinct()
    listed = ids.join(kev.select("cve_id"), "cve_id", "left_semi").groupBy(*keys).agg(F.lit(True).alias("in_kev"))
    scored = (
        facts.join(listed, keys, "left")
        .withColumn("in_kev", F.coalesce("in_kev", F.lit(False)))
        .withColumn("score", impact_score(F.col("severity"), F.col("in_kev"), F.col("locations")))
    )
    # The number of locations orders without a bound; the score shows it clipped.
    order = [F.desc("severity"), F.desc("in_kev"), F.desc("locations"), "rule_id"]
    return top_per_group(scored, ["scan"], order, n)


def attach_logs(top: DataFrame, logs: DataFrame) -> DataFrame:
    """Log count and latest log line per ranked rule; rules without logs stay.

    ``logs``: (rule_id, seq, line). Only logs of ranked rules are aggregated.
    The ranking is read twice, so it is written first; it has a few rows per scan.
    """
    top = cut(top)
    hit = logs.join(top.select("rule_id").distinct(), "rule_id", "left_semi")
    evidence = hit.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("n_logs"), F.max_by("line", "seq").alias("last_log")
    )
    return top.join(evidence, "rule_id", "left").withColumn("n_logs", F.coalesce("n_logs", F.lit(0)))


def findings_report(findings: DataFrame, kev: DataFrame, logs: DataFrame, n: int = 5) -> DataFrame:
    """Ranked findings with their evidence: the table behind the report."""
    return attach_logs(rank_findings(findings, kev, n), logs)


def report_text(ranked: DataFrame, generated: str, source: str) -> DataFrame:
    """The markdown report as ordered lines; ``generated`` is a parameter, not the clock."""
    ranked = cut(ranked)
    line = lambda *parts: F.concat(*parts).alias("text")
    place = [F.col("scan").alias("scan"), F.col("rank").alias("rank")]
    score = ranked.select(
        *place, line(F.lit("1. "), "scan", F.lit(" / "), F.col("rule_id").cast("string"), F.lit(": "), F.col("score").cast("string"))
    )
    logs = ranked.filter("n_logs > 0").select(
        *place, line(F.lit("- "), F.col("rule_id").cast("string"), F.lit(": "), F.col("n_logs").cast("string"), F.lit(" log lines"))
    )
    kev = ranked.filter("in_kev").select(*place, line(F.lit("- "), "scan", F.lit(" / "), F.col("rule_id").cast("string")))
    talking = ranked.filter("rank <= 3").select(*place, line(F.lit("- "), "scan", F.lit(": "), F.col("rule_id").cast("string")))
    return report_lines(
        ["# Findings report", f"_Generated: {generated}_", f"_Source: {source}_"],
        [("Top findings", score), ("Log evidence", logs), ("Catalog cross-reference", kev), ("Talking points", talking)],
        ["scan", "rank"],
        "text",
    )
