"""Change diffs → old and new action reference → capability differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.functions import choose_scan_mode, classify_action_type, parse_action_ref
from telltale.operators.filters import min_risk
from telltale.operators.joins import compare_sides, last_pair
from telltale.sources.lines import parse_diff
from telltale.sources.sinks import with_empty_fallback


def action_changes(lines: DataFrame) -> DataFrame:
    """(path, old, new) references of every change: the last removed and the last added one."""
    uses = parse_diff(lines).filter(F.col("text").contains("uses:"))
    pair = last_pair(uses, ["path"], "sign", ["line_no"], "text")
    return pair.select(
        "path", parse_action_ref("old_value").alias("old"), parse_action_ref("new_value").alias("new")
    )


def capability_changes(
    changes: DataFrame, capabilities: DataFrame, level: str = "HIGH", types: DataFrame | None = None
) -> DataFrame:
    """Capabilities added, removed or changed between the two references of each change.

    ``capabilities``: (repo, ref, file, rule_id, risk_score). Many changes raise
    one reference to the same other one, so each distinct pair of references is
    compared once, and the result joined to the changes that have it. ``types``:
    (repo, ref, using) of the actions; where both sides of a change are
    containers, capabilities of every level count. Without it, or for references
    it does not have, ``level`` holds.
    """
    ref = lambda which, side: F.struct(
        F.lit(side).alias("side"), F.col(f"pair.{which}.repo").alias("repo"), F.col(f"pair.{which}.ref").alias("ref")
    )
    # a struct of both is never NULL itself, so a missing side compares equal
    paired = changes.select("path", F.struct("old", "new").alias("pair"))
    refs = paired.select("pair").distinct().select("pair", F.inline(F.array(ref("old", 1), ref("new", 2))))
    hits = refs.join(capabilities, ["repo", "ref"])
    diff = compare_sides(hits, ["pair", "file", "rule_id"], "risk_score", "side")
    worst = diff.withColumn("risk_score", F.greatest("prior", "current"))
    if types is None:
        found = min_risk(worst, level)
    else:
        kinds = types.groupBy("repo", "ref").agg(F.max(classify_action_type("using")).alias("type"))
        side = lambda n: F.max(F.when(F.col("side") == n, F.col("type")))
        modes = (
            refs.join(kinds, ["repo", "ref"])
            .groupBy("pair")
            .agg(choose_scan_mode(side(1), side(2))["mode"].alias("mode"))
            .filter(F.col("mode") == "image")
        )
        placed = worst.join(modes, "pair", "left")
        images, others = placed.filter(F.col("mode").isNotNull()), placed.filter(F.col("mode").isNull())
        found = images.unionByName(min_risk(others, level)).drop("mode")
    return paired.join(found, "pair").select("path", "file", "rule_id", "prior", "current", "status", "risk_score")


def change_comment(diff: DataFrame) -> DataFrame:
    """Comment lines, or a two-line notice when nothing changed."""
    body = diff.select(
        F.concat_ws(" ", F.lit("-"), "status", "file", "rule_id").alias("text"), F.lit(0).alias("line_no")
    )
    spare = diff.sparkSession.createDataFrame(
        [("## Capability diff", 1), ("No differences found.", 2)], "text string, line_no int"
    )
    return with_empty_fallback(body, spare)
