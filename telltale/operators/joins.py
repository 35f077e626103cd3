"""Joins between telemetry tables.

All are equi-joins. None carries a broadcast hint: Catalyst broadcasts a side
when its estimated, and adaptive execution when its measured size is under
``spark.sql.autoBroadcastJoinThreshold``, and otherwise sort-merge joins with
skewed partitions split. Sides that may repeat a key are reduced to one row per
key before they meet the other side, so no hot key multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.functions import extract_cve_ids, layer_files
from telltale.operators.sets import compare_sets
from telltale.session import cut


def finding_cve_ids(findings: DataFrame, text: str) -> DataFrame:
    """One row per finding and distinct CVE id that its text names."""
    return findings.withColumn("cve_id", F.explode(F.array_distinct(extract_cve_ids(text))))


def kev_semi(findings: DataFrame, kev: DataFrame, on: str = "cve_id") -> DataFrame:
    """Findings whose id is in the catalog."""
    return findings.join(kev.select(on), on, "left_semi")


def kev_inner(findings: DataFrame, kev: DataFrame, on: str = "cve_id") -> DataFrame:
    """Findings with the catalog entry attached; of an id listed twice one entry is taken."""
    return findings.join(_one_row(kev, [on]), on, "inner")


def top_with_evidence(
    findings: DataFrame, logs: DataFrame, key: str, rank_by: list, n: int, log_seq: list[str], log_text: str
) -> DataFrame:
    """The ``n`` leading findings, each with its log count and latest log text.

    Logs are optional. They are filtered by the ``n`` keys and reduced to one
    row per key before the outer join. The ranking is read twice, so it is
    written first; how its few keys are joined is left to Spark.
    """
    top = cut(findings.orderBy(*rank_by).limit(n))
    hit = logs.join(top.select(key), key, "left_semi")
    evidence = hit.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_logs"), F.max_by(log_text, F.struct(*log_seq)).alias("last_log")
    )
    return top.join(evidence, key, "left").withColumn("n_logs", F.coalesce("n_logs", F.lit(0)))


def snapshot_diff(
    prior: DataFrame, current: DataFrame, on: list[str], value: str, keep_same: bool = False
) -> DataFrame:
    """Full outer comparison of two snapshots: added, removed, changed (and same).

    Both sides must hold one row per key; aggregate before calling. A tagged
    union and one aggregation do the work of the outer join: NULL keys match
    each other, and no side has to be sorted.
    """
    side = lambda df, s: df.select(*on, F.col(value).alias("_v"), F.lit(s).alias("_side"))
    return compare_sides(side(prior, 1).unionByName(side(current, 2)), on, "_v", "_side", keep_same)


def compare_sides(
    tagged: DataFrame, on: list[str], value: str, side: str, keep_same: bool = False
) -> DataFrame:
    """Prior (side 1) against current (side 2) value per key; of several values the greatest counts."""
    of = lambda s: F.col(side) == s
    both = tagged.groupBy(*on).agg(
        F.max(F.when(of(1), F.col(value))).alias("prior"),
        F.max(F.when(of(2), F.col(value))).alias("current"),
        F.min(side).alias("_lo"),
        F.max(side).alias("_hi"),
    )
    status = (
        F.when(F.col("_lo") == 2, F.lit("added"))
        .when(F.col("_hi") == 1, F.lit("removed"))
        .when(F.col("prior").eqNullSafe(F.col("current")), F.lit("same"))
        .otherwise(F.lit("changed"))
    )
    out = both.select(*on, "prior", "current", status.alias("status"))
    return out if keep_same else out.filter(F.col("status") != "same")


def last_pair(df: DataFrame, by: list[str], sign: str, order: list[str], value: str) -> DataFrame:
    """Per change, the last removed next to the last added value: one aggregation, no self-join."""
    pick = lambda s: F.max_by(
        F.when(F.col(sign) == s, F.col(value)), F.when(F.col(sign) == s, F.struct(*order))
    )
    return df.groupBy(*by).agg(pick("-").alias("old_value"), pick("+").alias("new_value"))


def not_listed(df: DataFrame, listed: DataFrame, on: str) -> DataFrame:
    """Distinct names used but not on the list. Deduplicated first: only names move."""
    return df.select(on).distinct().join(listed.select(on).distinct(), on, "left_anti")


def allowlist_gaps(used: DataFrame, allowed: DataFrame, on: str) -> DataFrame:
    """Names used but not allowed, and names allowed but not used: both anti-joins in one shuffle."""
    gap = F.when(F.col("side") == "only_first", "blocked_but_used").otherwise("allowed_but_unused")
    return compare_sets(used, allowed, on).filter("side != 'common'").select(on, gap.alias("gap"))


def blocklist_exact(df: DataFrame, blocklist: DataFrame, on: str) -> DataFrame:
    return df.join(blocklist.select(on), on, "left_semi")


def domain_suffixes(df: DataFrame, domain: str, name: str = "suffix") -> DataFrame:
    """One row per parent domain, the name itself first. A name has at most 127 labels."""
    labels = F.split(F.col(domain), r"\.")
    suffix = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
    )
    return df.withColumn(name, F.explode(suffix))


def blocklist_suffix(df: DataFrame, blocklist: DataFrame, domain: str) -> DataFrame:
    """Per distinct blocked name: row count and the most specific list entry above it.

    Rows are counted per name before the suffixes are exploded, so the join
    grows with the number of names and not with the number of queries.
    """
    names = df.groupBy(domain).agg(F.count(F.lit(1)).alias("n_rows"))
    listed = blocklist.select(F.col(domain).alias("suffix")).distinct()
    hits = domain_suffixes(names, domain).join(listed, "suffix", "inner")
    return hits.groupBy(domain, "n_rows").agg(
        F.max_by("suffix", F.length("suffix")).alias("matched_entry")
    )


def layer_table(history: DataFrame, diff_ids: DataFrame, layers: DataFrame, sources: DataFrame, image: str) -> DataFrame:
    """history ⋈ diff_ids ⋈ layers on position, then layer sources on digest."""
    return (
        history.join(diff_ids, [image, "pos"], "inner")
        .join(layers, [image, "pos"], "inner")
        .join(sources, [image, "digest"], "inner")
    )


def copied_then_removed(
    df: DataFrame, by: list[str], pos: str, added: str, removed: str, kind: str
) -> DataFrame:
    """Files added in one layer and removed in a later one, which are still recoverable.

    A removal after an addition exists exactly when the last removal lies after
    the first addition, so the self-join on ``j > i`` reduces to one aggregation
    and no pair is ever formed.
    """
    first = F.min(F.when(F.col(kind) == added, F.col(pos))).alias("added_at")
    last = F.max(F.when(F.col(kind) == removed, F.col(pos))).alias("removed_at")
    return df.groupBy(*by).agg(first, last).filter(F.col("added_at") < F.col("removed_at"))


def _one_row(df: DataFrame, on: list[str]) -> DataFrame:
    """One row per key, the least of its others, so that a join with it never multiplies.

    It is rebalanced, so the join shuffles it by itself: directly on the aggregation Spark could not split a hot key of
    the other side.
    """
    rest = [c for c in df.columns if c not in on]
    if not rest:
        return df.distinct().hint("rebalance")
    return df.groupBy(*on).agg(F.min(F.struct(*rest)).alias("_row")).select(*on, "_row.*").hint("rebalance")


def layer_file_actions(layers: DataFrame, keep: list[str], created_by: str = "created_by") -> DataFrame:
    """(keep, step, action, file, source): what the commands of image layers add and remove, one row per file."""
    files = F.posexplode(layer_files(created_by)).alias("step", "_f")
    return layers.select(*keep, files).select(*keep, "step", "_f.action", "_f.file", "_f.source")


def recoverable_files(layers: DataFrame, image: list[str], pos: str, created_by: str = "created_by") -> DataFrame:
    """Files that one layer adds and a later one removes, from the text of the layers' commands alone."""
    actions = layer_file_actions(layers, [*image, pos], created_by)
    return copied_then_removed(actions, [*image, "file"], pos, "added", "removed", "action")


def sbom_edges(packages: DataFrame, relationships: DataFrame, document: list[str] | None = None) -> DataFrame:
    """Relationships with the package names of both ends.

    ``document`` names the columns that identify a document; ids are unique
    within one only, so documents with the same ids never meet.
    """
    by = document or []
    source = packages.select(*by, F.col("spdx_id").alias("spdx_element_id"), F.col("name").alias("source_name"))
    target = packages.select(*by, F.col("spdx_id").alias("related_spdx_element"), F.col("name").alias("target_name"))
    out = relationships.join(_one_row(source, [*by, "spdx_element_id"]), [*by, "spdx_element_id"], "inner")
    return out.join(_one_row(target, [*by, "related_spdx_element"]), [*by, "related_spdx_element"], "inner")


def sbom_reachable(
    relationships: DataFrame, roots: DataFrame, depth: int | None = None, document: list[str] | None = None
) -> DataFrame:
    """Nodes within ``depth`` edges of the roots, with their least distance; without a depth all that can be reached.

    ``document`` as in ``sbom_edges``. The edges are written once. Each level
    joins the frontier to them and drops nodes already seen; it is written
    before the next one reads it, and an empty one ends the search.
    """
    by = document or []
    edges = cut(relationships.select(*by, "spdx_element_id", "related_spdx_element").distinct())
    frontier = roots.select(*by, "spdx_id").distinct().withColumn("depth", F.lit(0))
    seen, level = frontier, 0
    while depth is None or level < depth:
        level += 1
        frontier = cut(
            frontier.select(*by, F.col("spdx_id").alias("spdx_element_id"))
            .join(edges, [*by, "spdx_element_id"])
            .select(*by, F.col("related_spdx_element").alias("spdx_id"))
            .distinct()
            .join(seen.select(*by, "spdx_id"), [*by, "spdx_id"], "left_anti")
            .withColumn("depth", F.lit(level))
        )
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def sbom_beyond(relationships: DataFrame, reached: DataFrame, document: list[str] | None = None) -> DataFrame:
    """Nodes one edge behind what a search to a fixed depth has reached: empty if it was complete."""
    by = document or []
    ends = reached.select(*by, F.col("spdx_id").alias("spdx_element_id")).join(relationships, [*by, "spdx_element_id"])
    behind = ends.select(*by, F.col("related_spdx_element").alias("spdx_id")).distinct()
    return behind.join(reached.select(*by, "spdx_id"), [*by, "spdx_id"], "left_anti")


def signed_images(attestations: DataFrame, signatures: DataFrame, on: str = "digest") -> DataFrame:
    """Attestations with their number of signatures; the latter are counted per digest first."""
    counted = signatures.groupBy(on).agg(F.count(F.lit(1)).alias("n_signatures"))
    return attestations.join(counted, on, "inner")


def unsigned_images(attestations: DataFrame, signatures: DataFrame, on: str = "digest") -> DataFrame:
    return attestations.join(signatures.select(on), on, "left_anti")


def client_changes(a: DataFrame, b: DataFrame, client: str, fields: list[str]) -> DataFrame:
    """The same client in two scans, with the changed fields named."""
    left = a.select(client, *(F.col(f).alias(f"{f}_before") for f in fields))
    right = b.select(client, *(F.col(f).alias(f"{f}_after") for f in fields))
    changed = F.concat_ws(
        ",", *(F.when(~F.col(f"{f}_before").eqNullSafe(F.col(f"{f}_after")), F.lit(f)) for f in fields)
    )
    return left.join(right, client, "inner").withColumn("changed", changed)


def with_rule(findings: DataFrame, rules: DataFrame, on: str | list[str]) -> DataFrame:
    """Rule metadata attached to findings.

    ``on`` is the rule id, with the file and run if ids are only known within
    them. Of a rule that is defined more than once one definition is taken.
    """
    on = [on] if isinstance(on, str) else on
    return findings.join(_one_row(rules, on), on, "inner")
