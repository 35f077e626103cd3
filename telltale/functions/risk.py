"""Risk levels, scan modes and TLS verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telltale.functions._cols import ColumnLike, col

# 1 and 2 as reports carry them; 3 and 4 extend the scale and are
# an assumption of this package.
RISK_RANKS = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


def risk_score(level: ColumnLike) -> Column:
    """Rank of a level name; NULL for an unknown name."""
    value = F.upper(col(level))
    out = None
    for name, rank in RISK_RANKS.items():
        out = (F if out is None else out).when(value == name, F.lit(rank))
    return out


def risk_level(score: ColumnLike) -> Column:
    out = None
    for name, rank in RISK_RANKS.items():
        out = (F if out is None else out).when(col(score) == rank, F.lit(name))
    return out


def classify_action_type(using: ColumnLike) -> Column:
    """``docker`` must match exactly, ``node…`` and ``composite…`` by prefix."""
    value = col(using)
    return (
        F.when(value == "docker", F.lit("docker"))
        .when(value.startswith("node"), F.lit("node"))
        .when(value.startswith("composite"), F.lit("composite"))
    )


def choose_scan_mode(old_type: ColumnLike, new_type: ColumnLike) -> Column:
    """Two container actions are compared as images, anything else as directories."""
    both = F.coalesce((col(old_type) == "docker") & (col(new_type) == "docker"), F.lit(False))
    return F.struct(
        F.when(both, F.lit("image")).otherwise(F.lit("directory")).alias("mode"),
        F.when(~both, F.lit("high")).alias("min_file_risk"),
    )


def verdict(value: ColumnLike) -> Column:
    """Outcome of a TLS report value. The hedged and the bad wording come first."""
    text = col(value)
    return (
        F.when(text.rlike("potentially"), F.lit("potential"))
        .when(text.rlike("VULNERABLE|NOT ok"), F.lit("not ok"))
        .when(text.rlike(r"\(OK\)"), F.lit("ok"))
        .otherwise(F.lit("info"))
    )
