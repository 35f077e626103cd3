"""Registered queries: every operator over the driver's tables, with its SQL twin.

Native formats (JSON reports, traces, diffs) are first derived from those
tables by Spark and then parsed, so the work grows with the tables.
"""

from telltale.queries import (  # noqa: F401  (importing registers)
    aggregates,
    filtering,
    joining,
    jobs,
    reading,
    scalar,
    streams,
    windowing,
)
from telltale.queries.registry import QUERIES, Query, Tables

__all__ = ["QUERIES", "Query", "Tables"]
