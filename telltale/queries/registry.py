"""One table of queries: name → Spark callable and, where SQL can say it, the oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from telltale.sources.tables import table


class Tables:
    """Lazy access to the tables of one folder: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None
    headline: bool


QUERIES: dict[str, Query] = {}


def query(sql: str | None, headline: bool = False):
    """Register a function of ``Tables`` under its own name."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if fn.__name__ in QUERIES:
            raise ValueError(f"query {fn.__name__} is registered twice")
        QUERIES[fn.__name__] = Query(fn.__name__, fn, sql, headline)
        return fn

    return add
