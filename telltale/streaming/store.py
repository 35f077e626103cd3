"""Sinks for streams that change rows: epochs behind a manifest, merged as they age.

Every epoch writes what it changed as a run, a folder of its own, and then
replaces the manifest, which lists the runs in force, in one step. Readers open
only what the manifest lists. A retried epoch is already in the manifest and
changes nothing; an attempt that died left a folder that no one reads.

Once ``fan`` runs of a level have come together, they are merged into one of
the next level: the newest rows per key, laid out by ranges of the keys, so a
lookup by key prunes files. After n epochs there are at most
``fan · log(n) / log(fan)`` runs, and a row was rewritten once per level.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from telltale.operators.aggs import last_per_group
from telltale.sources.pointer import read_text, remove_folder, replace_text

EPOCH = "_epoch"
MANIFEST = "_manifest.json"
FAN = 8


class EpochStore:
    """Rows by epoch. With ``keys`` the newest row per key counts, without them all rows do.

    ``prune`` takes and returns the rows of a merge, to leave out what no reader needs any more.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: StructType,
        keys: list[str] | None = None,
        fan: int = FAN,
        prune: Callable[[DataFrame, dict], DataFrame] | None = None,
    ):
        self.spark, self.path, self.keys, self.fan, self.prune = spark, path, keys, fan, prune
        self.columns = [f.name for f in schema]
        nullable = StructType()
        for field in schema:
            nullable = nullable.add(field.name, field.dataType, True)
        self.schema = nullable.add(EPOCH, "long", True)

    def manifest(self) -> dict:
        text = read_text(self.spark, f"{self.path}/{MANIFEST}")
        return json.loads(text) if text else {"epoch": -1, "runs": [], "left": [], "notes": {}}

    def has(self, epoch: int) -> bool:
        return self.manifest()["epoch"] >= epoch

    def notes(self) -> dict:
        """What the last epoch had to say."""
        return self.manifest()["notes"]

    def _write(self, placed: DataFrame, name: str) -> None:
        placed.select(*self.columns, F.col(EPOCH).cast("long").alias(EPOCH)).write.parquet(f"{self.path}/{name}")

    def _switch(self, manifest: dict) -> None:
        replace_text(self.spark, f"{self.path}/{MANIFEST}", json.dumps(manifest))

    def commit(self, epoch: int, df: DataFrame, notes: dict | None = None) -> bool:
        """Add an epoch's rows; False if it was there already."""
        manifest = self.manifest()
        if manifest["epoch"] >= epoch:
            return False
        name = f"run-{epoch}-{uuid.uuid4().hex}"
        # hashed, not ranged: a sample of the bounds would run a stateful batch twice
        placed = df.repartition(*self.keys) if self.keys else df
        self._write(placed.withColumn(EPOCH, F.lit(epoch)), name)
        manifest["runs"].append({"name": name, "level": 0, "first": epoch, "last": epoch})
        self._switch(manifest | {"epoch": epoch, "notes": manifest["notes"] | (notes or {})})
        self._merge()
        return True

    def _merge(self) -> None:
        """Merge full levels. Runs that an earlier epoch's merge replaced are removed now: readers had that long."""
        stale, replaced = self.manifest()["left"], []
        while True:
            manifest = self.manifest()
            levels = [run["level"] for run in manifest["runs"]]
            full = [level for level in sorted(set(levels)) if levels.count(level) >= self.fan]
            if not full:
                break
            old = [run for run in manifest["runs"] if run["level"] == full[0]]
            name = f"run-{old[0]['first']}-{old[-1]['last']}-{uuid.uuid4().hex}"
            rows = self._newest(self._read(old))
            rows = self.prune(rows, manifest["notes"]) if self.prune else rows
            self._write(rows.repartitionByRange(*self.keys).sortWithinPartitions(*self.keys) if self.keys else rows, name)
            merged = {"name": name, "level": full[0] + 1, "first": old[0]["first"], "last": old[-1]["last"]}
            rest = [run for run in manifest["runs"] if run["level"] != full[0]]
            replaced += [run["name"] for run in old]
            self._switch(manifest | {"runs": [*rest, merged], "left": replaced})
        if replaced:
            for left in stale:
                remove_folder(self.spark, f"{self.path}/{left}")

    def _read(self, runs: list[dict]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{run['name']}" for run in runs))

    def _newest(self, rows: DataFrame) -> DataFrame:
        if not self.keys:
            return rows
        values = [c for c in [*self.columns, EPOCH] if c not in self.keys]
        return last_per_group(rows, self.keys, [EPOCH], values).select(*self.columns, EPOCH)

    def read(self) -> DataFrame:
        """The rows in force; a single run has one row per key as it is."""
        runs = self.manifest()["runs"]
        rows = self._read(runs)
        return (rows if len(runs) < 2 else self._newest(rows)).select(*self.columns)

    def read_keys(self, wanted: DataFrame) -> DataFrame:
        """The rows in force whose values of the columns of ``wanted`` are among its rows; NULLs match."""
        names = wanted.columns
        renamed = wanted.select(*(F.col(c).alias(f"_k_{c}") for c in names)).distinct()
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in names))
        runs = self.manifest()["runs"]
        rows = self._read(runs).join(renamed, same, "left_semi")
        return (rows if len(runs) < 2 else self._newest(rows)).select(*self.columns)
