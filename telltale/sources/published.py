"""Tables that are published whole: written beside, then switched to.

A published table is a folder with one folder per version and a pointer file
that names the version in force. Readers follow the pointer, so during a write,
and after a writer that died, they see the version before; a query that has
begun keeps reading the version it began with.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from telltale.sources.pointer import folders, read_text, remove_folder, replace_text

POINTER = "_current.json"
VERSION = "version-"


def current(spark: SparkSession, path: str) -> dict | None:
    """The pointer: the version in force and what was said of it when it was published."""
    text = read_text(spark, f"{path}/{POINTER}")
    return None if text is None else json.loads(text)


def write_beside(df: DataFrame, path: str) -> str:
    """Write a version that no reader sees yet; its name."""
    name = f"{VERSION}{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    return name


def switch_to(spark: SparkSession, path: str, version: str, **said) -> None:
    replace_text(spark, f"{path}/{POINTER}", json.dumps({"version": version, **said}))


def publish(df: DataFrame, path: str) -> None:
    switch_to(df.sparkSession, path, write_beside(df, path))


def read_version(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{version}")


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The version in force."""
    pointer = current(spark, path)
    if pointer is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return read_version(spark, path, pointer["version"])


def drop_versions(spark: SparkSession, path: str, older_than_hours: float = 24) -> list[str]:
    """Remove versions that are not in force and older than what any reader or writer still needs; their names."""
    pointer = current(spark, path) or {}
    limit = (time.time() - older_than_hours * 3600) * 1000
    old = [
        name
        for name, changed in folders(spark, path).items()
        if name.startswith(VERSION) and name != pointer.get("version") and changed <= limit
    ]
    for name in old:
        remove_folder(spark, f"{path}/{name}")
    return old
