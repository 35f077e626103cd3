"""Small text files that are replaced in one step, on any file system Spark knows.

A file is written beside its place and renamed over it, so a reader finds the
old text or the new one, whole, whenever it looks and wherever a writer dies.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    """Hadoop's path, its file system and its file context."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    at = fs.Path(path)
    system = at.getFileSystem(conf)
    at = system.makeQualified(at)
    return at, system, fs.FileContext.getFileContext(at.toUri(), conf)


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    at, system, context = _hadoop(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f"{at.getName()}.{uuid.uuid4().hex}")
    out = system.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(beside, at, options)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text, or None where there is no such file."""
    at, system, _ = _hadoop(spark, path)
    if not system.exists(at):
        return None
    stream = system.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def folders(spark: SparkSession, path: str) -> dict[str, int]:
    """Names of the folders in a folder, with when they were last changed, in milliseconds."""
    at, system, _ = _hadoop(spark, path)
    if not system.exists(at):
        return {}
    return {s.getPath().getName(): s.getModificationTime() for s in system.listStatus(at) if s.isDirectory()}


def remove_folder(spark: SparkSession, path: str) -> None:
    at, system, _ = _hadoop(spark, path)
    system.delete(at, True)
