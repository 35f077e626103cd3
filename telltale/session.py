"""Session defaults and the shared folder that lineage cuts and sinks write to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "telltale", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Adaptive execution is what splits a hot join key and what turns a join into
    a broadcast once the measured size of a side is under the threshold, so no
    operator in this package carries an unconditional broadcast hint on data
    whose size it does not know.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    On a cluster that is a filesystem every executor can reach. Only where the
    session names none, as in local tests, is a temporary folder made.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="telltale-")
        context.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the application's folder in the shared folder.

    One folder per application, so that whoever runs the job can drop all of
    its intermediate data at once when it has ended.
    """
    application = spark.sparkContext.applicationId
    return os.path.join(shared_dir(spark), f"telltale-{application}", f"{label}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from the written copy.

    Later steps see one fixed result even when executors are lost, and read
    only the columns they need from it.
    """
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> bool:
    """Remove all that this application has written to the shared folder: lineage cuts, blocks, sinks without a path of
    their own. For the end of a job, when none of its results is read any more."""
    from telltale.sources.pointer import folders, remove_folder

    name = f"telltale-{spark.sparkContext.applicationId}"
    found = name in folders(spark, shared_dir(spark))
    if found:
        remove_folder(spark, os.path.join(shared_dir(spark), name))
    return found
