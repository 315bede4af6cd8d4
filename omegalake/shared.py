"""The folder that driver and executors share, and frames written there."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and all runs in one process, as in local tests.
OWN_SHARED_DIR = "file:///tmp/checkpoints"

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    A cluster must name one: a folder of this machine would be another on each executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or OWN_SHARED_DIR).rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, Python stages get at most this many rows at once; for steps over long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back.

    This cuts the lineage, keeps a Python stage from running twice and survives the loss of
    any executor. The files are removed by ``release``, or when the driver process ends.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Removes what was kept in the shared folder so far; frames made from it can't be read any more.

    For long sessions, between one job and the next; at the driver's end it is done anyway.
    """
    while _staged:
        spark, path = _staged.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session ended first; whoever owns the folder clears it
            return
