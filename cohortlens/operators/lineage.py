"""Cutting lineage between dependent passes with a table in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_dir: dict[str, str] = {}
_removed_at_end: set[str] = set()
_within: ContextVar[list[str] | None] = ContextVar("_within", default=None)
_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # of a query, once it has ended


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only for a local master without one."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_dir.setdefault("path", tempfile.mkdtemp(prefix="spark-cohort-"))


def run_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it is removed when the application ends."""
    path = f"{shared_dir(spark)}/run-{spark.sparkContext.applicationId}"
    if path not in _removed_at_end:
        _removed_at_end.add(path)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(folder)  # only what exists can be marked
        files.deleteOnExit(folder)
    return path


def cut(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Write df once and continue from the written table.

    Used where one ordering pass feeds the next: the passes read their input several times, so a
    nested plan would grow with every level. The written table also survives lost executors, is read
    column by column, and tells Spark its true size (so small statistics are broadcast by Spark's own
    size check). A ``lasting`` table outlives the block of ``passing`` in which it is written.
    """
    path = f"{run_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    if not lasting and (written := _within.get()) is not None:
        written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is cut inside, and the shuffle files of the queries run inside, do not outlive the block. Its results are collected, or cut as lasting."""
    before, written = spark.conf.get(_CLEAN_SHUFFLES), []
    token = _within.set(written)
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        _within.reset(token)
        spark.conf.set(_CLEAN_SHUFFLES, before)
        for path in written:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
