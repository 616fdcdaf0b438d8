"""Session settings that operators rely on: shared folder and durable cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without that setting gets a folder of its own; on a cluster the
    setting is needed, as a folder of one machine would lose files for the others.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint on shared storage; survives lost executors."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Codec of written tables: a third less than Spark's default for wide rows.
TIGHT = "zstd"

#: What a query wrote needs its shuffle files no more; else they stay until the driver collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting while jobs run in this block; the session's own holds again after it."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a written table or a stream."""
    _ensure_checkpoint_dir(spark)
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared folder; survives lost executors.

    A checkpoint holds its rows uncompressed, is read with all its columns and carries on the
    size estimate of a plan that has one more join each round of a loop.
    """
    path = work_path(df.sparkSession, "round")
    with setting(df.sparkSession, FREE_SHUFFLES, "true"):
        df.write.parquet(path, compression=TIGHT)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task of costly row work: some seconds at a few hundred microseconds a row.
ROWS_AT_ONCE = 25_000


def dealt(df: DataFrame, rows: int = ROWS_AT_ONCE) -> DataFrame:
    """Deal the rows of a table evenly to tasks of about ``rows`` before costly row work.

    The splits of a scan follow the bytes of files: with few or large row groups some hold
    everything and others nothing, and a task grows with the table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of a few unsplittable files before costly row work.

    A scan that already has a partition per core, as any large table has, is left
    alone; only the raw rows of a small input are shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
