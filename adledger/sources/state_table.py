"""Stored state as plain Parquet tables, changed by batches that may be repeated.

A state table is partitioned by a hash bucket of its key. A batch reads and rewrites only
the buckets that its keys fall in, with dynamic partition overwrite; the number of buckets
is chosen so that one holds a file or two. A batch first stages everything it will write,
under its own name, and then puts the staged buckets in place. A lost batch is simply
repeated by its stream's checkpoint: one that was not staged to the end left the state
alone and is computed again, one that was is put in place again, which changes nothing.
One writer per folder at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adledger.session import FREE_SHUFFLES, TIGHT, setting

BUCKETS = 64


class StateTable:
    """The current rows of one kind, one per ``key``."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.columns = schema.names
        self.schema = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
        spark.createDataFrame([], self.schema).write.mode("ignore").partitionBy("bucket").parquet(self.path)

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self._rows().select(*self.columns)

    def near(self, keys: DataFrame, key: str) -> DataFrame:
        """All rows of the buckets that ``keys`` fall in; partitions are pruned before the scan."""
        touched = [r["bucket"] for r in keys.select(self.bucket(key)).distinct().collect()]  # at most ``buckets`` numbers
        return self._rows().filter(F.col("bucket").isin(touched)).select(*self.columns)

    def put(self, rows: DataFrame) -> None:
        """Replace the buckets that occur in ``rows`` by these rows, which must be whole buckets.

        Whole rows take far more room in a shuffle than in a table, so even and odd buckets go
        one after the other; ``rows`` is read twice.
        """
        placed = rows.select(*self.columns, self.bucket(self.key))
        for half in range(2):
            part = placed.filter(F.col("bucket") % 2 == half).repartition("bucket")
            with setting(part.sparkSession, FREE_SHUFFLES, "true"):
                part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(
                    self.path, compression=TIGHT)


class Staged:
    """What a batch writes: next rows of a state table's touched buckets, and rows for logs by day."""

    def __init__(self, state: DataFrame, **logs: DataFrame) -> None:
        self.state, self.logs = state, logs


class BatchFolder:
    """A folder with one state table and the logs of its batches."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.state = StateTable(spark, f"{self.root}/state", schema, key, buckets)

    def _complete(self, path: str) -> bool:
        """Did the job that wrote ``path`` end?"""
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def apply(self, version: str, compute: Callable[[], Staged]) -> None:
        """Stage and put in place the batch named ``version``; repeating it has no further effect.

        Logs are written first and the staged state last, so its end is the end of all.
        """
        staged = f"{self.root}/staged/batch={version}"
        if not self._complete(staged):
            batch = compute()
            for name, rows in batch.logs.items():
                with setting(rows.sparkSession, FREE_SHUFFLES, "true"):
                    rows.withColumn("run_date", F.to_date("captured_at")).write.mode("overwrite").partitionBy("run_date").parquet(
                        f"{self.root}/{name}/batch={version}", compression=TIGHT)
            with setting(batch.state.sparkSession, FREE_SHUFFLES, "true"):
                batch.state.write.mode("overwrite").parquet(staged, compression=TIGHT)
        self.state.put(self.spark.read.schema(T.StructType(self.state.schema.fields[:-1])).parquet(staged))

    def log(self, name: str, columns: T.StructType) -> DataFrame:
        """Rows of all batches; ``batch`` and ``run_date`` prune partitions."""
        whole = T.StructType([*columns.fields, T.StructField("batch", T.StringType()), T.StructField("run_date", T.DateType())])
        path = f"{self.root}/{name}"
        self.spark.createDataFrame([], whole).write.mode("ignore").partitionBy("batch", "run_date").parquet(path)
        return self.spark.read.schema(whole).parquet(path)
