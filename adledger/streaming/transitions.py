"""Availability checks as a stream: transitions, expiry and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from adledger import lexicon as lx
from adledger.operators.history import latest_status, status_transitions
from adledger.session import written
from adledger.sources.state_table import BUCKETS, BatchFolder, Staged
from adledger.streaming.ingest import batch_version

TRANSITION = T.StructType([
    T.StructField("listing_id", T.StringType()),
    T.StructField("captured_at", T.TimestampType()),
    T.StructField("id", T.LongType()),
    T.StructField("is_online", T.BooleanType()),
])


def check_folder(spark: SparkSession, root: str, buckets: int = BUCKETS) -> BatchFolder:
    """Latest check per listing with a log of the transitions."""
    return BatchFolder(spark, root, TRANSITION, "listing_id", buckets)


def track_checks(checks: DataFrame, folder: BatchFolder, checkpoint: str, **trigger) -> StreamingQuery:
    """Transitions of a stream of checks, and the latest check of each listing as its state.

    A micro-batch reads the statuses of the buckets its listings fall in, and only those of its
    own listings enter the search for flips; it is done by columns, with a listing that fills a
    third of a batch spread by time, and nothing held per key in Python.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        def compute() -> Staged:
            rows = written(batch.select(*TRANSITION.names))
            known = folder.state.near(rows, "listing_id")
            own = known.join(rows.select("listing_id").distinct(), "listing_id", "left_semi")
            # the stored status is the row before the batch; it is no transition itself
            both = own.withColumn("_old", F.lit(True)).unionByName(rows.withColumn("_old", F.lit(False)))
            flips = status_transitions(both).filter(~F.col("_old")).drop("_old")
            return Staged(latest_status(known.unionByName(rows)), transitions=flips)

        folder.apply(batch_version(folder.spark, checkpoint, batch_id), compute)

    return checks.writeStream.foreachBatch(run).option(
        "checkpointLocation", checkpoint
    ).trigger(**(trigger or {"availableNow": True})).start()


def stream_expiry(checks: DataFrame, *, ttl: int = lx.STATUS_TTL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Listings of a check stream without a new check for ``ttl`` seconds: listing_id, last_checked_at.

    Each check keeps its listing's session open for ``ttl`` seconds of event time. When the
    watermark passes the end of a session, its state is dropped and the listing reported, once
    for each time it went stale, however the checks are cut into batches.
    """
    session = F.session_window("captured_at", f"{ttl} seconds").alias("s")
    return checks.withWatermark("captured_at", delay).groupBy("listing_id", session).agg(
        F.max("captured_at").alias("last_checked_at")).select("listing_id", "last_checked_at")


def windowed_counts(checks: DataFrame, *, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Online and offline checks per tumbling window.

    In a stream, a window is reported and its state dropped when the watermark, ``delay`` behind
    the newest check, passes its end; later checks of it are dropped.
    """
    watched = checks.withWatermark("captured_at", delay) if checks.isStreaming else checks
    return watched.groupBy(F.window("captured_at", width).alias("w")).agg(
        F.count_if("is_online").alias("online"), F.count_if(~F.col("is_online")).alias("offline"),
    ).select(F.col("w.start").alias("window_start"), "online", "offline")
