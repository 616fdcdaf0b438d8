"""Continuous crawl: every micro-batch of captured pages or listings is one run."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from adledger.plans.batch import run_listings, run_pages, store_run
from adledger.sources.state_table import BatchFolder


def batch_version(spark: SparkSession, checkpoint: str, batch_id: int) -> str:
    """Name of a micro-batch: the query's own id, kept with its offsets, and the batch number.

    A query with a new offsets folder counts from 0 again, but under a new id.
    """
    meta = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()["value"]
    return f"{json.loads(meta)['id']}-{batch_id:012d}"


def _run_time(captured_at: Callable | None, batch_id: int) -> Column:
    """One time for all rows of a batch."""
    return F.lit(datetime.now(UTC)) if captured_at is None else captured_at(batch_id)


def ingest_listings(
    stream: DataFrame, folder: BatchFolder, checkpoint: str, *,
    captured_at: Callable | None = None, **trigger,
) -> StreamingQuery:
    """Upsert a stream of normalized listings; a repeated batch has no further effect.

    A batch is named after query and batch number; what it staged under that name is put in
    place again if the driver was lost in between.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        at = _run_time(captured_at, batch_id)
        store_run(folder, batch_version(folder.spark, checkpoint, batch_id),
                  lambda: run_listings(batch, folder.state.read(), at))

    return stream.writeStream.foreachBatch(run).option(
        "checkpointLocation", checkpoint
    ).trigger(**(trigger or {"availableNow": True})).start()


def ingest_pages(
    stream: DataFrame, folder: BatchFolder, checkpoint: str, *,
    captured_at: Callable | None = None, sources: list[str] | None = None, **trigger,
) -> StreamingQuery:
    """Extract, normalize, resolve and store a stream of captured pages."""
    def run(batch: DataFrame, batch_id: int) -> None:
        version = batch_version(folder.spark, checkpoint, batch_id)
        run_pages(batch, folder, _run_time(captured_at, batch_id), version, sources=sources)

    return stream.writeStream.foreachBatch(run).option(
        "checkpointLocation", checkpoint
    ).trigger(**(trigger or {"availableNow": True})).start()
