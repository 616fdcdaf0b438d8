"""One tracking run: pages or listings in, next state, snapshots and feed out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adledger import schema
from adledger.operators.clusters import assign_clusters, enrich_clusters
from adledger.operators.enrichment import call_provider, enrichment_input, merge_results, provider_warnings
from adledger.operators.scoring import with_score
from adledger.operators.state import Upsert, upsert
from adledger.operators.validation import crawl_quality, quality_message
from adledger.session import written
from adledger.sources.pages import extract_listings, split_pages
from adledger.sources.state_table import BUCKETS, BatchFolder, Staged

STATE = T.StructType([
    *schema.LISTING.fields,
    T.StructField("created_at", T.TimestampType()),
    T.StructField("last_seen_at", T.TimestampType()),
])
SNAPSHOT = T.StructType([
    T.StructField("listing_id", T.StringType()),
    T.StructField("captured_at", T.TimestampType()),
    T.StructField("pos", T.LongType()),
    T.StructField("price_eur", T.IntegerType()),
    T.StructField("mileage_km", T.IntegerType()),
    T.StructField("change_type", T.StringType()),
    T.StructField("payload_json", T.StringType()),
])


class Run(NamedTuple):
    """What a run would write, and its warnings (``scope, message``)."""

    upsert: Upsert
    warnings: DataFrame


def run_listings(
    fresh: DataFrame, stored: DataFrame, captured_at: Column, *,
    overrides: DataFrame | None = None, provider=None, scoring: dict | None = None,
    max_images: int | None = None,
) -> Run:
    """Resolve, enrich, score and store one batch of listings (with ``pos``).

    Two written tables cut the lineage: after the cascade, whose result is read
    several times by the cluster exchange, and before the upsert.
    """
    clustered = written(assign_clusters(fresh, stored))
    enriched = enrich_clusters(clustered)
    warnings = crawl_quality(clustered).select("scope", quality_message().alias("message"))
    if provider is not None:
        results = written(call_provider(enrichment_input(enriched, max_images=max_images), provider))
        enriched = merge_results(enriched, results)
        warnings = warnings.unionByName(provider_warnings(results))
    scored = written(with_score(enriched, scoring))
    return Run(upsert(scored, stored, captured_at, overrides=overrides), warnings)


def run_pages(
    pages: DataFrame, folder: BatchFolder, captured_at: Column, version: str, *,
    sources: list[str] | None = None, overrides: DataFrame | None = None, provider=None,
    scoring: dict | None = None,
) -> DataFrame:
    """A whole run over captured pages; returns its warnings (``scope, message``).

    A run that had been staged before is only put in place; its warnings are those of the pages.
    """
    usable, problems = split_pages(pages, sources)
    listings = written(extract_listings(usable, scoring=scoring))
    told = [problems.select(F.col("source").alias("scope"), F.concat_ws(": ", "url", "problem").alias("message"))]

    def run() -> Run:
        result = run_listings(listings, folder.state.read(), captured_at, overrides=overrides, provider=provider, scoring=scoring)
        told.append(result.warnings)
        return result

    store_run(folder, version, run)
    return reduce(DataFrame.unionByName, told)


def with_prices(columns: T.StructType, prices: T.DataType) -> T.StructType:
    """``columns`` with all prices of type ``prices``."""
    return T.StructType([T.StructField(f.name, prices) if f.name in ("price_eur", "previous_price_eur") else f for f in columns])


def listing_folder(spark: SparkSession, root: str, buckets: int = BUCKETS, prices: T.DataType = T.IntegerType()) -> BatchFolder:
    """State of listings with a log of their snapshots; ``prices`` is the type that listings bring."""
    return BatchFolder(spark, root, with_prices(STATE, prices), "id", buckets)


def store_run(folder: BatchFolder, version: str, run: Callable[[], Run]) -> None:
    """Apply a run: its snapshots, and the buckets of the state that hold its ids."""
    def compute() -> Staged:
        result = run().upsert
        touched = folder.state.near(result.stored, "id")
        return Staged(result.merged_into(touched), snapshots=result.snapshots)

    folder.apply(version, compute)
