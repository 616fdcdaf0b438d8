"""Checks of the streaming forms: each stream ends and is read back as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adledger import schema
from adledger.operators.skew import shuffled
from adledger.plans import cluster_queries as cq
from adledger.plans import history_queries as hq
from adledger.plans.batch import SNAPSHOT, listing_folder, with_prices
from adledger.plans.bindings import EVENTS, instant, pairs, table
from adledger.plans.registry import Registry
from adledger.session import work_path
from adledger.streaming import ingest, transitions

registry = Registry()


def _check_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "events")
    return (
        spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
        .selectExpr(EVENTS["listing_id"] + " AS listing_id", "cast(ts as timestamp) AS captured_at",
                    "event_id AS id", EVENTS["is_online"] + " AS is_online")
    )


def _drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything there is now and read what it wrote."""
    out = work_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", work_path(spark, f"{name}-offsets")
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@registry.add("o_str_2", f"""{hq.E}, {hq.FLIPS} SELECT listing_id, id, is_online FROM t""")
def streamed_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = transitions.check_folder(spark, work_path(spark, "checks"))
    transitions.track_checks(_check_stream(spark, sf_dir), folder, work_path(spark, "checks-offsets")).awaitTermination()
    return folder.log("transitions", transitions.TRANSITION).select("listing_id", "id", "is_online")


# what a watermark ten minutes behind the newest check has passed
PASSED = "(SELECT max(captured_at) - INTERVAL 10 MINUTE FROM e)"


@registry.add("o_str_3", f"""{hq.E}, g AS (SELECT *, lead(captured_at) OVER (PARTITION BY listing_id ORDER BY captured_at, id) AS onward FROM e)
SELECT listing_id, {hq.T('captured_at')} AS last_checked_at FROM g
WHERE (onward IS NULL OR onward - captured_at >= INTERVAL 300 SECOND) AND captured_at + INTERVAL 300 SECOND <= {PASSED}""")
def streamed_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings that went stale, by event time: every time that no check came for 300 seconds."""
    stale = _drain(spark, transitions.stream_expiry(_check_stream(spark, sf_dir)), "stale")
    return stale.withColumn("last_checked_at", instant("last_checked_at"))


@registry.add("o_str_5", f"""{hq.E} SELECT {hq.T("date_trunc('hour', captured_at)")} AS window_start,
  count(*) FILTER (WHERE is_online) AS online, count(*) FILTER (WHERE NOT is_online) AS offline
FROM e GROUP BY date_trunc('hour', captured_at) HAVING date_trunc('hour', captured_at) + INTERVAL 1 HOUR <= {PASSED}""")
def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the windows that the watermark has closed."""
    counts = _drain(spark, transitions.windowed_counts(_check_stream(spark, sf_dir)), "counts")
    return counts.withColumn("window_start", instant("window_start"))


# a run over all pairs; then one over the odd rows only, whose cluster is found in the state
CLUSTERED = f"""{cq.CASCADE}, own AS (SELECT id, pos, source, price_eur, coalesce(cluster, 'singleton_' || k_full) AS cluster_id FROM c_legacy),
z AS (SELECT *, min(price_eur) OVER (PARTITION BY cluster_id) AS least FROM own)"""


@registry.add("o_str_1", f"""{CLUSTERED} SELECT id, cluster_id, least AS price_eur, 'new' AS change_type,
  cast(1 AS bigint) AS snapshots FROM z""")
def streamed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings arrive as a stream; state and snapshots are read back."""
    return _ingested(spark, sf_dir, ["true"])


@registry.add("o_str_4", f"""{CLUSTERED} SELECT id, cluster_id,
  CASE WHEN source = 'Kleinanzeigen' THEN price_eur ELSE least END AS price_eur,
  CASE WHEN source <> 'Kleinanzeigen' THEN 'new' WHEN price_eur <> least THEN 'price_change' ELSE 'unchanged' END AS change_type,
  cast(CASE WHEN source = 'Kleinanzeigen' THEN 2 ELSE 1 END AS bigint) AS snapshots FROM z""")
def repeated_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd rows arrive again: one state row each, their stored clusters adopted, prices against those of the cluster."""
    return _ingested(spark, sf_dir, ["true", "source = 'Kleinanzeigen'"])


def _ingested(spark: SparkSession, sf_dir: str, arrivals: list[str]) -> DataFrame:
    inbox, offsets = work_path(spark, "inbox"), work_path(spark, "offsets")
    folder = listing_folder(spark, work_path(spark, "listings"), prices=T.LongType())
    wide = pairs(spark, sf_dir).withColumnRenamed("price_eur", "wide_price")
    fresh = schema.conform(wide, keep=("pos", "wide_price")).drop("cluster_id", "price_eur").withColumnRenamed("wide_price", "price_eur")
    for some in arrivals:
        fresh.filter(some).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(fresh.schema).parquet(inbox)
        ingest.ingest_listings(stream, folder, offsets).awaitTermination()
    snaps = folder.log("snapshots", with_prices(SNAPSHOT, T.LongType())).groupBy(F.col("listing_id").alias("id")).agg(F.count("*").alias("snapshots"))
    rows = folder.state.read().join(shuffled(snaps), "id").select("id", "cluster_id", "price_eur", "change_type", "snapshots")
    # an integer like the SQL's while all prices fit; larger ones stay as they are
    top = folder.state.read().agg(F.max("price_eur")).first()[0] or 0
    return rows.withColumn("price_eur", F.col("price_eur").cast("int")) if top < 1 << 31 else rows
