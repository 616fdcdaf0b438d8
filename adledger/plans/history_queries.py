"""Checks of snapshot histories and availability on the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adledger.functions.availability import is_stale
from adledger.operators import availability, history
from adledger.operators.clusters import unknown_ids
from adledger.plans.bindings import EVENTS, INSTANT_SQL, events, instant, sql
from adledger.plans.registry import Registry

registry = Registry()
E = f"WITH e AS ({sql(EVENTS, 'events')})"
T = INSTANT_SQL.format
NOW = "2024-02-01 00:00:00"

RUNS = f"""{E}, a AS (SELECT *, change_type = 'unchanged' AS calm,
  lag(change_type = 'unchanged', 1, false) OVER w AS calm_before FROM e
  WINDOW w AS (PARTITION BY listing_id ORDER BY captured_at, id)),
b AS (SELECT *, sum(CASE WHEN calm AND calm_before THEN 0 ELSE 1 END)
  OVER (PARTITION BY listing_id ORDER BY captured_at, id) AS run FROM a),
r AS (SELECT listing_id, run, min(captured_at) AS captured_at, min(id) AS id,
  max(captured_at) AS until_at, any_value(change_type) AS change_type,
  count(*) AS count FROM b GROUP BY 1, 2),
h AS (SELECT r.*, e.price_eur, e.mileage_km FROM r JOIN e USING (listing_id, id))"""
RUN_COLUMNS = f"""listing_id, h.id, {T('h.captured_at')} AS captured_at, {T('until_at')} AS until_at,
  h.change_type, h.price_eur, h.mileage_km, h.count, h.count > 1 AS is_collapsed"""


def _show(df: DataFrame, *times: str) -> DataFrame:
    return df.withColumns({t: instant(t) for t in times})


@registry.add("o_win_1", f"{RUNS} SELECT {RUN_COLUMNS} FROM h")
def collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(history.collapse_unchanged(events(spark, sf_dir)), "captured_at", "until_at")


@registry.add("o_win_2", f"""{RUNS}, n AS (SELECT *, row_number() OVER (PARTITION BY listing_id
  ORDER BY captured_at DESC, id DESC) AS rn FROM h)
SELECT {RUN_COLUMNS} FROM n AS h WHERE rn <= 20""")
def capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = history.collapse_unchanged(events(spark, sf_dir))
    return _show(history.last_entries(runs, 20), "captured_at", "until_at")


SERIES = """p AS (SELECT *, lag(price_eur) OVER w AS before, row_number() OVER w AS rn FROM e
  WHERE price_eur IS NOT NULL WINDOW w AS (PARTITION BY listing_id ORDER BY captured_at, id)),
s AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY captured_at, id) AS point
  FROM p WHERE rn = 1 OR before <> price_eur),
c AS (SELECT *, count(*) OVER (PARTITION BY listing_id) AS n FROM s)"""


@registry.add("o_win_3", f"""{E}, {SERIES} SELECT listing_id, id, {T('captured_at')} AS captured_at,
  price_eur, cast(point AS int) AS point FROM c WHERE n >= 2""")
def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(history.price_series(events(spark, sf_dir)), "captured_at")


FLIPS = """f AS (SELECT *, lag(is_online) OVER (PARTITION BY listing_id ORDER BY captured_at, id)
  AS before FROM e), t AS (SELECT * FROM f WHERE before IS NULL OR before <> is_online)"""


@registry.add("o_win_4", f"""{E}, {FLIPS} SELECT listing_id, id, {T('captured_at')} AS captured_at,
  is_online FROM t""")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(history.status_transitions(events(spark, sf_dir)), "captured_at").select(
        "listing_id", "id", "captured_at", "is_online")


@registry.add("o_win_5", f"""{RUNS}, {FLIPS}, u AS (
  SELECT listing_id, captured_at, id, 0 AS origin, change_type, price_eur, mileage_km FROM h
  UNION ALL SELECT listing_id, captured_at, id, 1,
    CASE WHEN is_online THEN 'came_online' ELSE 'went_offline' END, NULL, NULL FROM t)
SELECT listing_id, {T('captured_at')} AS captured_at, id, origin, change_type, price_eur, mileage_km,
  price_eur - lag(price_eur) OVER w AS price_delta,
  mileage_km - lag(mileage_km) OVER w AS mileage_delta
FROM u WINDOW w AS (PARTITION BY listing_id ORDER BY captured_at, origin, id)""")
def merged_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = events(spark, sf_dir)
    merged = history.timeline(
        history.collapse_unchanged(snapshots), history.status_transitions(snapshots))
    return _show(merged, "captured_at")


@registry.add("o_win_6", f"""{E} SELECT listing_id, max(id) AS id, {T('max(captured_at)')} AS captured_at,
  arg_max(is_online, captured_at) AS is_online FROM e GROUP BY 1""")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(history.latest_status(events(spark, sf_dir)), "captured_at").select(
        "listing_id", "id", "captured_at", "is_online")


@registry.add("o_agg_5", f"""{E}, s AS (SELECT listing_id, {T('min(captured_at)')} AS first_seen_at,
  {T('max(captured_at)')} AS last_seen_at,
  count(*) FILTER (WHERE change_type = 'price_change') AS price_changes,
  count(*) FILTER (WHERE change_type = 'metadata_change') AS metadata_changes,
  count(*) FILTER (WHERE change_type = 'manual_override') AS manual_overrides,
  arg_min(price_eur, captured_at) FILTER (WHERE price_eur IS NOT NULL) AS first_price_eur,
  arg_max(price_eur, captured_at) FILTER (WHERE price_eur IS NOT NULL) AS current_price_eur,
  min(price_eur) AS price_min_eur, max(price_eur) AS price_max_eur, count(*) AS snapshot_count
  FROM e GROUP BY 1)
SELECT *, round((current_price_eur - first_price_eur) / nullif(first_price_eur, 0) * 100, 1)
  AS change_pct FROM s""")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(history.history_summary(events(spark, sf_dir)), "first_seen_at", "last_seen_at")


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest check per listing, as the cached status table."""
    return history.latest_status(events(spark, sf_dir)).select(
        "listing_id", "is_online", F.col("captured_at").alias("last_checked_at"), "http_status",
        F.lit(None).cast("string").alias("error_message"))


STATUS = f"""{E}, l AS (SELECT *, row_number() OVER (PARTITION BY listing_id
  ORDER BY captured_at DESC, id DESC) AS rn FROM e),
st AS (SELECT listing_id, is_online, captured_at AS last_checked_at, http_status FROM l WHERE rn = 1)"""


@registry.add("o_srt_4", f"""{STATUS} SELECT listing_id, {T('last_checked_at')} AS last_checked_at
FROM st WHERE NOT is_online ORDER BY st.last_checked_at DESC, listing_id LIMIT 10""")
def recent_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = availability.recent_statuses(_statuses(spark, sf_dir), is_online=False, limit=10)
    return _show(recent, "last_checked_at").select("listing_id", "last_checked_at")


# listings of the availability view: one per customer key, some never checked
VIEW = "SELECT DISTINCT 'u_' || cast(o_custkey AS varchar) AS listing_id, 'shop' AS source FROM orders"


@registry.add("o_jon_3", f"""{STATUS}, v AS ({VIEW}) SELECT listing_id, v.source,
  coalesce(st.is_online, true) AS is_online, {T('st.last_checked_at')} AS last_checked_at,
  st.http_status FROM st FULL JOIN v USING (listing_id)""")
def status_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    shop = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "concat('u_', cast(o_custkey as string)) AS id", "'shop' AS source", "'' AS url",
        "'' AS title").distinct()
    view = availability.status_view(_statuses(spark, sf_dir), shop)
    return _show(view, "last_checked_at").select(
        "listing_id", "source", "is_online", "last_checked_at", "http_status")


AGE = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(captured_at)) / 1e6"


@registry.add("o_flt_6", f"{E} SELECT id, {AGE} >= 300 AS due FROM e")
def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        "id", is_stale(F.col("captured_at"), F.lit(NOW).cast("timestamp_ntz")).alias("due"))


CUT = "timestamp '2024-01-15 00:00:00'"


@registry.add("o_agg_9", f"""{STATUS}, r AS (SELECT *, last_checked_at < {CUT} AS skipped FROM st)
SELECT count(*) FILTER (WHERE NOT skipped) AS checked, count(*) FILTER (WHERE skipped) AS skipped,
  count(*) FILTER (WHERE is_online) AS online,
  count(*) FILTER (WHERE NOT is_online AND (skipped OR http_status IS NOT NULL)) AS offline,
  count(*) FILTER (WHERE NOT is_online AND NOT skipped AND http_status IS NULL) AS failed,
  count(*) AS total FROM r""")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _statuses(spark, sf_dir).withColumn(
        "skipped", F.expr("last_checked_at < timestamp_ntz '2024-01-15 00:00:00'"))
    return availability.health_summary(results)


@registry.add("o_agg_10", f"""{STATUS}, m AS (SELECT min(last_checked_at) AS oldest FROM st)
SELECT cast(greatest(0, round_even(least(300, min(300 - (epoch_us(oldest + INTERVAL 60 SECOND)
  - epoch_us(last_checked_at)) / 1e6)), 0)) AS int) AS cache_remaining_seconds FROM st, m""")
def expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses = _statuses(spark, sf_dir)
    oldest = statuses.agg(F.min("last_checked_at")).scalar()
    timed = statuses.withColumn("now", oldest + F.expr("INTERVAL 60 SECOND"))
    return availability.cache_expiry(
        timed.withColumn("last_checked_at", F.col("last_checked_at").cast("timestamp")),
        F.col("now").cast("timestamp"))


@registry.add("o_ups_5", f"""{E}, {FLIPS}, day AS (SELECT *, captured_at < {CUT} AS old FROM e),
a AS (SELECT listing_id, arg_max(is_online, captured_at) AS was FROM day WHERE old GROUP BY 1),
b AS (SELECT listing_id, arg_max(is_online, captured_at) AS now, max(captured_at) AS at
  FROM day WHERE NOT old GROUP BY 1)
SELECT listing_id, coalesce(now, was) AS is_online,
  now IS NOT NULL AND (was IS NULL OR was <> now) AS flipped FROM a FULL JOIN b USING (listing_id)""")
def status_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = events(spark, sf_dir)
    cut = F.expr("timestamp_ntz '2024-01-15 00:00:00'")

    def last(df: DataFrame) -> DataFrame:
        return history.latest_status(df).select(
            "listing_id", "is_online", F.col("captured_at").alias("last_checked_at"),
            "http_status", F.lit(None).cast("string").alias("error_message"))

    merged, flips = availability.upsert_status(
        last(checks.filter(F.col("captured_at") < cut)),
        last(checks.filter(F.col("captured_at") >= cut)))
    return merged.join(
        flips.select("listing_id", F.lit(True).alias("f")), "listing_id", "left"
    ).select("listing_id", "is_online", F.coalesce("f", F.lit(False)).alias("flipped"))


@registry.add("o_set_4", f"""{E}, v AS ({VIEW}) SELECT listing_id FROM v
WHERE listing_id NOT IN (SELECT listing_id FROM e)""")
def never_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    shop = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "concat('u_', cast(o_custkey as string)) AS listing_id")
    checked = events(spark, sf_dir).select(F.col("listing_id").alias("id")).distinct()
    return unknown_ids(shop, checked).withColumnRenamed("id", "listing_id")
