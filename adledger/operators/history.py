"""Histories of all listings at once: runs, series, summaries, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adledger.operators.scan import PART, in_ranges, part_starts, running
from adledger.operators.skew import lag_in_blocks
from adledger.session import written

# snapshots: listing_id, captured_at, id, price_eur, mileage_km, change_type


def _order() -> list[Column]:
    return [F.col("captured_at"), F.col("id")]


def _ranged(rows: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Rows in range partitions of (listing, time): a listing of any length is spread by its order."""
    return in_ranges(rows, ["listing_id"], order or _order())


def collapse_unchanged(snapshots: DataFrame) -> DataFrame:
    """Consecutive ``unchanged`` snapshots become one entry; others pass through.

    Runs are found inside range partitions first. Only the first and the last run of a
    listing in a partition can continue in a neighbour, so stitching looks at two rows per
    partition and never at a whole long history in one task.
    """
    calm = F.col("change_type") == "unchanged"
    inside = W.partitionBy("listing_id", PART).orderBy(*_order())
    starts = ~(calm & F.coalesce(F.lag(calm).over(inside), F.lit(False)))
    local = (
        _ranged(snapshots).withColumn("_start", starts.cast("int"))
        .withColumn("_run", F.sum("_start").over(inside))
        .groupBy("listing_id", PART, "_run")
        .agg(
            F.min_by(F.struct("change_type", "price_eur", "mileage_km"),
                     F.struct(*_order())).alias("head"),
            F.min(F.struct(*_order())).alias("begin"),
            F.max("captured_at").alias("until_at"),
            F.count("*").alias("count"),
        )
    )
    per_part = W.partitionBy("listing_id", PART)
    edge = (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(per_part))
    local = local.withColumn("_edge", edge)
    stitched = W.partitionBy(
        "listing_id", F.when(~F.col("_edge"), F.col(PART)), "_edge"
    ).orderBy("begin")
    local_calm = F.col("head.change_type") == "unchanged"
    continues = (
        F.col("_edge") & (F.col("_run") == 1) & local_calm
        & F.coalesce(F.lag(local_calm).over(stitched), F.lit(False))
    )
    return (
        local.withColumn("_new", (~continues).cast("int"))
        .withColumn("_group", F.sum("_new").over(stitched))
        .groupBy(
            "listing_id", "_edge", F.when(~F.col("_edge"), F.col(PART)).alias("_b"), "_group"
        )
        .agg(
            F.min_by("head", "begin").alias("head"), F.min("begin").alias("begin"),
            F.max("until_at").alias("until_at"), F.sum("count").alias("count"),
        )
        .select(
            "listing_id", F.col("begin.captured_at").alias("captured_at"),
            F.col("begin.id").alias("id"), "until_at",
            "head.change_type", "head.price_eur", "head.mileage_km", "count",
            (F.col("count") > 1).alias("is_collapsed"),
        )
    )


def last_entries(history: DataFrame, limit: int | None = None) -> DataFrame:
    """The latest ``limit`` entries per listing (cut down before the shuffle by Spark); all without one."""
    if limit is None:
        return history
    latest = W.partitionBy("listing_id").orderBy(
        F.col("captured_at").desc(), F.col("id").desc()
    )
    return history.withColumn("_rn", F.row_number().over(latest)).filter(
        F.col("_rn") <= limit
    ).drop("_rn")


def price_series(snapshots: DataFrame, limit: int | None = None) -> DataFrame:
    """Points where the price differs from the previous priced snapshot.

    The first ``limit`` points per listing if one is given, and none for a listing with a single one.
    """
    priced = _ranged(snapshots.filter("price_eur IS NOT NULL").select("listing_id", "captured_at", "id", "price_eur"))
    lagged = lag_in_blocks(
        priced, "listing_id", F.col(PART), _order(), {"_before": F.col("price_eur")}, first_flag="_first")
    points = written(lagged.filter(F.col("_first") | (F.col("_before") != F.col("price_eur"))).drop("_first", "_before"))
    # counts per listing and partition give both the number of a point and the number of all
    starts = part_starts(points, ["listing_id"])
    starts = starts.withColumn("_n", F.sum("_sum").over(W.partitionBy("listing_id")))
    numbered = running(points, starts, ["listing_id"], _order(), "point").filter("_n >= 2").drop("_n")
    numbered = numbered.withColumn("point", (F.col("point") + 1).cast("int"))
    return numbered if limit is None else numbered.filter(F.col("point") <= limit)


def history_summary(snapshots: DataFrame) -> DataFrame:
    """First and last sight, change counts and price range per listing."""
    when = F.struct(*_order())
    priced_when = F.when(F.col("price_eur").isNotNull(), when)

    def kinds(kind: str) -> Column:
        return F.count_if(F.col("change_type") == kind)

    first, current = F.min_by("price_eur", priced_when), F.max_by("price_eur", priced_when)
    return snapshots.groupBy("listing_id").agg(
        F.min("captured_at").alias("first_seen_at"), F.max("captured_at").alias("last_seen_at"),
        kinds("price_change").alias("price_changes"),
        kinds("metadata_change").alias("metadata_changes"),
        kinds("manual_override").alias("manual_overrides"),
        first.alias("first_price_eur"), current.alias("current_price_eur"),
        F.min("price_eur").alias("price_min_eur"), F.max("price_eur").alias("price_max_eur"),
        F.count("*").alias("snapshot_count"),
    ).withColumn("change_pct", F.round(
        (F.col("current_price_eur") - F.col("first_price_eur"))
        / F.nullif(F.col("first_price_eur"), F.lit(0)) * 100, 1))


def status_transitions(checks: DataFrame) -> DataFrame:
    """Checks that are the first of their listing or flip ``is_online``."""
    lagged = lag_in_blocks(
        _ranged(checks), "listing_id", F.col(PART), _order(),
        {"_before": F.col("is_online")}, first_flag="_first",
    ).drop(PART)
    return lagged.filter(
        F.col("_first") | ~F.col("_before").eqNullSafe(F.col("is_online"))
    ).drop("_first", "_before")


def latest_status(checks: DataFrame) -> DataFrame:
    """The last check of each listing; combined on the map side."""
    rest = [c for c in checks.columns if c != "listing_id"]
    return checks.groupBy("listing_id").agg(
        F.max_by(F.struct(*rest), F.struct(*_order())).alias("_row")
    ).select("listing_id", "_row.*")


def timeline(history: DataFrame, transitions: DataFrame) -> DataFrame:
    """Change entries and availability events in time order, with deltas.

    A delta compares with the entry right before, whatever its kind, and is null
    when either side has no value. At equal times change entries come first.
    """
    changes = history.select(
        "listing_id", "captured_at", "id", F.lit(0).alias("origin"), "change_type",
        "price_eur", "mileage_km",
    )
    events = transitions.select(
        "listing_id", "captured_at", "id", F.lit(1).alias("origin"),
        F.when(F.col("is_online"), F.lit("came_online")).otherwise(F.lit("went_offline"))
        .alias("change_type"),
        F.lit(None).cast("int").alias("price_eur"), F.lit(None).cast("int").alias("mileage_km"),
    )
    order = [F.col("captured_at"), F.col("origin"), F.col("id")]
    lagged = lag_in_blocks(
        _ranged(changes.unionByName(events), order), "listing_id", F.col(PART), order,
        {"_price": F.col("price_eur"), "_km": F.col("mileage_km")}, first_flag="_first",
    ).drop(PART)
    return lagged.withColumns({
        "price_delta": F.col("price_eur") - F.col("_price"),
        "mileage_delta": F.col("mileage_km") - F.col("_km"),
    }).drop("_price", "_km", "_first")
