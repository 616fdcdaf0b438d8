"""Feed order, summaries, distributions and the cluster group view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adledger import lexicon as lx
from adledger.functions.text import blank_to_null
from adledger.session import written
from adledger.operators.scan import values_at


def state_order() -> list[Column]:
    return [F.coalesce("price_eur", F.lit(lx.MISSING_PRICE_LAST)).asc(), F.col("id").asc()]


def feed_order() -> list[Column]:
    """Best score first, then dearest; remaining ties in state order."""
    return [F.col("score").desc(), F.coalesce("price_eur", F.lit(0)).desc(), *state_order()]


def list_order(name: str = "score-desc") -> list[Column]:
    """The ranking page's orders; expects ``status``, ``my_score``, ``created_at`` as needed.

    Price and mileage of 0 count as missing. Ties fall back to ``id``.
    """
    status = (
        F.when(F.col("status") == "online", F.lit(1))
        .when(F.col("status") == "offline", F.lit(2)).otherwise(F.lit(3))
    )
    my_score = F.coalesce("my_score", F.lit(0))
    last = F.lit(lx.MISSING_PRICE_LAST)
    price, km = F.nullif(F.col("price_eur"), F.lit(0)), F.nullif(F.col("mileage_km"), F.lit(0))
    registered = blank_to_null(F.col("first_registration"))
    created = F.coalesce(F.col("created_at").cast("string"), F.lit(""))
    orders = {
        "status-online": lambda: status.asc(),
        "status-offline": lambda: status.desc(),
        "score-asc": lambda: my_score.asc(),
        "score-desc": lambda: my_score.desc(),
        "price-asc": lambda: F.coalesce(price, last).asc(),
        "price-desc": lambda: F.coalesce(price, F.lit(0)).desc(),
        "mileage-asc": lambda: F.coalesce(km, last).asc(),
        "mileage-desc": lambda: F.coalesce(km, F.lit(0)).desc(),
        "ez-asc": lambda: F.coalesce(registered, F.lit("ZZZZ")).asc(),
        "ez-desc": lambda: F.coalesce(registered, F.lit("")).desc(),
        "created-desc": lambda: created.desc(),
        "created-asc": lambda: created.asc(),
        "source": lambda: F.coalesce("source", F.lit("")).asc(),
    }
    return [orders.get(name, orders["score-desc"])(), F.col("id").asc()]


def static_order(name: str) -> list[Column]:
    """Orders of the static listing page (score, price, mileage)."""
    return list_order_static[name]() + [F.col("id").asc()]


list_order_static = {
    "score": lambda: [F.coalesce("score", F.lit(0)).desc()],
    "price-asc": lambda: [F.coalesce("price_eur", F.lit(lx.MISSING_PRICE_LAST)).asc()],
    "price-desc": lambda: [F.coalesce("price_eur", F.lit(0)).desc()],
    "mileage-asc": lambda: [F.coalesce("mileage_km", F.lit(lx.MISSING_PRICE_LAST)).asc()],
}


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """Total order with a dense ``rank`` from 1, without a single-task window.

    The range-partitioned sort is made written once, so that counting its
    partitions and numbering its rows see the same layout. The offsets table has
    one row per partition.
    """
    placed = df.orderBy(*order).withColumns({
        "_part": F.spark_partition_id(),
        "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
    })
    placed = written(placed)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(
        "rank", F.col("_off") + F.col("_at") + 1
    ).drop("_part", "_at", "_off")


def feed_summary(listings: DataFrame) -> DataFrame:
    """One row: counts by change type, risk count, price and mileage statistics."""
    kind, price = F.col("change_type"), F.col("price_eur")
    flagged = F.size(F.coalesce("risk_flags", F.array().cast("array<string>"))) > 0
    return listings.agg(
        F.count("*").alias("total_active"),
        F.count_if(kind == "new").alias("new_listings"),
        F.count_if(~kind.isin("new", "unchanged")).alias("changed_listings"),
        F.count_if(kind == "price_change").alias("price_changes"),
        F.count_if(flagged).alias("risk_warnings"),
        F.bround(F.avg(price), 0).cast("int").alias("avg_price_eur"),
        F.min(price).alias("min_price_eur"), F.max(price).alias("max_price_eur"),
        F.bround(F.avg("mileage_km"), 0).cast("int").alias("avg_mileage_km"),
    )


def median_price(listings: DataFrame) -> DataFrame:
    """Exact median, mean of the middle pair, truncated; no task holds all values."""
    middle = values_at(listings, "price_eur", {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2)})
    return middle.select(((F.col("low").cast("bigint") + F.col("high")) / 2).cast("int").alias("median_price_eur"))


def distribution(listings: DataFrame, key: str) -> DataFrame:
    label = F.coalesce(blank_to_null(F.col(key).cast("string")), F.lit(lx.NOT_AVAILABLE))
    return listings.groupBy(label.alias("label")).agg(F.count("*").alias("count")).orderBy(
        F.col("count").desc(), "label"
    )


def cluster_primary(listings: DataFrame) -> DataFrame:
    """Per cluster the member to show: online first, then score, then smaller id."""
    group = F.coalesce(blank_to_null(F.col("cluster_id")), F.col("id"))
    order = F.struct(
        ~F.coalesce(F.col("status") == "online", F.lit(False)),
        -F.coalesce("score", F.lit(0)), F.col("id"),
    )
    return listings.groupBy(group.alias("group_id")).agg(F.min_by("id", order).alias("primary_id"))


def cluster_groups(listings: DataFrame) -> DataFrame:
    """Group view: primary, number of offers, sources in order of first member.

    ``pos`` is the display position. Sources collapse per (group, source) before
    they meet, so a huge cluster adds one row per source.
    """
    group = F.coalesce(blank_to_null(F.col("cluster_id")), F.col("id")).alias("group_id")
    per_source = listings.groupBy(group, "source").agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos")
    )
    named = F.when(blank_to_null(F.col("source")).isNotNull(), F.struct("first_pos", "source"))
    return per_source.groupBy("group_id").agg(
        F.sum("n").alias("offer_count"), F.min("first_pos").alias("pos"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(named)), lambda s: s["source"]), " + "
        ).alias("source_summary"),
    ).join(cluster_primary(listings), "group_id")
