"""Availability: classify captured check results, track status, report it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adledger import lexicon as lx
from adledger.functions.availability import is_gone_page, is_stale
from adledger.functions.identity import identity_token, url_join
from adledger.functions.text import blank_to_null
from adledger.operators.graph import follow
from adledger.operators.skew import lookup
from adledger.session import written


def _captured(captures: DataFrame) -> DataFrame:
    """Per captured URL its own verdict, and where a same-offer redirect leads.

    ``captures``: url, http_status, location_header, body, confirmed, error; one row
    per URL (``confirmed``: structured data says in stock).
    """
    status = F.col("http_status")
    target = url_join(F.col("url"), F.col("location_header"))
    redirected = status.between(300, 399) & blank_to_null(F.col("location_header")).isNotNull()
    same_offer = F.coalesce(identity_token(F.col("url")) == identity_token(target), F.lit(False))
    gone = status.between(200, 299) & is_gone_page(F.col("body"), F.col("confirmed"))
    failed = status.isNull()
    return captures.select(
        "url",
        F.when(redirected & same_offer, target).alias("next_url"),
        F.when(gone, F.lit(410)).otherwise(status).alias("status"),
        F.when(gone, F.lit("not found body"))
        .when(failed, F.coalesce("error", F.lit("all methods failed"))).alias("error"),
    )


def classify_checks(checks: DataFrame, captures: DataFrame, *, max_pages: int | None = lx.MAX_REDIRECT_HOPS) -> DataFrame:
    """Verdict per check ``(listing_id, url, checked_at)`` from captured pages.

    Redirects that keep the offer's identity are followed through the capture table, over at
    most ``max_pages`` pages (None: to the end); every other redirect means the offer is gone.
    A chain without an end in reach is a "redirect loop".
    Adds ``http_status, error_message, final_url, is_online``.
    """
    # bodies are read once; pages are followed by number, not by address, and one that was not captured has none
    table = written(written(_captured(captures)).withColumn("no", F.monotonically_increasing_id()))
    limit = None if max_pages is None else max_pages - 1
    led = table.filter(F.col("next_url").isNotNull()).select("no", "next_url")
    numbers = table.select(F.col("url").alias("next_url"), F.col("no").alias("next"))
    led = written(lookup(led, numbers, "next_url", "no").withColumn("next", F.coalesce("next", -1 - F.col("no"))))
    jumps = follow(led.select(F.col("no").alias("node"), "next"), limit)
    addresses = table.select("no", "url")
    named = led.filter("next < 0").select(F.col("next").alias("no"), F.col("next_url").alias("url")).unionByName(addresses)
    jumps = lookup(jumps.drop("first").join(led.withColumnRenamed("no", "node").select("node", F.col("next_url").alias("first")), "node")
                   .join(addresses.withColumnRenamed("no", "node"), "node"),
                   named.select(F.col("no").alias("target"), F.col("url").alias("_end")), "target", "node")
    ends = table.select(F.col("no").alias("target"), F.col("status").alias("_status"), F.col("error").alias("_error"), F.lit(True).alias("_seen"))
    # a chain cut by the limit may still point at a redirecting page
    lost = F.col("looped") if limit is None else F.col("looped") | (F.col("hops") > limit)
    status = F.when(~lost, F.col("_status"))
    followed = lookup(jumps, ends, "target", "url").select(
        "url", status.alias("status"),
        F.when(lost, F.lit("redirect loop")).when(F.col("_seen").isNull(), F.lit("not captured")).otherwise(F.col("_error")).alias("error"),
        F.when(status.between(200, 299), F.col("_end")).otherwise(F.col("first")).alias("final"))
    direct = table.filter(F.col("next_url").isNull()).select(
        "url", "status", "error", F.when(F.col("status").between(200, 299), F.col("url")).alias("final"))
    verdicts = direct.unionByName(followed).withColumnRenamed("url", "_url").withColumn("_known", F.lit(True))
    asked = checks.withColumn("_url", blank_to_null(F.col("url")))
    found = lookup(asked.filter(F.col("_url").isNotNull()), verdicts, "_url", "listing_id")
    blank = asked.filter(F.col("_url").isNull())
    told = found.select(
        *checks.columns, F.col("status").alias("http_status"),
        F.when(F.col("_known").isNull(), F.lit("not captured")).otherwise(F.col("error")).alias("error_message"),
        F.col("final").alias("final_url"),
    ).unionByName(blank.select(
        *checks.columns, F.lit(None).cast("int").alias("http_status"), F.lit("empty URL").alias("error_message"),
        F.lit(None).cast("string").alias("final_url")))
    return told.withColumn("is_online", F.coalesce(F.col("http_status").between(200, 299), F.lit(False)))


def due_checks(listings: DataFrame, statuses: DataFrame, now: Column, *, force: bool = False):
    """Listings with their cached status and ``due``: must they be checked again?"""
    cached = statuses.select(
        F.col("listing_id").alias("id"), F.col("is_online").alias("cached_online"),
        "last_checked_at",
    )
    return listings.join(cached, "id", "left").withColumn(
        "due", is_stale(F.col("last_checked_at"), now, force=force)
    )


def adopt_urls(listings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Online checks that ended at another address of the same offer rewrite the URL."""
    moved = verdicts.filter(F.col("is_online") & F.col("final_url").isNotNull()).select(
        F.col("listing_id").alias("id"), F.col("final_url").alias("_final")
    )
    return listings.join(moved, "id", "left").withColumn(
        "url", F.coalesce("_final", "url")
    ).select(*listings.columns)


def upsert_status(
    statuses: DataFrame, verdicts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Latest status per listing and the transition rows to append.

    ``statuses`` and ``verdicts``: listing_id, is_online, last_checked_at, http_status,
    error_message; one verdict per listing and run.
    """
    before = statuses.select("listing_id", F.col("is_online").alias("_before"),
                             F.lit(True).alias("_known"))
    flips = verdicts.join(before, "listing_id", "left").filter(
        F.col("_known").isNull() | (F.col("_before") != F.col("is_online"))
    ).select(
        "listing_id", F.col("last_checked_at").alias("captured_at"), "is_online", "http_status",
        "error_message",
    )
    kept = statuses.join(verdicts.select("listing_id"), "listing_id", "left_anti")
    return kept.unionByName(verdicts.select(*statuses.columns)), flips


def status_view(statuses: DataFrame, listings: DataFrame) -> DataFrame:
    """Every status with its listing, and never-checked listings as online."""
    known = listings.select(F.col("id").alias("listing_id"), "url", "title", "source")
    return statuses.join(known, "listing_id", "full").select(
        "listing_id", "url", "title", "source",
        F.coalesce("is_online", F.lit(True)).alias("is_online"),
        "last_checked_at", "http_status", "error_message",
    )


def recent_statuses(
    statuses: DataFrame, *, is_online: bool | None = None, limit: int | None = None
) -> DataFrame:
    """The checked statuses, newest first; with ``limit`` a top-k report."""
    chosen = statuses if is_online is None else statuses.filter(F.col("is_online") == is_online)
    ordered = chosen.orderBy(F.col("last_checked_at").desc(), "listing_id")
    return ordered if limit is None else ordered.limit(limit)


def health_summary(results: DataFrame) -> DataFrame:
    """One row of counts; ``results`` has ``skipped, is_online, http_status``.

    Skipped rows count by their cached flag; a checked row without any HTTP status
    has failed and is neither online nor offline.
    """
    online = F.coalesce("is_online", F.lit(False))
    answered = F.col("skipped") | F.col("http_status").isNotNull()
    return results.agg(
        F.count_if(~F.col("skipped")).alias("checked"),
        F.count_if("skipped").alias("skipped"),
        F.count_if(online).alias("online"),
        F.count_if(~online & answered).alias("offline"),
        F.count_if(~online & ~answered).alias("failed"),
        F.count("*").alias("total"),
    )


def cache_expiry(statuses: DataFrame, now: Column) -> DataFrame:
    """One row: seconds until the first cached status expires (half-even rounding)."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("last_checked_at").try_cast("timestamp"))) / 1e6
    ttl = F.lit(float(lx.STATUS_TTL_SECONDS))
    least = F.least(ttl, F.coalesce(F.min(ttl - age), ttl))
    return statuses.agg(
        F.greatest(F.lit(0), F.bround(least, 0).cast("int")).alias("cache_remaining_seconds")
    )
