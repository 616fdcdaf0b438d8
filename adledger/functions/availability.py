"""Is the offer behind a captured page still there?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adledger import lexicon as lx
from adledger.functions.text import text_or_empty


def is_gone_text(body: Column) -> Column:
    return body.rlike("(?iU)" + "|".join(f"(?:{p})" for p in lx.GONE_PATTERNS))


def has_live_veil(body: Column) -> Column:
    deleted, paused = lx.LIVE_VEILS
    return body.rlike(deleted) & body.rlike(paused)


def _same_address(a: Column, b: Column) -> Column:
    def norm(u: Column) -> Column:
        return F.regexp_replace(F.lower(F.trim(u)), "/+$", "")
    return norm(a) == norm(b)


def confirms_live(objects: Column, url: Column) -> Column:
    """Does structured data on the page say that this very offer is in stock?

    ``objects`` is the array of JSON objects of the page (see
    :func:`adledger.sources.markup.with_markup`), each as JSON text.
    """
    def one(text: Column) -> Column:
        kind = F.get_json_object(text, "$.@type")
        kinds = F.coalesce(F.from_json(kind, "array<string>"), F.array(kind))
        offer = F.coalesce(
            F.get_json_object(text, "$.offers[0].availability"),
            F.get_json_object(text, "$.offers.availability"),
        )
        return (
            F.arrays_overlap(kinds, F.array(*[F.lit(k) for k in lx.LISTING_TYPES]))
            & _same_address(F.get_json_object(text, "$.url"), url)
            & offer.contains(lx.IN_STOCK)
        )

    return F.coalesce(F.exists(objects, lambda t: F.coalesce(one(t), F.lit(False))), F.lit(False))


def is_gone_page(body: Column, confirmed: Column) -> Column:
    """Gone wording wins unless the page proves the offer live; veils win always."""
    body = text_or_empty(body)
    return is_gone_text(body) & (
        body.rlike(lx.GONE_VEILS) | ~(confirmed | has_live_veil(body))
    )


def is_block_page(body: Column, http_status: Column, server: Column) -> Column:
    """Challenge page of the protection vendor instead of the wanted page."""
    body = text_or_empty(body)
    titled = F.left(body, F.lit(500)).contains(lx.CHALLENGE_TITLE)
    head = F.left(body, F.lit(2000))
    challenge = titled & head.contains(lx.CHALLENGE_HOST) & body.contains(lx.CHALLENGE_TOKEN)
    vendor = (
        F.lower(text_or_empty(server)).contains(lx.CHALLENGE_VENDOR)
        | F.lower(head).contains(lx.CHALLENGE_VENDOR)
        | (
            head.contains(lx.CHALLENGE_TITLE)
            & (head.contains(lx.CHALLENGE_TOKEN) | head.contains(lx.CHALLENGE_HOST))
        )
    )
    return challenge | F.coalesce((http_status == 403) & vendor, F.lit(False))


def is_stale(last_checked: Column, now: Column, *, force: bool = False) -> Column:
    """Re-check when never checked, unreadable, or at least the TTL old."""
    checked = last_checked.try_cast("timestamp")
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(checked)) / 1e6
    return F.lit(force) | F.coalesce(age >= lx.STATUS_TTL_SECONDS, F.lit(True))
