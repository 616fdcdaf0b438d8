"""Conjunctive filters: the query-parameter set and the ranking page's set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adledger.functions.text import text_or_empty

_EXACT = ("source", "transmission", "trim", "body_style", "change_type", "accident_status")
_BOUNDS = {
    "price_min": ("price_eur", ">="), "price_max": ("price_eur", "<="),
    "mileage_min": ("mileage_km", ">="), "mileage_max": ("mileage_km", "<="),
    "score_min": ("score", ">="),
}
_YEARS = {
    "ez_min": ("first_registration", ">="), "ez_max": ("first_registration", "<="),
    "tuv_min": ("tuv_until", ">="),
}


def _compare(column: Column, op: str, value) -> Column:
    return column >= value if op == ">=" else column <= value


def no_risk() -> Column:
    return F.size(F.coalesce(F.col("risk_flags"), F.array().cast("array<string>"))) == 0


def filter_predicate(key: str, value) -> Column | None:
    """Predicate of one filter key, or None when key or value says nothing."""
    if not isinstance(value, str) or not value.strip():
        return None
    v = value.strip()
    if key in _EXACT:
        return F.col(key) == v
    if key == "engine":
        return (F.lower("engine") == v.lower()) | (F.lower("probable_engine") == v.lower())
    if key in _BOUNDS:
        column, op = _BOUNDS[key]
        try:
            return _compare(F.col(column), op, int(v))
        except ValueError:
            return None
    if key in _YEARS:
        column, op = _YEARS[key]
        year = F.substring(column, 1, 4)
        return (F.col(column) != "") & _compare(year, op, v)
    if key == "risk_free" and v in ("true", "1"):
        return no_risk()
    if key == "eu_spec" and v in ("true", "false"):
        return F.col("eu_spec") == (v == "true")
    return None


def filter_listings(listings: DataFrame, params: dict[str, str]) -> DataFrame:
    """AND of all parameters; unknown, empty and unreadable ones are ignored."""
    predicates = [p for p in (filter_predicate(k, v) for k, v in params.items()) if p is not None]
    return listings.filter(reduce(lambda a, b: a & b, predicates)) if predicates else listings


def visible(listings: DataFrame, *, show_hidden: bool = False) -> DataFrame:
    return listings if show_hidden else listings.filter(~F.coalesce("hidden", F.lit(False)))


def interactive_filter(
    listings: DataFrame, *, status: str = "all", text: str = "", ez_from: str = "",
    ez_to: str = "", source: str = "all", transmission: str = "all", trim: str = "all",
    engine: str = "all", body_style: str = "all", change_type: str = "all",
    price_min: float = 0, price_max: float = 0, km_min: float = 0, km_max: float = 0,
    score_min: int = 0, hide_risk: bool = False,
) -> DataFrame:
    """The ranking page's filter; expects ``status`` and ``my_score`` columns.

    Bounds at or below zero are off. A listing without registration fails a lower
    year bound and passes an upper one.
    """
    keep: list[Column] = []
    if status != "all":
        keep.append(F.coalesce("status", F.lit("unknown")) == status)
    query = text.lower().strip()
    if query:
        parts = ["title", "description_text", "source", "engine", "probable_engine", "trim",
                 "transmission", "body_style"]
        haystack = F.concat_ws(" ", *[F.nullif(F.col(p), F.lit("")) for p in parts])
        keep.append(F.lower(haystack).contains(query))
    year = F.substring(text_or_empty(F.col("first_registration")), 1, 4)
    if ez_from.strip():
        keep.append(year >= ez_from.strip())
    if ez_to.strip():
        keep.append(year <= ez_to.strip())
    exact = {"source": source, "transmission": transmission, "body_style": body_style,
             "change_type": change_type}
    keep += [F.col(c) == v for c, v in exact.items() if v != "all"]
    if trim != "all":
        keep.append(text_or_empty(F.col("trim")) == trim)
    if engine != "all":
        keep.append(F.coalesce(
            F.nullif("engine", F.lit("")), F.col("probable_engine"), F.lit("")) == engine)
    bounds = [("price_eur", price_min, price_max), ("mileage_km", km_min, km_max)]
    for column, low, high in bounds:
        if low > 0:
            keep.append(F.col(column) >= low)
        if high > 0:
            keep.append(F.col(column) <= high)
    if score_min > 0:
        keep.append(F.coalesce("my_score", F.lit(0)) >= score_min)
    if hide_risk:
        keep.append(no_risk())
    return listings.filter(reduce(lambda a, b: a & b, keep)) if keep else listings


def filter_counts(listings: DataFrame, params: dict[str, str]) -> DataFrame:
    """One row: how many listings pass the filter, and how many there are."""
    predicates = [p for p in (filter_predicate(k, v) for k, v in params.items()) if p is not None]
    keep = reduce(lambda a, b: a & b, predicates, F.lit(True))
    return listings.agg(F.count_if(keep).alias("total"), F.count("*").alias("total_all"))
