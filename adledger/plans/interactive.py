"""The ranking page as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from adledger.operators.filters import filter_listings, interactive_filter
from adledger.operators.report import list_order
from adledger.operators.scoring import with_personal_score


def query_listings(
    listings: DataFrame, *, params: dict[str, str] | None = None,
    order: str = "score-desc", preferences: dict | None = None, **filters,
) -> DataFrame:
    """Server filter, personal score over what it leaves, page filter, order.

    ``listings`` carries ``status`` and ``created_at``. Scores are relative to the
    loaded set, so the extents are taken before the page's own filter.
    """
    loaded = filter_listings(listings, params or {})
    scored = with_personal_score(loaded, preferences)
    return interactive_filter(scored, **filters).orderBy(*list_order(order))
