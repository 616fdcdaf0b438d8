"""All registered queries, one per operator, and their SQL."""

from __future__ import annotations

from adledger.plans import (
    cluster_queries, history_queries, listing_queries, page_queries, state_queries,
    stream_queries, text_queries,
)
from adledger.plans.registry import Query

_MODULES = [
    text_queries, listing_queries, history_queries, cluster_queries, state_queries, page_queries,
    stream_queries,
]


def queries() -> dict[str, Query]:
    return {n: q for m in _MODULES for n, q in m.registry.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for m in _MODULES for n, s in m.registry.sql.items()}
