"""All registered plans of the engine's own operators."""

from __future__ import annotations

from tidemark.plans import books, files, indicators, market, markets, operations, reports, research, stores, stream


def plans() -> tuple[dict, dict]:
    """Query functions and oracle SQL by name."""
    queries, sql = {}, {}
    for part in (market, indicators, research, books, reports, stores, files, stream, operations, markets):
        queries |= part.QUERIES
        sql |= part.SQL
    return queries, sql
