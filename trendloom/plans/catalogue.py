"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from trendloom.plans import analysis_queries, inventory_queries, match_queries, report_queries, source_queries, stream_queries, text_queries, timestamp_queries

MODULES = [timestamp_queries, text_queries, match_queries, report_queries, analysis_queries, inventory_queries, source_queries, stream_queries]


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
