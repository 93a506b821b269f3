"""All queries of the training-data operators, by name, with their SQL."""

from __future__ import annotations

from trendloom.llm import boilerplate_queries, cluster_queries, leakage_queries, lookalike_queries, neighbour_queries, reading_queries, subject_queries, tokenize_queries, truncation_queries

MODULES = [truncation_queries, subject_queries, neighbour_queries, cluster_queries, lookalike_queries, boilerplate_queries, tokenize_queries, leakage_queries, reading_queries]


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
