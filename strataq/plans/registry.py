"""All queries of the core package and their SQL."""

from __future__ import annotations

from strataq.plans import data_queries, golden_queries, measure_queries, source_queries

MODULES = [data_queries, measure_queries, source_queries, golden_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
