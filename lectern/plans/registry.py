"""The queries of the engine and, for each that SQL can express, what DuckDB answers alike."""

from __future__ import annotations

from lectern.plans import catalog_queries, form_queries, index_queries, join_queries, metric_queries, reference_queries, smart_queries, source_queries, text_queries

MODULES = (text_queries, join_queries, metric_queries, reference_queries, smart_queries, catalog_queries, source_queries, index_queries, form_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
