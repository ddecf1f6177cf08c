"""All queries of the core and their SQL."""

from __future__ import annotations

from namequarry.plans import pipeline_queries, record_queries, reference_queries

MODULES = (pipeline_queries, reference_queries, record_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in getattr(m, "ORACLE", {}).items()}
