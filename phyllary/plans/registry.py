"""All queries of the core: name -> function of (session, data folder)."""

from __future__ import annotations

from phyllary.plans import core_queries, place_queries, record_queries, refine_queries, source_queries

MODULES = [core_queries, record_queries, place_queries, refine_queries, source_queries]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in getattr(m, "SQL", {}).items()}
