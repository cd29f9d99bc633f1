"""All registered queries of the core and, where SQL can state it, the SQL of the same result."""

from __future__ import annotations

from textquarry.plans import registry_chunking, registry_metadata, registry_search, registry_sources

_PARTS = (registry_sources, registry_chunking, registry_search, registry_metadata)


def queries() -> dict:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
