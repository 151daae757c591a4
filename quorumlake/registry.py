"""All analytics queries by name and their DuckDB text."""

from __future__ import annotations

from .plans import catalog, comparisons, dashboard, landed, records  # noqa: F401: the others register more queries in the first


def queries() -> dict:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
