"""Queries over the input tables, with the SQL that checks them."""

from . import details, messy, pages, records, registry, reports, series, sources, streams, urls  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLE)
