"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from threadline.plans import matching, queries as plans


def queries() -> dict:
    return {f.__name__: f for f in (*plans.ALL, *matching.ALL)}


def oracle_sql() -> dict[str, str]:
    return plans.SQL | matching.SQL
