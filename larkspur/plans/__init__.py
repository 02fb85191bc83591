"""The registry of the engine's queries and the SQL that says the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MODULES = ("store", "temporal", "scalars", "management", "tracking", "streams", "reports", "storage", "places", "exchange")


def plan(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under an operator's name, with its SQL where SQL can say it."""

    def register(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return register


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
