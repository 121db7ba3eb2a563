"""Named queries over the star-schema tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, if given, the SQL that must return the same rows."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    from shelfwise.registry import data, demand, effects, forecasts, models  # noqa: F401

    return dict(QUERIES), dict(SQL)
