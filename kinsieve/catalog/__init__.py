"""Named queries over the given tables, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinsieve.session import staged

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its (function) name, with the SQL it must agree with. Within a query, equal
    stages are written once."""

    def register(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = staged(function)
        if sql is not None:
            ORACLES[key] = sql
        return function

    return register


def load_all() -> None:
    from kinsieve.catalog import (  # noqa: F401
        aggregation,
        columns,
        composite,
        joining,
        ordering,
        reading,
        statistical,
    )
