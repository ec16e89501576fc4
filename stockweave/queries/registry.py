"""Registration of queries with their oracle statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stockweave.sources.drivertables import DriverTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``sql`` is the equivalent DuckDB statement."""

    def register(fn: Callable[[DriverTables], DataFrame]) -> Callable[[DriverTables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, path: fn(DriverTables(spark, path))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
