"""Where the check modules register their queries and comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noticiario import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` gives the same result from the test tables."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return function(configure(spark), sf)

        run.__name__, run.__doc__ = function.__name__, function.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register
