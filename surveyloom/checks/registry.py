"""Named checks: a Spark query and, where SQL can express it, its reference in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"check {key} is registered twice")
        QUERIES[key] = query
        if sql is not None:
            ORACLES[key] = sql
        return query

    return register
