"""The registry of named queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a function of (spark, folder) under ``name``, with the same rows in DuckDB's SQL."""

    def keep(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep


