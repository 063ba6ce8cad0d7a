"""Queries of the photo engine and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import api_queries, bridge_queries, more_queries, photo_queries, record_queries, study_queries, table_queries  # noqa: F401  the others register into photo_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return {name: f for name, (f, _) in photo_queries.FOUND.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by the name of the query."""
    return {name: sql for name, (_, sql) in photo_queries.FOUND.items() if sql}
