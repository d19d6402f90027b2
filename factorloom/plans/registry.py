"""Every registered query, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import matrix_queries, model_queries

flagship = model_queries.flagship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return matrix_queries.QUERIES | model_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return matrix_queries.SQL | model_queries.SQL
