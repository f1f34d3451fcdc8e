"""All queries outside the ``llm`` subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnflow.plans import core_queries, series_queries, stream_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return core_queries.QUERIES | stream_queries.QUERIES | series_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return core_queries.ORACLE | stream_queries.ORACLE | series_queries.ORACLE
