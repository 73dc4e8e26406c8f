"""Registered queries of the library and the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    from . import academic_queries, advisor_queries, routing_queries, search_queries, stream_queries

    return search_queries.QUERIES | academic_queries.QUERIES | advisor_queries.QUERIES | stream_queries.QUERIES | routing_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import academic_queries, advisor_queries, routing_queries, search_queries, stream_queries

    return search_queries.SQL | academic_queries.SQL | advisor_queries.SQL | stream_queries.SQL | routing_queries.SQL
