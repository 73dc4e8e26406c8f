"""Throttling and request metrics over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.streaming import stream

from .registry import Query, table


def throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "event_id")
    return stream.throttle(events, 3, 3600.0)


def hourly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.request_metrics(table(spark, sf_dir, "events"), "event_type", "value")


QUERIES: dict[str, Query] = {"throttle": throttle, "hourly_metrics": hourly_metrics}
SQL = {"hourly_metrics": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 4) AS avg_value FROM events GROUP BY ALL"}
