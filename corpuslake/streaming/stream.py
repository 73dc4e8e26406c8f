"""Throttling and request metrics, as batch tables and as streams; incremental indexing is in :mod:`corpuslake.streaming.versions`."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.streaming.versions import index_batch, index_stream, read_index, versions  # noqa: F401

DECISIONS = "key string, ts timestamp, event_id long, allowed boolean, retry_after double"


def decide(stamps: list[float], accepted: deque, limit: int, window: float) -> list[tuple[bool, float]]:
    """For each time in order: whether fewer than ``limit`` were accepted within the window before it, and else how long until one leaves.

    One exactly a window old has left; refused ones leave no trace. ``accepted`` is carried on.
    """
    out = []
    for at in stamps:
        while accepted and accepted[0] <= at - window:
            accepted.popleft()
        allowed = len(accepted) < limit
        out.append((allowed, 0.0 if allowed else accepted[0] + window - at))
        if allowed:
            accepted.append(at)
    return out


def throttle(events: DataFrame, limit: int, window_seconds: float) -> DataFrame:
    """Decisions on events (key, ts, event_id), each key in order of time, then id. State is at most ``limit`` times a key."""

    def per_key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, accepted = None, deque()
        for pdf in batches:
            for name, rows in pdf.groupby("key", sort=False, dropna=False):
                if name != key:
                    key, accepted = name, deque()
                made = decide((rows["ts"].astype("int64") / 1e9 if str(rows["ts"].dtype).endswith("[ns]") else rows["ts"].astype("datetime64[us]").astype("int64") / 1e6).tolist(), accepted, limit, window_seconds)
                yield rows.assign(allowed=[a for a, _ in made], retry_after=[round(r, 6) for _, r in made])[["key", "ts", "event_id", "allowed", "retry_after"]]

    if limit <= 0 or window_seconds <= 0:
        raise ValueError("limit and window must be positive")
    rows = events.select(F.col("key").cast("string").alias("key"), "ts", F.col("event_id").cast("long").alias("event_id")).where("key is not null and ts is not null")
    # rows of a key arrive sorted, batch by batch, so no key is held whole
    return rows.repartition("key").sortWithinPartitions("key", "ts", "event_id").mapInPandas(per_key, DECISIONS)


def throttle_stream(events: DataFrame, limit: int, window_seconds: float, lateness: str = "10 minutes") -> DataFrame:
    """:func:`throttle` on a stream: accepted times are kept per key, and dropped once the watermark has passed the last of them by a window.

    Events later than ``lateness`` behind the latest are dropped, as are those without key or time.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def per_key(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        accepted = deque(state.get[0] if state.exists else [])
        made = decide(rows["ts"].astype("datetime64[us]").astype("int64").div(1e6).tolist(), accepted, limit, window_seconds)
        state.update((list(accepted),))
        due = int((accepted[-1] + window_seconds) * 1000) + 1 if accepted else 0
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(allowed=[a for a, _ in made], retry_after=[round(r, 6) for _, r in made])[["key", "ts", "event_id", "allowed", "retry_after"]]

    rows = events.select(F.col("key").cast("string").alias("key"), "ts", F.col("event_id").cast("long").alias("event_id")).where("key is not null and ts is not null")
    return rows.withWatermark("ts", lateness).groupBy("key").applyInPandasWithState(per_key, DECISIONS, "accepted array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def request_metrics(events: DataFrame, by: str, value: str, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(window_start, by, n, avg_value) in tumbling windows; on a stream, rows later than ``lateness`` are dropped."""
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 4).alias("avg_value"))
    return grouped.select(F.col("w.start").alias("window_start"), by, "n", "avg_value")
