"""Streams give what batches give."""

import datetime as dt

from pyspark.sql import functions as F

from corpuslake.operators import bm25
from corpuslake.streaming import stream


def test_throttle_stream_equals_batch(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(f"k{i % 3}", at + dt.timedelta(seconds=7 * i), i) for i in range(40)]
    events = spark.createDataFrame(rows, "key string, ts timestamp, event_id long")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    made = stream.throttle_stream(source, 2, 60.0)
    query = made.writeStream.format("memory").queryName("throttled").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["event_id"], r["allowed"]) for r in spark.table("throttled").collect()}
    assert got == {(r["event_id"], r["allowed"]) for r in stream.throttle(events, 2, 60.0).collect()} and len(got) == 40


def test_index_stream_equals_one_batch(spark, tmp_path):
    chunks = spark.createDataFrame([(f"d:{i}", "xy"[i % 2], f"words of chunk {i}") for i in range(6)], "chunk_id string, collection string, text string")
    for part in (0, 1):
        chunks.where(F.substring("chunk_id", 3, 1).cast("int") % 2 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "in"))
        stream.index_stream(source, str(tmp_path / "index"), str(tmp_path / "ck")).awaitTermination(120)
    kept = stream.read_index(spark, str(tmp_path / "index"))
    assert stream.versions(spark, str(tmp_path / "index")).count() == 2 and sorted(r["chunk_id"] for r in kept.collect()) == [f"d:{i}" for i in range(6)]
    batch = {tuple(r) for r in bm25.postings(chunks, "chunk_id").collect()}
    held = stream.read_index(spark, str(tmp_path / "index"), "postings")
    assert {tuple(r) for r in held.select(*bm25.postings(chunks, "chunk_id").columns).collect()} == batch


def test_metrics_on_a_stream_wait_for_the_watermark(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(at + dt.timedelta(minutes=30 * i), "a", float(i)) for i in range(8)]
    events = spark.createDataFrame(rows, "ts timestamp, kind string, ms double")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = stream.request_metrics(source, "kind", "ms").writeStream.format("memory").queryName("hourly").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = {tuple(r) for r in stream.request_metrics(events, "kind", "ms").collect()}
    closed = {tuple(r) for r in spark.table("hourly").collect()}
    assert closed and closed <= batch and batch - closed == {max(batch)}
