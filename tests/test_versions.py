"""The growing index against a dictionary; compaction, snapshots, failures."""

import random

import pytest

from corpuslake.operators import bm25
from corpuslake.sources import chunks as chunk_table
from corpuslake.streaming import versions

SCHEMA = "chunk_id string, collection string, text string"


def rows_of(df):
    return {tuple(r) for r in df.select("chunk_id", "collection", "text").collect()}


def test_a_growing_index_equals_a_dictionary_at_every_version(spark, tmp_path):
    rng, path, held, snapshots = random.Random(1), str(tmp_path / "index"), {}, {}
    for version in range(1, 21):
        new = {f"c{rng.randint(0, 60)}": (rng.choice("xy"), f"text of {version} {rng.randint(0, 9)}") for _ in range(8)}
        gone = {f"c{rng.randint(0, 60)}" for _ in range(3)} if version % 3 == 0 else set()
        rows = spark.createDataFrame([(k, *v) for k, v in new.items()], SCHEMA)
        deleted = spark.createDataFrame([(k,) for k in gone], "chunk_id string") if gone else None
        versions.index_batch(rows, path, version, deleted=deleted, fan_in=3)
        held = {k: v for k, v in held.items() if k not in gone} | new
        snapshots[version] = {(k, *v) for k, v in held.items()}
    parts = versions.live(spark, path)
    assert len(parts) <= 2 * 3 and max(p["level"] for p in parts) == 2
    assert rows_of(versions.read_index(spark, path)) == snapshots[20]
    for version in (1, 3, 8, 9, 14, 18, 20):
        assert rows_of(versions.read_index(spark, path, version=version)) == snapshots[version]
    want = {tuple(r) for r in bm25.postings(spark.createDataFrame(list(snapshots[20]), SCHEMA), "chunk_id").collect()}
    columns = bm25.postings(spark.createDataFrame([], SCHEMA), "chunk_id").columns
    assert {tuple(r) for r in versions.read_index(spark, path, "postings").select(*columns).collect()} == want
    stored = sum(versions.read_parts(spark, [p], "chunks").count() for p in parts)
    assert stored <= 2 * len(snapshots[20])  # a read touches no more than twice what it returns
    gone = versions.vacuum(spark, path)
    assert gone and rows_of(versions.read_index(spark, path)) == snapshots[20]
    with pytest.raises(ValueError):
        versions.read_index(spark, str(tmp_path / "none"))


def test_a_failed_compaction_or_batch_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    for version in (1, 2):
        versions.index_batch(spark.createDataFrame([(f"c{version}", "x", "one"), ("c0", "x", f"v{version}")], SCHEMA), path, version)
    before = rows_of(versions.read_index(spark, path))

    def fails(*args):
        raise OSError("disk full")

    with monkeypatch.context() as patch:
        patch.setattr(versions, "commit", fails)
        with pytest.raises(OSError):
            versions.compact(spark, path, 2)
        with pytest.raises(OSError):
            versions.index_batch(spark.createDataFrame([("c9", "x", "lost")], SCHEMA), path, 3)
    assert rows_of(versions.read_index(spark, path)) == before and len(versions.live(spark, path)) == 2
    assert versions.compact(spark, path, 2) == 1 and len(versions.live(spark, path)) == 1
    assert rows_of(versions.read_index(spark, path)) == before
    versions.index_batch(spark.createDataFrame([("c9", "x", "again")], SCHEMA), path, 2)  # committed already
    assert rows_of(versions.read_index(spark, path)) == before


def test_rows_of_one_id_are_chosen_by_content(spark, tmp_path):
    rows = [("a", "x", "one"), ("a", "x", "two"), ("a", "w", "three"), ("b", "x", None)]
    for parts in (1, 4):
        path = str(tmp_path / f"index{parts}")
        versions.index_batch(spark.createDataFrame(rows, SCHEMA).repartition(parts, "text"), path)
        assert rows_of(versions.read_index(spark, path)) == {("a", "x", "two"), ("b", "x", None)}
        old = spark.createDataFrame([("a", "x", "old"), ("c", "x", "old")], SCHEMA)
        assert rows_of(chunk_table.upserted(old, spark.createDataFrame(rows, SCHEMA).repartition(parts, "text"))) == {("a", "x", "two"), ("b", "x", None), ("c", "x", "old")}


def test_pages_of_a_scan_join_to_the_whole_collection(spark):
    rows = spark.createDataFrame([(f"c{i:03d}", "xy"[i % 2], f"t{i}", [0.5]) for i in range(50)], SCHEMA + ", vector array<double>")
    seen, after = [], None
    while page := chunk_table.scan(rows, "x", after, 7).collect():
        seen += [r["chunk_id"] for r in page]
        after = seen[-1]
        assert "vector" not in page[0].asDict()
    assert seen == [f"c{i:03d}" for i in range(0, 50, 2)] == [r["chunk_id"] for r in chunk_table.scan(rows, "x").collect()]
