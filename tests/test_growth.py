"""Queries whose cost must not grow faster than their tables."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from corpuslake.operators import classify, coverage, dense, graph, route


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_questions_are_not_broadcast_to_the_rules(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"how does the bolt {i} work") for i in range(50)] + [(50, None), (51, "bolt")], "query_id long, text string").write.parquet(str(tmp_path / "q"))
    asked = spark.read.parquet(str(tmp_path / "q"))  # a small file, which Spark would rather broadcast than the rules
    rules = spark.createDataFrame([(1, ["bolt", "7"]), (2, ["How", "does"]), (3, ["bolt"]), (4, [])], "rule_no int, words array<string>")
    want = {i: 1 if i == 7 else 2 for i in range(50)} | {51: 3}
    for most in (route.BROADCAST_RULES, 2):
        monkeypatch.setattr(route, "BROADCAST_RULES", most)
        out = route.first_rule(asked, rules)
        assert "BuildLeft" not in plan_of(out)
        assert dict(map(tuple, out.collect())) == want


def test_books_of_equal_scores_are_looked_for_in_the_first_block_alone(spark, monkeypatch):
    blocks = {}
    for b in range(10):
        blocks[b] = coverage.Matrix()
        blocks[b].add("topic", "common", np.array([0]), np.array([1 << (b % 4)], np.uint64))
    best, left = coverage.best_in_blocks(["common"], [], blocks, 1, coverage.Scores(0.85, 0.15), by_title=True)
    assert [b[2:4] for b in best] == [(0, 0)] and left == 9
    best, left = coverage.best_in_blocks(["common"], [], blocks, 2, coverage.Scores(0.85, 0.15), by_title=True)
    assert [b[2:4] for b in best] == [(0, 0), (1, 1)] and left == 8
    # books of many blocks, all alike: the first titles win, those without a title first of all
    monkeypatch.setattr(coverage, "BLOCK_BOOKS", 64)
    order = random.Random(4).sample(range(700), 700)
    titles = spark.createDataFrame([(f"b{i:03}", f"Title {i // 2:03}" if i else None) for i in order], "document_id string, title string")
    held = spark.createDataFrame([(f"b{i:03}", "topic", "sorting") for i in range(700)], "document_id string, kind string, name string")
    asked = spark.createDataFrame([(q, "topic", "sorting", 1) for q in range(20)], "query_id int, kind string, name string, pos int")
    out = coverage.best_books(asked, held, titles, 3).collect()
    assert sorted((r["query_id"], r["rank"], r["document_id"]) for r in out) == [(q, rank, f"b{rank - 1:03}") for q in range(20) for rank in (1, 2, 3)]


def test_neighbours_are_looked_up_once_however_often_they_are_asked_for(spark):
    nodes = spark.createDataFrame([("Topic", "t", "T"), *(("PastQuestion", f"q{i:03}", f"Explain {i % 7}") for i in range(300))], "label string, key string, name string")
    edges = spark.createDataFrame([("ABOUT", "PastQuestion", f"q{i:03}", "Topic", "t") for i in range(300)], "type string, start_label string, start_key string, end_label string, end_key string")
    plans = spark.createDataFrame([(q, "questions_about_topic", " T ", None) for q in range(200)] + [(200, "questions_about_topic", "none", None), (201, None, "t", None)], "query_id int, intent string, entity string, semester int")
    ends = plans.select("intent", F.lower(F.trim("entity")).alias("near"))
    assert graph.reached(ends, nodes, edges).count() == 300  # not 200 * 300
    assert graph.reached(ends, nodes, edges, 3).count() == 3
    out = graph.graph_hits(plans, nodes, edges, 3).select("query_id", "rank", "key").collect()
    want = sorted((f"Explain {i % 7}", f"q{i:03}") for i in range(300))[:3]
    assert sorted(map(tuple, out)) == [(q, n, key) for q in range(200) for n, (_, key) in enumerate(want, 1)]


def test_patterns_are_tried_wherever_they_can_occur(spark):
    texts = ["", "SYLLABUS of mArKs: q 7", "Kİndly Kindly Kindly", "course  Outcome", "Code of\nConduct, re-admission; Re: x", "table of contents; University of X", "date : max marks unit 4 exam"]
    texts += [w.replace("\\b", " ").replace("\\s+", " ").replace("\\d", "7").replace("\\s*", "").replace("?", "") for found in classify.FEATURES.values() for w, _ in found]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    plain = F.struct(*(sum((F.when(F.col("t").rlike(f"(?i){p}"), w).otherwise(0) for p, w in found), start=F.lit(0)).alias(kind) for kind, found in classify.FEATURES.items()))
    rows = df.select("t", classify.scores(F.col("t")).alias("s"), plain.alias("p"), classify.pick_type(classify.scores(F.col("t"))).alias("kind")).collect()
    for r in rows:
        assert r["s"] == r["p"]
        top = max(r["p"])
        assert r["kind"] == ("unknown" if top < 3 else next(k for k in classify.PRIORITY if r["p"][k] == top))


def test_many_questions_of_a_search_are_compared_in_slices():
    rng = np.random.default_rng(3)
    unit, rows = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(4096, 8)), rng.normal(size=(2048, 8))))
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    nearest = dense.Nearest(pa.array(np.arange(4096)), unit, 5, schema)
    tracemalloc.start()
    nearest.add(pa.array(np.arange(2048)), [], rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # all questions at once: 4096 * 1024 numbers of 8 bytes, several times
    scores, found = nearest.held[()]
    whole = np.rint(unit @ rows.T * 1e6).astype(np.int64)
    best = np.lexsort((np.broadcast_to(np.arange(2048), whole.shape), -whole), axis=1)[:, :5]
    assert np.array_equal(found, best) and np.array_equal(scores, np.take_along_axis(whole, best, 1))
