"""Quantiles and graph merges where one stage, value or node has most of the rows."""

import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from corpuslake.operators import graph, metrics


def test_bits_keep_the_order_of_doubles():
    values = np.array([-math.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e12, math.inf, math.nan])
    keys = metrics.ordered_bits(values)
    assert (np.diff(keys) > 0).all()
    assert np.array_equal(metrics.ordered_bits(keys.view(np.float64)), values.view(np.int64))


def test_quantiles_of_heavy_tails_are_exact(spark, monkeypatch):
    rng = random.Random(1)
    samples = [("heavy", rng.expovariate(0.01)) for _ in range(5000)] + [("heavy", 1e12), ("heavy", -1e300)]
    samples += [("same", 7.25)] * 3000 + [("two", -0.5), ("two", 4.0)] + [(None, x) for x in (3.0, 1.0, 2.0)] + [("one", 9.0), ("none", None)]
    samples += [("close", 1.0 + i * 2**-50) for i in range(2000)] + [("infinite", math.inf), ("infinite", 1.0), ("infinite", -math.inf)]
    rng.shuffle(samples)
    by = defaultdict(list)
    for stage, v in samples:
        if v is not None:
            by[stage].append(v)
    want = {}
    for stage, held in by.items():
        held.sort()
        n = len(held)
        want[stage] = (n, round((held[(n - 1) // 2] + held[n // 2]) / 2, 4), held[n * 95 // 100], held[0], held[-1])
    df = spark.createDataFrame(samples, "stage string, ms double").repartition(4)
    for rows in (metrics.SORTED_ROWS, 100, 0):
        monkeypatch.setattr(metrics, "SORTED_ROWS", rows)
        out = {r["stage"]: (r["n"], r["median"], r["p95"], r["min"], r["max"]) for r in metrics.latency_summary(df).collect()}
        assert out == want
    assert metrics.latency_summary(df.limit(0)).count() == 0


def brute_merge(nodes, edges):
    last = {}
    for r in sorted(nodes, key=lambda r: r[5]):
        last[r[3], r[0], r[1]] = r
    kept = {}
    for r in sorted(last.values(), key=lambda r: (r[4], r[3], r[5])):
        kept.setdefault((r[0], r[1]), r)
    allowed = set(graph.TRIPLES)
    last = {}
    for e in sorted(edges, key=lambda e: e[7]):
        if (e[1], e[0], e[3]) in allowed:
            last[(e[5], *e[:5])] = e
    stored = {}
    for e in sorted(last.values(), key=lambda e: (e[6], e[5], e[7])):
        ends = [kept.get((e[1], e[2])), kept.get((e[3], e[4]))]
        if all(n and n[4] <= e[6] for n in ends):
            stored.setdefault(e[:5], e)
    return set(kept.values()), set(stored.values())


def test_merging_around_a_hot_node_equals_brute_force_and_spreads(spark):
    rng = random.Random(4)
    nodes, edges = [], []
    for seq in range(1, 400):
        doc = f"d{seq}"
        subject = "hub" if rng.random() < 0.9 else f"s{rng.randint(0, 9)}"
        if rng.random() < 0.8:
            nodes.append(("Subject", subject, subject.upper() + str(seq), doc, seq, 0))
        for pos in range(6):
            topic = f"t{rng.randint(0, 1500)}"
            if rng.random() < 0.7:
                nodes += [("Topic", topic, f"T {seq}", doc, seq, pos)]
            edges += [("HAS_TOPIC", "Subject", subject, "Topic", topic, doc, seq, pos)] * rng.randint(1, 2)
        edges.append(("HAS_TOPIC", "Topic", "t1", "Subject", subject, doc, seq, 9))  # not allowed
    n = spark.createDataFrame(nodes, "label string, key string, name string, document_id string, ingest_seq int, pos int")
    e = spark.createDataFrame(edges, "type string, start_label string, start_key string, end_label string, end_key string, document_id string, ingest_seq int, pos int")
    want = brute_merge(nodes, edges)
    for hot in (graph.HOT_EDGES, 50):
        kept, stored = graph.merge(n, e, hot)
        assert {tuple(r) for r in kept.collect()} == want[0] and {tuple(r) for r in stored.select(*e.columns).collect()} == want[1]
        assert stored.count() == len(want[1]) > 500

    hub = spark.createDataFrame([("HAS_TOPIC", "Subject", f"s{i}", "Topic", "hub" if i % 10 else f"t{i}") for i in range(2000)], "type string, start_label string, start_key string, end_label string, end_key string")
    ends = spark.createDataFrame([("Topic", "hub", 1), *(("Subject", f"s{i}", 2) for i in range(2000)), *(("Topic", f"t{i}", 3) for i in range(2000))], "label string, key string, seen int")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = graph.with_ends(hub, ends, 50)  # the task that looked up the end
        sizes = [r["count"] for r in found.where("end_key = 'hub'").groupBy(F.spark_partition_id()).count().collect()]
        assert found.count() == 2000 and {r["since"] for r in found.collect()} == {2, 3}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 1800 and max(sizes) < 450 and len(sizes) > 8
