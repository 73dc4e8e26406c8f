"""The best books of bit matrices against brute force."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from corpuslake.operators import coverage
from corpuslake.plans import registry

SF = "/root/testdata/sf0.001"


def brute(required, profiles, titles, k):
    asked = defaultdict(lambda: {"topic": [], "subtopic": []})
    for q, kind, name, pos in sorted(required, key=lambda r: (r[0], r[3], r[2])):
        asked[q][kind].append(name)
    held = defaultdict(set)
    for book, kind, name in profiles:
        held[book, kind].add(name.strip(" .").lower())
    out = set()
    for q, names in asked.items():
        rows = []
        for book, title, author in titles:
            got = {kind: [n for n in names[kind] if n.strip(" .").lower() in held.get((book, kind), ())] for kind in names}
            if not got["topic"] and not got["subtopic"]:
                continue
            t, s = (len(got[kind]) / len(names[kind]) if names[kind] else 0.0 for kind in ("topic", "subtopic"))
            lists = [tuple(x) for kind in ("topic", "subtopic") for x in (got[kind], [n for n in names[kind] if n not in got[kind]])]
            rows.append((-float(f"{0.85 * t + 0.15 * s:.4f}"), -len(got["topic"]), title, book, author, *lists))
        out.update((q, rank, r[3], r[2], -r[0], -r[1], r[4], *r[5:]) for rank, r in enumerate(sorted(rows)[:k], 1))
    return out


def test_best_books_of_many_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(coverage, "MATRIX_BYTES", 20_000)  # several groups of blocks
    monkeypatch.setattr(coverage, "TASK_QUESTIONS", 50)
    rng = random.Random(2)
    by_place = {int(hashlib.md5(f"name{i}".encode()).hexdigest(), 16) % 384: f"name{i}" for i in range(200)}
    names = sorted(by_place.values())[:120]  # no two of one place, which would be near
    titles = [(f"b{i}", f"Title {rng.randint(0, 3000)}", rng.choice(["x", "y", None])) for i in range(9000)]
    profiles = [(b, kind, rng.choice([n, n.upper() + "."])) for b, *_ in titles for kind in ("topic", "subtopic") for n in rng.sample(names if kind == "topic" else names[:30], rng.randint(0, 3))]
    profiles += [("b7", "topic", n) for n in names]  # one book that covers everything
    required = [(q, kind, n, pos) for q in range(150) for kind in ("topic", "subtopic") for pos, n in enumerate(rng.sample(names, rng.randint(0 if q % 5 else 1, 6)))]
    required += [(900, "topic", "nowhere", 1), (901, "subtopic", names[3], 1), (902, "topic", names[5], 1), (902, "topic", "nowhere", 2)]
    need = spark.createDataFrame(required, "query_id int, kind string, name string, pos int")
    books = spark.createDataFrame([*titles, (None, "no id", "z")], "document_id string, title string, author string")
    held = spark.createDataFrame(profiles, "document_id string, kind string, name string")
    out = coverage.best_books(need, held, books, 4)
    found = {(r["query_id"], r["rank"], r["document_id"], r["title"], r["score"], r["n_matched"], r["author"], *(tuple(r[c]) for c in ("matched", "missing", "matched_subtopics", "missing_subtopics"))) for r in out.collect()}
    assert found == brute(required, profiles, titles, 4)
    assert coverage.best_books(need.limit(0), held, books, 4).count() == 0
    assert coverage.best_books(need, held.limit(0), books, 4).count() == 0


def test_blocks_that_cannot_better_the_best_are_left_out():
    import numpy as np

    blocks = {}
    for b in range(10):
        blocks[b] = coverage.Matrix()
        blocks[b].add("topic", "common", np.array([0]), np.array([1 << (b % 4)], np.uint64))
        if b == 3:
            blocks[b].add("topic", "rare", np.array([0]), np.array([8 | 2], np.uint64))
    best, left = coverage.best_in_blocks(["common", "rare"], [], blocks, 1, coverage.Scores(0.85, 0.15))
    assert [(b[2], b[3]) for b in best] == [(3, 3)] and left == 9
    best, left = coverage.best_in_blocks(["common"], [], blocks, 2, coverage.Scores(0.85, 0.15))
    assert len(best) == 10 and left == 0  # all alike: titles decide between blocks


def counted(monkeypatch):
    """Sets of names that are answered in this process: a search counts them on the driver."""
    found, made = [], coverage.in_matrices

    def in_matrices(sets, *args):
        found.append(sets.count())
        return made(sets, *args)

    monkeypatch.setattr(coverage, "in_matrices", in_matrices)
    return found


def test_coverage_rank_asks_for_every_order(spark):
    orders = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count()
    out = registry.queries()["coverage_rank"](spark, SF)
    assert out.select("query_id").distinct().count() == orders
    assert "% 20" not in registry.oracle_sql()["coverage_rank"] and "% 20" not in registry.oracle_sql()["coverage_violations"]


def test_questions_alike_are_answered_once(spark, monkeypatch):
    found = counted(monkeypatch)
    need = spark.createDataFrame([(q, "topic", n, 1 + (i + q) % 2) for q in range(100) for i, n in enumerate(("sorting", "graphs"))], "query_id int, kind string, name string, pos int")
    held = spark.createDataFrame([("a", "topic", "Sorting."), ("b", "topic", "graphs"), ("c", "topic", "graphs")], "document_id string, kind string, name string")
    titles = spark.createDataFrame([("a", "z"), ("b", "y"), ("c", "x")], "document_id string, title string")
    out = coverage.best_books(need, held, titles, 2).collect()
    assert found == [1]
    assert {r["query_id"]: (r["matched"], r["missing"]) for r in out if r["rank"] == 1} == {q: (["graphs"], ["sorting"]) for q in range(100)}
    assert sorted((r["query_id"], r["rank"], r["document_id"]) for r in out) == [(q, i + 1, b) for q in range(100) for i, b in enumerate("cb")]


def test_a_spread_counts_every_book_of_every_block(spark, monkeypatch):
    monkeypatch.setattr(coverage, "BLOCK_BOOKS", 64)
    monkeypatch.setattr(coverage, "MATRIX_BYTES", 2_000)  # several bins
    rng = random.Random(6)
    by_place = {int(hashlib.md5(f"name{i}".encode()).hexdigest(), 16) % 384: f"name{i}" for i in range(60)}
    names = sorted(by_place.values())[:12]
    titles = [(f"b{i}", f"Title {i % 90}") for i in range(600)]
    profiles = [(b, kind, n) for b, _ in titles[:-5] for kind in ("topic", "subtopic") for n in rng.sample(names, rng.randint(0, 2))]
    required = [(q, kind, n, pos) for q in range(60) for kind in ("topic", "subtopic") for pos, n in enumerate(rng.sample(names, rng.randint(0 if kind == "topic" else 1, 3)))]
    need = spark.createDataFrame(required, "query_id int, kind string, name string, pos int")
    books = spark.createDataFrame(titles, "document_id string, title string")
    held = spark.createDataFrame(profiles, "document_id string, kind string, name string")
    rows = coverage.spread(need, held, books)
    assert rows.select("query_id").distinct().count() < 60  # questions alike are one
    whole = coverage.rank_books(coverage.coverage(need, coverage.matches(need, held)), books)
    want = whole.groupBy("score", "topic_coverage", "subtopic_coverage", "n_matched").count()
    got = rows.groupBy("score", "topic_coverage", "subtopic_coverage", "n_matched").agg(F.sum(F.col("n_books") * F.col("n_questions")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # all books are looked at: a threshold of weights that no score meets makes every one a violation
    bad = coverage.violations(rows, 2.0, 2.0).agg(F.sum(F.col("n_books") * F.col("n_questions"))).first()[0]
    assert bad == whole.count() > 60 * 3
    firsts = {(r["score"], r["n_matched"]): r["rank"] for r in rows.where("query_id = 0").collect()}
    assert min(firsts.values(), default=1) == 1
