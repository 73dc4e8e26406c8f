"""The sharded index and containment against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpuslake.functions import params
from corpuslake.operators import contain, graph, shards


def terms_of(text):
    return [t for t in re.findall("[a-z0-9]+", (text or "").lower()) if len(t) >= 2 and t not in params.STOPWORDS]


def brute_bm25(docs, queries, k, k1=1.5, b=0.75):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in held]
    avg, df = sum(lengths) / len(docs), Counter(t for _, c in held for t in c)
    out = set()
    for q, text in queries:
        hits = []
        for (i, c), n in zip(held, lengths):
            score = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * n / avg)) for t in set(terms_of(text)) if t in c)
            if i is not None and round(score, 6) > 0:
                hits.append((-round(score, 6), i))
        out.update((q, rank, i, -s) for rank, (s, i) in enumerate(sorted(hits)[:k], 1))
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
def test_an_index_answers_as_brute_force(spark, tmp_path, monkeypatch, kind):
    rng = random.Random(7)
    words = [f"w{int(rng.expovariate(0.05))}" for _ in range(4000)]
    name = (lambda i: i * 7 % 1009) if kind == "long" else (lambda i: f"d{i * 7 % 1009}é")
    docs = [(name(i), " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(900)]
    docs += [(name(901), None), (name(902), ""), (None, "w1 w2 w3"), (name(903), "the of " * 9), (name(904), docs[5][1]), (name(905), docs[5][1])]
    queries = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(60)] + [(90, None), (91, ""), (92, "nowhere"), (93, docs[5][1])]
    table, asked = spark.createDataFrame(docs, f"doc_id {kind}, text string").repartition(3), spark.createDataFrame(queries, "query_id int, text string")
    want = brute_bm25(docs, queries, 5)
    index = shards.build_index(table, str(tmp_path / "index"), shard_docs=50)
    assert index.where("term is null").count() >= 18 and shards.corpus_stats(index).first()[0] == len(docs)
    df = {r["term"]: r["df"] for r in shards.term_stats(index).collect()}
    assert df == Counter(t for _, text in docs for t in set(terms_of(text)))
    opened = shards.open_index(spark, str(tmp_path / "index"))
    for part in (shards.PART_QUERIES, 17):
        monkeypatch.setattr(shards, "PART_QUERIES", part)
        assert {tuple(r) for r in shards.search(opened, asked, 5).collect()} == want
    assert shards.search(shards.build_index(table.limit(0)), asked).count() == 0
    assert shards.search(opened, asked.limit(0)).count() == 0
    with pytest.raises(ValueError):
        shards.search(opened, asked, 0)


def test_shards_that_cannot_better_the_best_are_skipped():
    scorer = shards.Scorer(1, 1.5, 0.75, 3.0)
    scorer.ask(shards.Question(1, ["a", "b"], [2.0, 1.0]))
    ids, lengths = pa.array([10, 11]), np.array([2.0, 4.0])
    scorer.read(ids, lengths, {"a": (np.array([0]), np.array([3.0])), "b": (np.array([0, 1]), np.array([1.0, 1.0]))})
    assert [h[1] for h in scorer.questions[0].best] == [10] and scorer.skipped == 0
    scorer.read(pa.array([1, 2]), lengths, {"b": (np.array([0, 1]), np.array([1.0, 5.0]))})
    assert [h[1] for h in scorer.questions[0].best] == [10] and scorer.skipped == 1


def test_texts_are_read_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} shared") for i in range(30)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    index = shards.build_index(spark.read.parquet(str(tmp_path / "docs")))
    plan = shards.search(index, spark.createDataFrame([(1, "shared word3")], "query_id int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path) not in plan


def test_containing_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice(["ab", "a", "é", "🎉", "--", "* ", "x\n"]) for _ in range(rng.randint(0, 40)))) for i in range(300)] + [(900, None), (901, ""), (3, "again a")]
    needles = [(f"n{i}", "".join(rng.choice(["ab", "a", "é", "🎉", "--", "* ", "x\n"]) for _ in range(rng.randint(1, 4)))) for i in range(80)]
    needles += [("symbols", "--*"), ("dots", "..."), ("empty", ""), ("null", None), ("same", needles[0][1]), (None, "ab")]
    rows, asked = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(needles, "query_id string, text string")
    want = Counter((q, i) for q, n in needles for i, t in texts if n is not None and t is not None and n in t)
    for size in (contain.BLOCK_CHARS, 40):
        out = contain.containing(rows, asked, block_chars=size)
        assert Counter(tuple(r) for r in out.collect()) == want
    assert contain.containing(rows, asked.limit(0)).count() == 0 == contain.containing(rows.limit(0), asked).count()
    assert "NestedLoop" not in contain.containing(rows, asked)._jdf.queryExecution().executedPlan().toString()


def test_pages_of_needles_equal_brute_force(spark):
    rng = random.Random(5)
    pages = [(f"d{rng.randint(0, 9)}", p, " ".join(rng.choice(["Alpha", "beta", "É", "+-", "x"]) for _ in range(6))) for p in range(1, 120)] + [("d1", 500, None), (None, 1, "alpha")]
    needles = [(f"d{i}", n) for i in range(11) for n in ("ALPHA beta", "é", "+-", "zz", "", "x X", None)]
    out = graph.page_of(spark.createDataFrame(pages, "document_id string, page int, text string"), spark.createDataFrame(needles, "document_id string, needle string"))
    first = defaultdict(lambda: 1)
    for d, p, t in sorted(pages, key=lambda r: -r[1]):
        for n in {n for _, n in needles if n is not None}:
            if t is not None and n.lower() in t.lower():
                first[d, n] = p
    assert {tuple(r) for r in out.collect()} == {(d, n, first[d, n] if n is not None else 1) for d, n in needles}
