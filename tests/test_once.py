"""Texts that are asked for often."""

from pyspark.sql import functions as F

from corpuslake.operators import dense, route
from corpuslake.plans import registry

SF = "/root/testdata/sf0.001"


def test_a_text_is_searched_for_once(spark):
    asked = spark.createDataFrame([(i, None if i % 5 == 4 else f"t{i % 5}") for i in range(200)], "query_id int, text string")
    seen = []

    def search(some):
        seen.append(some.count())
        return some.select("query_id", F.lit(1).alias("rank"), F.concat(F.lit("k"), F.coalesce("text", F.lit("-"))).alias("key"))

    out = route.once_per_text(asked, search)
    assert seen == [5]
    assert sorted((r["query_id"], r["rank"], r["key"]) for r in out.collect()) == [(i, 1, "k-" if i % 5 == 4 else f"kt{i % 5}") for i in range(200)]


def test_routed_questions_are_searched_for_once_a_text_and_only_where_the_graph_has_nothing(spark, monkeypatch):
    seen, search = [], dense.dense_topk

    def counted(queries, *args, **kwargs):
        seen.append(queries.count())
        return search(queries, *args, **kwargs)

    monkeypatch.setattr(dense, "dense_topk", counted)
    out = registry.queries()["routed_answers"](spark, SF).collect()
    names = {r["p_partkey"]: r["p_name"] for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    drawn = {r["query_id"] for r in out if r["method"] == "graph"}
    texts = [{(i % 6, name) for i, name in names.items() if i % 6 in kinds and i not in drawn} for kinds in ((0, 1, 4), (5,))]
    assert sorted(seen) == sorted(map(len, texts)) and sum(seen) < len(names) // 3
    assert {r["query_id"] for r in out if r["method"] == "dense"} <= {i for i in names if i % 6 in (0, 4, 5)} - drawn
