"""The pipeline's stages on the smallest tables: columns, kept rows and effects against the operators' brute force."""

import hashlib

import pytest

import corpus_pipeline
from corpuslake.llm import pii
from corpuslake.llm.common import stored

from .test_operators import brute_counts, jaccard, shingle_set, similar_classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name.replace(" ", "-"))
        tables.append(docs.collect())
    return tables


def test_rules_keep_what_passes(stages):
    before, after = stages[0], {r["doc_id"] for r in stages[1]}
    for r in before:
        n, _, _, _, repeats = brute_counts(r["text"])
        if n < 20 or 100 * repeats > 30 * n:
            assert r["doc_id"] not in after
    assert len(after) > 0.6 * len(before)


def test_one_of_each_group_stays(stages):
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in stages[1]}
    ids = sorted(sets)
    classes = similar_classes([sets[i] for i in ids])
    kept = {r["doc_id"] for r in stages[2]}
    least = {c: min(i for i, k in zip(ids, classes) if k == c) for c in set(classes)}
    assert kept == set(least.values())
    for i in set(ids) - kept:
        assert max(jaccard(sets[i], sets[j]) for j in ids if j != i) >= 0.8


def test_masks_take_effect(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2]}
    assert len(stages[3]) == len(before)
    for r in stages[3]:
        assert r["text"] == pii.masked(before[r["doc_id"]], pii.find_all(before[r["doc_id"]])) and r["n_chars"] == len(r["text"])


def test_columns_and_last_stage(stages):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for table in stages[:5]:
        assert list(table[0].asDict()) == names
    texts = {r["doc_id"]: r["text"] for r in stages[4]}
    assert len(stages[5]) == len(stages[4])
    for r in stages[5]:
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and r["n_tokens"] == len(r["ids"])


def test_odd_tables_go_through_all_stages(spark):
    rows = [(i, " ".join(f"word{(i * 7 + j) % 97}x" for j in range(30 + i)), None if i % 3 else "en", None if i % 4 else "s", None, i, i, "c", 1) for i in range(20)]
    rows += [(None, rows[3][1], None, "s", 1, 1, 1, "c", 1), (None, rows[5][1] + " more", None, None, 1, 1, 1, "c", 1), (7, None, None, None, None, 1, 1, "c", 1), (8, "", "en", "s", 0, 1, 1, "c", 1), (4, rows[4][1], "en", "s", 0, 1, 1, "c", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, task int, row int, carry_0 string, size int"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), name.replace(" ", "-"))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == names
        left = docs.collect()
    assert left == []
