"""Registered queries without SQL against brute force on the smallest tables."""

import hashlib
import re
import unicodedata
from collections import Counter, defaultdict
from math import sqrt

import numpy as np

from corpuslake.operators import dense
from corpuslake.plans import registry

SF = "/root/testdata/sf0.001"


def brute_clean(t):
    t = unicodedata.normalize("NFKC", re.sub(r"\r\n?", "\n", t or ""))
    t = re.sub("[\u200b\u200c\u200d\u2060\ufeff]", "", t.replace("\xa0", " "))
    t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", t)
    t = re.sub(r"[ \t]{2,}", " ", t)
    t = re.sub(r"[^\S\n]*\n[^\S\n]*", "\n", t)
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def test_clean_documents_takes_all_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, "ﬁne\u00a0\u00a0été\r\n \r\n\r\n\u200bx"), (-3, "Ａ① e\u0301")], "doc_id long, text string")
    docs.unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r["clean_md5"] for r in registry.queries()["clean_documents"](spark, str(tmp_path)).collect()}
    rows = docs.unionByName(odd).collect()
    assert len(rows) == len(out) == 203 and sum(not (r["text"] or "").isascii() for r in rows) > 30
    assert out == {r["doc_id"]: hashlib.md5(brute_clean(r["text"]).encode()).hexdigest() for r in rows}


def brute_embed(name):
    w = Counter()
    for term in re.findall("[a-z0-9]+", name.lower()):
        h = int(hashlib.md5(term.encode()).hexdigest(), 16)
        w[h % 384] += 1 - 2 * (h >> 8 & 1)
    norm = sqrt(sum(x * x for x in w.values()))
    return {b: x / norm for b, x in w.items()}


def test_coverage_rank_all_ranks_all_suppliers_for_all_orders(spark):
    parts = {r["p_partkey"]: (("topic", r["p_type"]), ("subtopic", r["p_brand"])) for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    titles = {r["s_suppkey"]: r["s_name"] for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    asked, sold = defaultdict(set), defaultdict(set)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        asked[r["l_orderkey"]].update(parts[r["l_partkey"]])
        sold[r["l_suppkey"]].update(parts[r["l_partkey"]])
    e = {name: brute_embed(name) for pair in parts.values() for _, name in pair}
    near = {(a, b): sum(x * e[b].get(i, 0) for i, x in e[a].items()) >= 0.4 - 1e-12 for a in e for b in e}
    covers = {(s, kind, name): any(k == kind and near[name, own] for k, own in sold[s]) for s in sold for kind, name in set().union(*parts.values())}
    want = set()
    for order, names in asked.items():
        rows = []
        for s in sold:
            (t, nt), (u, nu) = ((sum(covers[s, k, n] for k, n in names if k == kind), sum(k == kind for k, _ in names)) for kind in ("topic", "subtopic"))
            if t or u:
                rows.append((-round(0.85 * t / nt + 0.15 * u / nu, 4), -t, titles[s], str(s)))
        want.update((order, i, r[3], -r[0], -r[1]) for i, r in enumerate(sorted(rows)[:3], 1))
    out = registry.queries()["coverage_rank_all"](spark, SF).collect()
    assert {(r["query_id"], r["rank"], r["document_id"], r["score"], r["n_matched"]) for r in out} == want
    assert len({r["query_id"] for r in out}) == len(asked) > 1000
    assert registry.queries()["coverage_violations_all"](spark, SF).first()["n"] == 0


def test_dense_topk_in_blocks_of_the_stated_questions(spark, monkeypatch):
    monkeypatch.setattr(dense, "PART_QUERIES", 7)
    monkeypatch.setattr(dense, "PART_ROWS", 20)
    rows = sorted((r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    v = np.array([r[2] for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    want, merged = {}, {}
    for q in np.flatnonzero(ids % 20 == 0):
        score, all_hits = np.round(v @ v[q], 6), []
        for label in set(labels):
            mine = np.flatnonzero(labels == label)
            top = sorted((-score[i], ids[i]) for i in mine)[:5]
            want.update({(ids[q], label, n): (i, -s) for n, (s, i) in enumerate(top, 1)})
            all_hits += [x for x in top if -x[0] >= 0.1]
        merged.update({(ids[q], n): (i, -s) for n, (s, i) in enumerate(sorted(all_hits)[:5], 1)})
    out = registry.queries()["dense_topk_by_collection"](spark, SF).collect()
    assert {(r["query_id"], r["collection"], r["rank"]): (r["id"], r["score"]) for r in out} == want
    out = registry.queries()["dense_topk_all_collections"](spark, SF).collect()
    assert {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in out} == merged
