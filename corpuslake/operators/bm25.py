"""BM25 over tables: postings, statistics and top-k for a table of questions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import params
from corpuslake.functions.text import tokens
from corpuslake.operators import shards


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf, length): a row for each distinct term of a document."""
    cut = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("t"))
    terms = cut.select("doc_id", F.size("t").alias("length"), F.explode("t").alias("term"))
    return terms.groupBy("doc_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, df): in how many documents a term occurs."""
    distinct = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
    return distinct.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row (n_docs, avg_length); a document without terms counts with length 0."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(tokens(F.col(text_col)))).alias("avg_length"))


def bm25_topk(
    queries: DataFrame,
    docs: DataFrame,
    k: int = params.TOP_K,
    k1: float = params.K1,
    b: float = params.B,
    query_id: str = "query_id",
    query_text: str = "text",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(query_id, rank, doc_id, score): documents of positive score, by score rounded to 6 places, then doc_id.

    The texts are read once, into an index of shards (see :mod:`corpuslake.operators.shards`), which
    answers all questions; an index that is kept is asked with :func:`shards.search`.
    """
    if k <= 0 or k1 < 0 or not 0 <= b <= 1 or not math.isfinite(k1):
        raise ValueError("k must be positive, k1 not negative, b within 0 and 1")
    return shards.search(shards.build_index(docs, None, id_col, text_col), queries, k, k1, b, query_id, query_text)
