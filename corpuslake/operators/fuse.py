"""Reciprocal rank fusion of two rankings, and the blend that reranks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions import params


def fuse(dense: DataFrame, sparse: DataFrame, rrf_k: int = params.RRF_K) -> DataFrame:
    """(query_id, doc_id, rrf, dense, sparse) from two tables (query_id, doc_id, rank, score): a full outer join."""
    a = dense.select("query_id", "doc_id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense"))
    b = sparse.select("query_id", "doc_id", F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse"))

    def part(rank: str):
        return F.coalesce(1.0 / (F.lit(rrf_k) + F.col(rank)), F.lit(0.0))

    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    return both.select("query_id", "doc_id", (part("dense_rank") + part("sparse_rank")).alias("rrf"), "dense", "sparse")


def rerank(fused: DataFrame, k: int = params.TOP_K, rrf_weight: float = params.RRF_WEIGHT, dense_weight: float = params.DENSE_WEIGHT) -> DataFrame:
    """(query_id, rank, doc_id, score): the share of the best fused score blended with the dense score's place between its least and most."""
    per_query = Window.partitionBy("query_id")
    low, high = F.min("dense").over(per_query), F.max("dense").over(per_query)
    place = F.when(F.col("dense").isNotNull() & (high > low), (F.col("dense") - low) / (high - low)).otherwise(F.lit(0.0))
    most = F.max("rrf").over(per_query)
    score = F.round(rrf_weight * F.when(most > 0, F.col("rrf") / most).otherwise(F.lit(0.0)) + dense_weight * place, 6)
    scored = fused.select("query_id", "doc_id", score.alias("score"))
    rank = F.row_number().over(per_query.orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def pool_size(k: int) -> int:
    return max(2 * k, 10)
