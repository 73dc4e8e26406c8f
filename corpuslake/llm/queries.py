"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_lexicon, chat_format, hard_negatives, merkle, mixing, pii, posting_lists, quality_knn, quality_rules, sharding, simhash, token_counts, token_output
from .common import scratch_path


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_lexicon.digests(bpe_lexicon.round_trip(docs, vocabulary("byte_bpe_50k.json")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_knn.score(docs, quality_knn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return quality_rules.measure(docs, quality_rules.fit_ratios(docs, trusted))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("piece_bpe_32k.model"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_output.write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary("word_bpe_49k.json"), end_id=2)
    return token_output.read_ids(spark, path, ids=False)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op10_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.with_injection(spark.read.parquet(f"{sf_dir}/conversations.parquet"), spark)
    return chat_format.digests(chat_format.write_conversations(turns))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved_on = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0, moved_on)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_sharding,
        op2_bpe_lexicon,
        op3_mixing,
        op4_quality_knn,
        op5_simhash,
        op6_quality_rules,
        op7_token_counts,
        op8_token_output,
        op9_pii,
        op10_posting_lists,
        op11_chat_format,
        op12_hard_negatives,
        op13_merkle_manifest,
    ]
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding.oracle(), "op12_hard_negatives": hard_negatives.oracle(), "op13_merkle_manifest": merkle.oracle()}
