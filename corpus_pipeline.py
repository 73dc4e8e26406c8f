"""A corpus pipeline of five stages over the operators of ``corpuslake.llm``.

Each stage takes (spark, docs, sf_dir) and returns a table with the columns of ``documents``, but
for the last, which returns token ids. Between stages the table is written as Parquet.

Defined cases, of all stages: an empty table gives an empty one; rows are told apart by their place, so null and
repeated doc_ids are rows like any other; columns beyond those of documents, whatever their names, are
carried to the last stage; texts are taken whole whatever their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm import bpe_lexicon, mixing, pii, quality_rules, simhash
from corpuslake.llm.common import stored
from corpuslake.llm.queries import vocabulary


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the likelihood ratio reject; null and empty texts fail the base rules."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return quality_rules.kept(docs, quality_rules.fit_ratios(docs, trusted))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of the smallest doc_id; texts without a word are one group."""
    return simhash.deduplicated(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the spans found in each text and counts its characters anew; a null text stays null."""
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, some of them several times, so that sources reach their targets; null is a source, and a source without words is not taken."""
    return mixing.repeated(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of the ids and of the text decoded from them; a null text has none."""
    trip = bpe_lexicon.round_trip(docs, vocabulary("byte_bpe_50k.json"))
    return bpe_lexicon.digests(trip.select("doc_id", "ids", "decoded"), F.col("ids"))


STAGES = [
    ("quality rules", apply_quality_rules),
    ("SimHash near-dedup", drop_near_duplicates),
    ("PII", mask_personal_data),
    ("mixing", mix_sources),
    ("BPE encoding", encode_tokens),
]

#: The stages' hashing, drawing and merging have no form in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *before, (_, last) = STAGES
    for name, stage in before:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return last(spark, docs, sf_dir)
