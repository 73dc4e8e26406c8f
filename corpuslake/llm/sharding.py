"""Proportional stratified interleaving of documents into shards.

Within each source the rows are shuffled by a seeded hash and ranked; a row's fractional rank
``(rank - u) / n`` spreads its source evenly over (0, 1], where ``u`` in [0, 1) is a seeded
offset of the source, so that sources of one row don't meet at one point. Of rows alike in all that
is read, each but the first is shuffled by its number too. Sorted by fractional
rank, any stretch of the order holds each source in its share; cutting the order at equal counts
gives shards of the same mixture whose row counts differ by one at most (law ``rows``).

DataFrame functions only. Neither rank sorts a whole source or the whole table in one task:
see :func:`corpuslake.llm.common.global_rank`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import copy_numbers, cut, global_rank

#: Rows of the table of sources that are broadcast, at most.
BROADCAST_SOURCES = 50_000
#: Hash buckets that a source's rows, and the whole order, are sorted in; more where rows are many.
MIN_BUCKETS, MAX_BUCKETS, ROWS_PER_BUCKET = 1024, 65536, 50_000


def seeded(seed: int, *parts: Column) -> Column:
    """A number in [0, 2^52) from the md5 of the seed and the parts, the same in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def assign_shards(docs: DataFrame, n_shards: int = 16, seed: int = 42, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, text_crc32, law, shard, slot, grown_shard, then ``carry``.

    ``size`` is the UTF-8 length of the text plus 1. ``slot`` numbers the rows of a shard from 0
    without gaps. ``grown_shard`` is null under law ``rows``.

    Defined cases: a null text counts as empty (size 1, crc32 0); a null source is a source of
    its own; rows with a null or repeated doc_id each get a slot of their own, and rows alike in
    every column that is read are interchangeable; fewer rows than shards leave shards empty; an
    empty table gives no rows; other columns are ignored unless carried.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(F.encode(text, "UTF-8"))
    rows = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        crc.cast("long").alias("text_crc32"),
        *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)),
    )
    rows = cut(rows.withColumn("hash", seeded(seed, F.col("doc_id"), F.col("text_crc32"))).withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    numbered = copy_numbers(rows, ["source", "doc_id", "text_crc32", "size"])
    if numbered is not None:  # rows alike would have one hash and meet in one bucket
        again = seeded(seed, F.col("doc_id"), F.col("text_crc32"), F.col("copy"))
        rows = cut(numbered.withColumn("hash", F.when(F.col("copy") > 0, again).otherwise(F.col("hash"))).drop("copy"))
    buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, total // ROWS_PER_BUCKET))
    within = [F.col("hash"), F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]

    rows = rows.withColumn("bucket", F.shiftright("hash", 36) * F.lit(buckets).cast("long"))
    rows = rows.withColumn("bucket", F.shiftright("bucket", 16))  # hash / 2^52 * buckets, rounded down
    ranked = global_rank(rows, ["source"], "bucket", within, "rank")
    sizes = cut(rows.groupBy(F.col("source").alias("sized")).agg(F.count(F.lit(1)).alias("n")))
    per_source = F.broadcast(sizes) if sizes.count() <= BROADCAST_SOURCES else sizes
    ranked = ranked.join(per_source, F.col("source").eqNullSafe(F.col("sized"))).drop("sized")
    offset = seeded(seed, F.col("source")) / F.lit(float(1 << 52))
    placed = ranked.withColumn("at", (F.col("rank") - offset) / F.col("n"))
    placed = cut(placed.withColumn("bucket", F.least(F.floor(F.col("at") * buckets), F.lit(buckets - 1))))
    order = [F.col("at"), F.col("source").asc_nulls_first(), *within]
    spread = global_rank(placed, [], "bucket", order, "position").withColumn("position", F.col("position") - 1)
    shard = F.expr(f"position * {n_shards} div {max(total, 1)}")
    return spread.withColumn("shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.expr(f"position - (shard * {total} + {n_shards - 1}) div {n_shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
        *(F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)),
    )



def _crc_table() -> list[int]:
    """The table of the CRC-32 of IEEE 802.3, from its polynomial."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return table


def oracle(n_shards: int = 16, seed: int = 42) -> str:
    """DuckDB SQL for the rows of :func:`assign_shards`; CRC-32 is folded over the bytes."""
    number = "('0x' || substr(md5({}), 1, 13))::BIGINT"
    first, again = (number.format(f"concat_ws(':', '{seed}', coalesce(doc_id::VARCHAR, 'null'), text_crc32::VARCHAR{more})") for more in ("", ", copy::VARCHAR"))
    offset = number.format(f"concat_ws(':', '{seed}', coalesce(source, 'null'))")
    return f"""
    WITH bytes AS (
        SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size,
               list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b
        FROM documents),
    rows AS (
        SELECT doc_id, source, size::BIGINT AS size,
               xor(list_reduce(list_prepend(4294967295::BIGINT, b),
                   lambda c, x: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
        FROM bytes),
    copies AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id, text_crc32, size) - 1 AS copy FROM rows),
    hashed AS (SELECT *, CASE WHEN copy > 0 THEN {again} ELSE {first} END AS h FROM copies),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, text_crc32, size) AS r,
               count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total
        FROM hashed),
    placed AS (SELECT *, (r - {offset}::DOUBLE / 4503599627370496e0) / n AS f FROM ranked),
    cut AS (
        SELECT *, row_number() OVER (ORDER BY f, source NULLS FIRST, h, doc_id NULLS FIRST, text_crc32, size) - 1 AS p
        FROM placed)
    SELECT doc_id, size, text_crc32, 'rows' AS law, (p * {n_shards} // total)::INTEGER AS shard,
           (p - ((p * {n_shards} // total) * total + {n_shards - 1}) // {n_shards})::BIGINT AS slot,
           NULL::INTEGER AS grown_shard, source
    FROM cut"""
