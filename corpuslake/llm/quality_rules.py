"""Quality rules: counts of each text, and the likelihood ratio of two hashed n-gram models.

The raw model is the multinomial of hashed words and word pairs over all documents, the target
model the same over trusted documents. A text's score is the logarithm of its likelihood under
the target over that under the raw corpus, divided by its number of n-grams; a document is kept if
it passes the base rules and its score reaches ``THRESHOLD``.

DataFrame functions only. Nothing but a table of ``BUCKETS`` ratios reaches the driver; it comes
back as a constant of the plan. Each document's counts stay in its own row: words, their hashes
and the hashes of windows are arrays, which grow with the text and not with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, words_of

BUCKETS = 16_384
#: Log-likelihood ratio an n-gram, in nats, from which a document is kept.
THRESHOLD = -0.12
#: Trusted documents that the target model is fitted on, at most.
TRUSTED_ROWS = 20_000
#: Words of a window; a power of two.
WINDOW = 8
#: Fixed value: characters counted as symbols.
SYMBOLS = "#*$%&|<>"


def bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def with_words(docs: DataFrame, *keep: Column | str) -> DataFrame:
    """``keep`` and words, with their hashes h in text order."""
    worded = docs.select(*keep, words_of(F.col("text")).alias("words"))
    return worded.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))


def chained(h: Column, apart: int) -> Column:
    """The hash of each number with that ``apart`` places on; of hashes of windows of as many words, those of windows twice as wide."""
    both = F.zip_with(F.slice(h, 1, F.size(h) - apart), F.slice(h, 1 + apart, F.size(h)), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(h) > apart, both).otherwise(F.array().cast("array<bigint>"))


def fit_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """Log of target over raw probability of each bucket, from all of ``docs`` and those with a doc_id in ``trusted``.

    Both multinomials are smoothed by adding one to each bucket. Of more than ``TRUSTED_ROWS``
    trusted ids those of the lowest hashes are used; null ids are nobody's.
    """
    ids = trusted.select(F.col("doc_id").alias("good")).where("good is not null").distinct().orderBy(F.xxhash64("good"), "good").limit(TRUSTED_ROWS)
    flagged = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("good"), "left").select("text", F.col("good").isNotNull().cast("int").alias("is_good"))
    grams = with_words(flagged, "is_good").select("is_good", F.explode(F.concat("h", chained(F.col("h"), 1))).alias("gram")).select("is_good", bucket(F.col("gram")).alias("b"))
    counts = {row["b"]: (row["raw"], row["good"]) for row in grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("is_good").alias("good")).collect()}
    raw = [counts.get(b, (0, 0))[0] + 1 for b in range(BUCKETS)]
    good = [counts.get(b, (0, 0))[1] + 1 for b in range(BUCKETS)]
    shift = math.log(sum(raw)) - math.log(sum(good))
    return [math.log(g) - math.log(r) + shift for g, r in zip(good, raw, strict=True)]


def repeated_words(windows: Column) -> Column:
    """Positions that lie in a window whose hash occurs twice or more, from the hashes in text order."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    size = F.size(windows)
    none = F.array(F.lit(None).cast("struct<h: bigint, i: int>"))
    before = F.zip_with(ordered, F.concat(none, F.slice(ordered, 1, size - 1)), lambda x, y: F.struct(x["h"].alias("h"), x["i"].alias("i"), F.coalesce(x["h"] == y["h"], F.lit(False)).alias("again")))
    places = F.zip_with(before, F.slice(ordered, 2, size), lambda x, y: F.when(x["again"] | (x["h"] == y["h"]), x["i"]))
    starts = F.sort_array(F.filter(places, lambda p: p.isNotNull()))
    reach = F.zip_with(starts, F.slice(starts, 2, size), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.aggregate(reach, F.lit(0), lambda total, n: total + n)


def measure(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score, then ``carry`` as carry_0 and so on.

    Defined cases: a null or empty text has all counts 0, fails the base rules and scores 0; a
    null or repeated doc_id is handed through, one row for each row; texts are read whole; an
    empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(SPACES)) != "")
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    carried = [f"carry_{i}" for i in range(len(carry))]
    docs = docs.select("doc_id", "text", *(F.col(c).alias(n) for c, n in zip(carry, carried, strict=True)))
    rows = with_words(docs, "doc_id", *carried, symbols.cast("long").alias("n_symbols"), lines.alias("lines"))
    rows = rows.select(
        "doc_id",
        *carried,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "h",
        chained(F.col("h"), 1).alias("pairs"),
    )
    windows, width = F.col("pairs"), 2
    while width < WINDOW:
        windows, width = chained(windows, width), 2 * width
    rows = rows.withColumn("windows", windows)
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    total = sum((F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.get(table, bucket(g))) for grams in ("h", "pairs")), start=F.lit(0.0))
    n_grams = F.size("h") + F.size("pairs")
    repeats = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), repeated_words(F.col("windows"))).otherwise(F.lit(0))
    rows = rows.select("doc_id", *carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.cast("long").alias("n_repeat_words"), F.coalesce(total / F.nullif(n_grams, F.lit(0)), F.lit(0.0)).alias("score"))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", *carried
    )


def kept(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, columns unchanged."""
    # a condition on the task keeps the optimizer from computing all counts anew inside a pushed-down filter
    measured = measure(docs, ratios, threshold, docs.columns).withColumn("task", F.spark_partition_id()).where("kept and task >= 0")
    return measured.select(*(F.col(f"carry_{i}").alias(c) for i, c in enumerate(docs.columns)))
