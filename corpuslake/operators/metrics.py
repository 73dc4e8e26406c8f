"""Measures of rankings, routing, answers and extraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.text import ngrams
from corpuslake.sources.scratch import cut


def retrieval_metrics(hits: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, precision, rr) for each question of ``qrels`` (query_id, doc_id), from hits (query_id, rank, doc_id).

    Precision divides distinct relevant documents by rows returned; all are 0 without hits.
    """
    wanted = qrels.select("query_id", "doc_id").distinct()
    total = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    near = hits.where(F.col("rank") <= k).select("query_id", "doc_id", "rank")
    marked = near.join(wanted.withColumn("good", F.lit(True)), ["query_id", "doc_id"], "left")
    per_query = marked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("returned"),
        F.count_distinct(F.when(F.col("good"), F.col("doc_id"))).alias("found"),
        F.min(F.when(F.col("good"), F.col("rank"))).alias("first"),
    )
    joined = total.join(per_query, "query_id", "left")

    def zero(c: Column, name: str) -> Column:
        return F.coalesce(c, F.lit(0.0)).alias(name)

    return joined.select("query_id", zero(F.col("found") / F.col("n_relevant"), "recall"), zero(F.col("found") / F.col("returned"), "precision"), zero(1 / F.col("first"), "rr"))


def macro_average(per_query: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return per_query.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(c), 4).alias(c) for c in ("recall", "precision", "rr"))
    )


def empty_rate(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One row (n_queries, empty_rate): the share of questions without a hit; 0 where there is no question."""
    marked = queries.select("query_id").join(hits.select("query_id").distinct().withColumn("hit", F.lit(1)), "query_id", "left")
    return marked.agg(F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.round(F.avg(F.col("hit").isNull().cast("int")), 4), F.lit(0.0)).alias("empty_rate"))


def routing_metrics(routed: DataFrame) -> DataFrame:
    """One row (n, accuracy, false_rate, fallback_rate) from (expected, strategy, used_fallback)."""
    right = (F.col("expected") == F.col("strategy")).cast("int")
    return routed.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(right), 4).alias("accuracy"),
        F.round(F.avg(1 - right), 4).alias("false_rate"),
        F.round(F.avg(F.col("used_fallback").cast("int")), 4).alias("fallback_rate"),
    )


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def faithfulness(answer: Column, source: Column, n: int = 4) -> Column:
    """Share of the answer's distinct n-grams that its sources hold; 1 for an answer too short for one."""
    return shared_grams(words(answer), words(source), n)


def shared_grams(said: Column, read: Column, n: int = 4) -> Column:
    """:func:`faithfulness` of arrays of words."""
    own = F.array_distinct(ngrams(said, n))
    return F.when(F.size(own) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(own, ngrams(read, n))) / F.size(own))


def citations_valid(answer: Column, n_sources: Column) -> Column:
    """Whether an answer cites a source and none beyond those it was given."""
    cited = F.transform(F.regexp_extract_all(answer, F.lit(r"\[Source (\d+)\]"), 1), lambda c: c.cast("bigint"))
    return (F.size(cited) > 0) & F.forall(cited, lambda c: (c >= 1) & (c <= n_sources))


def answer_checks(answers: DataFrame, n: int = 4, unknown: str = "sufficient information") -> DataFrame:
    """(query_id, n_sources, faithfulness, source_correct, hallucinated) of answers (query_id, answer, sources array<string>).

    Marks of sources and a lead-in are no content. An answer too short for an n-gram is faithful
    only if it had no sources. It is hallucinated if it cites and holds n-grams that no source has, or
    has no sources and does not say that it lacks information.
    """
    content = F.regexp_replace(F.regexp_replace("answer", r"\[Source \d+\]", ""), r"(?i)^\s*according\s+to\s*:?\s*", "")
    rows = answers.select("query_id", "answer", F.size("sources").alias("n_sources"), words(content).alias("said"), words(F.array_join("sources", " ")).alias("read"))
    rows = rows.select("query_id", "answer", "n_sources", F.array_distinct(ngrams(F.col("said"), n)).alias("own"), F.array_distinct(ngrams(F.col("read"), n)).alias("held"))
    rows = rows.withColumn("shared", F.array_intersect("own", "held"))
    shared, none = F.size("shared"), F.col("n_sources") == 0
    faithful = F.when(F.size("own") > 0, shared / F.size("own")).otherwise(none.cast("double"))
    beyond = (shared < F.size("own")) & F.col("answer").rlike(r"\[Source \d+\]")
    return rows.select(
        "query_id", "n_sources", F.round(faithful, 4).alias("faithfulness"), citations_valid(F.col("answer"), F.col("n_sources")).alias("source_correct"),
        (beyond | (none & ~F.col("answer").contains(unknown))).alias("hallucinated"),
    )


def answer_summary(checks: DataFrame) -> DataFrame:
    """One row (n, mean_faithfulness, relevance, source_correctness, hallucination_rate) of :func:`answer_checks`; rates of no answer are 0."""

    def share(c: Column) -> Column:
        return F.coalesce(F.round(F.avg(c), 4), F.lit(0.0))

    return checks.agg(
        F.count(F.lit(1)).alias("n"), share(F.col("faithfulness")).alias("mean_faithfulness"), share((F.col("n_sources") > 0).cast("int")).alias("relevance"),
        share(F.col("source_correct").cast("int")).alias("source_correctness"), share(F.col("hallucinated").cast("int")).alias("hallucination_rate"),
    )


def extraction_quality(texts: DataFrame) -> DataFrame:
    """(extraction_method, n, character_accuracy, word_recall) from (extraction_method, extracted, truth)."""
    rows = texts.select("extraction_method", similarity(F.col("extracted"), F.col("truth")).alias("s"), word_recall(F.col("extracted"), F.col("truth")).alias("w"))
    return rows.groupBy("extraction_method").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 4).alias("character_accuracy"), F.round(F.avg("w"), 4).alias("word_recall"))


def hit_documents(hits: DataFrame, titles: DataFrame) -> DataFrame:
    """``hits`` (document_id, title, collection, ...) with ``doc``: its own id, else that of the document (id, known_title) with its title, else its title, else its collection."""
    known = titles.groupBy("known_title").agg(F.min("id").alias("by_title"))
    rows = hits.join(known, F.col("title") == F.col("known_title"), "left")
    doc = F.coalesce(F.nullif("document_id", F.lit("")), "by_title", F.nullif("title", F.lit("")), "collection")
    return rows.withColumn("doc", doc).drop("known_title", "by_title")


def word_recall(extracted: Column, truth: Column) -> Column:
    """Share of the truth's distinct words that the extracted text holds; 1 where the truth has none."""
    wanted = F.array_distinct(words(truth))
    return F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(wanted, words(extracted))) / F.size(wanted))


#: Texts up to so many characters are compared by Spark's own function, in the product of their lengths.
SHORT_TEXT = 256


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements of characters between two texts, with a column of the table as the bits of one number.

    What the texts begin and end with alike is left out. For the rest, each character of the longer takes time in proportion to the
    shorter's length over the word size; nothing is held but numbers of as many bits as that has characters.
    """
    if len(a) > len(b):
        a, b = b, a
    first = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    a, b = a[first:], b[first:]
    last = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), len(a))
    a, b = a[: len(a) - last], b[: len(b) - last]
    if not a:
        return len(b)
    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes).tolist()}
    every, top, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = every, 0  # rows where the column rises and falls by one
    for char in b:
        same = at.get(char, 0)
        level = same | down
        carried = (((same & up) + up) ^ up) | same
        rises, falls = down | (every & ~(carried | up)), up & carried
        distance += bool(rises & top) - bool(falls & top)
        rises, falls = (rises << 1 | 1) & every, falls << 1 & every
        up, down = falls | (every & ~(level | rises)), rises & level
    return distance


def similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length; 1 for two empty texts. Long texts go through :func:`edit_distance`, batch by batch."""

    def distances(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(left, right, strict=True)], dtype="Int64")

    longest = F.greatest(F.length(a), F.length(b))
    long = longest > SHORT_TEXT
    # where a text is long the other function gets nulls, and the other way round
    slow = F.pandas_udf(distances, "long")(F.when(long, a), F.when(long, b))
    edits = F.when(long, slow).otherwise(F.levenshtein(F.when(~long, a), F.when(~long, b)).cast("long"))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - edits / longest)


def quoted_answer(body: Column, max_chars: int = 400) -> Column:
    return F.concat(F.substring(body, 1, max_chars), F.lit(" [Source 1]"))


#: Bits of a digit of the selection, and rows of a digit that are sorted outright instead of being split by the next.
DIGIT_BITS, SORTED_ROWS = 16, 100_000


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles, NaN last; the inverse of itself on the bits."""
    bits = values.view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def select_places(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(by, place, key): of rows (by, key long), the key at each wanted place (by, place) of the order, counted from 0.

    A pass counts rows by the next 16 bits of their keys and follows the digit that holds the place, until so few rows
    are left that they are sorted, or none of the 64 bits is. Every pass counts before it shuffles;
    neither many equal values nor values far apart bring rows together.
    """
    at = wanted.select("by", "place", F.col("place").alias("rest"), F.lit(None).cast("long").alias("prefix"))
    for depth in range(64 // DIGIT_BITS):
        shift = 64 - DIGIT_BITS * (depth + 1)
        asked = at.select("by", "prefix").distinct()
        inside = F.col("rows.by").eqNullSafe(F.col("asked.by"))
        if depth:
            inside = inside & (F.shiftright("rows.key", shift + DIGIT_BITS) == F.col("asked.prefix"))
        met = rows.alias("rows").join(asked.alias("asked"), inside, "left_semi")
        counts = met.groupBy("by", F.shiftright("key", shift).alias("next")).agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.partitionBy("by", "upper").orderBy("next")) - F.col("n")  # 2^16 rows of a digit at most
        upper = F.shiftright("next", DIGIT_BITS) if depth else F.lit(0).cast("long")
        bins = counts.withColumn("upper", upper).withColumn("before", before).withColumnRenamed("by", "of")
        same = F.col("by").eqNullSafe(F.col("of")) & (F.col("rest") >= F.col("before")) & (F.col("rest") < F.col("before") + F.col("n"))
        if depth:
            same = same & (F.col("prefix") == F.col("upper"))
        found = cut(at.join(bins, same).select("by", "place", (F.col("rest") - F.col("before")).alias("rest"), F.col("next").alias("prefix"), "n"))
        at = found.drop("n")
        if (found.agg(F.max("n")).first()[0] or 0) <= SORTED_ROWS:
            break
    asked = at.groupBy(F.col("by").alias("of"), "prefix").agg(F.collect_list(F.struct("place", "rest")).alias("places"))
    left = rows.join(asked, F.col("by").eqNullSafe(F.col("of")) & (F.shiftright("key", shift) == F.col("prefix")))
    if shift == 0:  # all left of a digit are equal
        left = left.groupBy("by", "key", "places").agg(F.count(F.lit(1)).alias("n"))
        return left.select("by", F.explode("places").alias("p"), "key").select("by", "p.place", "key")
    nth = left.withColumn("nth", F.row_number().over(Window.partitionBy("by", "prefix").orderBy("key")) - 1)  # SORTED_ROWS at most
    found = nth.select("by", "key", F.explode(F.filter("places", lambda p: p["rest"] == F.col("nth"))).alias("p"))
    return found.select("by", "p.place", "key")


def latency_summary(samples: DataFrame, by: str = "stage", value: str = "ms") -> DataFrame:
    """(by, n, mean, median, p95, min, max); p95 is the element at the whole part of 0.95 n, counted from 0. Null values are left out.

    Places of the order are found by :func:`select_places`, whatever the values and however many a stage has.
    """
    kind = samples.schema[by].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ordered_bits(batch.column(1).to_numpy(zero_copy_only=False)))], ["by", "key"])

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2).to_numpy(zero_copy_only=False).copy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ordered_bits(keys.view(np.float64)).view(np.float64))], ["by", "place", "v"])

    rows = samples.where(F.col(value).isNotNull()).select(F.col(by).alias("by"), F.col(value).cast("double").alias("v"))
    stats = cut(rows.groupBy("by").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max")))
    keys = cut(rows.mapInArrow(keyed, f"by {kind}, key long"))
    places = F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2"), F.expr("n * 95 div 100")))
    found = select_places(keys, stats.select("by", F.explode(places).alias("place"))).mapInArrow(valued, f"by {kind}, place long, v double")
    told = found.join(stats.select(F.col("by").alias("of"), "n"), F.col("by").eqNullSafe(F.col("of")))

    def value_at(place: str) -> Column:
        return F.max(F.when(F.col("place") == F.expr(place), F.col("v")))

    median = F.round((value_at("(n - 1) div 2") + value_at("n div 2")) / 2, 4)
    marks = told.groupBy("of").agg(median.alias("median"), value_at("n * 95 div 100").alias("p95"))
    return stats.join(marks, F.col("by").eqNullSafe(F.col("of"))).select(F.col("by").alias(by), "n", "mean", "median", "p95", "min", "max")
