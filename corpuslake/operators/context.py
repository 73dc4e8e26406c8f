"""Prompts: sources within a budget, rendered blocks, internal and web parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions import params
from corpuslake.functions.text import truncate

EMPTY_NOTE = "No relevant context was found."


def source_block(index: Column, labels: list[Column], body: Column) -> Column:
    """``[Source i] (label, label)`` over the body; labels that are null are left out."""
    known = F.filter(F.array(*labels), lambda x: x.isNotNull())
    head = F.concat(F.lit("[Source "), index.cast("string"), F.lit("]"), F.when(F.size(known) > 0, F.concat(F.lit(" ("), F.array_join(known, ", "), F.lit(")"))).otherwise(F.lit("")))
    return F.concat(head, F.lit("\n"), F.coalesce(body, F.lit("")))


def web_block(index: Column, title: Column, url: Column, retrieved_at: Column, body: Column) -> Column:
    """``[Web i] title (url), retrieved time`` over the body."""
    when = F.when(retrieved_at.isNotNull() & (retrieved_at != ""), F.concat(F.lit(", retrieved "), retrieved_at)).otherwise(F.lit(""))
    name = F.coalesce(F.nullif(title, F.lit("")), F.lit("Web result"))
    return F.concat(F.lit("[Web "), index.cast("string"), F.lit("] "), name, F.lit(" ("), F.coalesce(url, F.lit("")), F.lit(")"), when, F.lit("\n"), F.coalesce(body, F.lit("")))


def web_contexts(web: DataFrame, queries: DataFrame, max_chars: int = params.CONTEXT_CHARS, max_sources: int = params.CONTEXT_SOURCES) -> DataFrame:
    """(query_id, n_sources, context) of web rows (query_id, rank, title, url, retrieved_at, text), numbered from 1 in order of rank.

    Blocks are measured with the number 0, so the numbers do not bear on what fits.
    """
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "url"))
    parts = [F.col(c) for c in ("title", "url", "retrieved_at", "text")]
    rows = web.withColumn("rank", place)
    measured = rows.withColumn("block", web_block(F.lit(0), *parts))
    order = Window.partitionBy("query_id").orderBy("rank")
    used = F.sum(F.length("block") + 2).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = measured.withColumn("used", used).where((F.col("rank") <= max_sources) & ((F.col("rank") == 1) | (F.col("used") <= max_chars)))
    numbered = fits.select("query_id", "rank", truncate(web_block(F.col("rank"), *parts), max_chars).alias("block"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "block")))
    joined = numbered.groupBy(F.col("query_id").alias("qid")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(ordered, lambda s: s["block"]), "\n\n").alias("c"))
    out = queries.join(joined, F.col("query_id") == F.col("qid"), "left")
    return out.select("query_id", F.coalesce("n", F.lit(0)).alias("n_sources"), F.coalesce("c", F.lit(EMPTY_NOTE)).alias("context"))


def within_budget(hits: DataFrame, max_chars: int = params.CONTEXT_CHARS, max_sources: int = params.CONTEXT_SOURCES) -> DataFrame:
    """Leading rows of (query_id, rank, block) whose blocks, each with 2 characters between, fit; the first is always kept, and cut to the limit."""
    order = Window.partitionBy("query_id").orderBy("rank")
    used = F.sum(F.length("block") + 2).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = hits.where(F.col("rank") <= max_sources).withColumn("used", used)
    first = F.row_number().over(order) == 1
    return rows.withColumn("first", first).where(F.col("first") | (F.col("used") <= max_chars)).withColumn("block", truncate(F.col("block"), max_chars)).drop("first", "used")


def contexts(hits: DataFrame, queries: DataFrame, max_chars: int = params.CONTEXT_CHARS, max_sources: int = params.CONTEXT_SOURCES) -> DataFrame:
    """(query_id, n_sources, context) for each question; a note where it has no source."""
    kept = within_budget(hits, max_chars, max_sources).groupBy(F.col("query_id").alias("qid"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "block")))
    joined = kept.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(ordered, lambda s: s["block"]), "\n\n").alias("c"))
    rows = queries.join(joined, F.col("query_id") == F.col("qid"), "left")
    return rows.select("query_id", F.coalesce("n", F.lit(0)).alias("n_sources"), F.coalesce("c", F.lit(EMPTY_NOTE)).alias("context"))


def prompts(contexts_: DataFrame, queries: DataFrame, history: DataFrame | None = None, web: DataFrame | None = None) -> DataFrame:
    """(query_id, prompt): context, web, conversation and question blocks; the web and conversation blocks only where they exist."""
    rows = queries.select("query_id", "text").join(contexts_.select("query_id", "context"), "query_id", "left")
    rows = rows.join(history.select("query_id", "history"), "query_id", "left") if history is not None else rows.withColumn("history", F.lit(None).cast("string"))
    rows = rows.join(web.select("query_id", F.col("context").alias("web")), "query_id", "left") if web is not None else rows.withColumn("web", F.lit(None).cast("string"))

    def block(title: str, c: str) -> Column:
        return F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat(F.lit(f"{title}:\n"), F.col(c)))

    parts = F.array(F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit(EMPTY_NOTE))), block("Web", "web"), block("Conversation", "history"), F.concat(F.lit("Question:\n"), F.coalesce("text", F.lit(""))))
    return rows.select("query_id", F.array_join(parts, "\n\n").alias("prompt"))


def reported_sources(hits: DataFrame, k: int) -> DataFrame:
    """The first k hits of each question with ``kind`` internal or web by their collection."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    kind = F.when(F.col("collection") == "web", "web").otherwise("internal")
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("kind", kind)
