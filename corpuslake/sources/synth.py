"""Academic pages built from the star schema by concatenation, so that they grow with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_COLUMNS = ("document_id", "page", "text", "ingest_seq")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def syllabus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A syllabus per supplier: its nation's studies, with a unit for each of its four parts."""
    supplier, nation, region, part = tables(spark, sf_dir, "supplier", "nation", "region", "part")
    units = part.where("p_partkey > 0").select(F.expr("(p_partkey - 1) div 4 + 1").alias("s"), F.expr("(p_partkey - 1) % 4 + 1").alias("unit"), "p_name", "p_type")
    lines = units.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("unit", F.concat(F.lit("Unit "), F.col("unit").cast("string"), F.lit(": "), "p_name", F.lit("\nOn "), "p_type", F.lit(".")).alias("line")))).alias("units"))
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(lines, F.col("s_suppkey") == F.col("s"))
    text = F.concat(
        "n_name", F.lit(" Studies Syllabus\n"), "r_name", F.lit(" University\nBachelor of Computer Science\nSemester "), (F.col("s_suppkey") % 8 + 1).cast("string"),
        F.lit("\nCSC-"), (F.col("s_suppkey") % 900 + 100).cast("string"), F.lit("\n"), F.array_join(F.transform("units", lambda u: u["line"]), "\n"),
    )
    return rows.select(F.concat(F.lit("syl-"), F.col("s_suppkey").cast("string")).alias("document_id"), F.lit(1).alias("page"), text.alias("text"), F.col("s_suppkey").alias("ingest_seq"))


def paper_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A past paper per order: a question for each of its lines."""
    orders, lineitem, part = tables(spark, sf_dir, "orders", "lineitem", "part")
    asked = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
    line = F.concat(F.lit("Q"), F.col("l_linenumber").cast("string"), F.lit(". Explain "), "p_name", F.lit(". ("), (F.col("l_partkey") % 9 + 2).cast("string"), F.lit(" marks)"))
    questions = asked.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))).alias("q"))
    text = F.concat(F.lit("Studies of Priority "), "o_orderpriority", F.lit("\nFull Marks: 60\nExamination "), F.date_format("o_orderdate", "yyyy"), F.lit("\n"), F.array_join(F.transform("q", lambda q: q["line"]), "\n"))
    rows = orders.join(questions, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(F.concat(F.lit("paper-"), F.col("o_orderkey").cast("string")).alias("document_id"), F.lit(1).alias("page"), text.alias("text"), F.col("o_orderkey").alias("ingest_seq"))


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book of two pages per supplier's four parts: a chapter and a subsection for each part."""
    (part,) = tables(spark, sf_dir, "part")
    book, chapter = F.expr("(p_partkey - 1) div 4 + 1"), F.expr("(p_partkey - 1) % 4 + 1")
    n = chapter.cast("string")
    line = F.concat(F.lit("Chapter "), n, F.lit(": "), "p_name", F.lit("\nAbout it.\n"), n, F.lit(".1 "), "p_type", F.lit("\nMore of it."))
    rows = part.select(book.alias("b"), F.expr("((p_partkey - 1) % 4) div 2 + 1").alias("page"), F.struct(chapter.alias("c"), line.alias("line")).alias("l"))
    text = F.concat(F.when(F.col("page") == 1, F.concat(F.lit("The Book of "), F.col("b").cast("string"), F.lit("\nby Jane Doe\nISBN 1\n"))).otherwise(""), F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n"))
    return rows.groupBy("b", "page").agg(text.alias("text")).select(F.concat(F.lit("book-"), F.col("b").cast("string")).alias("document_id"), F.col("page").cast("int"), "text", F.col("b").alias("ingest_seq"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text, expected) per part, covering the router's branches in turn."""
    (part,) = tables(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("What are the topics of "), "p_name", F.lit("?")))
        .when(kind == 1, F.concat(F.lit("Which subjects are in semester "), (F.col("p_partkey") % 8 + 1).cast("string"), F.lit("?")))
        .when(kind == 2, F.concat(F.lit("Explain regulation "), F.col("p_size").cast("string")))
        .when(kind == 3, F.concat(F.lit("latest news on "), "p_name"))
        .when(kind == 4, F.concat(F.lit("past questions about "), "p_name"))
        .otherwise(F.concat(F.lit("How does "), "p_name", F.lit(" work")))
    )
    expected = F.when(kind.isin(0, 1, 4), "GRAPH").when(kind == 2, "HYBRID").when(kind == 3, "WEB").otherwise("NORMAL")
    return part.select(F.col("p_partkey").alias("query_id"), text.alias("text"), expected.alias("expected"))
