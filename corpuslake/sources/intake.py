"""Intake of binary documents and page rows; parsed replies of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 20 * 1024 * 1024
MIN_PAGE_CHARS, TEXT_RATIO = 20, 0.5


def read_binary(spark: SparkSession, path: str, extension: str = "pdf", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files of a folder with ``reject_reason``, null for those to take in; only their first bytes are kept."""
    files = spark.read.format("binaryFile").load(path)
    return checked(files, extension, max_bytes)


def checked(files: DataFrame, extension: str = "pdf", max_bytes: int = MAX_BYTES) -> DataFrame:
    magic = F.substring("content", 1, 4)
    reason = (
        F.when(~F.lower("path").endswith(f".{extension}"), "unsupported extension").when(F.col("length") == 0, "empty file")
        .when(F.col("length") > max_bytes, "too large").when(magic != F.lit(b"%PDF"), "not a PDF")
    )
    return files.select("path", "length", reason.alias("reject_reason"))


def build_documents(pages: DataFrame, names: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """(document_id, page_count, page_errors, text): pages joined in order; a page with an error has no text."""
    text = F.when(F.col("error").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.lit(""))
    ordered = F.array_sort(F.collect_list(F.struct("page_number", text.alias("text"))))
    errors = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("page_number", "error"))))
    return pages.groupBy(*names).agg(F.count(F.lit(1)).alias("page_count"), errors.alias("page_errors"), F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))


def page_profile(pages: DataFrame, min_chars: int = MIN_PAGE_CHARS) -> DataFrame:
    """(document_id, page_count, total_chars, text_pages, text_ratio) from (document_id, text)."""
    chars = F.length(F.trim(F.coalesce("text", F.lit(""))))
    rows = pages.select("document_id", chars.alias("chars"))
    out = rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count"), F.sum("chars").alias("total_chars"), F.count_if(F.col("chars") >= min_chars).alias("text_pages"))
    return out.withColumn("text_ratio", F.col("text_pages") / F.col("page_count"))


def extraction_route(text_ratio: Column, forced: str | None = None, least: float = TEXT_RATIO) -> Column:
    if forced is not None:
        return F.lit(forced)
    return F.when(F.coalesce(text_ratio, F.lit(0.0)) >= least, "text").otherwise("ocr")


METADATA_SCHEMA = "title string, author string, subject string, subject_code string, semester int, year int, topics array<string>, subtopics array<string>"


#: Fields that must be lists where a reply has them, and what of, as a variant names its type.
LISTS = {"topics": "STRING", "subtopics": "STRING", "questions": "OBJECT", "chapters": "OBJECT"}


def list_error(body: Column) -> Column:
    """What is wrong with the shape of a reply's lists: the first field, by name, that is not a list of what it should hold; null where all are."""
    out = F.lit(None).cast("string")
    for field, kind in sorted(LISTS.items(), reverse=True):
        value = F.try_variant_get(F.try_parse_json(body), f"$.{field}", "variant")
        shape = F.schema_of_variant(value)
        fits = value.isNull() | F.is_variant_null(value) | (shape == "ARRAY<VOID>") | shape.rlike(f"^ARRAY<{kind}(<.*)?>$")
        out = F.when(~fits, F.lit(f"{field} is not a list of {'strings' if kind == 'STRING' else 'objects'}")).otherwise(out)
    return out


def parse_replies(replies: DataFrame, schema: str = METADATA_SCHEMA) -> DataFrame:
    """(document_id, reply, error) from (document_id, raw, ...): the object between the first and last brace, without fences, read by the schema.

    Lists of another shape are an error. Where ``replies`` has a column ``document_type`` and the schema
    that field, it takes the place of what the reply says.
    """
    body = F.regexp_extract(F.coalesce("raw", F.lit("")), r"(?s)(\{.*\})", 1)
    rows = replies.withColumn("body", body).withColumn("parsed", F.from_json("body", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    error = F.when(F.col("body") == "", "no JSON object").when(F.col("parsed._corrupt").isNotNull() & list_error(F.col("body")).isNull(), "malformed or mistyped JSON").otherwise(list_error(F.col("body")))
    fields = F.col("parsed").dropFields("_corrupt")
    if "document_type" in replies.columns and "document_type" in replies.sparkSession.createDataFrame([], schema).columns:
        fields = fields.withField("document_type", F.col("document_type"))
    return rows.withColumn("error", error).select("document_id", F.when(F.col("error").isNull(), fields).alias("reply"), "error")
