"""Rows out of a document's text: questions, topics, chapters, subtopics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.metadata import first_match, lines, marks, roman_to_int
from corpuslake.functions.text import clean_title, strip

# fixed values: how lines open a question, and how a question ends with its marks
OPENING = r"(?:[Qq][ \t\x0B\f]*\.?[ \t\x0B\f]*\d+[ \t\x0B\f]*[):.]|\(\d+\)|\d+[.):])"
TO_LINE_END = r".*+(?:\n|\z)"
MARKS_PHRASE = r"(?i)\s*(?:\(?\s*\d{1,3}\s*marks?\s*\)?|marks?\s*[:=]?\s*\d{1,3})\s*$"
# fixed values: words of lines that are no headings
NO_HEADING = (
    r"(?i)(marks?|credits?|semester|page|university|college|faculty|time\s*:|hrs|hours|total|date\s*:|subject\s*:|exam|examination|answer|attempt"
    r"|section|tribhuvan|department|course\s+title|course\s+code|course\s+objectives?|course\s+description|course\s+outcomes?|recommended|reference"
    r"|text\s*books?|prerequisites?|evaluation|assessment|grading|teaching\s+hours|lab|lectures?|question\s+paper|bachelor|level|syllabus|curriculum)"
)

# fixed values: lines that head a unit, a chapter, a line of the contents, a section
UNIT_LINE = r"(?im)^{}\s+([IVXLC\d]+)\s*[:.\-]?\s*(.*)$"
CHAPTER_LINE = r"(?i)^Chapter\s+(\d+|[IVXLC]+)\s*[:.\-]?\s*(.*)$"
CONTENTS_LINE = r"^(?:Chapter\s+)?(\d+)\s*[:.]?\s+([A-Z][A-Za-z &'.,:/-]{2,60}?)\s*\.\.+\s*\d+\s*$"
SECTION_LINE = r"^(\d+\.\d+(?:\.\d+)?)\s+(.*)$"


def question_list(text: Column) -> Column:
    """An array of (pos, question_number, text, marks): numbered questions with the lines that continue them, row by row.

    The text is split before the lines that open a question, so the cost is in proportion to its length.
    """
    found = F.filter(F.split(F.array_join(lines(text), "\n"), rf"\n(?={OPENING}{TO_LINE_END})"), lambda s: s.rlike(rf"^{OPENING}{TO_LINE_END}"))
    whole = F.transform(found, lambda s: F.struct(F.regexp_extract(s, r"\d+", 0).cast("int").alias("n"), F.trim(F.replace(F.regexp_replace(s, rf"^{OPENING}[ \t\x0B\f]*", ""), F.lit("\n"), F.lit(" "))).alias("whole")))
    return F.transform(whole, lambda q, i: F.struct((i + 1).cast("long").alias("pos"), q["n"].alias("question_number"), strip(F.regexp_replace(q["whole"], MARKS_PHRASE, "")).alias("text"), marks(q["whole"]).alias("marks")))


def questions(docs: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """(document_id, pos, question_number, text, marks): the questions of each row's text, without a shuffle."""
    return docs.select(F.col(id_col).alias("document_id"), F.inline(question_list(F.col(text_col))))


def heading_lines(text: Column, max_words: int = 8) -> Column:
    """Distinct short lines that open with a capital or digit and hold no word of the stop list."""

    def fits(x: Column) -> Column:
        n_words = F.size(F.split(x, r"\s+"))
        return (
            (F.length(x) >= 3) & x.rlike(r"^[\p{Lu}\p{Nd}]") & (n_words <= max_words) & ~x.rlike(r"^[\d\s.:/\-–—]+$") & ~(x.endswith(".") & (n_words > 4))
            & x.rlike("[A-Za-z]") & ~x.rlike(NO_HEADING)
        )

    return F.array_distinct(F.filter(lines(text), fits))


def syllabus_topics(text: Column) -> Column:
    """Titles of Unit headings, else of Module headings, else heading-like lines; distinct, in order."""

    def titled(kind: str) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(UNIT_LINE.format(kind)), 2), clean_title)
        return F.array_distinct(F.filter(found, lambda t: t.isNotNull()))

    units, modules = titled("Unit"), titled("Module")
    return F.when(F.size(units) > 0, units).when(F.size(modules) > 0, modules).otherwise(heading_lines(text))


def chapters(docs: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """(document_id, pos, chapter_number, title): headings in the body first, then lines of the contents; distinct by number and title."""
    rows = docs.select(F.col(id_col).alias("document_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("at", "line"))
    body, toc = CHAPTER_LINE, CONTENTS_LINE
    n = F.regexp_extract("line", body, 1)
    heads = rows.where(F.col("line").rlike(body)).select(
        "document_id", F.lit(0).alias("part"), "at", F.when(n.rlike(r"^\d+$"), n.try_cast("int")).otherwise(roman_to_int(n)).alias("chapter_number"), clean_title(F.regexp_extract("line", body, 2)).alias("title")
    )
    listed = rows.where(F.col("line").rlike(toc)).select(
        "document_id", F.lit(1).alias("part"), "at", F.regexp_extract("line", toc, 1).try_cast("int").alias("chapter_number"), clean_title(F.regexp_extract("line", toc, 2)).alias("title")
    )
    found = heads.unionByName(listed).where("title is not null")
    first = F.row_number().over(Window.partitionBy("document_id", "chapter_number", F.lower("title")).orderBy("part", "at"))
    kept = found.withColumn("nth", first).where("nth = 1")
    pos = F.row_number().over(Window.partitionBy("document_id").orderBy("part", "at"))
    return kept.select("document_id", pos.alias("pos"), "chapter_number", "title")


def subtopics(docs: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """(document_id, pos, key, title): numbered subsections; the later title wins on a repeated key, at the place of the first."""
    rows = docs.select(F.col(id_col).alias("document_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("at", "line"))
    pattern = SECTION_LINE
    found = rows.select("document_id", "at", first_match(F.col("line"), pattern, 1).alias("key"), clean_title(first_match(F.col("line"), pattern, 2)).alias("title"))
    grouped = found.where("key is not null and title is not null").groupBy("document_id", "key").agg(F.min("at").alias("pos"), F.max_by("title", "at").alias("title"))
    return grouped.select("document_id", "pos", "key", "title")


def chapter_subtopics(chapter_rows: DataFrame, subtopic_rows: DataFrame) -> DataFrame:
    """Each chapter with ``subtopics``, the titles of subsections whose key opens with its number, in order."""
    subs = subtopic_rows.select(F.col("document_id").alias("d"), F.split("key", r"\.")[0].try_cast("int").alias("n"), F.struct("pos", "title").alias("s"))
    joined = chapter_rows.join(subs, (F.col("document_id") == F.col("d")) & (F.col("chapter_number") == F.col("n")), "left")
    titles = F.transform(F.array_sort(F.collect_list("s")), lambda s: s["title"])
    return joined.groupBy("document_id", "pos", "chapter_number", "title").agg(titles.alias("subtopics"))
