"""Metadata of a document's text as column expressions; null where nothing matches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_title, collapse, strip

# fixed values: patterns of programs, in order of preference
PROGRAMS = (
    r"Bachelor of Science in Computer Science and Information Technology",
    r"Bachelor of Computer Application\w*",
    r"Bachelor of Business Administration",
    r"Bachelor of Information Technology",
    r"Bachelor of Computer Science",
    r"Bachelor of [A-Z][A-Za-z ]{2,40}",
    r"B\.?\s?Sc\.?\s?(?:in\s+)?CSIT\b",
    r"B\.?CA\b",
    r"B\.?IM\b",
    r"B\.?IT\b",
    r"B\.?BS\b",
    r"B\.?BA\b",
    r"M\.?\s?Sc\.?",
    r"M\.?CA\b",
)
# fixed values: words of lines that name no subject
SKIP_SUBJECT = (
    r"(?i)(university|time\s*:|marks|max(?:imum)?|exam|attempt|full\s+marks|date\s*:|semester|faculty|campus|roll\s*no|year\s*:"
    r"|level|bachelor|group|college|department|tribhuvan|code\s*:|credit|candidates?|required|answer|questions?)"
)
# fixed values: verbs that open a question
QUESTION_VERB = (
    r"(?i)^\s*(?:Explain|Define|Describe|Discuss|State|Write\s+short\s+notes?\s+on\s*|What\s+is\s+|What\s+are\s+|What\s+do\s+you\s+mean\s+by\s+"
    r"|Differentiate\s+between\s+|Compare\s+and\s+contrast\s+|Compare\s+|Distinguish\s+between\s+|List\s+|Mention\s+|Enumerate\s+|Justify\s+"
    r"|Prove\s+|Simplify\s+|Evaluate\s+|Draw\s+and\s+explain\s+|Define\s+and\s+explain\s+)\s*"
)
# fixed values: number words
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match; null where there is none."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), group), F.lit(0))


# fixed value: what every text holds that has blank lines, white space around a line or other line ends than \n
UNTIDY = r"\A\z|(?:\A|\n)[^!-~]|[^!-~](?:\n|\z)|\r"


def lines(text: Column) -> Column:
    """Stripped lines that aren't empty; a text that consists of them is only split."""
    stripped = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n"), strip), lambda x: x != "")
    return F.when(~text.rlike(UNTIDY), F.split(text, "\n")).otherwise(stripped)


def roman_to_int(value: Column) -> Column:
    """The value of a Roman numeral of I V X L C; null for any other text."""
    digits = F.transform(F.split(F.upper(value), ""), lambda d: F.coalesce(*(F.when(d == k, F.lit(v)) for k, v in ROMAN.items())))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("prev"))
    total = F.aggregate(
        F.reverse(digits), start, lambda s, d: F.struct((s["total"] + F.when(d < s["prev"], -d).otherwise(d)).alias("total"), d.alias("prev")), lambda s: s["total"]
    )
    return F.when(F.upper(value).rlike("^[IVXLC]+$"), F.nullif(total, F.lit(0)))


# fixed value: what every text that names a program holds
PROGRAM_START = r"(?i)(?=[bm])(?:Bachelor of|B\.?\s?Sc|B\.?CA|B\.?IM|B\.?IT|B\.?BS|B\.?BA|M\.?\s?Sc|M\.?CA)"
# fixed values: where a document says what it is about, by field
SEMESTER_NUMERAL = r"(?i)\bSemester\s+([IVXLC]+)\b"
SEMESTER_DIGITS = r"\bSemester\s+([0-9]{1,2})\b"
SEMESTER_ORDINAL = r"(?i)\b([0-9]{1,2})\s*(?:st|nd|rd|th)\s+Semester\b"
YEAR = r"\b(1[89]\d{2}|20\d{2})\b"
ACADEMIC_YEAR = r"\b(20\d{2})\s?[/\-]\s?(\d{2,4})\b(?!\s?-\s?\d{1,2}\b)"
SUBJECT_CODE = r"\b([A-Z]{2,6})\s?[-–]?\s?(\d{3})\b"
MARKS_AFTER_WORD = r"\b(?:Marks?|marks)\s*[:=]?\s*(\d{1,3})\b"
MARKS_BEFORE_WORD = r"\b(\d{1,3})\s*(?:Marks?|marks)\b"
UNIVERSITY_NAME = r"(?i)([A-Z][A-Za-z .&'’-]{2,40}\s+University)"
AUTHOR_LINE = r"(?i)^(?:by|author)\s*[:]?\s*([A-Za-z][A-Za-z .'&,-]{3,60})$"
SYLLABUS_HEAD = r"(?im)^(.+?)\s+(?:Syllabus|Curriculum|Course)\b"
NUMBERS_IN_BRACKETS = r"^[\d\s.:/\-–—()]+$"
NUMBERS_ONLY = r"^[\d\s.:/\-–—]+$"
NOTICE_SUBJECT = r"(?im)^(?:Subject|Sub)\s*[:.]?\s*(.+)$"


def first_that(items: Column, fits: Callable[[Column], Column]) -> Column:
    """The first item that fits; those after it are not looked at."""
    return F.aggregate(items, F.lit(None).cast("string"), lambda found, x: F.when(found.isNotNull(), found).when(fits(x), x))


def semester(text: Column) -> Column:
    """The semester named most often, numerals first, then digits, ordinals and words; the first met at a tie."""
    numerals = F.transform(F.regexp_extract_all(text, F.lit(SEMESTER_NUMERAL), 1), roman_to_int)
    digits = F.regexp_extract_all(text, F.lit(SEMESTER_DIGITS), 1).cast("array<int>")
    ordinals = F.regexp_extract_all(text, F.lit(SEMESTER_ORDINAL), 1).cast("array<int>")
    names = F.transform(
        F.regexp_extract_all(text, F.lit(rf"(?i)\b({'|'.join(ORDINALS)})\s+Semester\b"), 1), lambda w: F.array_position(F.array(*map(F.lit, ORDINALS)), F.lower(w)).cast("int")
    )
    found = F.concat(numerals, digits, ordinals, names)
    ranked = F.transform(F.array_distinct(found), lambda v: F.struct(F.size(F.filter(found, lambda x: x == v)).alias("n"), (-F.array_position(found, v)).alias("first"), v.alias("v")))
    return F.when(text.rlike("(?i)semester"), F.array_max(ranked)["v"])


def year(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(YEAR), 1).cast("array<int>")
    return F.get(F.filter(found, lambda y: y.between(1900, 2100)), F.lit(0))


def academic_year(text: Column) -> Column:
    return F.concat(first_match(text, ACADEMIC_YEAR, 1), F.lit("/"), first_match(text, ACADEMIC_YEAR, 2))


def subject_code(text: Column) -> Column:
    return F.concat(first_match(text, SUBJECT_CODE, 1), F.lit("-"), first_match(text, SUBJECT_CODE, 2))


def marks(text: Column) -> Column:
    return F.coalesce(first_match(text, MARKS_AFTER_WORD, 1), first_match(text, MARKS_BEFORE_WORD, 1)).cast("int")


def university(text: Column, names: Sequence[str] = ()) -> Column:
    """A name of the list that the text holds, in the list's order, else what stands before the word University."""
    listed = [F.when(text.contains(n), F.lit(n.strip())) for n in names if n]
    # the pattern starts anew at each letter, so it is only tried where the word occurs
    named = F.when(F.lower(text).contains("university"), first_match(text, UNIVERSITY_NAME, 1))
    return F.coalesce(*listed, F.trim(collapse(named)))


def program(text: Column) -> Column:
    named = F.coalesce(*(first_match(text, f"(?i){p}") for p in PROGRAMS))
    return F.when(text.rlike(PROGRAM_START), F.trim(collapse(named)))


def author(text: Column) -> Column:
    found = F.transform(lines(text), lambda x: first_match(x, AUTHOR_LINE, 1))
    return strip(collapse(F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))))


def syllabus_subject(text: Column) -> Column:
    heads = F.transform(F.regexp_extract_all(text, F.lit(SYLLABUS_HEAD), 1), clean_title)
    return F.get(F.filter(heads, lambda t: F.size(F.split(t, " ")) >= 2), F.lit(0))


def past_paper_subject(text: Column) -> Column:
    def fits(x: Column) -> Column:
        return F.length(x).between(5, 80) & ~x.rlike(NUMBERS_IN_BRACKETS) & ~x.rlike(SKIP_SUBJECT) & (F.regexp_count(x, F.lit("[A-Za-z]")) >= 5)

    return F.regexp_replace(collapse(first_that(lines(text), fits)), r"^[ .:\-]+|[ .:\-]+$", "")


def first_substantial_line(text: Column) -> Column:
    def fits(x: Column) -> Column:
        return x.rlike(r"\S\s+\S") & (F.length(x) <= 200) & ~x.rlike(NUMBERS_ONLY) & x.rlike("[A-Za-z]")

    return first_that(lines(text), fits)


def notice_subject(text: Column) -> Column:
    return clean_title(first_match(text, NOTICE_SUBJECT, 1))


def question_topic(text: Column) -> Column:
    """What a question is about: its verb dropped, cut at the first stop or "and" or "with"; null if over 120 characters."""
    topic = strip(F.get(F.split(F.regexp_replace(text, QUESTION_VERB, ""), r"[,.:;]|\s+(?:and|with)\s+"), F.lit(0)))
    return F.when(F.length(topic).between(1, 120), topic)


def metadata(text: Column, first_page: Column, document_type: Column, names: Sequence[str] = ()) -> dict[str, Column]:
    """All metadata columns by name; which apply depends on the document's type."""
    of = document_type
    title = first_substantial_line(first_page)
    return {
        "university": university(text, names),
        "program": program(text),
        "semester": semester(text),
        "academic_year": academic_year(text),
        "subject_code": subject_code(text),
        "author": author(text),
        "title": F.when(of == "notice", F.coalesce(notice_subject(text), title)).otherwise(title),
        "subject": F.when(of == "syllabus", F.coalesce(syllabus_subject(text), title)).when(of == "past_question", past_paper_subject(text)),
        "year": F.when(of == "past_question", year(text)),
    }
