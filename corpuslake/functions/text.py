"""Column functions on text: cleaning, titles, names, tokens, masking, rendering."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import params


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def nfkc(text: Column) -> Column:
    """The NFKC form, batch by batch in Python: Spark has no function for it."""

    def normalize(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.pandas_udf(normalize, "string")(text)


def clean_text(text: Column, normalized: Column | None = None) -> Column:
    """Extracted page text without layout noise; null becomes empty.

    ``normalized`` is the NFKC form, where the caller has it: see :func:`clean_pages`.
    """
    out = F.coalesce(text if normalized is None else normalized, F.lit(""))
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, " ", " ")
    out = F.regexp_replace(out, "[​‌‍⁠﻿]", "")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    out = F.regexp_replace(out, r"(?U)[^\S\n]*\n[^\S\n]*", "\n")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def clean_pages(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """``pages`` with the text cleaned; only rows with a character beyond ASCII pass through Python for NFKC."""
    plain = pages.where(F.coalesce(~F.col(text_col).rlike(r"[^\x00-\x7f]"), F.lit(True))).withColumn(text_col, clean_text(F.col(text_col)))
    other = pages.where(F.col(text_col).rlike(r"[^\x00-\x7f]"))
    unix = F.regexp_replace(text_col, r"\r\n?", "\n")
    other = other.withColumn(text_col, nfkc(unix)).withColumn(text_col, clean_text(F.col(text_col)))
    return plain.unionByName(other)


def tokens(text: Column, stopwords: Sequence[str] = params.STOPWORDS) -> Column:
    """Lower-cased ASCII words and numbers of two characters or more, without stopwords, in order; none for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*stopwords))


def evidence_tokens(text: Column, stopwords: Sequence[str] = params.EVIDENCE_STOPWORDS) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9']+"), 0)
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, stopwords)))


def clean_title(value: Column) -> Column:
    """White space collapsed, blanks and ``.:-–—`` stripped; null if nothing is left."""
    out = F.regexp_replace(collapse(F.coalesce(value, F.lit(""))), r"^[ .:\-–—]+|[ .:\-–—]+$", "")
    return F.nullif(out, F.lit(""))


def session_title(message: Column, max_chars: int = params.TITLE_CHARS, default: str = "New conversation") -> Column:
    """A message as a title: cleaned, cut at the last blank where it is too long."""
    title = clean_title(message)
    head = F.substring(title, 1, max_chars - 3)
    cut = F.concat(F.when(head.contains(" "), F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head), F.lit("..."))
    return F.when(title.isNull(), default).when(F.length(title) <= max_chars, title).otherwise(cut)


def expand_aliases(query: Column, aliases: Mapping[str, str] = params.ALIASES) -> Column:
    for alias, name in aliases.items():
        query = F.regexp_replace(query, rf"(?i)\b{alias}\b", name)
    return query


def name_key(value: Column) -> Column:
    """Lower case, stripped, white space collapsed."""
    return collapse(strip(F.lower(value)))


def loose_name_key(value: Column) -> Column:
    """:func:`name_key` with punctuation as blanks."""
    return name_key(F.regexp_replace(value, r"(?U)[^\w\s]", " "))


def mask_sensitive(value: Column, words: Sequence[str] = params.SENSITIVE_WORDS, mask: str = "***") -> Column:
    """``mask`` where the value holds one of the words in any case."""
    return F.when(F.lower(value).rlike("|".join(words)), mask).otherwise(value)


def truncate(block: Column, max_chars: int) -> Column:
    """Cut at the last blank within the limit, with `` ...``; as it is where it fits."""
    head = F.substring(block, 1, max_chars)
    return F.when(F.length(block) <= max_chars, block).otherwise(F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit(" ...")))


def redirect_target(href: Column, host: str, parameter: str) -> Column:
    """The url that a redirect link of ``host`` carries in ``parameter``; any other link as it is."""
    link = F.replace(href, F.lit("&amp;"), F.lit("&"))
    full = F.when(link.startswith("//"), F.concat(F.lit("https:"), link)).otherwise(link)
    value = F.try_url_decode(F.regexp_extract(full, rf"[?&]{parameter}=([^&#]*)", 1))
    own = F.regexp_extract(full, r"^[a-z]+://([^/?#:]+)", 1)
    return F.when((own == host) | own.endswith("." + host), F.coalesce(F.nullif(value, F.lit("")), link)).otherwise(link)


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by blanks; none where there are fewer."""
    count = F.size(words) - (n - 1)
    runs = F.slice(words, 1, count)
    for i in range(1, n):  # a word at a time, all runs at once: an expression inside a lambda would be made anew for each run
        runs = F.zip_with(runs, F.slice(words, i + 1, count), lambda run, word: F.concat(run, F.lit(" "), word))
    return F.when(count > 0, runs).otherwise(F.array().cast("array<string>"))
