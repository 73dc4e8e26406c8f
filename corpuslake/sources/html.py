"""Links and plain text of HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: entities in pages, the ampersand last
ENTITIES = (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def plain_text(html: Column) -> Column:
    """Without scripts, styles and tags, entities decoded, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r\f\x0b]+", " "))


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, pos, url, title, score): each anchor in order; score falls by a tenth a place, to a half."""
    anchors = F.regexp_extract_all(F.col(html_col), F.lit(r"(?s)<a\s[^>]*>(?:.*?</a>)?"), 0)
    rows = pages.select(F.col(id_col).alias("page_id"), F.posexplode(anchors).alias("pos", "anchor"))
    url = F.regexp_extract("anchor", r'^<a\s[^>]*?href="([^"]*)"', 1)
    score = F.greatest(1 - F.lit(0.1) * F.col("pos"), F.lit(0.5))
    return rows.select("page_id", "pos", url.alias("url"), plain_text(F.col("anchor")).alias("title"), score.alias("score"))
