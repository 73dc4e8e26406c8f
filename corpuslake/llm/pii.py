"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts the score.

Base kinds are kept whenever their own checks hold: ``email``, ``ip`` (parts up to 255), ``card``
(12 to 19 digits, Luhn) and ``phone`` (9 to 15 digits). The others are kept at a score of
``KEEP`` or more: ``iban`` (mod-97) stands by its checksum, ``ssn`` needs a context word. The
score starts from the kind's own and rises where a context word stands near the span; for base
kinds it is information only.

Matches are leftmost and do not overlap within a kind. The patterns below are written so that a
text of any shape is scanned in time that grows with its length: runs are taken possessively or
found from their one fixed character.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: Score of a span by itself, what a context word adds, how far context reaches, and what is kept.
OWN = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT_ADDS, CONTEXT_REACH, KEEP = 0.3, 48, 0.5
CONTEXT = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "móvil"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social security", "tax id"),
}
NEAR = {kind: re.compile(r"\b(?:" + "|".join(words) + r")", re.IGNORECASE) for kind, words in CONTEXT.items()}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


class Span(NamedTuple):
    start: int
    kind: str
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an IBAN without blanks has the right check digits: 1 modulo 97 once its head is moved to its end."""
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from each at-sign: the longest local part before it that no earlier match has taken, and the domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = at + 1
        at = text.find("@", free)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest stretch of whole blank-separated groups that passes."""
    for m in IBAN.finditer(text):
        end = m.end()
        while end > m.start() and not mod97(text[m.start() : end].replace(" ", "")):
            end = text.rfind(" ", m.start(), end)
        if end > m.start() and not (end < len(text) and text[end].isalnum()):
            yield m.start(), end


def ssns(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000")


FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "ssn": ssns}


def find_all(text: str) -> list[Span]:
    """All spans that are kept, by start, then kind as listed."""
    spans = []
    for kind, finder in FINDERS.items():
        for start, end in finder(text):
            near = NEAR[kind].search(text, max(0, start - CONTEXT_REACH), start) or NEAR[kind].search(text, end, end + CONTEXT_REACH)
            score = min(1.0, OWN[kind] + CONTEXT_ADDS * bool(near))
            if kind in BASE or score >= KEEP:
                spans.append(Span(start, kind, end, score))
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each stretch that spans cover replaced by the first one's kind in brackets."""
    out, done = [], 0
    for span in spans:
        if span.start >= done:
            out += [text[done : span.start], f"[{span.kind.upper()}]"]
        done = max(done, span.end)
    return "".join(out) + text[done:]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, score>>): offsets in code points, end exclusive.

    Defined cases: a null or empty text has no spans; a null or repeated doc_id is handed through,
    one row for each row; texts are read whole; an empty table gives no rows; other columns are
    ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in find_all(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, SPANS)], ["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind: string, start: int, end: int, score: double>>"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id", "text"], rows, schema)


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``text`` masked and ``n_chars``, where it is a column, counted anew; null texts stay null.

    Columns and their order stay, whatever they are; nothing is looked up by doc_id.
    """
    at, schema = docs.columns.index("text"), docs.schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (text := t.as_py()) is None else masked(text, find_all(text)) for t in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(rows, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans, the list of all spans and that of their scores."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))
