"""Which texts hold which needles: all needles at once, in one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of the needles that one automaton takes, about (a state takes some 40 bytes), and needles of it at most.
BLOCK_CHARS, BLOCK_NEEDLES = 4_000_000, 100_000


def automaton(needles: list[tuple[int, str]]):
    """An Aho-Corasick automaton whose values are lists of the positions of equal needles; None without a needle."""
    import ahocorasick

    by_text: dict[str, list[int]] = {}
    for at, needle in needles:
        by_text.setdefault(needle, []).append(at)
    if not by_text:
        return None
    made = ahocorasick.Automaton()
    for text, positions in by_text.items():
        made.add_word(text, positions)
    made.make_automaton()
    return made


def found_in(text: str, made) -> list[int]:
    """Positions of the needles that a text holds, in order."""
    seen: dict[int, list[int]] = {}
    for _, positions in made.iter(text):
        seen[id(positions)] = positions
    return sorted(x for positions in seen.values() for x in positions)


def containing(texts: DataFrame, needles: DataFrame, id_col: str = "doc_id", text_col: str = "text", needle_id: str = "query_id", needle_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(needle_id, id): every pair of a text and a needle that it holds, as it is written.

    Needles are dealt into blocks of about ``block_chars`` characters; the texts are read where they are, once a
    block, past an automaton that is broadcast. Null texts and needles are left out; an empty needle
    is in every text; rows alike give a pair each.
    """
    kinds = {needle_id: needles.schema[needle_id].dataType, id_col: texts.schema[id_col].dataType}
    schema = pa.schema([(name, to_arrow_type(kind)) for name, kind in kinds.items()])
    types = ", ".join(f"{name} {kind.simpleString()}" for name, kind in kinds.items())
    wanted = needles.where(F.col(needle_col).isNotNull()).select(F.col(needle_id).alias("needle_id"), F.col(needle_col).alias("needle"))
    read = texts.where(F.col(text_col).isNotNull()).select(id_col, text_col)
    chars, count = wanted.agg(F.coalesce(F.sum(F.length("needle")), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, -(-chars // block_chars), -(-count // BLOCK_NEEDLES))
    block_of = F.pmod(F.xxhash64("needle_id", "needle"), F.lit(blocks))
    out = None
    for block in range(blocks):
        mine = wanted.where(block_of == block).toArrow()  # about block_chars characters
        shared = texts.sparkSession.sparkContext.broadcast((mine.column(0).combine_chunks(), mine.column(1).to_pylist()))

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, words = shared.value
            made = automaton([(i, w) for i, w in enumerate(words) if w])
            empty = [i for i, w in enumerate(words) if not w]
            for batch in batches:
                rows, at = [], []
                for row, text in enumerate(batch.column(1)):
                    found = empty + (found_in(text.as_py(), made) if made else [])
                    rows += [row] * len(found)
                    at += found
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())).cast(schema.field(0).type), batch.column(0).take(pa.array(rows, pa.int64()))], schema=schema)

        part = read.mapInArrow(look, types)
        out = part if out is None else out.unionByName(part)
    return out


def first_pages(pages: DataFrame, needles: DataFrame) -> DataFrame:
    """(document_id, needle, page): the least page of the document (document_id, page, text) that holds the needle in any case; null where none does.

    A page meets the needles of its own document, and is read once past an automaton of them.
    """
    asked = needles.where("needle is not null and document_id is not null").select("document_id", "needle").distinct()
    lists = asked.groupBy(F.col("document_id").alias("d")).agg(F.collect_list(F.struct("needle", F.lower("needle").alias("low"))).alias("asked"))
    met = pages.where("text is not null").select("document_id", "page", F.lower("text").alias("body")).join(lists, F.col("document_id") == F.col("d"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, made, names, empty = None, None, [], []
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                doc = batch.column(0)[i].as_py()
                if doc != own:
                    asked = batch.column(3)[i].as_py()
                    own, names = doc, [a["needle"] for a in asked]
                    made, empty = automaton([(j, a["low"]) for j, a in enumerate(asked) if a["low"]]), [j for j, a in enumerate(asked) if not a["low"]]
                found = empty + (found_in(batch.column(2)[i].as_py(), made) if made else [])
                out += [(doc, names[j], batch.column(1)[i].as_py()) for j in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["document_id", "needle", "page"])

    rows = met.select(F.col("document_id").cast("string").alias("document_id"), F.col("page").cast("long").alias("page"), "body", "asked")
    least = rows.mapInArrow(look, "document_id string, needle string, page long").groupBy(F.col("document_id").alias("_d"), F.col("needle").alias("_n")).agg(F.min("page").alias("page"))
    joined = needles.select("document_id", "needle").distinct().join(least, (F.col("document_id").cast("string") == F.col("_d")) & (F.col("needle") == F.col("_n")), "left")
    return joined.select("document_id", "needle", F.col("page").cast(pages.schema["page"].dataType).alias("page"))
