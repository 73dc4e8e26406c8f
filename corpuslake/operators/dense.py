"""Vectors of texts by signed feature hashing, and exact nearest rows by cosine."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpuslake.functions import params


#: Tokens whose place and sign a task remembers.
KNOWN_TOKENS = 1_000_000


def embed(docs: DataFrame, dimensions: int = params.DIMENSIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, vector array<double>): each text's unit vector of signed token counts; all zero without tokens, or where they cancel.

    The digest of a token gives its place, modulo the dimensions, and its sign, by bit 8. Row by row, no shuffle.
    """
    if dimensions <= 0:
        raise ValueError(f"a vector needs one dimension at least, not {dimensions}")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}
        find = re.compile("[a-z0-9]+").findall

        def placed(token: str) -> tuple[int, int]:
            number = int(hashlib.md5(token.encode()).hexdigest(), 16)
            if len(known) >= KNOWN_TOKENS:
                known.clear()
            known[token] = found = number % dimensions, 1 - 2 * (number >> 8 & 1)
            return found

        for batch in batches:
            vectors = np.zeros((batch.num_rows, dimensions))
            for row, text in enumerate(batch.column(1)):
                for token, n in Counter(find((text.as_py() or "").lower())).items():
                    place, sign = known.get(token) or placed(token)
                    vectors[row, place] += sign * n
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
            offsets = pa.array(np.arange(batch.num_rows + 1) * dimensions, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], ["doc_id", "vector"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(rows, f"doc_id {id_type}, vector array<double>")


def hash_embed(docs: DataFrame, dimensions: int = params.DIMENSIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, bucket, w): the non-zero components of :func:`embed`."""
    return embed(docs, dimensions, id_col, text_col).select("doc_id", F.posexplode("vector").alias("bucket", "w")).where("w <> 0")


def embed_distinct(docs: DataFrame, embed: Callable[[Iterator], Iterator], text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``vector``: each distinct text goes once through ``embed``, an Arrow iterator pandas_udf body over batches of texts."""
    udf = F.pandas_udf(embed, "array<float>")
    texts = docs.select(F.col(text_col).alias("one_text")).where("one_text is not null").distinct().withColumn("vector", udf("one_text"))
    return docs.join(texts, F.col(text_col) == F.col("one_text"), "left").drop("one_text")


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors that are null, empty, of unequal lengths or of length zero."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    whole = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (whole > 0), dot(a, b) / whole).otherwise(F.lit(0.0))


#: Vectors compared with questions at once; questions that are broadcast, or go in a group of the search; vectors of such a group, about.
BLOCK, PART_QUERIES, PART_ROWS = 1024, 8192, 16384
#: Questions compared with a block at once: what comes of it is BLOCK times as many numbers, several times over.
ASKED = 512
#: Hits that a task holds before it hands them on.
HELD_HITS = 2_000_000


def measurable(vector: str) -> Column:
    """Whether a vector has a direction: not null, nothing in it null or infinite or not a number, something in it not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one dimension as the rows of a matrix, each of length 1."""
    v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that no square is too great or too small
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def blocked(left: DataFrame, left_id: str, n_left: int, right: DataFrame, right_id: str, n_right: int, meet: Callable, schema: str) -> DataFrame:
    """Both sides dealt by hash in groups of about PART_QUERIES and PART_ROWS rows; ``meet(left, right)`` for each pair of groups."""
    blocks, parts = max(1, -(-n_left // PART_QUERIES)), max(1, -(-n_right // PART_ROWS))

    def dealt(df: DataFrame, name: str, own: str, n: int, other: str, copies: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(name), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    keys = ["_block", "_part"]
    a, b = dealt(left, left_id, "_block", blocks, "_part", parts), dealt(right, right_id, "_part", parts, "_block", blocks)
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(meet, schema)


class Nearest:
    """The k best hits of each question and group over the batches that :meth:`add` is given: by score to six places, then id."""

    def __init__(self, questions: pa.Array, unit: np.ndarray, k: int, schema: pa.Schema) -> None:
        self.questions, self.unit, self.k, self.schema = questions, unit, k, schema
        self.held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, ids: pa.Array, groups: list[pa.Array], unit: np.ndarray) -> None:
        kinds: dict[tuple, list[int]] = {}
        for i, kind in enumerate(zip(*(g.to_pylist() for g in groups), strict=True) if groups else [()] * len(ids)):
            kinds.setdefault(kind, []).append(i)
        names = ids.to_numpy(zero_copy_only=False)
        for kind, rows in kinds.items():
            at = np.array(rows)
            at = at[np.argsort(names[at], kind="stable")]
            for start in range(0, len(at), BLOCK):
                part = at[start : start + BLOCK]
                best = [self.nearer(slice(q, q + ASKED), kind, names[part], unit[part]) for q in range(0, len(self.unit), ASKED)]
                self.held[kind] = np.concatenate([b[0] for b in best]), np.concatenate([b[1] for b in best])

    def nearer(self, asked: slice, kind: tuple, names: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best hits of some questions, after a block of rows in the order of their ids."""
        # one number orders by score, then by id; no two are equal
        order = np.rint(self.unit[asked] @ unit.T * 1e6).astype(np.int64) * BLOCK - np.arange(len(names))
        if len(names) > self.k:
            order = -np.partition(-order, self.k - 1, axis=1)[:, : self.k]
        near = -order % BLOCK
        scores, found = (order + near) // BLOCK, names[near]
        if kind in self.held:
            scores, found = np.concatenate([self.held[kind][0][asked], scores], 1), np.concatenate([self.held[kind][1][asked], found], 1)
        best = np.lexsort((found, -scores), axis=1)[:, : self.k]
        return np.take_along_axis(scores, best, 1), np.take_along_axis(found, best, 1)

    def full(self) -> bool:
        return len(self.held) * len(self.unit) * self.k > HELD_HITS

    def hits(self) -> pa.Table:
        out = []
        for kind, (scores, found) in self.held.items():
            n = scores.shape[1]
            asked = self.questions.take(pa.array(np.repeat(np.arange(len(scores)), n)))
            fixed = [pa.array([value] * scores.size, self.schema.field(1 + i).type) for i, value in enumerate(kind)]
            out.append(pa.table([asked, *fixed, pa.array(found.ravel(), self.schema.field("id").type), pa.array(scores.ravel() / 1e6)], schema=self.schema))
        self.held = {}
        return pa.concat_tables(out) if out else self.schema.empty_table()


def dense_topk(
    queries: DataFrame, rows: DataFrame, k: int = params.TOP_K, floor: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding", groups: tuple[str, ...] = ()
) -> DataFrame:
    """(query_id, *groups, rank, id, score): the k nearest rows by cosine rounded to 6 places, then id, for each question (query_id, vector) and group.

    Up to PART_QUERIES questions are broadcast, and each task keeps its own k best of each, so that
    no row is shuffled; more questions meet the rows in blocks. Vectors take part if they have a
    direction (see :func:`measurable`) and the dimension of most questions (the greater at a tie), questions
    and rows alike; rows without id don't.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    asked = queries.select("query_id", "vector").where(measurable("vector"))
    dims = asked.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "dim")).alias("most")).first()["most"]
    n_asked, dim = (dims["n"], dims["dim"]) if dims else (0, 0)
    asked = asked.where(F.size("vector") == dim)
    usable = rows.where(F.col(id_col).isNotNull() & (F.size(vector_col) == dim) & measurable(vector_col)).select(id_col, *groups, vector_col)
    kept = {"query_id": queries.schema["query_id"].dataType} | {g: rows.schema[g].dataType for g in groups} | {"id": rows.schema[id_col].dataType}
    types = "".join(f"{name} {kind.simpleString()}, " for name, kind in kept.items()) + "score double"
    schema = pa.schema([*((name, to_arrow_type(kind)) for name, kind in kept.items()), ("score", pa.float64())])

    if n_asked <= PART_QUERIES:
        shared = rows.sparkSession.sparkContext.broadcast(asked.toArrow().combine_chunks())  # PART_QUERIES rows at most

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vectors = shared.value.column("vector").combine_chunks()
            nearest = Nearest(shared.value.column("query_id").combine_chunks(), matrix(vectors, dim), k, schema) if n_asked else None
            for batch in batches if nearest else ():
                nearest.add(batch.column(0), batch.columns[1:-1], matrix(batch.column(len(batch.columns) - 1), dim))
                if nearest.full():
                    yield from nearest.hits().to_batches()
            if nearest:
                yield from nearest.hits().to_batches()

        close = usable.mapInArrow(search, types)
    else:

        def meet(questions: pa.Table, held: pa.Table) -> pa.Table:
            if not questions.num_rows or not held.num_rows:
                return schema.empty_table()
            q, h = questions.combine_chunks(), held.combine_chunks()
            nearest = Nearest(q.column("query_id").combine_chunks(), matrix(q.column("vector").combine_chunks(), dim), k, schema)
            nearest.add(h.column(id_col).combine_chunks(), [h.column(g).combine_chunks() for g in groups], matrix(h.column(vector_col).combine_chunks(), dim))
            return nearest.hits()

        close = blocked(asked, "query_id", n_asked, usable, id_col, usable.count(), meet, types)
    if floor is not None:
        close = close.where(F.col("score") >= floor)
    rank = F.row_number().over(Window.partitionBy("query_id", *groups).orderBy(F.desc("score"), "id"))
    return close.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", *groups, "rank", "id", "score")


def cosine_pairs(left: DataFrame, right: DataFrame, threshold: float, dimensions: int = params.DIMENSIONS) -> DataFrame:
    """(left_id, right_id, cosine): texts (doc_id, text) of the two sides whose vectors reach a threshold above 0, compared block by block."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    a, b = (embed(side, dimensions).where(measurable("vector")) for side in (left, right))
    kinds = [df.schema["doc_id"].dataType for df in (a, b)]
    schema = pa.schema([("left_id", to_arrow_type(kinds[0])), ("right_id", to_arrow_type(kinds[1])), ("cosine", pa.float64())])

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return schema.empty_table()
        mine, theirs = mine.combine_chunks(), theirs.combine_chunks()
        unit = matrix(theirs.column("vector").combine_chunks(), dimensions)
        out = []
        for at in range(0, mine.num_rows, BLOCK):
            part = mine.slice(at, BLOCK)
            scores = matrix(part.column("vector").combine_chunks(), dimensions) @ unit.T
            i, j = np.nonzero(scores >= threshold)
            out.append(pa.table([part.column("doc_id").take(pa.array(i)), theirs.column("doc_id").take(pa.array(j)), pa.array(scores[i, j])], schema=schema))
        return pa.concat_tables(out)

    return blocked(a, "doc_id", left.count(), b, "doc_id", right.count(), meet, f"left_id {kinds[0].simpleString()}, right_id {kinds[1].simpleString()}, cosine double")


def tagged(hits: DataFrame, rows: DataFrame, method: str, id_col: str = "doc_id") -> DataFrame:
    """``hits`` with the columns of what they hit and the name of the method that found them."""
    return hits.join(rows, id_col).withColumn("method", F.lit(method))


def merged_topk(hits: DataFrame, k: int = params.TOP_K) -> DataFrame:
    """One ranking per question over all groups' hits."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)
