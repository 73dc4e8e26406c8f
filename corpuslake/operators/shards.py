"""An inverted index as a table, and exact BM25 top-k over it.

Texts are read once. Each task cuts its documents into shards of SHARD_DOCS and writes, for a shard, one
row with the ids and lengths of its documents and one row for each of its terms: which of the
documents hold it, how often, and how much it can add to a score at most. Questions are answered from
these rows alone: those of asked terms are brought together by shard, a task adds up the parts of a
question's terms over a shard as arrays, and keeps its k best. A shard whose terms cannot add up to the
k-th best so far is skipped. What is shuffled are postings of asked terms, once, and k rows a task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpuslake.functions import params
from corpuslake.functions.text import tokens
from corpuslake.sources.scratch import stored

#: Documents and postings of a shard, at most (a longer document is a shard of its own).
SHARD_DOCS, SHARD_POSTINGS = 4096, 1 << 20
#: Questions that a task answers over its shards.
PART_QUERIES = 8192


class Shard:
    """The documents that a task has read since it last wrote a shard."""

    def __init__(self) -> None:
        self.ids: list = []
        self.lengths: list[int] = []
        self.codes: dict[str, int] = {}
        self.postings: list[tuple[list[int], list[int]]] = []
        self.held = 0

    def add(self, doc_id: object, terms: Counter) -> None:
        codes = [self.codes.setdefault(t, len(self.codes)) for t in terms]
        self.postings.append((codes, list(terms.values())))
        self.ids.append(doc_id)
        self.lengths.append(sum(terms.values()))
        self.held += len(codes)

    def rows(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        """The shard's rows: first that of its documents, without a term, then its terms in order."""
        codes, tfs = (np.array([x for part in self.postings for x in part[i]], np.int64) for i in range(2))
        docs = np.repeat(np.arange(len(self.ids)), [len(part[0]) for part in self.postings])
        names = sorted(self.codes)
        place = np.empty(len(names), np.int64)
        place[[self.codes[n] for n in names]] = np.arange(len(names))
        order = np.lexsort((docs, place[codes])) if len(codes) else codes
        ends = np.bincount(place[codes], minlength=len(names)).cumsum() if len(codes) else np.zeros(0, np.int64)
        at = np.r_[0, 0, ends].astype(np.int32)
        one = np.r_[0, np.full(len(names) + 1, len(self.ids))].astype(np.int32)
        lengths = np.array(self.lengths, np.int64)
        n, total = np.r_[len(self.ids), np.diff(np.r_[0, ends])].astype(np.int64), np.zeros(len(names) + 1, np.int64)
        total[0] = lengths.sum()
        columns = [
            pa.array(np.full(len(names) + 1, number)), pa.array([None, *names], pa.string()),
            pa.ListArray.from_arrays(at, pa.array(docs[order], pa.int32())), pa.ListArray.from_arrays(at, pa.array(tfs[order], pa.int64())),
            pa.ListArray.from_arrays(one, pa.array(self.ids, schema.field("ids").type.value_type)), pa.ListArray.from_arrays(one, pa.array(lengths)),
            pa.array(n), pa.array(total),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def index_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The index of ``docs``: (shard, term, docs, tfs, ids, lengths, n, total), see the module.

    ``n`` counts a shard's documents, or those of them that hold the term; ``total`` is the sum of the
    documents' lengths. A null text has no terms; rows of one id are documents each for itself.
    """
    id_type = docs.schema[id_col].dataType
    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("docs", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64())), ("ids", pa.list_(to_arrow_type(id_type))), ("lengths", pa.list_(pa.int64())), ("n", pa.int64()), ("total", pa.int64())])
    stop = frozenset(params.STOPWORDS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, number, shard = re.compile("[a-z0-9]{2,}").findall, (TaskContext.get().partitionId() << 32), Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                terms = Counter(find((text.as_py() or "").lower()))
                for word in stop & terms.keys():
                    del terms[word]
                if shard.ids and (len(shard.ids) >= shard_docs or shard.held + len(terms) > shard_postings):
                    yield shard.rows(number, schema)
                    number, shard = number + 1, Shard()
                shard.add(doc_id, terms)
        if shard.ids:
            yield shard.rows(number, schema)

    types = f"shard long, term string, docs array<int>, tfs array<long>, ids array<{id_type.simpleString()}>, lengths array<long>, n long, total long"
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(build, types)


def build_index(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """:func:`index_rows` as a stored table: at ``path``, or in the shared folder."""
    rows = index_rows(docs, id_col, text_col, shard_docs)
    if path is None:
        return stored(rows, "index")
    rows.write.mode("overwrite").parquet(path)
    return open_index(docs.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row (n_docs, avg_length)."""
    heads = index.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), F.sum("total").alias("total"))
    return heads.select("n_docs", (F.col("total") / F.nullif("n_docs", F.lit(0))).alias("avg_length"))


def term_stats(index: DataFrame) -> DataFrame:
    """(term, df): in how many documents a term occurs."""
    return index.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))


class Question:
    """A question's terms with their weights, and its k best documents so far as (score in millionths, id)."""

    def __init__(self, query_id: object, terms: list[str], weights: list[float]) -> None:
        self.query_id, self.terms, self.best = query_id, list(zip(terms, weights, strict=True)), []

    def least(self, k: int) -> int:
        return self.best[-1][0] if len(self.best) == k else 0


class Scorer:
    """Answers questions over shards, one at a time."""

    def __init__(self, k: int, k1: float, b: float, avg_length: float) -> None:
        self.k, self.k1, self.b, self.avg = k, k1, b, avg_length
        self.questions: list[Question] = []
        self.asked: set[str] = set()
        self.skipped = 0

    def ask(self, question: Question) -> None:
        self.questions.append(question)
        self.asked.update(t for t, _ in question.terms)

    def read(self, ids: pa.Array, lengths: np.ndarray, terms: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        norm = self.k1 * (1 - self.b + self.b * (lengths / self.avg)) if self.avg else np.zeros(len(lengths))
        parts = {t: (docs, tfs * (self.k1 + 1) / (tfs + norm[docs])) for t, (docs, tfs) in terms.items() if t in self.asked}
        most = {t: part.max(initial=0.0) for t, (_, part) in parts.items()}
        names = ids.to_numpy(zero_copy_only=False)
        if names.dtype == object:
            names = names.astype(str)
        for question in self.questions:
            own = [(t, w) for t, w in question.terms if t in parts]
            bound = sum(w * most[t] for t, w in own)
            if not own or round(bound * 1e6) + 1 < question.least(self.k):
                self.skipped += bool(own)
                continue
            score = np.zeros(len(lengths))
            for t, w in own:
                docs, part = parts[t]
                score[docs] += w * part
            whole = np.rint(score * 1e6).astype(np.int64)
            found = np.flatnonzero(whole >= max(1, question.least(self.k)))
            if len(found) > self.k:
                bar = np.partition(whole[found], len(found) - self.k)[len(found) - self.k]
                found = found[whole[found] >= bar]
            found = found[np.lexsort((names[found], -whole[found]))][: self.k]
            merged = question.best + list(zip(whole[found].tolist(), ids.take(pa.array(found)).to_pylist(), strict=True))
            question.best = sorted(merged, key=lambda h: (-h[0], h[1]))[: self.k]


def search(index: DataFrame, queries: DataFrame, k: int = params.TOP_K, k1: float = params.K1, b: float = params.B, query_id: str = "query_id", query_text: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score): of an index, the documents of positive score for each question, by score rounded to 6 places, then doc_id.

    A question without text or known terms has no rows. Questions in groups of PART_QUERIES, a row
    each, go to every task that holds shards; documents without an id take no part.
    """
    if k <= 0 or k1 < 0 or not 0 <= b <= 1 or not math.isfinite(k1):
        raise ValueError("k must be positive, k1 not negative, b within 0 and 1")
    spark = index.sparkSession
    words = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    n_docs, avg_length = corpus_stats(index).first()
    known = index.join(words.select("term").distinct(), "term", "left_semi")
    df = known.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = words.join(df, "term").groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list(idf).alias("weights"))
    asked = stored(asked, "questions")
    groups = max(1, -(-asked.count() // PART_QUERIES))
    bins = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = index.where("term is null").unionByName(known)
    keys = ["group", "bin"]
    sent = rows.withColumn("bin", F.pmod(F.xxhash64("shard"), F.lit(bins)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    told = asked.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    both = told.unionByName(sent, allowMissingColumns=True).repartition(groups * bins, *keys)
    # a task's questions come first, then shard by shard its documents and their terms
    both = both.sortWithinPartitions(*keys, F.col("shard").asc_nulls_first(), F.col("term").asc_nulls_first())
    kept = {"query_id": queries.schema[query_id].dataType, "doc_id": index.schema["ids"].dataType.elementType}
    types = ", ".join(f"{name} {kind.simpleString()}" for name, kind in kept.items()) + ", score double"
    schema = pa.schema([*((name, to_arrow_type(kind)) for name, kind in kept.items()), ("score", pa.float64())])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scorer, shard, head, terms = None, None, None, None, {}

        def done() -> None:
            if head is not None:
                usable = head[0].is_valid()
                scorer.read(head[0], head[1], terms) if usable.false_count == 0 else scorer.read(*with_ids(head, usable, terms))

        def hits() -> pa.RecordBatch:
            found = [(q.query_id, doc_id, score / 1e6) for q in scorer.questions for score, doc_id in q.best]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], schema.field(i).type) for i in range(3)], schema=schema)

        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                here = column["group"][i].as_py(), column["bin"][i].as_py()
                if here != now:
                    if scorer is not None:
                        done()
                        yield hits()
                    now, scorer, shard, head, terms = here, Scorer(k, k1, b, avg_length), None, None, {}
                if not column["shard"][i].is_valid:
                    scorer.ask(Question(column["query_id"][i].as_py(), column["terms"][i].as_py(), column["weights"][i].as_py()))
                    continue
                if column["shard"][i].as_py() != shard:
                    done()
                    shard, head, terms = column["shard"][i].as_py(), None, {}
                if column["term"][i].is_valid:
                    terms[column["term"][i].as_py()] = column["docs"][i].values.to_numpy(), column["tfs"][i].values.to_numpy().astype(np.float64)
                else:
                    head = column["ids"][i].values, column["lengths"][i].values.to_numpy().astype(np.float64)
        if scorer is not None:
            done()
            yield hits()

    near = both.select(*keys, "query_id", "terms", "weights", "shard", "term", "docs", "tfs", "ids", "lengths").mapInArrow(answer, types)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def with_ids(head: tuple, usable: pa.Array, terms: dict) -> tuple:
    """A shard's documents and terms without the documents that have no id."""
    keep = usable.to_numpy(zero_copy_only=False)
    place = keep.cumsum() - 1
    left = {t: (place[docs[keep[docs]]], tfs[keep[docs]]) for t, (docs, tfs) in terms.items()}
    return head[0].filter(usable), head[1][keep], left
