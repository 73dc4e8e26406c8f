"""How well books cover what a course requires."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpuslake.functions import params
from corpuslake.functions.text import evidence_tokens, expand_aliases, loose_name_key, name_key, strip
from corpuslake.operators.dense import cosine_pairs
from corpuslake.sources.scratch import cut, stored


def evidence_rows(queries: DataFrame, hits: DataFrame, min_cosine: float = 0.01) -> DataFrame:
    """Hits (query_id, rank, score, text, document_type, subject) on syllabi that are similar enough or share a token with the question."""
    own = queries.select(F.col("query_id").alias("q"), evidence_tokens(F.col("text")).alias("asked"))
    rows = hits.where("document_type = 'syllabus'").join(own, F.col("query_id") == F.col("q"))
    return rows.where((F.col("score") >= min_cosine) | F.arrays_overlap("asked", evidence_tokens(F.col("text")))).drop("q", "asked")


def best_subject(evidence: DataFrame) -> DataFrame:
    """(query_id, subject): named by most evidence, by the better rank at a tie."""
    counts = evidence.where("subject is not null").groupBy("query_id", "subject").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    return counts.groupBy("query_id").agg(F.min_by("subject", F.struct(-F.col("n"), "first", "subject")).alias("subject"))


def widened(hits: DataFrame, subjects: DataFrame) -> DataFrame:
    """All syllabus hits of each question's subject."""
    return hits.where("document_type = 'syllabus'").join(subjects, ["query_id", "subject"])


def required_names(chunk_names: DataFrame, graph_names: DataFrame) -> DataFrame:
    """(query_id, kind, name, pos): distinct names, those of chunks before those of the graph, each (query_id, kind, name, pos)."""
    both = chunk_names.withColumn("part", F.lit(0)).unionByName(graph_names.withColumn("part", F.lit(1)))
    first = both.groupBy("query_id", "kind", "name").agg(F.min(F.struct("part", "pos")).alias("at"))
    return first.select("query_id", "kind", "name", F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("at", "name")).alias("pos"))


def book_profiles(chunks: DataFrame) -> DataFrame:
    """(document_id, kind, name): distinct topics and subtopics of each book's chunks (document_id, topic, subtopic, subtopics)."""
    topics = chunks.select("document_id", F.lit("topic").alias("kind"), F.col("topic").alias("name"))
    listed = F.concat(F.array("subtopic"), F.coalesce("subtopics", F.array().cast("array<string>")))
    subs = chunks.select("document_id", F.lit("subtopic").alias("kind"), F.explode(listed).alias("name"))
    return topics.unionByName(subs).where("name is not null and name <> ''").distinct()


def matches(required: DataFrame, profiles: DataFrame, threshold: float = params.MATCH_THRESHOLD) -> DataFrame:
    """(kind, name, document_id): required names that a book covers, by equal name or by cosine of hashed tokens.

    Each distinct name is embedded once, and names are compared block by block; the threshold must
    be above 0.
    """
    want = required.select("kind", "name").distinct()
    have = profiles.select("kind", F.col("name").alias("own"), "document_id").distinct()
    same = want.withColumn("k", loose_name_key(F.col("name"))).join(have.withColumn("k", loose_name_key(F.col("own"))), ["kind", "k"]).select("kind", "name", "document_id")
    wanted = want.select(F.col("name").alias("doc_id"), F.col("name").alias("text")).distinct()
    owned = have.select(F.col("own").alias("doc_id"), F.col("own").alias("text")).distinct()
    close = cosine_pairs(wanted, owned, threshold).select(F.col("left_id").alias("name"), F.col("right_id").alias("own"))
    near = want.join(close, "name").join(have, ["kind", "own"]).select("kind", "name", "document_id")
    return same.unionByName(near).distinct()


def coverage(required: DataFrame, matched: DataFrame, topic_weight: float = params.TOPIC_WEIGHT, subtopic_weight: float = params.SUBTOPIC_WEIGHT) -> DataFrame:
    """(query_id, document_id, score, topic_coverage, subtopic_coverage, n_matched, matched, missing) for books that match anything required.

    ``required`` is (query_id, kind, name, pos); lists are in its order. What is not required at all covers 0.
    """
    totals = required.groupBy("query_id").agg(
        F.count_if(F.col("kind") == "topic").alias("n_topics"), F.count_if(F.col("kind") == "subtopic").alias("n_subs"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "topic", F.struct("pos", "name")))).alias("all_topics"),
    )
    hit = required.join(matched, ["kind", "name"]).groupBy("query_id", "document_id")
    got = hit.agg(
        F.count_if(F.col("kind") == "topic").alias("t"), F.count_if(F.col("kind") == "subtopic").alias("s"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "topic", F.struct("pos", "name")))).alias("own"),
    )
    rows = got.join(totals, "query_id")
    topics = F.coalesce(F.col("t") / F.nullif("n_topics", F.lit(0)), F.lit(0.0))
    subs = F.coalesce(F.col("s") / F.nullif("n_subs", F.lit(0)), F.lit(0.0))
    return rows.select(
        "query_id", "document_id", F.round(topic_weight * topics + subtopic_weight * subs, 4).alias("score"), F.round(topics, 4).alias("topic_coverage"),
        F.round(subs, 4).alias("subtopic_coverage"), F.col("t").alias("n_matched"), F.transform("own", lambda s: s["name"]).alias("matched"),
        F.transform(F.array_except("all_topics", "own"), lambda s: s["name"]).alias("missing"),
    )


#: Books of a block, which are the bits of a row of its matrix; bytes of the matrices that a task holds; questions that a task takes, about.
BLOCK_BOOKS, MATRIX_BYTES, TASK_QUESTIONS = 4096, 64 << 20, 65_536


def owners(required: DataFrame, profiles: DataFrame, threshold: float = params.MATCH_THRESHOLD) -> DataFrame:
    """(kind, name, own): the names of profiles that count as a required name, by equal key or by cosine of hashed tokens."""
    want = required.select("kind", "name").distinct()
    have = profiles.select("kind", F.col("name").alias("own")).distinct()
    same = want.withColumn("k", loose_name_key(F.col("name"))).join(have.withColumn("k", loose_name_key(F.col("own"))), ["kind", "k"]).select("kind", "name", "own")
    wanted, owned = (df.select(F.col(c).alias("doc_id"), F.col(c).alias("text")).distinct() for df, c in ((want, "name"), (have, "own")))
    close = cosine_pairs(wanted, owned, threshold).select(F.col("left_id").alias("name"), F.col("right_id").alias("own"))
    return same.unionByName(want.join(close, "name").join(have, ["kind", "own"]).select("kind", "name", "own")).distinct()


def bit_matrix(required: DataFrame, profiles: DataFrame, books: DataFrame, threshold: float = params.MATCH_THRESHOLD) -> DataFrame:
    """(block, kind, name, word, bits): which books of a block cover a required name, 64 to a number; words without a bit are left out.

    ``books`` is (document_id, block, place), ``place`` counting from 0 in each block.
    """
    own = profiles.select("document_id", "kind", F.col("name").alias("own")).join(books, "document_id")
    word = F.floor(F.col("place") / 64).cast("int").alias("word")
    bit = F.expr("shiftleft(1L, place % 64)")
    held = own.groupBy("block", "kind", "own", word).agg(F.bit_or(bit).alias("bits"))
    return held.join(owners(required, profiles, threshold), ["kind", "own"]).groupBy("block", "kind", "name", "word").agg(F.bit_or("bits").alias("bits"))


class Matrix:
    """The bit matrix of one block: a row of bits for each (kind, name)."""

    #: Rows that are kept unpacked, a byte for each book.
    UNPACKED = 2048

    def __init__(self) -> None:
        self.packed: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}
        self.flags: dict[tuple[str, str], np.ndarray] = {}
        #: How many books each place stands for.
        self.books = np.ones(BLOCK_BOOKS, np.int64)

    def add(self, kind: str, name: str, words: np.ndarray, bits: np.ndarray) -> None:
        self.packed[kind, name] = words, bits

    def stand_for(self, places: np.ndarray, numbers: np.ndarray) -> None:
        self.books[places] = numbers

    def row(self, key: tuple[str, str]) -> np.ndarray:
        """A flag for each book of the block."""
        if key not in self.flags:
            if len(self.flags) >= self.UNPACKED:
                self.flags.clear()
            words, bits = self.packed[key]
            out = np.zeros(BLOCK_BOOKS // 64, np.uint64)
            out[words] = bits
            self.flags[key] = np.unpackbits(out.view(np.uint8), bitorder="little")
        return self.flags[key]

    def covered(self, kind: str, names: list[str]) -> tuple[list[int], list[np.ndarray], np.ndarray]:
        """Positions among ``names`` of those that some book covers, their rows, and how many of them each book covers."""
        at = [i for i, name in enumerate(names) if (kind, name) in self.packed]
        rows = [self.row((kind, names[i])) for i in at]
        total = np.zeros(BLOCK_BOOKS, np.int64)
        for row in rows:
            total += row
        return at, rows, total


class Scores:
    """Scores as whole ten-thousandths, rounded half up as Spark rounds them."""

    def __init__(self, topic_weight: float, subtopic_weight: float) -> None:
        self.weights, self.known = (topic_weight, subtopic_weight), {}

    def __call__(self, t: int, n_topics: int, s: int, n_subs: int) -> int:
        key = t, n_topics, s, n_subs
        if key not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            value = self.weights[0] * (t / n_topics if n_topics else 0.0) + self.weights[1] * (s / n_subs if n_subs else 0.0)
            self.known[key] = int(Decimal(repr(value)).scaleb(4).quantize(Decimal(1), ROUND_HALF_UP))
        return self.known[key]


def best_in_blocks(topics: list[str], subs: list[str], blocks: dict[int, Matrix], k: int, scores: Scores, by_title: bool = False) -> tuple[list[tuple], int]:
    """(score, matched topics, block, place, positions of matched topics, of matched subtopics) of the k best books of some blocks, and how many blocks were left out.

    A block that could not better the k-th best so far, were one book to cover all that any book of it covers, is not
    looked into; blocks that promise most come first. With ``by_title`` the numbers of blocks follow the order of titles,
    so that of equal blocks the first ones decide, and k books are given at most.
    """
    bounds = []
    for block, matrix in blocks.items():
        t, s = (sum((kind, name) in matrix.packed for name in names) for kind, names in (("topic", topics), ("subtopic", subs)))
        if t or s:
            bounds.append((-scores(t, len(topics), s, len(subs)), -t, block))
    best: list[tuple] = []
    for done, (bound, most, block) in enumerate(sorted(bounds)):
        if len(best) >= k and ((bound, most, block) > best[-1][:3] if by_title else (bound, most) > best[-1][:2]):
            return best, len(bounds) - done
        at_t, rows_t, t = blocks[block].covered("topic", topics)
        at_s, rows_s, s = blocks[block].covered("subtopic", subs)
        width = len(subs) + 1
        pairs = t * width + s
        found = np.flatnonzero(np.bincount(pairs)[1:]) + 1
        order = sorted((-scores(p // width, len(topics), p % width, len(subs)), -(p // width), p) for p in found.tolist())
        taken: list[tuple] = []
        for score, count, pair in order:
            for place in np.flatnonzero(pairs == pair)[: k - len(taken)].tolist():
                taken.append((score, count, block, place, [i for i, row in zip(at_t, rows_t, strict=True) if row[place]], [i for i, row in zip(at_s, rows_s, strict=True) if row[place]]))
            if len(taken) >= k:
                break
        if by_title:
            best = sorted(best + taken, key=lambda b: b[:4])[:k]
            continue
        # of equal score and count all are kept here: titles decide between blocks
        best = sorted(best + taken, key=lambda b: b[:2])
        if len(best) > k:
            worst = best[k - 1][:2]
            best = [b for b in best if b[:2] <= worst]
    return best, 0


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``number``, from 0 in the given order, which must be a total one; sorted in ranges, whose sizes alone meet."""
    parts = max(1, df.sparkSession.sparkContext.defaultParallelism)
    ranges = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the partition's number, 33 bits for the row's
    rows = cut(ranges.select("*", F.shiftright(at, 33).cast("int").alias("_range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_start"))  # a row a range
    return rows.join(F.broadcast(starts), "_range").withColumn("number", F.col("_start") + F.col("_row")).drop("_range", "_row", "_start")


def required_sets(required: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked, sets): each question's names in their order (query_id, topics, subs, set_key, set_topics, set_subs), and each distinct set of names once.

    Sets are (set_id, set_key, set_topics, set_subs, n_questions), with the names sorted and ``set_key`` a hash of both lists. Null names take no part.
    """
    lists = (F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "name")))) for kind in ("topic", "subtopic"))
    rows = required.where("name is not null").groupBy("query_id").agg(*(F.transform(x, lambda p: p["name"]).alias(c) for x, c in zip(lists, ("topics", "subs"), strict=True)))
    rows = rows.withColumn("set_topics", F.array_sort("topics")).withColumn("set_subs", F.array_sort("subs"))
    asked = stored(rows.withColumn("set_key", F.xxhash64("set_topics", "set_subs")), "required-names")
    sets = asked.groupBy("set_key", "set_topics", "set_subs").agg(F.count(F.lit(1)).alias("n_questions"))
    return asked, cut(sets.withColumn("set_id", F.monotonically_increasing_id()))


def alike(profiles: DataFrame) -> DataFrame:
    """(document_id, profile_key, profile): all names of each book, sorted, and their hash; books alike in them cover the same of any question."""
    names = profiles.where("document_id is not null and name is not null").groupBy("document_id").agg(F.array_sort(F.collect_set(F.struct("kind", "name"))).alias("profile"))
    return names.withColumn("profile_key", F.xxhash64("profile"))


def numbered_books(books: DataFrame, *order: str) -> DataFrame:
    """``books`` with the block and the place of each, in the given order."""
    rows = numbered(books, *order)
    return cut(rows.select("*", F.floor(F.col("number") / BLOCK_BOOKS).cast("int").alias("block"), (F.col("number") % BLOCK_BOOKS).alias("place")).drop("number"))


#: Kind of the row of a block's matrix that holds how many books each place stands for.
BOOKS_OF_PLACE = ""


def in_matrices(sets: DataFrame, profiles: DataFrame, books: DataFrame, threshold: float, answer: Callable[[list[str], list[str], dict[int, Matrix]], list[tuple]], types: str) -> DataFrame:
    """(set_id, ...): what ``answer`` gives for each set of names, its topics and subtopics, and the matrices of a task's blocks, as rows of ``types``.

    A task holds MATRIX_BYTES of blocks of ``books`` (document_id, block, place, n_books), and reads sets one by one; a set meets the blocks
    of each bin, in a task a bin.
    """
    spark = sets.sparkSession

    def of_kind(kind: str, names: str) -> Column:
        return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    names = F.concat(of_kind("topic", "set_topics"), of_kind("subtopic", "set_subs"))
    wanted = cut(sets.select(F.inline(names)).distinct())
    bits = bit_matrix(wanted, profiles, books.select("document_id", "block", "place"), threshold).groupBy("block", "kind", "name").agg(F.collect_list(F.struct("word", "bits")).alias("words"))
    many = books.where("n_books > 1").groupBy("block").agg(F.collect_list(F.struct(F.col("place").cast("int").alias("word"), F.col("n_books").alias("bits"))).alias("words"))
    rows = cut(bits.unionByName(many.withColumn("kind", F.lit(BOOKS_OF_PLACE)).withColumn("name", F.lit(""))))
    size = rows.agg(F.sum(F.size("words") * 12 + 100)).first()[0] or 0
    groups = max(1, -(-size // MATRIX_BYTES))
    n_sets = sets.count()
    tasks = max(1, min(spark.sparkContext.defaultParallelism, n_sets // 1024), -(-n_sets // TASK_QUESTIONS))
    keys = ["bin", "task"]
    held = rows.withColumn("bin", F.pmod("block", F.lit(groups)).cast("int")).withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    sent = sets.select("set_id", F.col("set_topics").alias("topics"), F.col("set_subs").alias("subs"))
    sent = sent.withColumn("task", F.pmod(F.xxhash64("set_id"), F.lit(tasks)).cast("int")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    columns = ["set_id", "block", "kind", "name", "words", "topics", "subs"]
    # a task's matrices come first, then its sets
    both = held.unionByName(sent, allowMissingColumns=True).withColumn("asks", F.col("block").isNull())
    both = both.repartition(groups * tasks, *keys).sortWithinPartitions(*keys, "asks", "block").select(*keys, *columns)
    schema = to_arrow_schema(StructType.fromDDL(f"set_id long, {types}"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, matrices = None, {}
        for batch in batches:
            out = []
            bins, own_tasks, ids, block, kind, name, words, topics, subs = batch.columns
            for i in range(batch.num_rows):
                here = bins[i].as_py(), own_tasks[i].as_py()
                if here != now:
                    now, matrices = here, {}
                if block[i].is_valid:
                    at = words[i].values
                    matrix = matrices.setdefault(block[i].as_py(), Matrix())
                    if kind[i].as_py() == BOOKS_OF_PLACE:
                        matrix.stand_for(at.field("word").to_numpy(), at.field("bits").to_numpy())
                    else:
                        matrix.add(kind[i].as_py(), name[i].as_py(), at.field("word").to_numpy(), at.field("bits").to_numpy().view(np.uint64))
                    continue
                out += [dict(zip(schema.names, (ids[i].as_py(), *found), strict=True)) for found in answer(topics[i].as_py(), subs[i].as_py(), matrices)]
            yield pa.RecordBatch.from_pylist(out, schema)

    return both.mapInArrow(search, f"set_id long, {types}")


def scored(rows: DataFrame, topic_weight: float, subtopic_weight: float) -> DataFrame:
    """``rows`` (t, s, n_topics, n_subs, ...) with score, topic_coverage, subtopic_coverage and n_matched."""
    topics, subs = (F.coalesce(F.col(n) / F.nullif(of, F.lit(0)), F.lit(0.0)) for n, of in (("t", "n_topics"), ("s", "n_subs")))
    return rows.withColumn("score", F.round(topic_weight * topics + subtopic_weight * subs, 4)).withColumn("topic_coverage", F.round(topics, 4)).withColumn("subtopic_coverage", F.round(subs, 4)).withColumnRenamed("t", "n_matched")


def best_books(required: DataFrame, profiles: DataFrame, titles: DataFrame, k: int, topic_weight: float = params.TOPIC_WEIGHT, subtopic_weight: float = params.SUBTOPIC_WEIGHT, threshold: float = params.MATCH_THRESHOLD) -> DataFrame:
    """(query_id, rank, document_id, title, score, topic_coverage, subtopic_coverage, n_matched, matched, missing, matched_subtopics, missing_subtopics, and other columns of ``titles``).

    The k books that cover best what each question requires (query_id, kind, name, pos), of those that match
    anything: by score, then matched topics, then title, then document_id. The rows are those of
    :func:`coverage` and :func:`rank_books`, but no row for a (question, book) is ever made: books are
    the bits of a matrix in blocks of BLOCK_BOOKS, a task holds MATRIX_BYTES of blocks, reads sets of required names one
    by one, counts bits in blocks that can still better its k best, and hands on those alone. Blocks follow the
    order of titles, so that books of equal scores are not looked for beyond the first. Questions that require
    the same names are answered once, and of books that are alike in all their names, which every question ranks by title, the first k stand for all.

    ``titles`` is (document_id, title, ...), one row a book; books without a title take no part. A document_id
    or name that is null takes no part; a question that nothing matches has no row.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    profiles = cut(profiles.select("document_id", "kind", "name"))
    place = F.row_number().over(Window.partitionBy("profile_key", "profile").orderBy("title", "document_id"))
    first = titles.join(alike(profiles), "document_id").withColumn("_place", place).where(F.col("_place") <= k).drop("_place", "profile_key", "profile")
    books = numbered_books(first, "title", "document_id")
    asked, sets = required_sets(required)
    scores = Scores(topic_weight, subtopic_weight)

    def best(topics: list[str], subs: list[str], matrices: dict[int, Matrix]) -> list[tuple]:
        found = best_in_blocks(topics, subs, matrices, k, scores, by_title=True)[0]
        return [(block, place, -t, len(got_s), [topics[j] for j in got_t], [subs[j] for j in got_s]) for _, t, block, place, got_t, got_s in found]

    near = in_matrices(sets, profiles, books.withColumn("n_books", F.lit(1).cast("long")), threshold, best, "in_block long, at long, t long, s long, got_topics array<string>, got_subs array<string>")
    rows = near.join(books, (F.col("in_block") == F.col("block")) & (F.col("at") == F.col("place"))).join(sets.drop("n_questions"), "set_id")
    rows = scored(rows.withColumn("n_topics", F.size("set_topics")).withColumn("n_subs", F.size("set_subs")), topic_weight, subtopic_weight)
    rank = F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("score"), F.desc("n_matched"), "title", "document_id"))
    answers = cut(rows.withColumn("rank", rank).where(F.col("rank") <= k).drop("in_block", "at", "block", "place", "set_id"))  # k rows a set

    def split(names: str, got: str) -> list[Column]:
        return [F.filter(names, lambda x: F.array_contains(got, x)), F.filter(names, lambda x: ~F.array_contains(got, x))]

    lists = zip((*split("topics", "got_topics"), *split("subs", "got_subs")), ("matched", "missing", "matched_subtopics", "missing_subtopics"), strict=True)
    more = [c for c in titles.columns if c not in ("document_id", "title")]
    return asked.join(answers, ["set_key", "set_topics", "set_subs"]).select(
        "query_id", "rank", "document_id", "title", "score", "topic_coverage", "subtopic_coverage", "n_matched", *(c.alias(name) for c, name in lists), *more
    )


def spread(required: DataFrame, profiles: DataFrame, titles: DataFrame, topic_weight: float = params.TOPIC_WEIGHT, subtopic_weight: float = params.SUBTOPIC_WEIGHT, threshold: float = params.MATCH_THRESHOLD) -> DataFrame:
    """(query_id, rank, score, topic_coverage, subtopic_coverage, n_matched, n_books, n_questions): how all books that match anything cover what each question requires.

    The rows of :func:`coverage` and :func:`rank_books` for every (question, book), those of equal counts of topics and subtopics as one with their number,
    ``n_books``, and the rank of the first of them; questions that require the same names as one with their number, ``n_questions``, and a query_id of its own.
    Every book of every block is counted; no row for a (question, book) is ever made. Arguments are those of :func:`best_books`.
    """
    profiles = cut(profiles.select("document_id", "kind", "name"))
    named = titles.select("document_id").join(alike(profiles), "document_id")
    books = numbered_books(named.groupBy("profile_key", "profile").agg(F.min("document_id").alias("document_id"), F.count(F.lit(1)).alias("n_books")).select("document_id", "n_books"), "document_id")
    sets = required_sets(required)[1]

    def counts(topics: list[str], subs: list[str], matrices: dict[int, Matrix]) -> list[tuple]:
        width, total = len(subs) + 1, np.zeros((len(topics) + 1) * (len(subs) + 1), np.int64)
        for matrix in matrices.values():
            pairs = matrix.covered("topic", topics)[2] * width + matrix.covered("subtopic", subs)[2]
            np.add.at(total, pairs, matrix.books)
        return [(p // width, p % width, int(total[p])) for p in (np.flatnonzero(total[1:]) + 1).tolist()]

    found = in_matrices(sets, profiles, books, threshold, counts, "t long, s long, n long").groupBy("set_id", "t", "s").agg(F.sum("n").alias("n_books"))
    rows = found.join(sets.select("set_id", F.size("set_topics").alias("n_topics"), F.size("set_subs").alias("n_subs"), "n_questions"), "set_id")
    order = Window.partitionBy("set_id").orderBy(F.desc("score"), F.desc("n_matched"), F.desc("s"))
    ranked = scored(rows, topic_weight, subtopic_weight).withColumn("rank", F.sum("n_books").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_books") + 1)
    return ranked.select(F.col("set_id").alias("query_id"), "rank", "score", "topic_coverage", "subtopic_coverage", "n_matched", "n_books", "n_questions")


def rank_books(covered: DataFrame, titles: DataFrame, k: int | None = None) -> DataFrame:
    """``covered`` with title and rank: by score, then matched topics, then title."""
    rows = covered.join(titles, "document_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("n_matched"), "title", "document_id"))
    ranked = rows.withColumn("rank", rank)
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def recommend(queries: DataFrame, hits: DataFrame, graph_names: DataFrame, profiles: DataFrame, titles: DataFrame, k: int = 3, top_hits: int = 10) -> DataFrame:
    """(query_id, subject, no_syllabus_evidence, rank, document_id, title, score, n_matched, matched, missing): the books that best cover what each question's subject requires.

    ``hits`` (query_id, rank, score, text, document_type, subject, topic, subtopic) are found for
    the questions; ``graph_names`` (subject_key, kind, name, pos) is what the graph holds of a
    subject; ``profiles`` and ``titles`` are of books. A question without evidence, or that no
    book matches, has one row without a book.
    """
    asked = queries.withColumn("text", expand_aliases(strip(F.col("text"))))
    near = cut(hits.where(F.col("rank") <= top_hits))
    found = evidence_rows(asked, near)
    subjects = best_subject(found)
    used = widened(near, subjects).unionByName(found.join(subjects, "query_id", "left_anti"))
    own = used.select("query_id", F.explode(F.create_map(F.lit("topic"), "topic", F.lit("subtopic"), "subtopic")).alias("kind", "name"), F.col("rank").alias("pos"))
    drawn = subjects.join(graph_names, name_key(F.col("subject")) == F.col("subject_key")).select("query_id", "kind", "name", "pos")
    wanted = required_names(own.where("name is not null and name <> ''"), drawn.where("name is not null and name <> ''"))
    bare = subjects.join(wanted.where("kind = 'topic'").select("query_id").distinct(), "query_id", "left_anti")
    wanted = cut(wanted.unionByName(bare.select("query_id", F.lit("topic").alias("kind"), F.col("subject").alias("name"), F.lit(1).alias("pos"))))
    ranked = best_books(wanted, profiles, titles, k)
    rows = queries.select("query_id").join(found.select("query_id").distinct().withColumn("found", F.lit(True)), "query_id", "left").join(subjects, "query_id", "left").join(ranked, "query_id", "left")
    return rows.select("query_id", "subject", F.col("found").isNull().alias("no_syllabus_evidence"), "rank", "document_id", "title", "score", "n_matched", "matched", "missing")


def summary_text(ranked: DataFrame) -> DataFrame:
    """(query_id, summary): a sentence on the best book, and one on the next where there is one."""
    first = F.max(F.when(F.col("rank") == 1, F.concat("title", F.lit(" covers "), F.round(F.col("score") * 100, 0).cast("int").cast("string"), F.lit("% of the required topics."))))
    second = F.max(F.when(F.col("rank") == 2, F.concat(F.lit("Next is "), "title", F.lit(" with "), F.round(F.col("score") * 100, 0).cast("int").cast("string"), F.lit("%."))))
    return ranked.groupBy("query_id").agg(F.concat_ws(" ", first, second).alias("summary"))


def violations(ranked: DataFrame, topic_weight: float = params.TOPIC_WEIGHT, subtopic_weight: float = params.SUBTOPIC_WEIGHT) -> DataFrame:
    """Rows whose score is not the weighted sum, or which rank behind a lower score."""
    expected = topic_weight * F.col("topic_coverage") + subtopic_weight * F.col("subtopic_coverage")
    before = F.lag("score").over(Window.partitionBy("query_id").orderBy("rank"))
    rows = ranked.withColumn("before", before)
    return rows.where((F.abs(F.col("score") - expected) > 1.5e-4) | (F.col("before") < F.col("score"))).drop("before")
