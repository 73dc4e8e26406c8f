"""Approximate nearest neighbours with balanced posting lists.

A bounded sample of the vectors (``SAMPLE_ROWS``) fits the centroids of the lists, by k-means whose
assignment is made dearer for crowded lists. The same prices hold when every vector is indexed: it
is put in the list of least squared distance plus price, which keeps lists near equal, and a
vector near a boundary, whose next lists are at most ``BOUNDARY`` times as far by that measure, is
replicated to up to ``REPLICAS`` lists. A query walks an in-memory graph of the centroids from the
nearest one on, best first, and takes the lists within a ratio of the nearest centroid's
distance, and at least as many as hold ``LEAST_ROWS`` first copies; exact distances then rank
what those lists hold.

The ratio is fitted when the index is built: the true neighbours of ``TRIED`` sample vectors, found
by brute force over all rows, tell how far their lists are. It is the least at which the search of
these reaches ``RECALL``, and not below ``RATIO``.

Rows are told apart by a number of their own, so rows of one vec_id are queries and candidates each
for itself. Lists are split by hash where they or the queries that read them are many, so that one common
vector or a crowded list is never met in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut

SAMPLE_ROWS = 16_384
ROWS_PER_LIST, MIN_LISTS, MAX_LISTS = 250, 8, 4096
BOUNDARY, REPLICAS, RATIO, LEAST_ROWS = 1.05, 3, 1.14, 500
LINKS, ROUNDS = 24, 12
TRIED, RECALL = 256, 0.95
#: Vectors and queries that one group of the search holds, about.
PART_ROWS, PART_QUERIES = 8192, 2048


@dataclass
class Index:
    """Centroids, the graph over them, how many first copies each list holds, the prices of lists, and the ratio of the search; ``MAX_LISTS`` rows at most."""

    centroids: np.ndarray
    links: np.ndarray
    sizes: np.ndarray
    prices: np.ndarray
    ratio: float = RATIO


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row long, vec_id long, v array<double>) of the vectors that take part; ``row`` numbers them, with gaps.

    Those with a null id, and vectors that are null, empty, zero, or hold null or non-finite
    components take none; of several dimensions, the one with most vectors does (the smaller at a tie).
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (common["d"] if common else 0)).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def fit(sample: np.ndarray, n_lists: int, seed: int = 42) -> Index:
    """Balanced k-means on the sample, then each centroid's nearest others as its links in the graph."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    n_lists = max(1, min(n_lists, len(distinct)))
    centroids = distinct[rng.choice(len(distinct), n_lists, replace=False)]
    prices, slope = np.zeros(n_lists), 0.0
    for at in range(ROUNDS):
        nearest, far = np.zeros(len(distinct), int), np.zeros(len(distinct))
        for i in range(0, len(distinct), 2048):  # so that memory stays within 2048 * n_lists
            d = squared(distinct[i : i + 2048], centroids)
            nearest[i : i + 2048], far[i : i + 2048] = (d + prices).argmin(1), d.min(1)
        counts = np.bincount(nearest, minlength=n_lists)
        slope = slope or 0.1 * float(np.median(far))
        prices += slope * np.clip(counts / max(counts.mean(), 1) - 1, -1, 1)
        if at < ROUNDS // 2:  # then the centroids rest and the prices settle
            sums = np.zeros_like(centroids)
            np.add.at(sums, nearest, distinct)
            centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    prices -= prices.min()
    between = squared(centroids, centroids)
    np.fill_diagonal(between, np.inf)
    links = between.argsort(axis=1)[:, : min(LINKS, n_lists - 1)]
    # a ring through all centroids keeps the graph in one piece
    links = np.concatenate([links, np.roll(np.arange(n_lists), -1)[:, None]], axis=1)
    return Index(centroids, links, np.zeros(n_lists, np.int64), prices)


def lists_of(query: np.ndarray, index: Index, ratio: float, least: int) -> list[int]:
    """Lists to search, nearest first: a best-first walk over the graph, cut by the distance ratio."""

    def distance(nodes: np.ndarray) -> np.ndarray:
        return np.sqrt(((index.centroids[nodes] - query) ** 2).sum(1))

    n = len(index.centroids)
    entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))
    seen = np.zeros(n, bool)
    seen[entries] = True
    heap = list(zip(distance(entries).tolist(), entries.tolist(), strict=True))
    heapq.heapify(heap)
    found: list[tuple[float, int]] = []
    nearest, held = np.inf, 0
    spare = 0
    while heap:
        d, node = heapq.heappop(heap)
        nearest = min(nearest, d)
        if d > ratio * nearest and held >= least:
            spare += 1
            if spare > LINKS:  # the walk goes a little further, for what lies behind
                break
        found.append((d, node))
        held += int(index.sizes[node])
        fresh = np.unique(index.links[node][~seen[index.links[node]]])
        seen[fresh] = True
        for far, other in zip(distance(fresh).tolist(), fresh.tolist(), strict=True):
            heapq.heappush(heap, (far, other))
    found.sort()
    kept, held = [], 0
    for d, node in found:
        if d > ratio * nearest and held >= least:
            break
        kept.append(node)
        held += int(index.sizes[node])
    return kept


def places(v: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest lists of each vector, and which of them take it."""
    cost = np.sqrt(squared(v, index.centroids) + index.prices)
    near = cost.argsort(axis=1, kind="stable")[:, :REPLICAS]
    kept = np.take_along_axis(cost, near, 1) <= BOUNDARY * np.take_along_axis(cost, near[:, :1], 1)
    kept[:, 0] = True
    return near, kept


def assign(rows: DataFrame, index: Index) -> DataFrame:
    """(list, first, row, vec_id, v): each vector in its cheapest list (``first``) and, near a boundary, in the next ones."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                v = part.column(2).flatten().to_numpy().reshape(part.num_rows, -1)
                near, kept = places(v, shared.value)
                row, order = np.nonzero(kept)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(near[row, order], pa.int32()), pa.array(order == 0), *taken.columns], ["list", "first", "row", "vec_id", "v"])

    return rows.mapInArrow(place, "list int, first boolean, row long, vec_id long, v array<double>")


def true_lists(rows: DataFrame, index: Index, own: np.ndarray, asked: np.ndarray, k: int) -> list[tuple[int, list[int]]]:
    """(place in ``asked``, lists) of each of its k nearest others in all rows; a task keeps its own k best of each."""
    shared = rows.sparkSession.sparkContext.broadcast((index, own, asked))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, numbers, q = shared.value
        far, held = np.full((len(q), k), np.inf), np.zeros((len(q), k, q.shape[1]))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                v = part.column(2).flatten().to_numpy().reshape(part.num_rows, -1)
                d = squared(q, v)
                d[numbers[:, None] == part.column(0).to_numpy()[None, :]] = np.inf
                near = np.argpartition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else np.tile(np.arange(d.shape[1]), (len(q), 1))
                far, held = np.concatenate([far, np.take_along_axis(d, near, 1)], 1), np.concatenate([held, v[near]], 1)
                least = np.argsort(far, axis=1, kind="stable")[:, :k]
                far, held = np.take_along_axis(far, least, 1), np.take_along_axis(held, least[:, :, None], 1)
        row, order = np.nonzero(np.isfinite(far))
        if not len(row):
            return
        near, kept = places(held[row, order], fitted)
        lists = pa.array([n[t].tolist() for n, t in zip(near, kept, strict=True)], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(far[row, order]), lists], ["place", "d", "lists"])

    close = rows.mapInArrow(best, "place int, d double, lists array<int>")
    rank = F.row_number().over(Window.partitionBy("place").orderBy("d", "lists"))
    # TRIED * k rows at most
    return [(r["place"], r["lists"]) for r in close.withColumn("rank", rank).where(F.col("rank") <= k).select("place", "lists").collect()]


def fit_ratio(rows: DataFrame, index: Index, own: np.ndarray, asked: np.ndarray, k: int, least: int = LEAST_ROWS) -> float:
    """The least ratio at which searches for the ``asked`` vectors find ``RECALL`` of their true neighbours."""
    found = true_lists(rows, index, own, asked, k)
    if not found:
        return RATIO
    d = np.sqrt(squared(asked, index.centroids))
    nearest = d.min(axis=1)
    needed = [d[q, lists].min() / nearest[q] if nearest[q] > 0 else 1.0 for q, lists in found]
    ratio = max(RATIO, float(np.quantile(needed, RECALL, method="higher")))
    widest = max(d.max(axis=1)[nearest > 0] / nearest[nearest > 0], default=ratio)
    while True:  # the walk may lose lists that are near enough
        taken = [set(lists_of(q, index, ratio, least)) for q in asked]
        if np.mean([not taken[q].isdisjoint(lists) for q, lists in found]) >= RECALL or ratio > widest:
            return ratio
        ratio *= 1.02


def draw(rows: DataFrame, n: int, seed: int) -> list:
    """(row, v) of different vectors, about SAMPLE_ROWS + TRIED by the lowest hashes: the bar follows from the count, so no task sends more than its share."""
    wanted = SAMPLE_ROWS + TRIED
    h = F.xxhash64(F.lit(seed), "v")
    share = 0.95 * wanted / n if n > wanted else 1.0
    low = rows.withColumn("h", h) if share == 1.0 else rows.withColumn("h", h).where(F.col("h") < F.lit(int((share - 0.5) * 2.0**64)))
    drawn = low.groupBy("h", "v").agg(F.min("row").alias("row")).select("row", "v", "h").collect()
    return sorted(drawn, key=lambda r: (r["h"], r["v"]))[:wanted]


def build(rows: DataFrame, seed: int = 42, k: int = 10) -> tuple[Index, DataFrame]:
    """The index of usable vectors (row, vec_id, v), its ratio fitted for k neighbours, and its posting lists, stored in the shared folder.

    The sample holds at most SAMPLE_ROWS different vectors, whatever the number of rows and
    partitions; a vector that many rows hold is drawn once.
    """
    n = rows.count()
    n_lists = min(MAX_LISTS, max(MIN_LISTS, n // ROWS_PER_LIST))
    drawn = draw(rows, n, seed) if n else []
    if not drawn:
        none = np.zeros(0, int)
        return Index(np.zeros((0, 0)), np.zeros((0, 0), int), none, none), rows.select(F.lit(0).alias("list"), F.lit(True).alias("first"), "row", "vec_id", "v")
    v = np.array([row["v"] for row in drawn])
    fitted = min(len(v), SAMPLE_ROWS)
    index = fit(v[:fitted], n_lists, seed)
    # vectors that the centroids were fitted to lie nearer to theirs, so the ratio is tried on as many of them as there are among all rows
    others = min(len(v) - fitted, round(TRIED * (1 - fitted / n)))
    tried = [*range(min(TRIED - others, fitted)), *range(fitted, fitted + others)]
    postings = cut(assign(rows, index))
    for row in postings.groupBy("list").agg(F.count_if("first").alias("n")).collect():
        index.sizes[row["list"]] = row["n"]
    index.ratio = fit_ratio(rows, index, np.array([drawn[i]["row"] for i in tried]), v[tried], k)
    return index, postings


def search(queries: DataFrame, index: Index, postings: DataFrame, k: int = 10, ratio: float | None = None, least: int = LEAST_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of ``queries`` (row, vec_id, v), without itself.

    ``score`` is the Euclidean distance of the vectors as given, in double precision; equal
    distances go by vec_id. ``ratio`` is the index's own unless given. Rows that share a vec_id are
    queries and candidates each for itself, so each such query has a ranking of its own.
    """
    shared = queries.sparkSession.sparkContext.broadcast(index)
    ratio = index.ratio if ratio is None else ratio

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = [lists_of(np.array(v.as_py()), shared.value, ratio, least) if len(shared.value.centroids) else [] for v in batch.column(2)]
            row = np.repeat(np.arange(batch.num_rows), [len(p) for p in picked])
            flat = pa.array([x for p in picked for x in p], pa.int32())
            yield pa.RecordBatch.from_arrays([flat, *batch.take(pa.array(row)).columns], ["list", "row", "vec_id", "v"])

    asked = cut(queries.mapInArrow(walk, "list int, row long, vec_id long, v array<double>"))
    held = postings.groupBy("list").agg(F.count(F.lit(1)).alias("rows"))
    wanted = asked.groupBy("list").agg(F.count(F.lit(1)).alias("asks"))
    # a row per list, MAX_LISTS at most
    split = held.join(wanted, "list").select("list", F.ceil(F.col("rows") / PART_ROWS).cast("int").alias("parts"), F.ceil(F.col("asks") / PART_QUERIES).cast("int").alias("shares"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Rows of a list dealt over its own parts, and copied to each of the other side's."""
        mine = F.pmod(F.xxhash64("row"), F.col(own)).cast("int").alias(own)
        copies = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
        return df.join(F.broadcast(split), "list").select("list", mine, copies, "row", "vec_id", "v").select("list", "parts", "shares", "row", "vec_id", "v")

    left, right = dealt(asked, "shares", "parts"), dealt(postings, "parts", "shares")

    def nearest(asks: pa.Table, rows: pa.Table) -> pa.Table:
        ids, numbers = rows.column("vec_id").to_numpy(), rows.column("row").to_numpy()
        v = rows.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
        asked, near, far = [], [], []
        for own, vector in zip(asks.column("row").to_pylist(), asks.column("v").to_pylist(), strict=True):
            others = np.flatnonzero(numbers != own)
            if not len(others):
                continue
            d = np.sqrt(((v[others] - np.array(vector)) ** 2).sum(1))
            if len(d) > k:
                close = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                others, d = others[close], d[close]
            best = np.lexsort((numbers[others], ids[others], d))[:k]
            asked += [own] * len(best)
            near.append(others[best])
            far.append(d[best])
        at = np.concatenate(near) if near else np.zeros(0, int)
        found = {"query_row": pa.array(asked, pa.int64()), "row": pa.array(numbers[at], pa.int64()), "vec_id": pa.array(ids[at], pa.int64())}
        return pa.table(found | {"score": pa.array(np.concatenate(far) if far else [], pa.float64())})

    keys = ["list", "parts", "shares"]
    # a vector of several lists is found in each of them
    close = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest, "query_row long, row long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id", "row"))
    best = close.withColumn("rank", rank).where(F.col("rank") <= k)
    names = queries.select(F.col("row").alias("asked"), F.col("vec_id").alias("query_id"))
    return best.join(names, F.col("query_row") == F.col("asked")).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42) -> DataFrame:
    """Indexes all vectors and searches with those rows for which ``queries`` holds (a condition on vec_id).

    Defined cases: see :func:`usable` for vectors that take no part; rows of one vec_id are told
    apart (see :func:`search`); fewer than k candidates are all returned; an empty table gives no rows; other columns are ignored.
    """
    rows = cut(usable(vectors, id_col, vector_col))
    index, postings = build(rows, seed, k)
    return search(rows.where(queries), index, postings, k)
