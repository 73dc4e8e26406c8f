"""Hard negatives for contrastive training, by slot-decomposed selection.

An anchor's positives are its best rows of the same label; a negative of a positive is a row of
another label whose score lies between two shares of the positive's. The positives' upper limits,
in descending order, cut an anchor's scores into disjoint slots. Whatever a positive may take lies in its
own slot or a lower one, so the best ``k`` of each slot are enough for all positives: combiners keep
those, per tile, per task and per anchor, and merging the slots from the lowest upwards gives for each slot the
best ``k`` at or below its limit, whatever windows overlap. A window's lower limit then cuts that list short.

All anchors meet all rows in tiles: a row tile of about ROW_TILE rows is sent to each anchor tile of about ANCHOR_TILE
anchors (one tile for up to 8,192 of them), and a task scores one against the other by a matrix product. Scores
are exact integers. Positives are looked for among rows of the anchor's bucket of labels only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, stored

POSITIVES, NEGATIVES = 5, 3
#: Per cent of a positive's score that a negative's must have at least and at most.
LOWEST, HIGHEST = 50, 95
SCALE = 256
LABEL_BUCKETS = 64
ANCHOR_TILE, ROW_TILE = 8192, 2048
#: Row tiles that a task takes for one anchor tile at most, and scores that it holds at once.
TILES_PER_TASK, STRIP_SCORES = 512, 1 << 20
#: Beyond this magnitude scores are held at it, so that a hundred times a score is a long.
LARGEST_SCORE = 9 * 10**16
LOW = -(1 << 62)


def quantised(values: np.ndarray, lengths: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Rows of floor(scale * x) as whole doubles, shorter vectors filled up with 0."""
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(out * scale))  # beyond the greatest double, that


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of two sets of whole-numbered rows, exact up to LARGEST_SCORE."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width < 2.0**53:
        return (a @ b.T).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        easy = np.abs(a) @ np.abs(b).T < 2.0**53  # bounds every partial sum
        out = np.zeros(easy.shape, np.int64)
        out[easy] = (a @ b.T)[easy].astype(np.int64)
    whole_a, whole_b = ({i: [int(v) for v in side[i]] for i in which} for side, which in ((a, np.flatnonzero(~easy.all(1)).tolist()), (b, np.flatnonzero(~easy.all(0)).tolist())))
    for i, j in zip(*(x.tolist() for x in np.nonzero(~easy)), strict=True):
        exact = sum(x * y for x, y in zip(whole_a[i], whole_b[j], strict=True))
        out[i, j] = max(-LARGEST_SCORE, min(LARGEST_SCORE, exact))
    return out


def leading(anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Positions of the best ``k`` of each (anchor, slot): higher scores first, then lower places."""
    order = np.lexsort((place, -score, slot, anchor))
    a, s = anchor[order], slot[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])]) if len(order) else order
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[nth < k]


class Combiner:
    """The best ``k`` rows of each slot of each anchor of one tile, over the row tiles seen so far.

    ``limits`` holds an anchor's upper limits, descending, filled up with LOW, and last the least score of use.
    """

    def __init__(self, label: np.ndarray, row: np.ndarray, vectors: np.ndarray, limits: np.ndarray, same: bool, k: int) -> None:
        self.label, self.row, self.vectors, self.limits, self.least, self.same, self.k = label, row, vectors, limits[:, :-1], limits[:, -1:], same, k
        self.kept: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(5)]  # anchor, slot, score, vec_id, row
        self.bar = self.bars(np.full(self.limits.size, LOW))  # the score that a slot's k-th best has

    def bars(self, worst: np.ndarray) -> np.ndarray:
        return np.where(self.limits == LOW, np.iinfo(np.int64).max, worst.reshape(self.limits.shape))

    def add(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        step = max(1, STRIP_SCORES // max(1, len(ids)))
        for at in range(0, len(self.label), step):
            part = slice(at, at + step)
            score = products(self.vectors[part], vectors)
            wanted = (self.label[part, None] == labels) == self.same
            wanted &= score <= self.limits[part, :1]
            wanted &= score >= np.maximum(self.least[part], self.bar[part].min(axis=1)[:, None])
            if self.same:
                wanted &= self.row[part, None] != rows
            i, j = np.nonzero(wanted)
            found, i = score[i, j], i + at
            slot = (found[:, None] <= self.limits[i, 1:]).sum(axis=1)
            fit = found >= self.bar[i, slot]
            i, j, found, slot = i[fit], j[fit], found[fit], slot[fit]
            best = leading(i, slot, found, j, self.k)  # rows of a tile stand in order of their ids
            self.merge([i[best], slot[best], found[best], ids[j[best]], rows[j[best]]])

    def merge(self, more: list[np.ndarray]) -> None:
        if not len(more[0]):
            return
        all_of = [np.concatenate(pair) for pair in zip(self.kept, more, strict=True)]
        by_id = np.empty(len(all_of[0]), np.int64)
        by_id[np.lexsort((all_of[4], all_of[3]))] = np.arange(len(by_id))
        best = leading(*all_of[:3], by_id, self.k)
        self.kept = [x[best] for x in all_of]
        anchor, slot, score = self.kept[:3]
        flat = anchor * self.limits.shape[1] + slot
        full = np.bincount(flat, minlength=self.bar.size) >= self.k
        worst = np.full(self.bar.size, np.iinfo(np.int64).max)
        np.minimum.at(worst, flat, score)
        self.bar = self.bars(np.where(full, worst, LOW))


def usable(rows: DataFrame, label: Column) -> DataFrame:
    """(row, id, label, vector) of the rows (id, label, vector) with a label and a whole, finite vector, ``label`` replaced."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    placed = rows.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), F.col("label").isNotNull().alias("labelled"), label.cast("long").alias("label"), "vector")
    return placed.where(F.col("labelled") & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite).select("row", "id", "label", "vector")


def tiled(rows: DataFrame, cell: Column, size: int) -> DataFrame:
    """A stored table (cell, part, parts, members): rows (row, id, label, vector, limits) in tiles of about ``size``, in order of their ids; ``parts`` is the number of tiles of the cell."""
    placed = rows.withColumn("cell", cell)
    cells = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))  # LABEL_BUCKETS rows at most
    placed = placed.join(F.broadcast(cells), "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    members = F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("last"), "id", "row", "label", "vector", "limits")))
    return stored(placed.groupBy("cell", "part", "parts").agg(members.alias("members")), "tiles")


def unpacked(members: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids (null as the greatest long), rows, labels and quantised vectors of a tile."""
    column = {name: members.field(name) for name in ("id", "row", "label")}
    ids = column["id"].fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype(np.int64)
    rows, labels = (column[name].to_numpy(zero_copy_only=False).astype(np.int64) for name in ("row", "label"))
    vectors = members.field("vector")
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, rows, labels, quantised(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lengths)


def met(anchors: DataFrame, tiles: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor, slot, score, id, row): what each task keeps of the best ``k`` rows of each anchor's slots, of rows with the same or another label.

    ``anchors`` and ``tiles`` come from :func:`tiled`, ``members`` of the former with ``limits`` as :class:`Combiner` takes them.
    """
    spark = anchors.sparkSession
    anchors, tiles = anchors.select("cell", "part", F.col("parts").alias("anchor_parts"), F.col("members").alias("anchors")), tiles.select("cell", F.col("part").alias("row_part"), "parts", "members")
    most = max(1, spark.sparkContext.defaultParallelism * 2)
    tasks = F.greatest(F.least(F.col("parts"), F.lit(most)), F.ceil(F.col("parts") / TILES_PER_TASK)).cast("int")
    per_cell = tiles.groupBy("cell").agg(F.max(tasks).alias("tasks"))
    of_anchors = anchors.groupBy("cell").agg(F.max("anchor_parts").alias("anchor_parts"))
    sent = tiles.join(F.broadcast(of_anchors), "cell").withColumn("task", F.pmod("row_part", tasks)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("anchor_parts") - 1)))
    asked = anchors.join(F.broadcast(per_cell), "cell").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    keys = ["cell", "part", "task"]
    # anchors first, so that a task reads each anchor tile once and then its row tiles, one at a time
    both = asked.select(*keys, F.lit(-1).alias("row_part"), F.col("anchors").alias("members")).unionByName(sent.select(*keys, "row_part", "members"))
    # so many tasks whatever the bytes: what takes time is the product, not the reading
    both = both.repartition(max(most, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys).sortWithinPartitions(*keys, "row_part")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Combiner | None = None

        def done() -> pa.RecordBatch:
            anchor, slot, value, ids, rows = now.kept
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (now.row[anchor], slot, value, ids, rows)], ["anchor", "slot", "score", "id", "row"])

        for batch in batches:
            for at in range(batch.num_rows):
                members = batch.column("members")[at].values
                ids, rows, labels, vectors = unpacked(members)
                if batch.column("row_part")[at].as_py() < 0:
                    if now is not None:
                        yield done()
                    limits = members.field("limits").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    now = Combiner(labels, rows, vectors, limits.reshape(len(rows), -1), same, k)
                else:
                    now.add(ids, rows, labels, vectors)
        if now is not None:
            yield done()

    return map_batches(both, ["row_part", "members"], score, "anchor long, slot long, score long, id long, row long")


def best_of(kept: DataFrame, k: int) -> DataFrame:
    """(anchor, slot, best): the best ``k`` (score, id, row) of all tasks' rows of a slot, in order."""
    order = F.struct((-F.col("score")).alias("down"), "id", "row")
    best = F.slice(F.array_sort(F.collect_list(order)), 1, k)
    return kept.groupBy("anchor", "slot").agg(F.transform(best, lambda b: F.struct((-b["down"]).alias("score"), b["id"].alias("id"), b["row"].alias("row"))).alias("best"))


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    label: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    lowest: int = LOWEST,
    highest: int = HIGHEST,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on the rows (id) that ask, ``label`` an expression of (id, label) that replaces the
    label. An anchor's positives are its best other rows of the same label, as many as ``positives``;
    for each, the best ``negatives`` rows of other labels with a score from ``lowest`` to ``highest`` per cent of the positive's.
    A score is the inner product of the vectors' floor(256 x); ties go to the smaller id.

    Defined cases: rows without a label or vector, or with a null or non-finite component, take no part; a row with a
    null id is no anchor and comes last in ties; a shorter vector counts as 0 in what it lacks; rows of
    one id are rows each for itself, as anchors too; scores beyond 9e16 are held there; a positive of
    negative score has no negatives, as its window is empty; an empty table, or one without anchors,
    gives no rows; other columns are ignored. Within, the greatest long stands for a null id.
    """
    base = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    known = stored(usable(base, F.col("label") if label is None else label), "vectors")
    bucket, one_cell = (F.pmod(F.xxhash64("label"), F.lit(n)).cast("int") for n in (LABEL_BUCKETS, 1))
    asking, known = known.where(anchors), known.withColumn("limits", F.lit(None).cast("array<long>"))
    alike = F.array(F.lit(LARGEST_SCORE), F.lit(LOW)).cast("array<long>")
    near = met(tiled(asking.withColumn("limits", alike), bucket, ANCHOR_TILE), tiled(known, bucket, ROW_TILE), True, positives)
    chosen = best_of(near, positives).select("anchor", F.col("best").alias("positives"))
    chosen = cut(chosen.withColumn("upper", F.expr(f"transform(positives, p -> (p.score * {highest} - pmod(p.score * {highest}, 100)) div 100)")).withColumn("slots", F.reverse(F.array_sort(F.array_distinct("upper")))))
    filled = F.concat("slots", F.array_repeat(F.lit(LOW), F.lit(positives) - F.size("slots")))
    least = F.expr(f"array_min(transform(positives, p -> (p.score * {lowest} - pmod(p.score * {lowest}, 100)) div 100))")
    ready = asking.join(chosen.select("anchor", F.concat(filled, F.array(least)).cast("array<long>").alias("limits")), F.col("row") == F.col("anchor")).drop("anchor")
    other = best_of(met(tiled(ready, one_cell, ANCHOR_TILE), tiled(known, one_cell, ROW_TILE), False, negatives), negatives)
    found = other.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "best"))).alias("found"))  # as many as slots
    asked = chosen.join(found, "anchor").select("anchor", "slots", "found", F.explode(F.arrays_zip("positives", "upper")).alias("p"))
    # the suffix of slots from the positive's own downwards
    own = asked.withColumn("slot", F.size(F.filter("slots", lambda s: s > F.col("p.upper"))))
    suffix = F.flatten(F.transform(F.filter("found", lambda f: f["slot"] >= F.col("slot")), lambda f: f["best"]))
    taken = own.select("anchor", F.col("p.positives").alias("positive"), F.slice(suffix, 1, negatives).alias("best"))
    rows_of = taken.select("anchor", "positive", F.posexplode(F.filter("best", lambda b: b["score"] * 100 >= F.col("positive.score") * lowest)).alias("at", "negative"))
    ids = asking.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    none = F.lit(np.iinfo(np.int64).max)
    return rows_of.join(ids, "anchor").select(
        "anchor_id", F.nullif("positive.id", none).alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
        F.nullif("negative.id", none).alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("negative.score").alias("negative_score"),
    )


def oracle() -> str:
    """DuckDB SQL for the registered query's rows: anchors divisible by 50, labels of ids divisible by 7 moved on by one."""
    return f"""
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES})
    SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND {LOWEST} * positive_score <= 100 * score AND 100 * score <= {HIGHEST} * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= {NEGATIVES}"""
