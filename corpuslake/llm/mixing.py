"""Mixing sources to target weights by balanced sampling with the cube method.

Each source's target is its share of all words by weight, at most ``CAP`` times the words it has,
with the excess reshared by weight. A document is taken ``floor(target / size of its source)``
times whole, and once more with the remaining probability. Those draws are balanced: within a
source, the cube method moves the vector of inclusion probabilities along directions that leave
two totals unchanged, the words and the documents expected, until only a few probabilities
lie strictly between 0 and 1. With two totals a direction needs three documents, and is the cross
product of their two rows of constraints.

The flight runs in blocks of documents dealt by a hash; what each block leaves undecided (two
documents at most) meets in larger strides in the next round, until a source has one block left,
whose last few documents land by one seeded draw each. A document's result depends on the table
and the seed alone.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import copy_numbers, cut, stored, word_count

WEIGHTS, CAP = (5, 2, 1), 3
#: Documents of a block, about.
BLOCK_ROWS = 1024
#: Sources up to which their table of a row each is broadcast.
BROADCAST_SOURCES = 50_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source throughout, which its running sums take in one task.

    Sources by code point, null last, have the weights in turn. A source is held at its cap if the
    even level of those before it in order of cap to weight exceeds its own ratio of the two.
    """
    numbered = sizes.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("at") % len(weights) + 1).cast("int"))
    weighed = numbered.withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("w"), "at")
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    levelled = weighed.withColumn("level", level).withColumn("held", F.col("level") * F.col("w") >= F.col("most"))
    # the first source that isn't held sets the level of all from there on
    common = F.min_by(F.when(~F.col("held"), F.col("level")), F.when(~F.col("held"), F.struct(F.col("most") / F.col("w"), F.col("at")))).over(Window.partitionBy())
    target = F.when(F.col("held"), F.col("most")).otherwise(F.least(common * F.col("w"), F.col("most")))
    return levelled.withColumn("target", target).select("source", "source_size", "target")


def flight(sizes: list[float], chances: list[float]) -> list[float]:
    """Inclusion probabilities moved until at most two lie strictly between 0 and 1, with their sum and their sum weighed by size kept."""
    eps, out, free = 1e-9, list(chances), []
    for i, p in enumerate(out):
        if eps < p < 1 - eps:
            free.append(i)
        if len(free) < 3:
            continue
        a, b, c = free
        u = [sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a]]
        if not any(u):
            u = [1.0, -1.0, 0.0]  # equal sizes: any direction of sum zero
        step = math.inf
        for x, d in zip(free, u, strict=True):
            if d > 0:
                step = min(step, (1 - out[x]) / d)
            elif d < 0:
                step = min(step, out[x] / -d)
        for x, d in zip(free, u, strict=True):
            moved = out[x] + step * d
            out[x] = 0.0 if moved <= eps else 1.0 if moved >= 1 - eps else moved
        free = [x for x in free if 0 < out[x] < 1]
    return out


def cube_round(rows: DataFrame, land: bool, seed: int) -> DataFrame:
    """One flight in each (source, block); on landing, what is left is drawn by the seed."""

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        # largest first, so that what is left undecided is small
        pdf = pdf.sort_values(["size", "hash", "doc_id"], ascending=[False, True, True], kind="stable", na_position="first").reset_index(drop=True)
        chances = flight(pdf["size"].astype(float).tolist(), pdf["chance"].tolist())
        if land:
            # the fewest draws: of what remains, one after another keeps the expected count
            key = f"{seed}:{pdf['source'][0]}:{len(pdf)}".encode()
            rng, carry = random.Random(hashlib.sha256(key).digest()), 0.0
            point = rng.random()
            for i, p in enumerate(chances):
                if 0 < p < 1:
                    chances[i] = float(math.floor(carry + p + point) > math.floor(carry + point))
                    carry += p
        pdf["chance"] = chances
        return pdf

    return rows.groupBy("source", "block").applyInPandas(fly, rows.schema)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, seed: int = 42, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, source, size (words), source_size, target, copies, taken (copies times size), then ``carry``.

    Defined cases: a null or empty text has size 0 and follows its source's draw, adding no words;
    a null source is a source; a source without words has target 0 and no copies; rows with a null
    or repeated doc_id are drawn each for itself; an empty table gives no rows; other columns are
    ignored unless carried.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("hash"), *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "mix")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = source_targets(sizes.select("source", "source_size"), weights, cap)
    sources = cut(targets.join(sizes.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))  # a row per source
    most, n_sources = sources.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per_source = sources.select(F.col("source").alias("s"), "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("chance"), F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks"))
    if n_sources <= BROADCAST_SOURCES:
        per_source = F.broadcast(per_source)
    placed = rows.join(per_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    kept = ["row", "doc_id", "source", "size", "hash", "chance"]
    undecided = placed.where("chance > 0 and chance < 1").select(*kept, "blocks")
    numbered = copy_numbers(undecided, ["hash", "source"])
    if numbered is not None:  # rows alike would have one hash and meet in one block
        undecided = numbered.withColumn("hash", F.when(F.col("copy") > 0, F.xxhash64("hash", "copy")).otherwise(F.col("hash"))).drop("copy")
    undecided = undecided.withColumn("block", F.pmod("hash", "blocks")).drop("blocks")
    decided = None
    while True:
        last = most <= BLOCK_ROWS
        flown = cut(cube_round(undecided, last, seed))
        done = flown.where("chance = 0 or chance = 1").select(F.col("row").alias("drawn"), F.col("chance").cast("int").alias("extra"))
        decided = done if decided is None else decided.unionByName(done)
        if last:
            break
        # at most two are left of each block; blocks of the next round hold those of BLOCK_ROWS / 2 blocks
        most = 2 * math.ceil(most / BLOCK_ROWS)
        fewer = math.ceil(most / BLOCK_ROWS)
        undecided = flown.where("chance > 0 and chance < 1").withColumn("block", F.pmod("block", F.lit(fewer)))
    copies = (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("int")
    drawn = placed.join(decided, F.col("row") == F.col("drawn"), "left").withColumn("copies", copies)
    return drawn.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *(F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)))


def repeated(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, seed: int = 42) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, columns unchanged."""
    names = [f"col_{i}" for i in range(len(docs.columns))]
    mixed = mix(docs.select(*docs.columns, *(F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True))), weights, cap, seed, names)
    rows = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
