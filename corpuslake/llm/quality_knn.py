"""Quality scores by nearest-neighbour voting among labelled documents in a latent semantic space.

A text's features are hashed counts: its words' shapes, beginnings, ends and hashes of the whole
words, and how it repeats words and lines. A word of over ``PIECE`` characters is cut into pieces
that count as words, so no part of a text goes unread, be there blanks in it or not. Log counts weighed by inverse document frequency are projected on the leading
singular directions of a bounded sample of labelled documents. The sample's latent vectors, of
unit length, are broadcast; each task takes exact cosine products of its documents with all of
them, block by block, and the ``NEIGHBOURS`` most similar vote with their labels, weighed by a
power of their similarity.

Everything that is broadcast or gathered is bounded by ``SAMPLE_ROWS`` labelled rows, ``FEATURES``
hashed features and ``DIMENSIONS`` directions.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .vocab import Memo

SAMPLE_ROWS, FEATURES, DIMENSIONS = 4096, 4096, 64
NEIGHBOURS, POWER, THRESHOLD = 24, 16, 0.3
MARK = 0.1
PIECE = 64
BLOCK = 256
SHAPES = re.compile(r"([A-Z]+)|([a-z]+)|([0-9]+)|([^\x00-\x7f]+)|(.)", re.DOTALL)


class WordFeatures(Memo):
    """Word -> its hashed features, of each piece: its shape, first three and last three characters and all of it, each with its kind."""

    def make(self, word: str) -> tuple[int, ...]:
        places: list[int] = []
        for at in range(0, len(word), PIECE):
            piece = word[at : at + PIECE]
            shape = SHAPES.sub(lambda m: "A" if m[1] else "a" if m[2] else "0" if m[3] else "é" if m[4] else m[5], piece)
            places += (zlib.crc32(f.encode("utf-8", "replace")) % FEATURES for f in (f"shape {shape}", f"start {piece[:3]}", f"end {piece[-3:]}", f"all {piece}"))
        return tuple(places)


def features(text: str, known: WordFeatures) -> tuple[np.ndarray, np.ndarray]:
    """(indices, weights) of a whole text; the words' log counts have length 1, and marks for each tenth of repetition reached and each doubling of length add ``MARK``."""
    words = text.encode().split()
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    places: list[int] = []
    repeats: list[int] = []
    for word, n in counts.items():
        own = known[word.decode("utf-8", "replace")]
        places += own
        repeats += [n] * len(own)
    dense = np.log1p(np.bincount(places, repeats, FEATURES))
    dense /= max(float(np.linalg.norm(dense)), 1.0)
    tenths = {
        "words seen before": len(words) - len(counts),
        "words as before": sum(a == b for a, b in pairwise(words)),
        "lines seen before": len(lines) - len(set(lines)),
    }
    of = {"words seen before": len(words), "words as before": len(words), "lines seen before": len(lines)}
    marks = [f"{name} {t}" for name, n in tenths.items() for t in range(1, 10 * n // max(of[name], 1) + 1)]
    marks += [f"words {t}" for t in range(len(words).bit_length() + 1)]
    for mark in marks:
        dense[zlib.crc32(f"mark {mark}".encode()) % FEATURES] += MARK
    used = np.flatnonzero(dense)
    return used, dense[used]


@dataclass
class Model:
    """Inverse document frequencies, directions, unit vectors of the labelled sample and their labels."""

    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def fit_model(rows: list, seed: int = 42) -> Model:
    """From (label, indices, weights) of the sample: a randomised truncated decomposition of its weighted counts."""
    n = len(rows)
    x = np.zeros((n, FEATURES), np.float32)
    for i, (_, used, weights) in enumerate(rows):
        x[i, used] = weights
    idf = (np.log((1 + n) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rank = max(1, min(DIMENSIONS, n))
    y = x @ np.random.default_rng(seed).standard_normal((FEATURES, rank + 16)).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(y)
        y = x @ (x.T @ q)
    q, _ = np.linalg.qr(y)
    _, _, directions = np.linalg.svd(q.T @ x, full_matrices=False)
    vectors = x @ directions[:rank].T
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Model(idf, np.ascontiguousarray(directions[:rank].T), vectors, np.array([label for label, _, _ in rows], np.float64))


def score_block(model: Model, block: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Votes in [0, 1] for a block of feature rows."""
    x = np.zeros((len(block), FEATURES), np.float32)
    for i, (used, weights) in enumerate(block):
        x[i, used] = weights
    v = (x * model.idf) @ model.directions
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    similar = v @ model.vectors.T
    k = min(NEIGHBOURS, similar.shape[1])
    near = np.argpartition(-similar, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(similar, near, 1).astype(np.float64), 1e-3) ** POWER
    return (weight * model.labels[near]).sum(1) / weight.sum(1)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, seed: int = 42) -> Model:
    """The model of at most ``SAMPLE_ROWS`` labelled rows that aren't held out, of the lowest hashes of their ids.

    Of several labels of an id the lowest counts, of several texts the first in order; ids
    without a document are left out.
    """
    drawn = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("labelled")).agg(F.min("quality").alias("quality"))
    drawn = drawn.orderBy(F.xxhash64(F.lit(seed), "labelled"), "labelled").limit(SAMPLE_ROWS)
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("labelled")).groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordFeatures()
        for batch in batches:
            found = [features(t.as_py() or "", known) for t in batch.column(2)]
            used, weights = pa.array([u for u, _ in found], pa.list_(pa.int32())), pa.array([w for _, w in found], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), used, weights], ["doc_id", "quality", "used", "weights"])

    sample = map_batches(texts, ["doc_id", "quality", "text"], rows, "doc_id long, quality int, used array<int>, weights array<float>").toArrow().sort_by("doc_id")
    return fit_model([(q, np.array(u), np.array(w)) for q, u, w in zip(*(sample.column(c).to_pylist() for c in ("quality", "used", "weights")), strict=True)], seed)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each whole text.

    Defined cases: a null or empty text is scored by its marks alone; a null or repeated doc_id is
    handed through, one row for each row, and a null one isn't held out; with no labelled row
    every score is 0.5; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordFeatures()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if len(shared.value.labels):
                    scores = score_block(shared.value, [features(t.as_py() or "", known) for t in part.column(1)])
                else:
                    scores = np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(scores, 0, 1))], ["doc_id", "score"])

    scored = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id", "text"], rows, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
