"""SimHash near-duplicate detection by tiled exact comparison.

Distinct fingerprints are laid out in cells by the population counts of their four 16-bit words.
Two fingerprints within ``radius`` bits have cells whose counts differ by ``radius`` in all at
most, so only such pairs of cells are compared; every other pair is skipped unread. A cell is cut
into tiles of about ``TILE`` fingerprints, and a row of the work table is one pair of tiles, which
a task compares with numpy: exclusive-or of all pairs, then bit counts. No pair within the radius
is missed, whatever the data.

For near-duplicates by similarity there are longer fingerprints, of the set of a text's shingles
(:func:`similar_components`): there the population count that tells tiles apart is that of the set
itself, since two sets of a Jaccard similarity of ``s`` or more differ in size by that factor at most.
What lies within a wide radius is a candidate, and the shingle sets of candidates confirm it exactly.
Where a pair of tiles holds few candidates they are listed; where it is crowded, the sets themselves go
along with the tiles, and a task gives only links that it has confirmed and that connect what was not connected.

For op5's fingerprints a pair of tiles yields no list of pairs but the spanning links of what it connects, at most one
per fingerprint. Links are then joined into components by rounds of large-star and small-star
steps, all as Spark joins; nothing is gathered on the driver but the count of changed rows.

The comparisons grow with the square of the number of distinct fingerprints (about one pair in
twenty is compared); see README for figures.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, stored

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Near-duplicates by similarity: words of a shingle, Jaccard similarity, bits of the long fingerprint that may differ, in all and in the first quarter.
SIMILAR_SHINGLE, SIMILARITY, SIMILAR_RADIUS, FIRST_RADIUS = 5, 0.8, 66, 24
#: Sets of up to so many shingles, whose fingerprints are coarse, are also looked for by what is left of each when one shingle is taken out.
SMALL_SET = 8
#: Candidates that a pair of tiles lists, for each of its texts, at most; shingles of the sets that go along with a crowded tile, or a piece of it, about.
FEW, PIECE_SHINGLES = 1, 1 << 19
#: Tiles of long fingerprints are cut by size so that SIZE_STEPS bands make up a factor of SIMILARITY.
SIZE_STEPS = 4
#: Fingerprints of a tile; a pair of tiles takes about TILE * STRIP * 9 bytes to compare.
TILE, LONG_TILE, STRIP = 2048, 8192, 128
#: A distance beyond any other.
FAR = np.uint16(1 << 15)
#: Ids of rows with candidates that are broadcast, at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def fingerprint(text: str, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text, ASCII letters lower-cased: a bit is set if it is in over half the hashes."""
    words = text.encode().lower().split()  # of bytes: the six ASCII spaces, and ASCII letters
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long) of each whole text; fp holds the 64 bits as a signed number, 0 where there is no word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", width, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id", "text"], rows, "doc_id long, fp long")


def shingle_set(text: str, width: int) -> set[bytes]:
    """The shingles of a text, ASCII letters lower-cased; of fewer words the whole sequence."""
    words = text.encode().lower().split()
    if len(words) < width:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def long_fingerprint(text: str, width: int = SIMILAR_SHINGLE, seed: int = SEED) -> tuple[list[int], int, list[int]]:
    """SimHash of the set of a text's shingles, as four signed 64-bit numbers, the size of the set, and for a small set the keys of :func:`small_links`.

    Keys are sums of hashes, modulo 2^64: of the set, then of the set without each of its shingles.
    """
    shingles = shingle_set(text, width)
    if not shingles:
        return [0] * 4, 0, []
    ones = np.zeros(256, np.int64)
    for half in range(2):
        raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s, seed + half) for s in shingles]), np.uint8).reshape(-1, 16)
        for at in range(0, len(raw), 1 << 14):
            ones[128 * half : 128 * half + 128] += np.unpackbits(raw[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    keys: list[int] = []
    if len(shingles) <= SMALL_SET:
        hashes = np.array([xxhash.xxh3_64_intdigest(s, seed) for s in shingles], np.uint64)
        keys = np.r_[hashes.sum(), hashes.sum() - hashes].view(np.int64).tolist()
    return np.packbits(ones * 2 > len(shingles)).view("<i8").tolist(), len(shingles), keys


def long_fingerprints(docs: DataFrame, width: int = SIMILAR_SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, f0 to f3 long, size, keys) of each whole text; all zero where there is no word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [long_fingerprint(t.as_py() or "", width, seed) for t in batch.column(1)]
            parts = [pa.array([f[0][i] for f in found], pa.int64()) for i in range(4)]
            more = [pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *parts, *more], ["doc_id", "f0", "f1", "f2", "f3", "size", "keys"])

    return map_batches(docs.select("doc_id", "text"), ["doc_id", "text"], rows, "doc_id long, f0 long, f1 long, f2 long, f3 long, size long, keys array<long>")


def tile_links(ids: np.ndarray, a: np.ndarray, other_ids: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links of the pairs within the radius between two tiles of different fingerprints (or within one, if their ids are the same)."""
    same = np.array_equal(ids, other_ids)
    a, b = a[:, 0], b[:, 0]
    nodes = ids if same else np.concatenate([ids, other_ids])
    labels, shift, links = np.arange(len(nodes)), 0 if same else len(ids), []
    for at in range(0, len(a), STRIP):
        close = np.bitwise_count(a[at : at + STRIP, None] ^ b[None, :]) <= radius
        if same:
            close[np.arange(len(close)), at + np.arange(len(close))] = False
        for i in np.flatnonzero(close.any(axis=1)).tolist():
            others = np.flatnonzero(close[i]) + shift
            own = labels[at + i]
            found, where = np.unique(labels[others], return_index=True)
            for label, j in zip(found.tolist(), others[where].tolist(), strict=True):
                if label != own:
                    labels[labels == label] = own
                    links.append((int(nodes[at + i]), int(nodes[j])))
    return links


class Tile:
    """One tile of long fingerprints: nodes, the components that they are in so far, sizes of their sets, fingerprints (4 columns), and the sets as sorted hashes where they are needed."""

    def __init__(self, nodes: np.ndarray, labels: np.ndarray, sizes: np.ndarray, prints: np.ndarray, sets: list[np.ndarray] | None = None) -> None:
        order = np.argsort(nodes)  # so that nothing hangs on the order of a shuffle
        self.nodes, self.labels, self.sizes, self.prints = nodes[order], labels[order], sizes[order], prints[order]
        self.sets = None if sets is None else [sets[i] for i in order.tolist()]


def open_pairs(one: Tile, other: Tile, same: bool, radius: int, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """Strips (first row, distances) of the pairs of two tiles within the radius; FAR stands for all others, and for those whose sizes do not allow the similarity or which one component holds."""
    a, b = one.prints, other.prints
    for at in range(0, len(a), STRIP):
        d = distances(a[at : at + STRIP], b, radius)
        if d is None:
            continue
        mine, theirs = one.sizes[at : at + STRIP, None], other.sizes
        out = (d > radius) | (one.labels[at : at + STRIP, None] == other.labels) | (np.minimum(mine, theirs) < similarity * np.maximum(mine, theirs))
        if same:
            out |= np.arange(at, at + len(d))[:, None] >= np.arange(len(b))
        d[out] = FAR
        yield at, d


def tile_candidates(one: Tile, other: Tile, same: bool, radius: int, similarity: float, most: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Pairs of nodes to confirm, of those within the radius between two tiles; if they are more than ``most``, none, but the nodes that are in such pairs."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    count, in_one, in_other = 0, np.zeros(len(one.nodes), bool), np.zeros(len(other.nodes), bool)
    for at, d in open_pairs(one, other, same, radius, similarity):
        i, j = np.nonzero(d <= radius)
        count += len(i)
        in_one[i + at] = in_other[j] = True
        if count <= most:
            kept.append((one.nodes[i + at], other.nodes[j]))
    if count > most:
        return [], np.union1d(one.nodes[in_one], other.nodes[in_other]).tolist()
    return [pair for i, j in kept for pair in zip(i.tolist(), j.tolist(), strict=True)], []


def tile_confirmed(one: Tile, other: Tile, same: bool, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links between two tiles that hold their sets: pairs within the radius whose sets have the similarity, as many as connect what such pairs connect."""
    names, labels = np.unique(np.r_[one.labels, other.labels], return_inverse=True)
    root, links = np.arange(len(names)), []
    mine, theirs = labels[: len(one.labels)], labels[len(one.labels) :]
    held, ends = np.concatenate(other.sets), np.r_[0, np.cumsum([len(x) for x in other.sets])]
    known, codes = np.unique(held, return_inverse=True)
    sizes = np.diff(ends)
    for at, d in open_pairs(one, other, same, radius, similarity):
        for i in np.flatnonzero((d <= radius).any(axis=1)).tolist():
            own = root[mine[at + i]]
            others = np.flatnonzero((d[i] <= radius) & (root[theirs] != own))
            if not len(others):
                continue
            mark, hashes = np.zeros(len(known), bool), one.sets[at + i]
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            mark[place[known[place] == hashes]] = True
            upto = np.r_[0, mark[codes].cumsum()]
            shared = upto[ends[others + 1]] - upto[ends[others]]
            near = others[shared >= similarity * (len(hashes) + sizes[others] - shared)]
            for label, k in zip(*np.unique(root[theirs[near]], return_index=True), strict=True):
                root[root == label] = own
                links.append((int(one.nodes[at + i]), int(other.nodes[near[k]])))
    return links


def distances(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray | None:
    """Differing bits of each pair of two arrays of long fingerprints; FAR where the first 64 bits differ in more than FIRST_RADIUS. None where few are near and none within the radius."""
    close = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]) <= FIRST_RADIUS
    i, j = np.nonzero(close)
    if len(i) * 8 < close.size:
        near = np.bitwise_count(a[i] ^ b[j]).sum(axis=1, dtype=np.uint16)
        if not len(near) or near.min() > radius:
            return None
        d = np.full(close.shape, FAR)
        d[i, j] = near
        return d
    d = sum(np.bitwise_count(a[:, None, k] ^ b[None, :, k]).astype(np.uint16) for k in range(a.shape[1]))
    d[~close] = FAR
    return d


def cell_of(fp: Column) -> Column:
    """The four population counts as one number, base 32."""
    word = [F.bit_count(F.shiftrightunsigned(fp, 48 - 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    return word[0] * 32768 + word[1] * 1024 + word[2] * 32 + word[3]


def neighbour_steps(radius: int) -> list[int]:
    """Differences between cell numbers whose counts differ by ``radius`` at most, each unordered pair once."""
    near = range(-radius, radius + 1)
    steps = [(a, b, c, d) for a in near for b in near for c in near for d in near if abs(a) + abs(b) + abs(c) + abs(d) <= radius]
    return [a * 32768 + b * 1024 + c * 32 + d for a, b, c, d in steps if (a, b, c, d) >= (0, 0, 0, 0)]


def tiled_links(placed: DataFrame, fps: Sequence[str], steps: Sequence[int], radius: int, tile: int, found_in: Callable) -> DataFrame:
    """(src, dst): what ``found_in`` finds in pairs of tiles of (node, fps, cell) whose cells differ by one of ``steps``, each unordered pair of cells once.

    A row of the work table is a pair of tiles, joined by the one tile's own number: a crowded
    cell, whatever its share of all rows, is so many tiles of their own.
    """
    # a row per cell: of 17^4 cells, or the bands of a logarithm, at most
    cells = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts"))
    tiles = placed.join(F.broadcast(cells), "cell").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    members = tiles.groupBy("cell", "part").agg(F.collect_list(F.struct("node", *fps)).alias("members"))
    tiles = cut(members.select("cell", "part", *(F.col(f"members.{c}").alias(c) for c in ("node", *fps))))
    mine = ["node", *fps]
    theirs = [f"other_{c}" for c in mine]
    sent = tiles.withColumn("other", F.explode(F.transform(F.array(*map(F.lit, steps)), lambda step: F.col("cell") + step)))
    sent = sent.join(F.broadcast(cells.select(F.col("cell").alias("other"), "parts")), "other")
    sent = sent.withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where((F.col("cell") < F.col("other")) | (F.col("part") <= F.col("other_part")))
    met = tiles.select(F.col("cell").alias("other"), F.col("part").alias("other_part"), *(F.col(c).alias(o) for c, o in zip(mine, theirs, strict=True)))
    pairs = sent.join(met, ["other", "other_part"]).select(*mine, *theirs)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in range(batch.num_rows):
                at = [column[row].values.to_numpy() for column in batch.columns]
                # by number, so that which of equals is taken does not hang on the order of a shuffle
                orders = [np.argsort(at[0]), np.argsort(at[len(mine)])]
                at = [c[orders[i >= len(mine)]] for i, c in enumerate(at)]
                a, b = (np.stack(side, 1).view(np.uint64) for side in (at[1 : len(mine)], at[len(mine) + 1 :]))
                found += found_in(at[0], a, at[len(mine)], b, radius)
            yield pa.RecordBatch.from_arrays([pa.array([link[i] for link in found], pa.int64()) for i in range(2)], ["src", "dst"])

    return pairs.mapInArrow(compare, "src long, dst long")


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(src, dst): links that connect all fingerprints (column fp, distinct) within the radius of one another."""
    return tiled_links(distinct.select(F.col("fp").alias("node"), "fp", cell_of(F.col("fp")).alias("cell")), ["fp"], neighbour_steps(radius), radius, TILE, tile_links)


PAIR = ["cell", "part", "other", "other_part"]


def similar_tiles(distinct: DataFrame, similarity: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, f0 to f3, size) with the tile (cell, part) that they are in, by size, and the pairs of tiles whose sizes allow the similarity, each once."""
    band = F.floor(F.log(F.greatest("size", F.lit(1))) * (SIZE_STEPS / -math.log(similarity))).cast("int")
    placed = distinct.select("node", "size", *(f"f{i}" for i in range(4)), band.alias("cell"))
    cells = cut(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts")))  # a row for each band of a logarithm
    nodes = placed.join(F.broadcast(cells), "cell").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts")
    upper = cells.select(F.col("cell").alias("other"), F.col("parts").alias("other_parts"))
    pairs = cells.withColumn("other", F.explode(F.transform(F.array(*map(F.lit, range(SIZE_STEPS + 1))), lambda step: F.col("cell") + step))).join(F.broadcast(upper), "other")
    pairs = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.withColumn("other_part", F.explode(F.sequence(F.when(F.col("cell") == F.col("other"), F.col("part")).otherwise(0), F.col("other_parts") - 1)))
    return cut(nodes), pairs.select(*PAIR)


NODE = ["node", "label", "size", *(f"f{i}" for i in range(4))]


def tile_of(members: pa.Scalar) -> Tile:
    """A tile from the list of its members, NODE and, where there are any, ``hashes``."""
    at = [members.values.field(c).to_numpy() for c in NODE]
    fields = [members.values.type.field(i).name for i in range(members.values.type.num_fields)]
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in members.values.field("hashes")] if "hashes" in fields else None
    return Tile(at[0], at[1], at[2], np.stack(at[3:], 1).view(np.uint64), sets)


def compared(nodes: DataFrame, pairs: DataFrame, radius: int, similarity: float, few: int = FEW) -> DataFrame:
    """A stored table of candidates (src, dst) from the pairs of tiles (PAIR), and a row with PAIR for each pair of tiles that has too many, with the nodes (``crowd``) that they are of.

    ``nodes`` is (NODE, cell, part).
    """
    wanted = pairs.select("cell", "part").union(pairs.select("other", "other_part")).distinct()
    members = nodes.join(wanted, ["cell", "part"], "left_semi").groupBy("cell", "part").agg(F.collect_list(F.struct(*NODE)).alias("members"))
    tiles = cut(members)
    met = tiles.select(F.col("cell").alias("other"), F.col("part").alias("other_part"), F.col("members").alias("others"))
    work = pairs.join(tiles, ["cell", "part"]).join(met, ["other", "other_part"]).select(*PAIR, "members", "others")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = [batch.column(c)[row].as_py() for c in PAIR]
                one, other = tile_of(batch.column("members")[row]), tile_of(batch.column("others")[row])
                links, crowd = tile_candidates(one, other, at[:2] == at[2:], radius, similarity, few * (len(one.nodes) + len(other.nodes)))
                src, dst = ([None] if crowd else [link[i] for link in links] for i in range(2))
                left = [[x] if crowd else [None] * len(links) for x in at]
                held = pa.array([crowd] if crowd else [None] * len(links), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), *(pa.array(x, pa.int32()) for x in left), held], ["src", "dst", *PAIR, "crowd"])

    return stored(work.mapInArrow(compare, "src long, dst long, cell int, part int, other int, other_part int, crowd array<long>"), "candidates")


def in_crowds(nodes: DataFrame, crowded: DataFrame) -> DataFrame:
    """The nodes that candidates of crowded pairs of tiles are of."""
    return cut(nodes.join(crowded.select(F.explode("crowd").alias("in_crowd")).distinct(), F.col("node") == F.col("in_crowd"), "left_semi"))


def shingle_hashes(texts: DataFrame, width: int) -> DataFrame:
    """(row, hashes): the sorted 64-bit hashes of each text's shingles, as bytes."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.fromiter((xxhash.xxh3_64_intdigest(x) for x in shingle_set(t.as_py() or "", width)), np.uint64)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["row", "hashes"])

    return texts.select("row", "text").mapInArrow(hashed, "row long, hashes binary")


def crowded_links(nodes: DataFrame, pairs: DataFrame, texts: DataFrame, width: int, radius: int, similarity: float, piece: int) -> DataFrame:
    """(src, dst): confirmed links from crowded pairs of tiles (PAIR), which are compared in pieces that hold about ``piece`` shingles each."""
    wanted = pairs.select("cell", "part").union(pairs.select("other", "other_part")).distinct()
    mine = cut(nodes.join(wanted, ["cell", "part"], "left_semi"))
    sizes = cut(mine.groupBy("cell", "part").agg(F.ceil(F.sum("size") / piece).cast("int").alias("pieces")))
    ids = mine.select(F.col("node").alias("wanted"))
    sets = shingle_hashes(texts.join(ids, F.col("row") == F.col("wanted"), "left_semi"), width)
    held = mine.join(sets, F.col("node") == F.col("row")).join(sizes, ["cell", "part"]).withColumn("piece", F.pmod(F.xxhash64("node", F.lit(1)), F.greatest("pieces", F.lit(1))).cast("int"))
    tiles = stored(held.groupBy("cell", "part", "piece").agg(F.collect_list(F.struct(*NODE, "hashes")).alias("members")), "crowds")
    met = tiles.select(F.col("cell").alias("other"), F.col("part").alias("other_part"), F.col("piece").alias("other_piece"), F.col("members").alias("others"))
    same = (F.col("cell") == F.col("other")) & (F.col("part") == F.col("other_part"))
    theirs = sizes.select(F.col("cell").alias("other"), F.col("part").alias("other_part"), F.col("pieces").alias("other_pieces"))
    cuts = pairs.join(sizes, ["cell", "part"]).join(theirs, ["other", "other_part"])
    cuts = cuts.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest("pieces", F.lit(1)) - 1))).withColumn("other_piece", F.explode(F.sequence(F.lit(0), F.greatest("other_pieces", F.lit(1)) - 1)))
    cuts = cuts.where(~same | (F.col("piece") <= F.col("other_piece"))).select(*PAIR, "piece", "other_piece")
    work = cuts.repartition(*PAIR, "piece", "other_piece").join(tiles, ["cell", "part", "piece"]).join(met, ["other", "other_part", "other_piece"]).select((same & (F.col("piece") == F.col("other_piece"))).alias("same"), "members", "others")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                links = tile_confirmed(tile_of(batch.column("members")[row]), tile_of(batch.column("others")[row]), batch.column("same")[row].as_py(), radius, similarity)
                yield pa.RecordBatch.from_arrays([pa.array([link[i] for link in links], pa.int64()) for i in range(2)], ["src", "dst"])

    return work.mapInArrow(confirm, "src long, dst long")


def small_links(distinct: DataFrame) -> DataFrame:
    """(src, dst): small sets one of which is the other without one shingle, by keys (see :func:`long_fingerprint`)."""
    whole = distinct.where((F.col("size") > 0) & (F.col("size") < SMALL_SET)).select(F.col("keys")[0].alias("key"), F.col("node").alias("src"))
    less = distinct.where(F.size("keys") > 2).select(F.explode(F.slice("keys", 2, SMALL_SET)).alias("key"), F.col("node").alias("dst"))
    return less.join(whole, "key").where("src <> dst").select("src", "dst")


def similar_components(distinct: DataFrame, texts: DataFrame, width: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, radius: int = SIMILAR_RADIUS, tile: int = LONG_TILE, few: int = FEW, piece: int = PIECE_SHINGLES) -> DataFrame:
    """(node, component) of nodes (node, f0 to f3, size, keys; different fingerprints) that links connect to another; see :func:`components`.

    A link is a pair within the radius whose texts (row, text) have shingle sets of that similarity or
    more. Every pair within the radius is confirmed or refused, unless its texts are connected by then:
    those of uncrowded pairs of tiles first; then crowded tiles, each with itself and the next of its size;
    then, of the other crowded pairs, what these have not connected.
    """
    nodes, pairs = similar_tiles(distinct, similarity, tile)

    def labelled(nodes: DataFrame, linked: DataFrame) -> DataFrame:
        own = linked.select(F.col("node").alias("linked"), "component")
        return nodes.join(own, F.col("node") == F.col("linked"), "left").withColumn("label", F.coalesce("component", "node")).drop("linked", "component")

    def joined(linked: DataFrame, links: DataFrame) -> DataFrame:
        return components(links.unionByName(linked.select(F.col("node").alias("src"), F.col("component").alias("dst"))))

    found = compared(nodes.withColumn("label", F.col("node")), pairs, radius, similarity, few)
    listed = found.where("src is not null").select("src", "dst").unionByName(small_links(distinct))
    linked = components(confirmed(listed, texts, width, similarity))
    crowded = found.where("src is null").select(*PAIR, "crowd")
    if crowded.isEmpty():
        return linked
    nodes = in_crowds(nodes, crowded)
    beside = (F.col("cell") == F.col("other")) & (F.col("other_part") - F.col("part") <= 1)
    for first in (True, False):
        left = crowded.where(beside == first)
        if left.isEmpty():
            continue
        if not first:
            again = compared(labelled(nodes, linked), left.select(*PAIR), radius, similarity, few)
            linked = joined(linked, confirmed(again.where("src is not null").select("src", "dst"), texts, width, similarity))
            left = again.where("src is null").select(*PAIR, "crowd")
            if left.isEmpty():
                continue
            nodes = in_crowds(nodes, left)
        linked = joined(linked, crowded_links(labelled(nodes, linked), left.select(*PAIR), texts, width, radius, similarity, piece))
    return linked


def confirmed(links: DataFrame, texts: DataFrame, width: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The links (src, dst) whose texts (row, text) have shingle sets of that Jaccard similarity or more."""
    links = cut(links.distinct())
    ids = cut(links.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    linked = texts.join(F.broadcast(ids) if few else ids, F.col("row") == F.col("node"), "left_semi")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(side.as_buffer(), np.uint64) for side in (x, y))
                shared = len(np.intersect1d(a, b, assume_unique=True))
                kept.append(shared >= similarity * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["src", "dst"]).filter(pa.array(kept, pa.bool_()))

    sets = shingle_hashes(linked, width)
    one = links.join(sets.select(F.col("row").alias("src"), F.col("hashes").alias("a")), "src")
    both = one.join(sets.select(F.col("row").alias("dst"), F.col("hashes").alias("b")), "dst")
    return both.select("src", "dst", "a", "b").mapInArrow(similar, "src long, dst long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): each linked node with the smallest node that it is connected to.

    Rounds of two steps over links (u, v), u > v. Large-star: what is above u and next to it links
    to the smallest around u. Small-star: what is below u links to the smallest below it. Both keep
    connectivity, and when a round changes nothing each component is a star around its least node.
    """
    links = cut(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = cut(small.where("u <> v").distinct())
        now = links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == mark:
            break
        mark = now
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; a
    text of fewer words than a shingle is one shingle; whole texts are read whatever their length;
    rows with a repeated doc_id each give a row; a null doc_id is never a component's id unless
    the component has no other, then that is null; an empty table gives no rows; other columns
    are ignored.
    """
    prints = cut(fingerprints(docs, width, seed))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(near_links(distinct, radius))
    known = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    names = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = known.join(names, "component").select(F.col("fp").alias("print"), "component_id")
    return prints.join(named, F.col("fp") == F.col("print")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, width: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, radius: int = SIMILAR_RADIUS, seed: int = SEED) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest doc_id, columns unchanged.

    Two texts are linked if their sets of ``width``-word shingles have a Jaccard similarity of
    ``similarity`` or more; groups are what links connect. Candidates are those whose 256-bit
    fingerprints differ in at most ``radius`` bits (and the first 64 in FIRST_RADIUS), and small sets
    that differ by one shingle; all of them are confirmed but those that others have connected.

    Defined cases: rows are told apart by their place, so null and repeated doc_ids lose no group
    (null comes last; of equal ids the first stored stays); null, empty and blank texts are one
    group; an empty table gives no rows.
    """
    names = [f"col_{i}" for i in range(len(docs.columns))]
    placed = docs.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)), F.monotonically_increasing_id().alias("row"))
    placed = stored(placed, "dedup")
    text, doc_id = (names[docs.columns.index(c)] for c in ("text", "doc_id"))
    fps = [f"f{i}" for i in range(4)]
    prints = cut(long_fingerprints(placed.select(F.col("row").alias("doc_id"), F.col(text).alias("text")), width, seed).withColumnRenamed("doc_id", "row"))
    distinct = cut(prints.groupBy(*fps).agg(F.min("row").alias("node"), F.min("size").alias("size"), F.min("keys").alias("keys")))
    texts = placed.select("row", F.col(text).alias("text"))
    linked = similar_components(distinct, texts, width, similarity, radius)
    known = distinct.join(linked.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select(*fps, F.coalesce("component", "node").alias("component"))
    ids = placed.select(F.col("row").alias("at"), F.col(doc_id).cast("long").alias("id"))
    # per fingerprint, then per group: no group meets in one task
    best = prints.join(ids, F.col("row") == F.col("at")).groupBy(*fps).agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    first = best.join(known, fps).groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("kept"))
    left = placed.join(first, F.col("row") == F.col("kept"), "left_semi")
    return left.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
