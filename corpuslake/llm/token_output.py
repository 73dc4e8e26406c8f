"""Token ids in files: frequency-ranked, byte-aligned variable-length coding with separate control bytes.

Ids are renumbered by how often they occur in the corpus, so that frequent ones take one byte.
Each group of four numbers has one control byte of four 2-bit lengths; the numbers' own bytes lie
in a stream of their own. A file of the format is a Parquet file whose rows are blocks: the
documents of a block and their lengths, its control bytes and its data bytes. Parquet is only the
container, so that the files go to any store that Spark writes to and appear whole or not at all.
A block is decoded with numpy alone: a table gives the four lengths of each control byte, running
sums give the places, and one gather per byte position gives the numbers.

Files are in ascending order of doc_id, and so are the blocks of a file and the documents of a
block. ``start`` of a block counts from its file; what precedes a file is summed over files.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, scratch_path
from .vocab import Memo, broadcast_file, byte_alphabet, once

#: Ids after which a block ends.
BLOCK_IDS = 262_144
CHUNK_CHARS = 4_000_000
#: Bytes of ids that go in a file, before they are coded.
FILE_BYTES = 16 << 20

BLOCKS = "file int, block int, start long, doc_ids array<long>, lengths array<long>, control binary, data binary"


#: The steps of the one kind of tokenizer that is read, in its file's own form.
STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_SPLIT = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


class WordIds(Memo):
    """Word -> ids of the tokenizers library as bytes, for tokenizers whose ids of a text are those of its words in turn.

    That holds where white space is dropped, no rule looks across it, and ASCII letters are
    lower-cased whatever stands beside them; a file with other steps is refused. Added tokens
    are found in the text as it is, so texts that hold one in any case go to the library whole.
    """

    SIZE = 500_000

    def __init__(self, content: bytes, width: int) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        spec = json.loads(content)
        split, bytewise = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])[:2]
        rules = {"normalizers": STEPS, "pattern": WORD_SPLIT, "behavior": "Removed", "invert": True, "add_prefix_space": False, "use_regex": False}
        if any(((spec["normalizer"] or {}) | split | bytewise).get(rule) != value for rule, value in rules.items()) or spec.get("post_processor"):
            raise ValueError("only tokenizers that lower-case and split by words are read")
        if any(t["normalized"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("an added token has matching rules that are not read")
        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width, self.code = width, {2: "H", 4: "I"}[width]
        self.special = [t["content"].lower().encode() for t in spec["added_tokens"]]
        self.model, self.alphabet = self.tokenizer.model, [c for c, _ in sorted(byte_alphabet().items(), key=lambda item: item[1])]

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def make(self, word: bytes) -> bytes:
        if found := PLAIN.fullmatch(text := word.decode()):
            letters, stops = found.groups()
            if letters and stops:
                return self[letters.encode()] + self[stops.encode()]
            # one piece of the split, and composed: the model's own merging is all that is left to do
            piece = text.lower().encode()
            return self.packed([t.id for t in self.model.tokenize("".join(map(self.alphabet.__getitem__, piece)))])
        return self.packed(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def of(self, text: str) -> bytes:
        """The ids of a whole text."""
        raw = text.encode()
        lowered = raw.lower()
        if any(token in lowered for token in self.special):
            return self.packed(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        # of a text beyond ASCII, capitals stay: whether a letter and its mark are composed may hang on the case
        words = lowered if len(raw) == len(text) else raw
        return b"".join(map(self.__getitem__, words.split()))  # of bytes: the six ASCII blanks


#: Letters of one piece that composing leaves as they are, then marks that lie in one piece: no apostrophe, digit or control.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")


def encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, row, ids binary): the ids of each whole text and ``end_id``, as little-endian unsigned numbers of :func:`id_bytes` bytes; ``row`` tells rows apart."""
    file, width = broadcast_file(docs.sparkSession, tokenizer), id_bytes(tokenizer)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = once(hashlib.sha256(file.value).hexdigest(), lambda: WordIds(file.value, width))
        end = words.packed([end_id])
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                start, chars, out = at, 0, []
                while at < batch.num_rows and chars < CHUNK_CHARS:
                    text = batch.column(2)[at].as_py() or ""
                    out.append(words.of(text) + end)
                    chars += len(text)
                    at += 1
                columns = [*(c.slice(start, at - start) for c in batch.columns[:2]), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "ids"])

    docs = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), "text")
    return map_batches(docs, ["doc_id", "row", "text"], rows, "doc_id long, row long, ids binary")


def id_bytes(tokenizer: str) -> int:
    """2 where a tokenizer's ids fit in 16 bits, else 4."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4


def rank_ids(encoded: DataFrame, width: int) -> np.ndarray:
    """All ids that occur, most frequent first; as many as the vocabulary has at most."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                counts = np.bincount(np.frombuffer(ids.as_py(), f"<u{width}"))
                if len(counts) > len(total):
                    counts[: len(total)] += total
                    total = counts
                else:
                    total[: len(counts)] += counts
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    counts = map_batches(encoded, ["ids"], partial, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return np.array([row["id"] for row in counts.orderBy(F.desc("n"), "id").select("id").collect()], np.uint32)


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    numbers = numbers.astype("<u4")
    lengths = 1 + (numbers >= 1 << 8).astype(np.uint8) + (numbers >= 1 << 16) + (numbers >= 1 << 24)
    codes = np.zeros(-(-len(numbers) // 4) * 4, np.uint8)
    codes[: len(numbers)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = numbers.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    return control.tobytes(), data.tobytes()


#: Lengths of the four numbers of each control byte.
LENGTHS = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first ``n`` numbers of the two streams."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    places = np.cumsum(lengths) - lengths
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    numbers = np.zeros(n, np.uint32)
    for i in range(4):
        longer = lengths > i
        numbers[longer] |= padded[places[longer] + i].astype(np.uint32) << np.uint32(8 * i)
    return numbers


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> np.ndarray:
    """Encodes all documents and writes their files to ``path``; returns the ids by rank, which readers need.

    The ids by rank are also written, to ``path``/ranks. The encoded rows are kept in the shared
    folder, so that the texts are read and encoded once.

    Defined cases: a null or empty text is its end id alone; rows without doc_id come first;
    rows of equal doc_id are in the order of a hash of their ids, then of their place in the table; a document longer than a
    block has one of its own; an empty table writes no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    kept = scratch_path(spark, "encoded")
    encode(docs, tokenizer, end_id).write.option("compression", "zstd").parquet(kept)
    encoded = spark.read.schema("doc_id long, row long, ids binary").parquet(kept)
    width = id_bytes(tokenizer)
    ranks = rank_ids(encoded, width)
    rank_of = np.zeros(int(ranks.max()) + 1 if len(ranks) else 1, np.uint32)
    rank_of[ranks] = np.arange(len(ranks), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)  # 4 bytes an id of the vocabulary
    n_bytes = encoded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    files = max(spark.sparkContext.defaultParallelism, n_bytes // FILE_BYTES)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number, start = TaskContext.get().partitionId(), 0, 0
        names, lengths, parts, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal number, start, names, lengths, parts, held
            control, data = pack(np.concatenate(parts))
            row = {"file": file, "block": number, "start": start, "doc_ids": names, "lengths": lengths, "control": control, "data": data}
            number, start = number + 1, start + held
            names, lengths, parts, held = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], SCHEMA)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0), batch.column(1), strict=True):
                parts.append(shared.value[np.frombuffer(ids.as_py(), f"<u{width}")])
                names.append(doc_id.as_py())
                lengths.append(len(parts[-1]))
                held += lengths[-1]
                if held >= BLOCK_IDS:
                    yield block()
        if parts:
            yield block()

    # the row's place parts rows of one doc_id and equal ids, however many there are
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids").asc(), F.col("row").asc()]
    ordered = encoded.repartitionByRange(int(files), *order).sortWithinPartitions(*order).select("doc_id", "ids")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(ranks)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    return ranks


SCHEMA = pa.schema(
    [("file", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())]
)


def read_ids(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): each document as decoded from the files of ``path``.

    ``start`` counts the ids of all documents before it; ``ids`` are little-endian unsigned 32-bit
    numbers, left out on request.
    """
    by_rank = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    shared = spark.sparkContext.broadcast(np.array([row["id"] for row in by_rank], np.uint32))
    stored = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["lengths"], np.int64)
                numbers = shared.value[unpack(row["control"], row["data"], int(sizes.sum()))].astype("<u4")
                ends = np.cumsum(sizes)
                parts = [numbers[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                columns = [
                    pa.array([row["file"]] * len(sizes), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["start"] + ends - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ]
                names = ["file", "doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.binary())] * ids, names + ["ids"] * ids)

    decoded = stored.select("file", "doc_ids", "lengths", "start", "control", "data").mapInArrow(
        documents, "file int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    )
    totals = stored.select("file", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("file").agg(F.sum("n").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("file").alias("numbered"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("passed"))  # a row per file
    joined = decoded.join(starts, F.col("file") == F.col("numbered"))
    return joined.select("doc_id", (F.col("start") + F.col("passed")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))
