r"""Chat formatting: conversations as marked-up texts with the spans that training takes its loss on.

A turn reads ``### role: text</turn>`` and a line feed. What would read as a mark within a role or
text, and the escape itself, has a backslash before it, so the form can be read back exactly:
in texts ``\``, ``### `` and ``</turn>``, in roles the colon too.

Turns are laid out in ranges of (conversation, turn), so a conversation of any length spreads over tasks. A
task takes them batch by batch as columns: lengths of the segments (mark, role, mark, text, mark),
their cumulative offsets, and for each source byte the place that it goes to, as numpy arrays; one
preallocated buffer receives all bytes of the batch, and the offsets of conversations make it an
Arrow column of texts. A conversation that goes on beyond a batch or PIECE_BYTES gives several pieces, in
ascending order of ``piece``; joined in that order they are its text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stored

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
IN_TEXT, IN_ROLE = r"(\\|### |</turn>)", r"(\\|### |</turn>|:)"
TRAINED_ROLE = "assistant"
#: Bytes of a piece beyond which a conversation goes on in the next; a longer turn is a piece of its own.
PIECE_BYTES = 1 << 20
#: Source bytes that are scattered at once (eight bytes of index each), and formatted bytes of a batch.
SLAB, BATCH_BYTES = 1 << 20, 16 << 20

PIECES = "conv_id long, piece long, closed boolean, text string, spans array<struct<start:long,end:long>>, n_turns long"
ESCAPED = re.compile(r"\\(\\|### |</turn>|:)")
ENDS = re.compile(r"\\(?:\\|### |</turn>|:)|</turn>\n")
ROLE_ENDS = re.compile(r"\\(?:\\|### |</turn>|:)|: ")


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the offsets of its values in them."""
    wide = column.cast(pa.large_string())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def scatter(out: np.ndarray, column: pa.Array, to: np.ndarray) -> None:
    """Copies each value of ``column`` to its place ``to`` in ``out``, whatever their lengths, a slab at a time."""
    data, offsets = bytes_of(column)
    shift = to - offsets[:-1]
    for low in range(int(offsets[0]), int(offsets[-1]), SLAB):
        high = min(low + SLAB, int(offsets[-1]))
        first, last = np.searchsorted(offsets, low, "right") - 1, np.searchsorted(offsets, high, "left")
        held = np.diff(np.clip(offsets[first : last + 1], low, high))
        out[np.arange(low, high) + np.repeat(shift[first:last], held)] = data[low:high]


def escaped(column: pa.Array, marks: str) -> pa.Array:
    return pc.replace_substring_regex(column.fill_null(""), marks, r"\\\1")


def formatted(role: pa.Array, text: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """The turns of one batch in one buffer, their offsets in it, their lengths in characters, and where in its turn each text begins and ends, in characters (2 columns)."""
    n = len(role)
    role, text = escaped(role, IN_ROLE), escaped(text, IN_TEXT)
    segments = [pa.repeat(OPEN, n), role, pa.repeat(BETWEEN, n), text, pa.repeat(CLOSE, n)]
    sizes = np.stack([np.diff(bytes_of(s)[1]) for s in segments], 1)
    ends = sizes.ravel().cumsum().reshape(sizes.shape)
    starts = ends - sizes
    buffer = pa.allocate_buffer(int(ends[-1, -1]) if n else 0)
    out = np.frombuffer(buffer, np.uint8)
    for k, segment in enumerate(segments):
        scatter(out, segment, starts[:, k])
    chars = np.stack([pc.utf8_length(s).to_numpy(zero_copy_only=False).astype(np.int64) for s in segments], 1).cumsum(axis=1)
    return buffer, np.r_[0, ends[:, -1]] if n else np.zeros(1, np.int64), chars[:, -1], chars[:, 2:4]


def pieces_of(conv: np.ndarray, offsets: np.ndarray, most: int) -> np.ndarray:
    """First turns of pieces: a conversation's first, and one wherever a piece would grow beyond ``most`` bytes."""
    new = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]]).tolist()
    cuts = []
    for first, last in zip(new, [*new[1:], len(conv)], strict=True):
        while first < last:
            cuts.append(first)
            first = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
    return np.array(cuts)


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts whose texts have about BATCH_BYTES at most."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, first = sizes.cumsum(), 0
    while first < len(sizes):
        before = upto[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(upto, before + BATCH_BYTES, "right")))
        yield batch.slice(first, last - first)
        first = last


def format_conversations(turns: DataFrame, trained_role: str = TRAINED_ROLE, id_col: str = "conv_id", turn_col: str = "turn", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(conv_id, piece, closed, text, spans, n_turns) of turns (conv_id, turn, role, text).

    ``spans`` are those of the texts of ``trained_role`` in the piece, in characters, escapes included.
    ``closed`` is true where the piece is known to be the whole conversation.

    Defined cases: a null text or role is an empty one; a null conv_id is a conversation of its own; a
    null turn comes first; turns of one number are ordered by a hash of role and text; a conversation
    without a trained turn has no spans; a table without rows gives none; other columns are ignored.
    """
    own = F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), own.alias("own"), F.monotonically_increasing_id().alias("row"), "role", "text")
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "own", "row"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # a number that rises from each range to the next
    rows = rows.select("conv_id", F.monotonically_increasing_id().alias("piece"), "role", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, edge = None, None  # the piece held back, and whether it may go on from the range before
        for batch in (p for b in batches for p in parts(b)):
            ids = batch.column("conv_id")
            # null as a number of its own, told from all others by a second one
            conv = np.stack([ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)], 1).astype(np.int64)
            changes = np.r_[0, (conv[1:] != conv[:-1]).any(axis=1).cumsum()] if len(conv) else np.zeros(0, np.int64)
            buffer, offsets, chars, texts = formatted(batch.column("role"), batch.column("text"))
            first = pieces_of(changes, offsets, piece_bytes)
            ends = np.r_[first[1:], len(conv)]
            column = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets[np.r_[first, len(conv)]].astype(np.int64)), buffer])
            before = chars.cumsum() - chars
            of_piece = np.repeat(np.arange(len(first)), ends - first)
            spans = texts + (before - before[first][of_piece])[:, None]
            trained = pc.fill_null(pc.equal(batch.column("role"), trained_role), False).to_numpy(zero_copy_only=False)
            counts = np.r_[0, np.add.reduceat(trained.astype(np.int64), first).cumsum()]
            pairs = pa.StructArray.from_arrays([pa.array(spans[trained, i]) for i in range(2)], ["start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pairs)
            whole = np.bincount(changes[first])[changes[first]] == 1
            taken = pa.array(first)
            rows = pa.RecordBatch.from_arrays([ids.take(taken), batch.column("piece").take(taken), pa.array(whole), column.cast(pa.string()), lists, pa.array(ends - first)], ["conv_id", "piece", "closed", "text", "spans", "n_turns"])
            if last is not None and last.column("conv_id")[0] == rows.column("conv_id")[0] or last is None:
                rows = opened(rows, 0)  # goes on from the piece held back, or may from the range before
                last = None if last is None else opened(last, 0)
            if last is not None:
                yield last
            yield rows.slice(0, rows.num_rows - 1)
            last = rows.slice(rows.num_rows - 1)
        if last is not None:
            yield opened(last, 0)  # may go on in the next range

    return rows.mapInArrow(task, PIECES)


def opened(rows: pa.RecordBatch, at: int) -> pa.RecordBatch:
    """``rows`` with the piece at ``at`` marked as not known to be whole."""
    closed = rows.column("closed").to_numpy(zero_copy_only=False).copy()
    closed[at] = False
    return rows.set_column(rows.schema.get_field_index("closed"), "closed", pa.array(closed))


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted piece."""
    start = 0
    for found in ENDS.finditer(text):
        if found.group() != CLOSE:
            continue
        if not text.startswith(OPEN, start):
            raise ValueError(f"no turn begins at character {start}")
        role_end = next(m for m in ROLE_ENDS.finditer(text, start + len(OPEN)) if m.group() == BETWEEN)
        yield unescaped(text[start + len(OPEN) : role_end.start()]), unescaped(text[role_end.end() : found.start()])
        start = found.end()
    if start != len(text):
        raise ValueError(f"the turn at character {start} does not end")


class Digest:
    """What is told of one conversation, piece by piece."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, text: str, spans: Sequence[dict]) -> None:
        for role, said in read_turns(text):
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
        for span in spans:
            said = unescaped(text[span["start"] : span["end"]])
            self.loss.update(said.encode())
            self.loss_chars += len(said)
        self.formatted_chars += len(text)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from formatted pieces.

    Pieces that are whole are read where they are; those of one conversation meet, in order, one at a time.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, spans in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                digest = Digest()
                digest.add(text.as_py(), spans.as_py())
                rows.append((conv.as_py(), *digest.row()))
            yield batch_of(rows)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            rows = []
            for conv, text, spans in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                if digest is None or conv.as_py() != now:
                    if digest is not None:
                        rows.append((now, *digest.row()))
                    now, digest = conv.as_py(), Digest()
                digest.add(text.as_py(), spans.as_py())
            yield batch_of(rows)
        if digest is not None:
            yield batch_of([(now, *digest.row())])

    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    columns = ["conv_id", "text", "spans"]
    cut = pieces.where(~F.col("closed")).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return map_batches(pieces.where("closed"), columns, whole, out).unionByName(map_batches(cut, columns, joined, out))


def write_conversations(turns: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """:func:`format_conversations`, written as a Parquet table and read again."""
    return stored(format_conversations(turns, piece_bytes=piece_bytes), "chats")


def with_injection(turns: DataFrame, spark: SparkSession) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with a conversation -7 whose texts hold marks of other templates and this one."""
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
