"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

One pass counts the pre-tokenised words of the whole corpus (partial counts in each task, summed
by Spark). The most frequent ones, ``LEXICON_WORDS`` at most, are compiled with their ids into an
acyclic automaton whose equal suffixes are shared: the arcs of a word's path add up to the word's
number, and that number indexes its ids. The automaton is a flat file that the workers of an
executor map into memory together. Words that it lacks are merged exactly by rank.

Each worker remembers what it looked up lately; the lexicon's and the memo's size bear on speed
only, never on the ids.
"""

from __future__ import annotations

import hashlib
import heapq
import mmap
import os
import re
import struct
import tempfile
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored
from .vocab import ID_BITS, ByteLevelBpe, Memo, broadcast_file, once

LEXICON_WORDS = 65_536
#: Distinct stretches that a counting task holds before it hands its counts on.
COUNTED_WORDS = 200_000
#: Longer words are neither counted nor looked up.
LONGEST_WORD = 64
ID_MASK = (1 << ID_BITS) - 1
NO_MERGE = 1 << 62
#: Rows of output are handed on after about so many characters.
CHUNK_CHARS = 4_000_000

#: Fixed value: the pattern that byte-level BPE splits text by before it merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space and what follows it up to the next: no match of SPLIT crosses the end of one.
STRETCH = r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|\s+"


def merged(word: bytes, bpe: ByteLevelBpe) -> list[int]:
    """The ids of a word after all merges, lowest rank first and leftmost among equals."""
    ids, get = [bpe.byte_ids[b] for b in word], bpe.merges.get
    if len(ids) > LONGEST_WORD:
        return merged_long(ids, bpe.merges)
    pairs = [get(a << ID_BITS | b, NO_MERGE) for a, b in pairwise(ids)]
    while pairs:
        least = min(pairs)
        if least == NO_MERGE:
            break
        i = pairs.index(least)
        ids[i] = new = least & ID_MASK
        del ids[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(new << ID_BITS | ids[i + 1], NO_MERGE)
        if i:
            pairs[i - 1] = get(ids[i - 1] << ID_BITS | new, NO_MERGE)
    return ids


def merged_long(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """:func:`merged` for words of any length, by a heap over a linked list."""
    n = len(symbols)
    ids, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(found, i) for i in range(n - 1) if (found := merges.get(ids[i] << ID_BITS | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        merge, i = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j >= n or merges.get(ids[i] << ID_BITS | ids[j]) != merge:
            continue  # one of the two has been merged since
        ids[i], ids[j] = merge & ID_MASK, -1
        after[i] = k = after[j]
        h = before[i]
        if k < n:
            before[k] = i
            if (found := merges.get(ids[i] << ID_BITS | ids[k])) is not None:
                heapq.heappush(heap, (found, i))
        if h >= 0 and (found := merges.get(ids[h] << ID_BITS | ids[i])) is not None:
            heapq.heappush(heap, (found, h))
    return [x for x in ids if x >= 0]


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The automaton of sorted, distinct words as one flat buffer.

    Words go in sorted order, so once a word leaves a branch the branch is final: its states are
    then replaced by equal ones that are already registered, deepest first.
    """
    registry: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # of the last word: [is a word's end, [(label, state), ...]] by depth
    last, starts, ids = b"", array("I", [0]), array("I")

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            end, arcs = path.pop()
            key = (end, tuple(arcs))
            if key not in registry:
                registry[key] = len(states)
                states.append(key)
            path[-1][1].append((last[len(path) - 1], registry[key]))

    for word, word_ids in entries:
        shared = len(os.path.commonprefix([last, word]))
        close(shared)
        path.extend([False, []] for _ in range(len(word) - shared))
        path[-1][0] = True
        last = word
        ids.extend(word_ids)
        starts.append(len(ids))
    close(0)
    states.append((path[0][0], tuple(path[0][1])))

    below: list[int] = []  # words reachable from a state; children are registered before parents
    first, labels, targets, skips = array("I"), bytearray(), array("I"), array("I")
    for end, arcs in states:
        first.append(len(targets))
        passed = int(end)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            skips.append(passed)
            passed += below[target]
        below.append(passed)
    first.append(len(targets))
    ends = bytes(end for end, _ in states)
    parts = [first.tobytes(), targets.tobytes(), skips.tobytes(), starts.tobytes(), ids.tobytes(), bytes(labels), ends]
    return struct.pack("<7I", *map(len, parts)) + b"".join(parts)


def holds(path: str, content: bytes) -> bool:
    """Whether a file is there and has the content; one that was cut short or altered is written anew."""
    try:
        with open(path, "rb") as f:
            return f.read(len(content) + 1) == content
    except OSError:
        return False


class Lexicon:
    """A compiled lexicon, mapped from a file of its own content's name in the worker's temporary folder."""

    def __init__(self, content: bytes) -> None:
        path = os.path.join(tempfile.gettempdir(), f"lexicon-{hashlib.sha256(content).hexdigest()[:24]}")
        if not holds(path, content):
            with tempfile.NamedTemporaryFile(dir=tempfile.gettempdir(), delete=False) as out:
                out.write(content)
            os.replace(out.name, path)
        with open(path, "rb") as f:
            view = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        sizes, at, parts = struct.unpack_from("<7I", view), 28, []
        for n in sizes:
            parts.append(view[at : at + n])
            at += n
        self.first, self.targets, self.skips, self.starts, self.ids = (p.cast("I") for p in parts[:5])
        self.labels, self.ends = parts[5:]
        self.root = len(self.ends) - 1

    def find(self, word: bytes) -> list[int] | None:
        """The ids of a word, or None where the lexicon lacks it."""
        state, number, first, labels, skips, targets = self.root, 0, self.first, self.labels, self.skips, self.targets
        for b in word:
            end = first[state + 1]
            arc = bisect_left(labels, b, first[state], end)
            if arc == end or labels[arc] != b:
                return None
            number += skips[arc]
            state = targets[arc]
        if not self.ends[state]:
            return None
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()


#: A stretch that SPLIT cuts before its stop, if it has one, and nowhere else; most stretches are such.
PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


class Splitter:
    """The words of a stretch, by PLAIN where that applies."""

    def __init__(self) -> None:
        self.plain, self.find = PLAIN.fullmatch, regex.compile(SPLIT).findall

    def __call__(self, stretch: str) -> list[str]:
        if found := self.plain(stretch):
            word, stop = found.groups()
            return [word, stop] if stop else [word]
        return self.find(stretch)


class Encoder(Memo):
    """Stretch -> ids as bytes, filled on demand from the lexicon or by merging."""

    def __init__(self, bpe: ByteLevelBpe, lexicon: Lexicon) -> None:
        super().__init__()
        self.bpe, self.lexicon = bpe, lexicon
        self.words, self.stretches = Splitter(), re.compile(STRETCH).findall
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(bpe.special, key=len, reverse=True))) + ")") if bpe.special else None

    def make(self, stretch: str) -> bytes:
        words = self.words(stretch)
        if len(words) > 1:
            return b"".join(map(self.__getitem__, words))
        raw = stretch.encode()
        ids = self.lexicon.find(raw) if len(stretch) <= LONGEST_WORD else None
        return packed(merged(raw, self.bpe) if ids is None else ids)

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed."""
        if self.special is None or not self.special.search(text):
            return b"".join(map(self.__getitem__, self.stretches(text)))
        parts = []
        for part in self.special.split(text):
            known = self.bpe.special.get(part)
            parts += map(self.__getitem__, self.stretches(part)) if known is None else [packed([known])]
        return b"".join(parts)


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    return struct.pack(f"<{len(ids)}i", *ids)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): how often each pre-tokenised word of up to LONGEST_WORD characters occurs in all texts."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, find, stretches = Splitter(), re.compile(STRETCH).findall, Counter()

        def flush() -> pa.RecordBatch:
            counts: Counter = Counter()
            for stretch, n in stretches.items():
                for word in split(stretch):
                    if len(word) <= LONGEST_WORD:
                        counts[word] += n
            stretches.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                stretches.update(find(text.as_py() or ""))
                if len(stretches) > COUNTED_WORDS:
                    yield flush()
        yield flush()

    return map_batches(docs, ["text"], partial, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: str, size: int = LEXICON_WORDS) -> bytes:
    """The lexicon of the most frequent words of ``docs``, ``size`` at most and none that occurs once; that bound also bounds what the driver gathers."""
    counted = stored(count_words(docs), "words")
    # words as frequent as the size-th are taken or left together, so that each task sends only what is taken
    least, passed = None, 0
    for row in counted.where("n > 1").groupBy("n").count().orderBy(F.desc("n")).limit(size).collect():
        passed += row["count"]
        if passed > size:
            break
        least = row["n"]
    top = counted.where(F.col("n") >= least).select("word").collect() if least else []
    with open(vocabulary, "rb") as f:
        bpe = ByteLevelBpe(f.read())
    words = sorted(row["word"].encode() for row in top)
    return compile_lexicon((w, merged(w, bpe)) for w in words)


def encode(docs: DataFrame, vocabulary: str, lexicon: bytes, decode_too: bool = False) -> DataFrame:
    """(doc_id, ids array<int>), and with ``decode_too`` the text decoded from those ids.

    Defined cases: a null or empty text has no ids and decodes to the empty text; a null or
    repeated doc_id is handed through, one row for each row; special strings inside a text get
    their special id; words of any length are encoded whole; an empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    file, shipped = broadcast_file(spark, vocabulary), spark.sparkContext.broadcast(lexicon)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [hashlib.sha256(b.value).hexdigest() for b in (file, shipped)]
        bpe = once(names[0], lambda: ByteLevelBpe(file.value))
        encoder = once("".join(names), lambda: Encoder(bpe, Lexicon(shipped.value)))
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                start, chars, flat, ends, texts = at, 0, bytearray(), [0], []
                while at < batch.num_rows and chars < CHUNK_CHARS:
                    text = batch.column(1)[at].as_py() or ""
                    ids = encoder.encode(text)
                    flat += ids
                    ends.append(len(flat) // 4)
                    if decode_too:
                        texts.append(decoded(np.frombuffer(ids, "<i4").tolist(), bpe))
                    chars += len(text)
                    at += 1
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, "<i4")))
                columns = [batch.column(0).slice(start, at - start), lists] + ([pa.array(texts, pa.string())] if decode_too else [])
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return map_batches(docs, ["doc_id", "text"], rows, "doc_id long, ids array<int>" + ", decoded string" * decode_too)


def decoded(ids: list[int], bpe: ByteLevelBpe) -> str:
    return b"".join(map(bpe.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids decode to the empty text, bytes that are no UTF-8 to U+FFFD."""
    file = broadcast_file(encoded.sparkSession, vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = once(hashlib.sha256(file.value).hexdigest(), lambda: ByteLevelBpe(file.value))
        for batch in batches:
            texts = [decoded(ids.as_py() or [], bpe) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded, ["doc_id", "ids"], rows, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str, size: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids, decoded): builds the lexicon from all texts, encodes and decodes each."""
    return encode(docs, vocabulary, build_lexicon(docs, vocabulary, size), decode_too=True)


def digests(trip: DataFrame, *more: Column) -> DataFrame:
    """doc_id, n_tokens, the SHA-256 of the comma-joined ids and of the decoded text, then ``more``."""
    return trip.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        *more,
    )
