"""Token counts of a piece vocabulary: byte-pair merging with a heap over a linked list.

The count of a stretch of text is its initial symbols minus the merges, plus the extra bytes of
characters that the vocabulary lacks; no ids are made. A text is cut before each run of spaces:
no piece holds a space after another character, so no merge crosses such a cut, and equal
stretches have equal counts, which each worker remembers for those met lately.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .vocab import Memo, broadcast_file, once

#: Fixed value: the character that stands for a space in piece vocabularies.
SPACE = "▁"


class Pieces:
    """Merge priorities of a sentencepiece BPE model file."""

    def __init__(self, content: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(content)
        norm, trainer = model.normalizer_spec, model.trainer_spec
        kinds = model.SentencePiece
        if (
            trainer.model_type != trainer.BPE
            or trainer.treat_whitespace_as_suffix
            or not trainer.byte_fallback
            or norm.name != "identity"
            or norm.precompiled_charsmap
            or norm.remove_extra_whitespaces
            or not norm.escape_whitespaces
            or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces)
        ):
            raise ValueError("only BPE models with identity normalisation and byte fallback are counted")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == kinds.NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece holds a space after another character")

    def count(self, text: str) -> int:
        """Tokens of one stretch: the lowest-ranked adjacent pair merges first, the leftmost among equals."""
        rank, parts, n = self.rank, list(text), len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            pair = parts[i] + parts[i + 1]
            if pair in rank:
                heap.append((rank[pair], i, pair))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != len(pair) or parts[i] + parts[j] != pair:
                continue  # one of the two has been merged since
            parts[i], parts[j] = pair, ""
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                longer = pair + parts[k]
                if longer in rank:
                    heapq.heappush(heap, (rank[longer], i, longer))
            h = before[i]
            if h >= 0:
                longer = parts[h] + pair
                if longer in rank:
                    heapq.heappush(heap, (rank[longer], h, longer))
        extra = sum(len(p.encode()) - 1 for p in parts if p and p not in rank)
        return n - merges + extra


class Counts(Memo):
    """Stretch -> tokens, filled on demand."""

    def __init__(self, pieces: Pieces) -> None:
        super().__init__()
        self.pieces, self.make = pieces, pieces.count
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def of(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.cut(self.pieces.prefix + text.replace(" ", SPACE))))


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): tokens of each whole text, as the model's library counts them.

    Defined cases: a null or empty text has no bytes and no tokens; a null or repeated doc_id is
    handed through, one row for each row; texts of any length are counted whole; special strings
    in a text are plain text; an empty table gives no rows; other columns are ignored.
    """
    file = broadcast_file(docs.sparkSession, model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = once(hashlib.sha256(file.value).hexdigest(), lambda: Counts(Pieces(file.value)))
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(counts.of(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    counted = map_batches(docs, ["doc_id", "text"], rows, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
