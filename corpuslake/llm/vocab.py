"""Reading of tokenizer files: the driver broadcasts a file's bytes, each worker parses them once."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark import TaskContext
from pyspark.sql import SparkSession

#: Parsed files and memos of this worker, by content key, for the tasks of one stage.
_parsed: dict[str, Any] = {}
_stage: list[int] = []


def broadcast_file(spark: SparkSession, path: str):
    """The file's bytes as a broadcast; tokenizer files are a few MB whatever the corpus."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def forget_other_stages() -> None:
    """Drops what this worker remembers once it has a task of another stage, so that memos don't pile up."""
    task = TaskContext.get()
    now = [task.stageId()] if task else []
    if now != _stage:
        _parsed.clear()
        _stage[:] = now


def once(key: str, make: Callable[[], Any]) -> Any:
    """``make()``, called once for a key in this worker process and stage."""
    forget_other_stages()
    if key not in _parsed:
        _parsed[key] = make()
    return _parsed[key]


class Memo(dict):
    """What :meth:`make` gave for the keys met lately, in two generations: a full one becomes the older, which is then asked before making anew.

    Holds ``2 * SIZE`` entries at most, none for keys of over ``LONGEST`` characters; that bears on speed only.
    """

    SIZE, LONGEST = 300_000, 64

    def __init__(self) -> None:
        self.older: dict = {}

    def make(self, key: str) -> Any:
        raise NotImplementedError

    def __missing__(self, key: str) -> Any:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.LONGEST:
            if len(self) >= self.SIZE:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next free code point from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Bits that an id takes where several numbers are packed in one.
ID_BITS = 20


class ByteLevelBpe:
    """Ids, merge ranks and bytes of a byte-level BPE file in the JSON form of the tokenizers library."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        model, alphabet = spec["model"], byte_alphabet()
        ids: dict[str, int] = model["vocab"]
        odd = {"dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"}
        if model["type"] != "BPE" or any(model.get(k) for k in odd) or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE files are read")
        split = spec.get("pre_tokenizer") or {}
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space", True) or not split.get("use_regex", True) or (spec.get("post_processor") or {}).get("type", "ByteLevel") != "ByteLevel":
            raise ValueError("only files that split by the byte-level pattern, without a prefix space, are read")
        self.token_bytes: list[bytes] = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token)
        self.byte_ids = [0] * 256
        for token, i in ids.items():
            if len(token) == 1:
                self.byte_ids[alphabet[token]] = i
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: Two adjacent ids as one number -> the merge's rank and the merged id as one number.
        self.merges = {ids[a] << ID_BITS | ids[b]: rank << ID_BITS | ids[a + b] for rank, (a, b) in enumerate(pairs)}
        self.special: dict[str, int] = {}
        for t in spec.get("added_tokens", []):
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError(f"added token {t['content']!r} has matching rules that are not read")
            self.special[t["content"]] = t["id"]
            self.token_bytes += [b""] * (t["id"] + 1 - len(self.token_bytes))
            self.token_bytes[t["id"]] = t["content"].encode()
