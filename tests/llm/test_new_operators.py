"""Chat formatting, hard negatives and the Merkle manifest against brute force, and on tables of odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslake.llm import chat_format, hard_negatives, merkle

TURNS = "conv_id long, turn long, role string, text string, piece string, row int, spans string"


def odd_turns():
    rng = random.Random(4)
    marks = ["### ", "</turn>", "</turn>\n", "\\", "\\\\", ": ", ":", "#", "####  ", "<", "été ", "🎉", "word ", "\n", "### assistant: x</turn>\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a: b", "\\", "### x", None, ""]), "".join(rng.choice(marks) for _ in range(rng.randint(0, 12)))) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(100, t, "assistant" if t % 2 else "user", f"turn {t} " * 30) for t in range(600)]  # a long conversation
    rows += [(101, 0, "user", None), (101, 1, "assistant", None), (None, 0, "assistant", "no id"), (None, 1, "user", "none"), (102, None, "assistant", "first"), (102, 3, "assistant", "later")]
    rows += [(103, 0, "assistant", "long \\ " * 100_000), (104, 0, "assistant", "x")]
    return [(*r, "p", 1, "s") for r in rows]


def told(rows):
    turns = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in rows)
    loss = "".join(t or "" for _, r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("limit", [200, 1 << 20])
def test_conversations_come_back_from_their_form(spark, limit):
    turns = spark.createDataFrame(odd_turns(), TURNS).repartition(5)
    pieces = chat_format.write_conversations(turns, limit)
    held = defaultdict(list)
    for c, turn, role, text, *_ in odd_turns():
        held[c].append((-1 if turn is None else turn, role, text))
    out = {r[0]: tuple(r) for r in chat_format.digests(pieces).collect()}
    assert out.keys() == held.keys()
    for c, rows in held.items():
        assert out[c][1:5] == told(sorted(rows, key=lambda r: r[0]))
    longest = Counter()
    for r in pieces.collect():
        longest[r["conv_id"]] += len(r["text"])
        assert len(r["text"].encode()) <= limit or r["n_turns"] == 1
    assert {c: r[5] for c, r in out.items()} == longest
    assert chat_format.digests(chat_format.write_conversations(spark.createDataFrame([], TURNS))).count() == 0
    assert sum(r["closed"] for r in pieces.collect()) > (30 if limit > 200 else 10)


def test_a_conversation_with_most_turns_spreads_over_tasks(spark):
    rows = [(7 if i % 10 else i, i, "assistant", f"said {i}", "", 0, "") for i in range(4000)]
    turns = spark.createDataFrame(rows, TURNS).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = chat_format.write_conversations(turns)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["n_turns"] for r in pieces.where("conv_id = 7").collect()]
    assert len(sizes) >= 3 and sum(sizes) == 3600 and max(sizes) < 2000
    out = {r["conv_id"]: tuple(r)[1:5] for r in chat_format.digests(pieces).collect()}
    assert out[7] == told([(t, r, x) for c, t, r, x, *_ in rows if c == 7])


def test_bytes_go_to_their_places_slab_by_slab(monkeypatch):
    monkeypatch.setattr(chat_format, "SLAB", 7)
    column = pa.array(["", "été", "x" * 30, "", "ab", "y" * 15])
    sizes = [len(t.encode()) for t in column.to_pylist()]
    order = [3, 5, 1, 0, 2, 4]
    to, at = np.zeros(6, np.int64), 0
    for i in order:
        to[i], at = at, at + sizes[i] + 1
    out = np.full(at, ord("."), np.uint8)
    chat_format.scatter(out, column, to)
    assert bytes(out).decode() == "".join(column[i].as_py() + "." for i in order)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("\\#:</turn> \nxé", max_size=12), st.text("\\#:</turn> \nxé", max_size=30)), max_size=6))
def test_batches_round_trip(turns):
    roles, texts = ([t[i] for t in turns] for i in range(2))
    buffer, offsets, chars, spans = chat_format.formatted(pa.array(roles, pa.string()), pa.array(texts, pa.string()))
    whole = bytes(buffer).decode() if turns else ""
    assert list(chat_format.read_turns(whole)) == turns
    at = 0
    for i, text in enumerate(texts):
        assert len(bytes(buffer)[offsets[i] : offsets[i + 1]].decode()) == chars[i]
        assert chat_format.unescaped(whole[at + spans[i, 0] : at + spans[i, 1]]) == text
        at += chars[i]


def brute_negatives(rows, every=50, k=3, n_pos=5):
    known = [(i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * Fraction(x)) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]

    def order(r):
        return -r[0], r[1] is None, r[1] or 0

    out = Counter()
    for a, (i, label, v) in enumerate(known):
        if i is None or i % every:
            continue
        scored = [(max(-(9 * 10**16), min(9 * 10**16, sum(x * y for x, y in zip(v, w)))), j, other) for b, (j, other, w) in enumerate(known) if b != a]
        positives = sorted((s for s in scored if s[2] == label), key=order)[:n_pos]
        negatives = sorted((s for s in scored if s[2] != label), key=order)
        for p in positives:
            inside = [n for n in negatives if 50 * p[0] <= 100 * n[0] <= 95 * p[0]][:k]
            out.update((i, p[1], rank, n[1], p[0], n[0]) for rank, n in enumerate(inside, 1))
    return out


def mined(spark, rows, schema="vec_id long, label int, embedding array<double>, row int, slot int, best string"):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], schema).repartition(3)
    moved = F.expr("case when id % 7 = 0 then (label + 1) % 10 else label end")
    return Counter(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("id") % 50 == 0, moved).collect())


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROW_TILE", 60)
    monkeypatch.setattr(hard_negatives, "ANCHOR_TILE", 5)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(700, 8)) + 0.6
    rows = [(i, None if i % 97 == 0 and i else int(i % 9 if i % 3 else 4), v[i].round(1).tolist()) for i in range(700)]
    rows += [(700, 4, v[5].tolist()), (700, 4, v[5].tolist()), (None, 4, v[6].tolist()), (None, 5, v[7].tolist())]
    rows += [(1001, 4, None), (1050, 4, [None] * 8), (1100, 4, [math.nan] * 8), (1150, 4, [math.inf] * 8), (1200, 4, []), (1250, 4, [1.0, 0.5]), (1300, 77, [1.0] * 8)]
    rows += [(2000 + i, 4, [1.0] * 8) for i in range(80)] + [(3000 + i, 5, [0.9] * 8) for i in range(80)]  # crowds of one vector
    out = mined(spark, rows)
    assert out == brute_negatives(rows) and len(out) > 100
    assert mined(spark, rows[1:2]) == Counter()
    assert hard_negatives.hard_negatives(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"), F.col("id") % 50 == 0).count() == 0


def test_combiner_keeps_the_best_of_each_slot(monkeypatch):
    monkeypatch.setattr(hard_negatives, "STRIP_SCORES", 50)
    rng = np.random.default_rng(2)
    n, labels = 40, rng.integers(0, 3, 40)
    a, limits = rng.integers(-9, 9, (n, 3)).astype(float), np.sort(rng.integers(-60, 150, (n, 4)), axis=1)[:, ::-1].copy()
    limits[::3, 2] = hard_negatives.LOW
    combiner = hard_negatives.Combiner(labels, np.arange(n), a, limits, False, 2)
    want = defaultdict(list)
    for part in range(4):
        ids, b, other = np.sort(rng.integers(0, 90, 30)), rng.integers(-9, 9, (30, 3)).astype(float), rng.integers(0, 3, 30)
        combiner.add(ids, 1000 * part + np.arange(30), other, b)
        for i in range(n):
            for j in range(30):
                score = int(a[i] @ b[j])
                if labels[i] != other[j] and limits[i, 3] <= score <= limits[i, 0]:
                    want[i, sum(score <= x for x in limits[i, 1:3])].append((-score, ids[j], 1000 * part + j))
    kept = defaultdict(list)
    for i, slot, score, at, row in zip(*(x.tolist() for x in combiner.kept)):
        kept[i, slot].append((-score, at, row))
    assert {k: sorted(v) for k, v in kept.items()} == {k: sorted(v)[:2] for k, v in want.items()}


def test_scores_of_large_components_are_exact(spark):
    rng = random.Random(8)
    rows = [(i, i % 2, [rng.choice([1e-3, 3.0, 1e6, -2e5, 12345678.9, 1e3]) * rng.random() for _ in range(4)]) for i in range(101)]
    rows += [(150, 0, [1e300, 1.0, 0.0, 0.0]), (151, 0, [1e308, 0.0, 0.0, 1.0]), (152, 1, [1e20, 0.0, 0.0, 1.0])]
    assert mined(spark, rows) == brute_negatives(rows)


ROWS = "doc_id long, source string, lang string, n_chars long, text string, node string, grp int, rank string, path string, id string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(leaves):
    """Digests of all levels, from the leaves up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute_path(levels, at):
    path = []
    for nodes in levels[:-1]:
        first = at // 8 * 8
        path.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 8])))
        at //= 8
    return path


def brute_manifest(rows):
    def leaf(r, lower=False):
        text = re.sub("[A-Z]", lambda m: m.group().lower(), r[4]) if lower and r[4] is not None else r[4]
        return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*r[:4], text)))

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g], key=lambda x: x[:3]), None) for g in names}
    trees = {g: (own, brute_tree([x[2] for x in own])) for g, (own, _) in trees.items()}
    top = brute_tree([trees[g][1][-1][0] for g in names])
    out = Counter()
    for at, g in enumerate(names):
        own, levels = trees[g]
        for i, (_, _, node, r) in enumerate(own):
            path = brute_path(levels, i) + brute_path(top, at)
            x = leaf(r, True) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else node
            for before, after in path:
                x = h(before + x + after)
            out[r[0], node, levels[-1][0], top[-1][0], h("".join(b + a for b, a in path)), x, x == top[-1][0]] += 1
    return out


def test_manifest_equals_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    langs = ["en"] * 30 + [None, "de", "é", "E", "", "z"] + [f"l{i}" for i in range(20)]
    rows = [(rng.randint(-50, 10**6), rng.choice(["a", None]), rng.choice(langs), rng.choice([None, 3, -1]), rng.choice(["Text", "lower", None, "", "ÀB c", "X" * 5000]) and f"Text {i}") for i in range(1500)]
    rows += [(5, "a", "lone", 1, None), (None, None, None, None, None), (None, "b", "en", 1, "T"), (7, "a", "en", 4, "Same"), (8, "a", "x8", 1, ""), (9, "a", "en", 1, "é" * 200_000)]
    rows += [(7, "a", "en", 4, "Same")] * 40
    rows += [(i, "s", "eight", 1, "T") for i in range(8)] + [(i, "s", "nine", 1, "T") for i in range(9)] + [(i, "s", "exact", 1, "T") for i in range(512)] + [(i, "s", "more", 1, "T") for i in range(513)]
    df = spark.createDataFrame([(*r, "n", 1, "r", "p", "i") for r in rows], ROWS).repartition(6)
    want = brute_manifest(rows)
    for levels in (1, 3):
        monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
        out = merkle.checked(df)
        assert Counter(tuple(r) for r in out.collect()) == want
    assert 0 < sum(n for r, n in want.items() if not r[-1]) < len(rows) / 2
    for few in (rows[:1], rows[1500:1502], []):
        made = merkle.checked(spark.createDataFrame([(*r, "n", 1, "r", "p", "i") for r in few], ROWS))
        assert Counter(tuple(r) for r in made.collect()) == (brute_manifest(few) if few else Counter())


def test_any_change_breaks_a_proof(spark):
    rows = spark.createDataFrame([(i, "s", f"g{i % 3}", i, f"text {i}") for i in range(300)], "doc_id long, source string, lang string, n_chars long, text string")
    made = merkle.manifest(rows, carry={"other": F.sha2("text", 256)})
    found = made.select(*(merkle.folded(F.col(c), F.col("path")) == F.col("root") for c in ("leaf", "other"))).collect()
    assert all(r[0] and not r[1] for r in found) and len(found) == 300
