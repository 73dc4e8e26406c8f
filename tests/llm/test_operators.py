"""Each operator against a brute-force version, and on tables of odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from corpuslake.llm import bpe_lexicon, mixing, pii, posting_lists, quality_knn, quality_rules, sharding, simhash, token_counts, token_output
from corpuslake.llm.queries import vocabulary
from corpuslake.llm.vocab import ByteLevelBpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard int, fp long, words string, row int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join(rng.choice(["the", "ered", "Thing", "onor", "hé", "été,", "stre.", "x1", "ing", "and"]) + rng.choice(["", "", "s", "an"]) for _ in range(n))


def odd_rows():
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "one", "Two words", "a" * 3000, "wörd " * 2000, "x@y.z 1.2.3.4 +1 555-123-4567", "<|endoftext|> hi <s>", "\x1c é́ ﬁ 🎉"]
    texts += [prose(rng, rng.randint(1, 120)) for _ in range(30)]
    texts += [texts[12]] * 4 + [texts[14] + " tail", "spam### " * 40, "again again again again again again again again " * 5]
    texts += ["x <|ENDOFTEXT|> y<|EndOfText|>", "H\u0331 \u1e96 E\u0301 it's IT'S \u0130", prose(rng, 20_000), "\u5b57" * 100_000]
    sources = ["a", "b", None, "", "ünï"]
    rows = [(i, t, None if i % 7 == 0 else "en", sources[min(i % 9, 4)], None, i, 1, 2, "w", 3) for i, t in enumerate(texts)]
    rows += [(None, "no id at all", None, None, None, 0, 0, 0, "", 0), (5, texts[5], "en", "a", 1, 1, 1, 1, "", 1), (5, texts[5], "en", "a", 1, 1, 1, 1, "", 1)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_sharding_keeps_laws_and_mixture(odd, empty):
    out = rows_of(sharding.assign_shards(odd, 4, carry=["shard"]).toDF("doc_id", "size", "text_crc32", "law", "at", "slot", "grown", "source", "carried"))
    assert len(out) == len(odd_rows())
    by = defaultdict(list)
    for r in out:
        by[r["at"]].append(r)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    for source in {r["source"] for r in out}:
        total = sum(r["source"] == source for r in out)
        for rows in by.values():
            assert abs(sum(r["source"] == source for r in rows) - total * len(rows) / len(out)) <= 2
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    again = rows_of(sharding.assign_shards(odd.repartition(2), 4).select("doc_id", "text_crc32", F.col("shard").alias("at"), "slot"))
    assert Counter(tuple(r.values()) for r in again) == Counter((r["doc_id"], r["text_crc32"], r["at"], r["slot"]) for r in out)
    assert sharding.assign_shards(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(odd, 0)


def test_bpe_equals_the_library_and_round_trips(odd, empty):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = Counter()
    for i, t, *_ in odd_rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    for size in (10, bpe_lexicon.LEXICON_WORDS):
        trip = bpe_lexicon.round_trip(odd, path, size)
        assert Counter(tuple(r) for r in bpe_lexicon.digests(trip).collect()) == want
    texts = bpe_lexicon.decode(trip.select("doc_id", "ids"), path)
    assert Counter(tuple(r) for r in texts.collect()) == Counter((i, t or "") for i, t, *_ in odd_rows())
    assert bpe_lexicon.round_trip(empty, path).count() == 0


def test_bpe_files_that_split_otherwise_are_refused():
    import json

    spec = json.loads(open(vocabulary("byte_bpe_50k.json")).read())
    for change in ({"add_prefix_space": True}, {"use_regex": False}, {"type": "Whitespace"}):
        other = json.dumps(spec | {"pre_tokenizer": spec["pre_tokenizer"] | change})
        with pytest.raises(ValueError):
            ByteLevelBpe(other.encode())
    assert ByteLevelBpe(json.dumps(spec).encode()).merges


def test_lexicon_finds_its_words_and_no_others(tmp_path):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))).encode() for _ in range(400)})
    kept = words[::2]
    lexicon = bpe_lexicon.Lexicon(bpe_lexicon.compile_lexicon((w, [len(w), i]) for i, w in enumerate(kept)))
    for i, w in enumerate(kept):
        assert lexicon.find(w) == [len(w), i]
    assert all(lexicon.find(w) is None for w in words[1::2])
    assert bpe_lexicon.Lexicon(bpe_lexicon.compile_lexicon([])).find(b"a") is None


def test_mixing_reaches_targets(spark, odd, empty):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 60)), "en", f"s{i % 10 if i % 3 else 0}", 0, 0, 0, 0, "", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = rows_of(mixing.mix(docs))
    assert len(out) == len(rows)
    size = {i: len(WORD.findall(t)) for i, t, *_ in rows}
    own = Counter()
    for i, _, _, s, *_ in rows:
        own[s] += size[i]
    names = sorted(own)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    held = set()
    while True:  # the excess over a cap is shared anew until none is above
        level = (sum(own.values()) - sum(3 * own[s] for s in held)) / sum(weight[s] for s in names if s not in held)
        over = {s for s in names if s not in held and level * weight[s] > 3 * own[s]}
        if not over:
            break
        held |= over
    taken = Counter()
    for r in out:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        target = 3 * own[r["source"]] if r["source"] in held else level * weight[r["source"]]
        assert r["source_size"] == own[r["source"]] and r["target"] == pytest.approx(target)
        taken[r["source"]] += r["taken"]
    for s in names:
        target = 3 * own[s] if s in held else level * weight[s]
        assert abs(taken[s] - target) <= max(60, 0.01 * target)
    again = {(r["doc_id"], r["taken"]) for r in rows_of(mixing.mix(docs.repartition(7)))}
    assert again == {(r["doc_id"], r["taken"]) for r in out}
    odd_out = rows_of(mixing.mix(odd))
    assert len(odd_out) == len(odd_rows()) and sum(r["taken"] for r in odd_out) > 0
    assert mixing.repeated(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0


def test_flight_keeps_both_totals():
    rng = random.Random(2)
    sizes = [float(rng.randint(1, 500)) for _ in range(300)]
    chances = [rng.choice([0.0, 0.2, 0.5, 0.9, 1.0]) for _ in sizes]
    moved = mixing.flight(sizes, chances)
    assert sum(0 < p < 1 for p in moved) <= 2
    assert sum(moved) == pytest.approx(sum(chances), abs=1e-5)
    assert sum(p * s for p, s in zip(moved, sizes)) == pytest.approx(sum(p * s for p, s in zip(chances, sizes)), rel=1e-6)
    same = mixing.flight([7.0] * 50, [0.3] * 50)
    assert sum(same) == pytest.approx(15, abs=1e-5) and sum(0 < p < 1 for p in same) <= 2


def test_quality_votes_on_held_out_rows(spark, odd, empty):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        good = i % 4 != 0
        text = prose(rng, 60) if good else rng.choice([" ".join(w + rng.choice("#$%&") * 3 for w in prose(rng, 60).split()), "word " * 60])
        rows.append((i, text, "en", "s", 0, 0, 0, 0, "", 0))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels + [(None, 1, 0), (99999, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_knn.fit(docs, marks)
    out = rows_of(quality_knn.score(docs, model))
    assert len(model.labels) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(600))
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in out)
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 != 0) for r in held]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert len(rows_of(quality_knn.score(odd, model))) == len(odd_rows())
    assert quality_knn.score(empty, model).count() == 0
    by_id = {i: t for i, t, *_ in rows}
    known = quality_knn.WordFeatures()
    for r in out[:60]:  # the vote by brute force
        used, weights = quality_knn.features(by_id[r["doc_id"]], known)
        x = np.zeros(quality_knn.FEATURES)
        x[used] = weights
        v = (x * model.idf) @ model.directions
        similar = model.vectors @ (v / np.linalg.norm(v))
        near = sorted(range(len(similar)), key=lambda j: -similar[j])[: quality_knn.NEIGHBOURS]
        votes = [max(similar[j], 1e-3) ** quality_knn.POWER for j in near]
        want = sum(w * model.labels[j] for w, j in zip(votes, near)) / sum(votes)
        assert r["score"] == pytest.approx(want, abs=1e-3)
    mixed = docs.unionByName(docs.where("doc_id % 7 = 0").withColumn("text", F.lit("zzz"))), marks.unionByName(marks.where("doc_id % 5 = 0").withColumn("quality", F.lit(0)))
    models = [quality_knn.fit(d.repartition(n), m.repartition(n)) for n in (2, 5) for d, m in [mixed]]
    assert (models[0].labels == models[1].labels).all() and np.allclose(models[0].idf, models[1].idf) and min(models[0].labels) == 0
    nobody = quality_knn.fit(empty, marks)
    assert {r["score"] for r in rows_of(quality_knn.score(odd, nobody))} == {0.5}


def test_quality_features_read_whole_words():
    known, word = quality_knn.WordFeatures(), "x" * 1000
    seen = {tuple(quality_knn.features(word[:i] + "y" + word[i + 1 :], known)[0].tolist()) for i in (3, 70, 500, 800, 990)}
    assert len(seen) == 5
    assert quality_knn.features("\u5b57" * 2000, known)[0].tolist() != quality_knn.features("\u5b57" * 900 + "\u6f22" * 200 + "\u5b57" * 900, known)[0].tolist()


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, radius=3):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and root(i) != root(j):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def test_simhash_equals_brute_force(odd, empty):
    rows = odd_rows()
    prints = [brute_fingerprint(t) for _, t, *_ in rows]
    classes = linked(prints)
    least = {c: min((i for (i, *_), k in zip(rows, classes) if k == c and i is not None), default=None) for c in classes}
    want = Counter((i, f"{p:016x}", least[c]) for (i, *_), p, c in zip(rows, prints, classes))
    assert Counter(tuple(r) for r in simhash.near_duplicates(odd).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


def shingle_set(text, width=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + width]) for i in range(max(len(words) - width + 1, min(len(words), 1)))}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def similar_classes(sets, least=0.8):
    """Components of texts whose shingle sets have that similarity or more."""
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= least:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


def test_near_copies_go_by_similarity(spark, odd, empty):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for _ in range(60):  # a text, near copies of it well within the bound, and one that shares half of it
        base = [rng.choice(words) for _ in range(rng.choice([150, 200, 900, 2000]))]
        versions = [base, base]
        for _ in range(4):
            edited = list(base)
            for _ in range(max(1, len(base) // 150)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            versions.append(edited)
        half = len(base) // 2
        versions += [base[:half] + [rng.choice(words) for _ in range(len(base) - half)]]
        for v in versions:
            rows.append((n, " ".join(v), "en", "s", 0, 0, 0, 0, "", 0))
            n += 1
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r["doc_id"] for r in simhash.deduplicated(docs.repartition(5)).collect()}
    sets = [shingle_set(t) for _, t, *_ in rows]
    classes = similar_classes(sets)
    least = {c: min(i for i, k in enumerate(classes) if k == c) for c in set(classes)}
    wrong = kept ^ set(least.values())
    assert len(wrong) <= 0.01 * len(rows), len(wrong)
    for i in set(range(n)) - kept:
        assert max(jaccard(sets[i], sets[j]) for j in range(n) if j != i) >= 0.8

    out = simhash.deduplicated(odd)
    assert out.columns == odd.columns
    odd_sets = [shingle_set(t) for _, t, *_ in odd_rows()]
    assert out.count() == len(set(similar_classes(odd_sets)))
    assert simhash.deduplicated(empty).count() == 0


def edited_copies(rng, originals, copies, length, edits):
    """Texts and copies of them with some words changed, each a list of words."""
    words = [f"w{i}" for i in range(5000)]
    out = []
    for _ in range(originals):
        base = [rng.choice(words) for _ in range(length)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(*edits)):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(own)
    return out


def least_of_groups(sets):
    """The first of each group of sets of similarity 0.8 or more, found over an index of their elements."""
    held = defaultdict(list)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, own in enumerate(sets):
        shared = Counter(j for x in own for j in held[x])
        for j, n in shared.items():
            if n >= 0.8 * (len(own) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for x in own:
            held[x].append(i)
    return {root(i) for i in range(len(sets))}


@pytest.mark.parametrize("originals, copies, length, edits", [(40, 8, 60, (1, 3)), (40, 8, 25, (1, 3)), (60, 6, 9, (0, 1)), (1, 900, 120, (2, 6)), (2, 400, 200, (1, 3))])
def test_no_link_of_edited_copies_is_lost(spark, originals, copies, length, edits):
    rng = random.Random(length)
    texts = edited_copies(rng, originals, copies, length, edits)
    rng.shuffle(texts)
    rows = [(i, " ".join(t), "en", "s", 0, 0, 0, 0, "", 0) for i, t in enumerate(texts)]
    kept = {r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    want = least_of_groups([shingle_set(r[1]) for r in rows])
    assert kept == want and len(want) < len(rows)


def test_short_texts_that_differ_by_one_shingle(spark):
    rng = random.Random(21)
    texts = [t for i in range(900) for base in edited_copies(rng, 1, 1, 8 + i % 6, (0, 0)) for t in (base, base[:-1])]
    rows = [(i, " ".join(t), "en", "s", 0, 0, 0, 0, "", 0) for i, t in enumerate(texts)]
    kept = {r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert kept == least_of_groups([shingle_set(r[1]) for r in rows]) and len(kept) == 1050


def test_crowded_tiles_are_compared_with_their_sets(spark):
    rng = random.Random(9)
    texts = edited_copies(rng, 3, 150, 80, (0, 3)) + edited_copies(rng, 100, 1, 80, (0, 0))
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "row long, text string")
    prints = simhash.long_fingerprints(rows.select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "node").dropDuplicates(["f0", "f1", "f2", "f3"])
    found = {r["node"]: r["component"] for r in simhash.similar_components(prints, rows, tile=40, few=0, piece=900).collect()}
    kept = sorted(r["node"] for r in prints.collect())
    groups = least_of_groups([shingle_set(" ".join(texts[i])) for i in kept])
    assert {found.get(i, i) for i in kept} == {kept[i] for i in groups} and len(groups) > 103


def test_tiles_list_pairs_or_confirm_links():
    rng = np.random.default_rng(3)

    def tile(first, n, labels=None):
        base = rng.integers(0, 1 << 60, 60).astype(np.uint64) if first == 0 else tile.base
        tile.base = base
        sets = [np.unique(np.r_[base[: rng.integers(40, 61)], rng.integers(0, 1 << 60, rng.integers(0, 12)).astype(np.uint64)]) for _ in range(n)]
        prints = np.full((n, 4), 7, np.uint64)
        prints[:, 3] ^= rng.integers(0, 1 << 60, n).astype(np.uint64)
        nodes = np.arange(first, first + n)
        return simhash.Tile(nodes, nodes if labels is None else labels, np.array([len(x) for x in sets]), prints, sets)

    one, other = tile(0, 150), tile(1000, 120)

    def near(a, b, radius=30):
        close = int(a[0][3] ^ b[0][3]).bit_count() <= radius
        shared = len(np.intersect1d(a[1], b[1]))
        return close and min(len(a[1]), len(b[1])) >= 0.8 * max(len(a[1]), len(b[1])), close and shared >= 0.8 * (len(a[1]) + len(b[1]) - shared)

    def all_pairs(x, y, same):
        found = [(int(x.nodes[i]), int(y.nodes[j]), *near((x.prints[i], x.sets[i]), (y.prints[j], y.sets[j]))) for i in range(len(x.nodes)) for j in range(len(y.nodes)) if not same or i < j]
        return {p[:2] for p in found if p[2]}, {p[:2] for p in found if p[3]}

    def classes(pairs):
        parent = {}

        def root(x):
            while x in parent:
                x = parent[x]
            return x

        for x, y in pairs:
            if root(x) != root(y):
                parent[root(x)] = root(y)
        groups = defaultdict(set)
        for x in {x for pair in pairs for x in pair}:
            groups[root(x)].add(x)
        return sorted(map(sorted, groups.values()))

    for x, y, same in ((one, other, False), (one, one, True)):
        candidates, confirmed = all_pairs(x, y, same)
        listed, crowd = simhash.tile_candidates(x, y, same, 30, 0.8, len(candidates))
        assert set(listed) == candidates and len(listed) == len(candidates) > 500 and crowd == []
        assert simhash.tile_candidates(x, y, same, 30, 0.8, len(candidates) - 1) == ([], sorted({n for pair in candidates for n in pair}))
        links = simhash.tile_confirmed(x, y, same, 30, 0.8)
        assert set(links) <= confirmed and classes(links) == classes(confirmed) and len(links) < len(x.nodes) + len(y.nodes) < len(confirmed)
    joined = simhash.Tile(one.nodes, np.zeros(150, np.int64), one.sizes, one.prints, one.sets)
    assert simhash.tile_candidates(joined, joined, True, 30, 0.8, 0) == ([], []) and simhash.tile_confirmed(joined, joined, True, 30, 0.8) == []


def test_simhash_links_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 64)
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(120)]
    prints = {0, (1 << 64) - 1}
    for s in seeds:
        for _ in range(rng.randint(0, 5)):
            x = s
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
        prints.add(s)
    for _ in range(200):  # one crowd of near copies, in a chain
        s ^= 1 << rng.randrange(64)
        prints.add(s)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.near_links(df)).collect()}
    classes = linked(prints)
    groups = defaultdict(list)
    for p, c in zip(signed, classes):
        groups[c].append(p)
    for members in groups.values():
        assert {found.get(m, m) for m in members} == {min(members)}


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def brute_score(text, ratios):
    words = WORD.findall(text or "")

    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    pair = [signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), 42))) for a, b in zip(h, h[1:])]
    grams = [x % quality_rules.BUCKETS for x in h + pair]
    return grams, (sum(ratios[g] for g in grams) / len(grams) if grams else 0.0)


def test_quality_rules_equal_brute_force(spark, odd, empty):
    trusted = spark.createDataFrame([(i,) for i in range(10, 30)] + [(None,), (777,)], "doc_id long")
    ratios = quality_rules.fit_ratios(odd, trusted)
    raw, good = Counter(), Counter()
    for i, t, *_ in odd_rows():
        grams, _ = brute_score(t, [0.0] * quality_rules.BUCKETS)
        raw.update(grams)
        if i is not None and 10 <= i < 30:
            good.update(grams)
    n_raw, n_good = sum(raw.values()) + quality_rules.BUCKETS, sum(good.values()) + quality_rules.BUCKETS
    want = [np.log((good[b] + 1) / n_good) - np.log((raw[b] + 1) / n_raw) for b in range(quality_rules.BUCKETS)]
    assert np.allclose(ratios, want)
    out = defaultdict(list)
    for r in rows_of(quality_rules.measure(odd, ratios)):
        out[r["doc_id"]].append(r)
    assert sum(map(len, out.values())) == len(odd_rows())
    for i, t, *_ in odd_rows():
        r, (n, chars, symbols, dup, rep) = out[i][0], brute_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep), t
        score = brute_score(t, ratios)[1]
        assert r["score"] == pytest.approx(score, abs=1e-9)
        failed = n < 20 or 100 * rep > 30 * n
        assert r["base_failed"] == failed and r["kept"] == (not failed and score >= quality_rules.THRESHOLD)
    kept = quality_rules.kept(odd, ratios)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for rs in out.values() for r in rs)
    assert quality_rules.measure(empty, ratios).count() == 0
    assert quality_rules.fit_ratios(empty, trusted) == [0.0] * quality_rules.BUCKETS


def test_quality_rules_stay_in_the_jvm(odd):
    plan = quality_rules.measure(odd, [0.0] * quality_rules.BUCKETS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_token_counts_equal_the_library(odd, empty):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for i, t, *_ in odd_rows())
    assert Counter(tuple(r) for r in token_counts.count_tokens(odd, path, 100).collect()) == want
    assert token_counts.count_tokens(empty, path).count() == 0


def test_token_files_read_back(spark, odd, empty, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    token_output.write_ids(odd, str(tmp_path / "ids"), path, 2)
    out = rows_of(token_output.read_ids(spark, str(tmp_path / "ids")))
    want = Counter()
    for i, t, *_ in odd_rows():
        want[i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()] += 1
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in out) == want
    out.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in out if r["doc_id"] is not None] == sorted(i for i, *_ in odd_rows() if i is not None)
    start = 0
    for r in out:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(r["ids"]) // 4, zlib.crc32(r["ids"]))
        start += r["n_tokens"]
    token_output.write_ids(empty, str(tmp_path / "none"), path, 2)
    assert token_output.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        words = token_output.WordIds(f.read(), 2)
    rng = random.Random(6)
    bits = ["<|ENDOFTEXT|>", "<|endoftext|>", "<|StartOfText|>", "H\u0331", "\u1e96", "\u00c9", "E\u0301", " ", "\n", "\x1c", "\x85", "it's", "DON'T", "3", "12", "ab", "AB", "\ufb01", "\u03a3", "\U0001f389", "\x01", ".", ",,", "<|", "\u0301", "\u1e9e"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        assert np.frombuffer(words.of(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_files_of_alike_rows(spark, tmp_path):
    rows = spark.range(300_000).select((F.col("id") % 2).alias("doc_id"), F.lit("").alias("text"))
    path = str(tmp_path / "ids")
    token_output.write_ids(rows, path, vocabulary("word_bpe_49k.json"), 2)
    out = token_output.read_ids(spark, path).agg(F.count("*").alias("n"), F.sum("start").alias("s"), F.max("n_tokens").alias("m")).first()
    assert (out["n"], out["s"], out["m"]) == (300_000, 300_000 * 299_999 // 2, 1)
    files = spark.read.parquet(f"{path}/blocks").groupBy("file").agg(F.sum(F.size("doc_ids")).alias("n")).collect()
    assert len(files) >= 4 and max(r["n"] for r in files) < 150_000


def test_packed_numbers_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        numbers = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = token_output.pack(numbers)
        assert (token_output.unpack(control, data, n) == numbers).all() and len(control) == -(-n // 4)


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]
            if fits():
                out.append((m.start(), pii.BASE.index(kind), m.end()))
    return sorted(out)


def test_personal_data_equals_brute_force(spark, empty):
    rng = random.Random(7)
    bits = ["a", "@", ".", "a@b.c", "1", "12", "255", "256", "1.2.3.4", "+", "+1", "4111111111111111", " ", "-", "(", ")", "é", "4111 1111 1111 1111", "٣", "\n", "🎉"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [None, "", "9" * 5000, "a@" * 3000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    for r in rows_of(pii.digests(pii.find_spans(docs))):
        assert len(r["scores"].split(",")) == len(r["spans"].split(",")) and (r["scores"] == "") == (r["spans"] == "")
        want = brute_spans(texts[r["doc_id"]])
        listed = ",".join(f"{pii.BASE[k]}:{s}:{e}" for s, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(w[1] == i for w in want) for i in range(4)]
        assert set(listed.split(",")) <= set(r["spans"].split(","))
    assert pii.find_spans(empty).count() == 0


def test_personal_data_added_kinds_and_masks(spark):
    text = "pay DE89 3704 0044 0532 0130 00 now, DE88 3704 0044 0532 0130 00 not; ssn 123-45-6789; plain 123-45-6789" + "." * 60 + " 987-65-4321"
    found = [(s.kind, text[s.start : s.end]) for s in pii.find_all(text) if s.kind not in pii.BASE]
    assert found[0] == ("iban", "DE89 3704 0044 0532 0130 00") and ("ssn", "123-45-6789") in found and len([k for k, _ in found if k == "iban"]) == 1
    docs = spark.createDataFrame([(1, "mail a@b.co now", "x", "s", 15), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted(map(tuple, pii.mask(docs).collect()))
    assert out == [(1, "mail [EMAIL] now", "x", "s", 16), (2, None, None, None, None)]


def test_neighbours_recall_order_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((3000, 16))
    v[100:400] = v[100]  # a crowd of equal vectors
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)]
    rows += [(5000, None, 0), (5100, [0.0] * 16, 0), (5200, [float("nan")] * 16, 0), (5300, [1.0] * 3, 0), (None, [1.0] * 16, 0), (5400, [None] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = defaultdict(list)
    for r in rows_of(posting_lists.nearest_neighbours(df, F.col("vec_id") % 100 == 0)):
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(out) == {i for i in range(3000) if i % 100 == 0}
    hit = 0
    for q, found in out.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        assert all(f[2] == pytest.approx(d[f[1]], abs=1e-12) for f in found)
        hit += len({f[1] for f in found} & set(best.tolist()))
    assert hit >= 0.9 * 10 * len(out)
    few = posting_lists.nearest_neighbours(df.where("vec_id < 3"), F.col("vec_id") == 0)
    assert few.count() == 2
    assert posting_lists.nearest_neighbours(df.where("vec_id > 4999"), F.col("vec_id") >= 0).count() <= 2
    assert posting_lists.nearest_neighbours(df.where("vec_id is null"), F.col("vec_id") >= 0).count() == 0


def test_posting_lists_keep_recall_with_many_lists(spark, monkeypatch):
    monkeypatch.setattr(posting_lists, "ROWS_PER_LIST", 16)
    rng = np.random.default_rng(11)
    v = rng.normal(size=(16_000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(v)), pa.int64()), "embedding": pa.array(v.tolist(), pa.list_(pa.float64()))}))
    found = defaultdict(set)
    for r in rows_of(posting_lists.nearest_neighbours(df, F.col("vec_id") % 200 == 0)):
        found[r["query_id"]].add(r["vec_id"])
    assert len(found) == 80
    hit = 0
    for q, ids in found.items():
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(ids & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.92 * 10 * len(found), hit


def test_posting_lists_are_balanced_and_the_driver_takes_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(posting_lists, "SAMPLE_ROWS", 1000)
    monkeypatch.setattr(posting_lists, "ROWS_PER_LIST", 100)
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(6000, 8)) * 0.3, rng.normal(size=(2000, 8)) * 3])  # most rows in a small ball
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(v)), pa.int64()), "embedding": pa.array(v.tolist(), pa.list_(pa.float64()))})).repartition(16)
    rows = posting_lists.cut(posting_lists.usable(df, "vec_id", "embedding"))
    assert 900 <= len(posting_lists.draw(rows, len(v), 42)) <= 1000 + posting_lists.TRIED
    index, _ = posting_lists.build(rows)
    assert index.sizes.sum() == len(v) and index.sizes.max() <= 4 * index.sizes.mean(), index.sizes


def test_rows_of_one_vector_id_are_told_apart(spark):
    rows = [(0, [0.0, 1.0], 1, 2.0), (0, [5.0, 5.0], 1, 2.0), (1, [0.0, 2.0], 1, 2.0), (2, [5.0, 6.0], 1, 2.0), (2, [5.0, 6.0], 1, 2.0), (3, [9.0, 9.0], None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int, v double")
    out = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in posting_lists.nearest_neighbours(df, F.col("vec_id") == 0, k=3).collect())
    first = [(1, 1.0), (0, round(41**0.5, 6)), (2, round(50**0.5, 6))]
    second = [(2, 1.0), (2, 1.0), (3, round(32**0.5, 6))]
    assert out == sorted((0, i + 1, *hit) for ranking in (first, second) for i, hit in enumerate(ranking))


def crowd(spark):
    """100,000 rows alike in every column, written by several tasks, and some others."""
    alike = spark.range(0, 100_000, 1, 8).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("s").alias("source"))
    return alike.unionByName(spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("t").alias("source")))


def test_rows_alike_are_spread(spark):
    rows = sharding.cut(crowd(spark).withColumn("row", F.monotonically_increasing_id()))
    numbered = sharding.copy_numbers(rows, ["doc_id", "text", "source"])
    r = numbered.groupBy("doc_id", "text").agg(F.count("*").alias("n"), F.count_distinct("copy").alias("d"), F.min("copy").alias("a"), F.max("copy").alias("b")).where("doc_id is null").first()
    assert (r["n"], r["d"], r["a"], r["b"]) == (100_000, 100_000, 0, 99_999)
    assert sharding.copy_numbers(rows.where("doc_id is not null"), ["doc_id", "text", "source"]) is None
    out = sharding.assign_shards(crowd(spark), 4).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.count_if(F.col("source") == "t").alias("t")).collect()
    assert [(r["n"], r["m"]) for r in out] == [(25_500, 25_499)] * 4 and all(abs(r["t"] - 500) <= 2 for r in out)


def test_mixing_rows_alike(spark):
    out = mixing.mix(crowd(spark))
    sums = {r["source"]: (r["n"], r["taken"], r["target"], r["copies"], r["size"]) for r in out.groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("copies").alias("copies"), F.first("source_size").alias("size")).collect()}
    for n, taken, target, copies, size in sums.values():
        assert abs(taken - target) <= max(9, 0.001 * target)
        assert abs(copies - n * target / size) <= 3  # documents are balanced as well as words
    assert sums["s"][0] == 100_000


def test_mixing_balances_documents(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(1, 300)), f"s{i % 3}") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in mixing.mix(docs).groupBy("source").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"), F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect():
        assert abs(r["copies"] - r["n"] * r["target"] / r["size"]) <= 3 and abs(r["taken"] - r["target"]) <= 600
