"""The bit-parallel edit distance against the plain table."""

import random
import time

from pyspark.sql import functions as F

from corpuslake.operators import metrics


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_distances_equal_the_plain_table():
    rng = random.Random(3)
    for _ in range(1500):
        letters = rng.choice(["ab", "abcdé", "🎉xé\n "])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, rng.choice([4, 20, 90])))) for _ in range(2))
        assert metrics.edit_distance(a, b) == plain(a, b) == metrics.edit_distance(b, a)


def test_texts_of_a_hundred_thousand_characters():
    rng = random.Random(4)
    a = [rng.choice("abcdefgh é") for _ in range(100_000)]
    b = list(a)
    for _ in range(500):
        b[rng.randrange(1000, 99_000)] = "#"
    began = time.process_time()
    assert metrics.edit_distance("".join(a), "".join(b)) == sum(x != y for x, y in zip(a, b)) and time.process_time() - began < 60


def test_long_and_short_texts_are_measured_alike(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abé ") for _ in range(rng.choice([0, 5, 200, 256, 257, 700]))), "".join(rng.choice("abé ") for _ in range(rng.choice([0, 9, 300])))) for i in range(60)]
    rows += [(900, None, "x"), (901, "x" * 300, None), (902, "", "")]
    out = {r["id"]: r["s"] for r in spark.createDataFrame(rows, "id int, a string, b string").select("id", metrics.similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    for i, a, b in rows:
        want = None if a is None or b is None else 1.0 if not a and not b else 1 - plain(a, b) / max(len(a), len(b))
        assert out[i] == want
