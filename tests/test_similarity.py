import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslab.functions import distance
from corpuslab.operators import similarity


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_block_distances():
    rng = random.Random(1)
    sizes = [0, 1, 5, 63, 64, 65, 127, 128, 129, 200]
    text = lambda letters: "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))
    patterns = [text("abcé😀") for _ in range(20)] + [""]
    others = [text("abcéz") for _ in range(60)] + ["b"]
    alphabet = np.unique(distance.code_points("".join(patterns)))
    order = np.argsort([-len(t) for t in others], kind="stable")
    block = distance.make_block(others, order, alphabet)
    for p in patterns:
        pattern = distance.make_pattern(p, alphabet)
        want = np.array([plain_distance(p, others[r]) for r in order])
        everything = np.arange(len(order))
        assert list(distance.distances(pattern, block, everything)) == list(want)
        some = everything[::3]
        assert list(distance.distances(pattern, block, some)) == list(want[some])
        assert (distance.lower_bounds(pattern, block) <= want).all()


def test_blocks_are_joined_and_few_texts_are_compared_at_a_time(monkeypatch):
    """What the bounds leave of several blocks is compared in one go, and gives what block by block does."""
    rng = random.Random(2)
    line = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(60, 140)))
    frame = pd.DataFrame({"text": [line() for _ in range(400)], "n": range(400)})
    generated = [line() for _ in range(8)]
    monkeypatch.setattr(similarity, "BLOCK", 8)
    calls, plain = [], distance.distances
    monkeypatch.setattr(distance, "distances", lambda p, b, *k: calls.append(len(b.sizes)) or plain(p, b, *k))
    best = similarity._Best(generated, ["n"])
    best.add(frame)
    want = [min((plain_distance(t, g), n) for n, t in enumerate(frame["text"])) for g in generated]
    assert [(d, *key) for d, key, _ in best.best] == want
    assert len(calls) < 4 * len(generated)  # block by block there were up to fifty calls a text


def texts(spark, rows):
    return spark.createDataFrame(rows, "n long, text string")


def plain_nearest(generated, originals, end=""):
    return {
        g: min((plain_distance(t + end, g), n, t) for n, t in originals) for _, g in generated
    }


@pytest.mark.parametrize("scan", [True, False])
@pytest.mark.parametrize("newline", [True, False])
def test_nearest_is_exact(spark, scan, newline, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    monkeypatch.setattr(similarity, "LONGEST", 100)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
    line = lambda: " ".join(word() for _ in range(rng.randint(0, 12)))
    originals = [(i, line()) for i in range(120)]
    originals += [(200 + i, originals[i][1]) for i in range(5)] + [(300, "x" * 400)]
    generated = [(i, line()) for i in range(25)]
    generated += [(50, originals[3][1]), (51, ""), (52, "y" * 300), (53, originals[4][1] + "q")]
    found = similarity.nearest_original(
        texts(spark, generated), texts(spark, originals), ["n"], newline, scan
    ).collect()
    want = plain_nearest(generated, originals, "\n" if newline else "")
    assert {r.gen: (r.distance, r.key.n, r.text) for r in found} == want


def test_nearest_without_close_lengths(spark):
    found = similarity.nearest_original(
        texts(spark, [(0, "a" * 500)]), texts(spark, [(1, "a"), (2, "b")]), ["n"]
    ).collect()
    assert [(r.distance, r.text) for r in found] == [(499, "a")]


def test_nearest_without_originals(spark):
    assert similarity.nearest_original(texts(spark, [(0, "a")]), texts(spark, []), ["n"]).collect() == []


def test_nearest_with_null_and_empty_texts(spark):
    found = similarity.nearest_original(
        texts(spark, [(0, None), (1, ""), (2, "ab"), (3, "ab")]), texts(spark, [(7, None), (8, "abc"), (9, "")]), ["n"]
    ).collect()
    assert sorted((r.gen, r.distance, r.text) for r in found) == [("", 0, ""), ("ab", 1, "abc")]


def test_letters_without_partner_bound_the_distance(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(0, 12)))
    rows = spark.createDataFrame([(word(), word()) for _ in range(300)], "gen string, text string")
    letters = ["a", "b", "é"]
    profiles = rows.select(
        "gen", "text", *similarity._profile("gen", letters, "g"), *similarity._profile("text", letters, "o")
    )
    for r in profiles.withColumn("least", similarity._unmatched(4)).collect():
        assert abs(len(r.gen) - len(r.text)) <= r.least <= plain_distance(r.gen, r.text)


def test_no_original_within_the_bound_is_missed(spark):
    """Lengths and letters rule out none that the built-in distance would find."""
    rng = random.Random(5)
    line = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 200)))
    originals = [line() for _ in range(400)]
    frame = spark.createDataFrame([(o, 1) for o in originals], "text string, n int")
    known = frame.select(
        "text", F.struct("n").alias("key"), F.floor(F.length("text") / similarity.BAND).alias("band"),
        F.pmod(F.xxhash64("text"), F.lit(similarity.SALTS)).cast("int").alias("salt"),
        *similarity._profile("text", list("abcdefgh "), "o"),
    )
    asked = spark.createDataFrame([(o + "z", 8) for o in originals[:20]], "gen string, bound int")
    asked = asked.select("*", *similarity._profile("gen", list("abcdefgh "), "g"))
    pairs = similarity._within(asked, known, F.col("bound"), similarity.SALTS, 10)
    assert {(r.gen, r.text) for r in pairs.where("distance = 1").collect()} == {(o + "z", o) for o in originals[:20]}


def test_similarity_by_run_counts_repeated_texts(spark):
    generated = spark.createDataFrame(
        [("r", "abc"), ("r", "abc"), ("r", "abx"), ("s", "abc")], "run string, text string"
    )
    nearest = similarity.nearest_original(generated, texts(spark, [(1, "abcd")]), ["n"])
    got = {r.run: (r.n_texts, r.mean_distance) for r in
           similarity.similarity_by_run(generated, nearest, "run").collect()}
    assert got == {"r": (3, round(4 / 3, 6)), "s": (1, 1.0)}
