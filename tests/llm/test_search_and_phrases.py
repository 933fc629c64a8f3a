"""Lexical search, vector tree and collocations against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import collocations, lexical, vector_tree

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def clashing(df, *names):
    for name in names:
        df = df.withColumn(name, F.lit("old"))
    return df


# lexical search


def plain_ranking(docs, items, k):
    held = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    asked = defaultdict(set)
    for item, text in items:
        if item is not None:
            asked[item] |= set(TERM.findall(lower(text)))
    rows = []
    for item, terms in asked.items():
        scores = []
        for doc, counts in held:
            m = 100 - 50 + (50 * sum(counts.values()) * n_docs) // total
            score = 0
            for t in terms & set(counts):
                df = sum(t in c for _, c in held)
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                score += w * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 20 * m))
            if score > 0:
                scores.append((-score, doc is not None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scores)[:k], 1):
            rows.append((item, rank, doc, -score))
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["É", "漢字", "A1", "the", "the", "the"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(1, 40)))) for i in range(150)]
    rows += [(7, "the W1 w2!"), (7, "the W1 w2!"), (None, "w1 w2"), (200, None), (201, ""), (202, " .,- ")]
    rows += [(300 + i, "w3 w4, w5") for i in range(40)] + [(400, "w6 the " * 30_000)]
    return rows


@pytest.mark.parametrize("k,bucket", [(5, 8), (50, 4096)])
def test_lexical(spark, odd_texts, k, bucket):
    items = [(1, "The w1 w2 W3"), (2, "w5 É unseen"), (2, "w6"), (3, None), (4, "?!"), (None, "w1"), (5, "w3 w4 w5")]
    docs = clashing(spark.createDataFrame(odd_texts, "doc_id long, text string"), "item", "score", "n", "ids", "a.b")
    asked = clashing(spark.createDataFrame(items, "item_id long, text string"), "doc", "rank", "i")
    found = lexical.search(docs.repartition(3), asked, k=k, bucket=bucket)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_ranking(odd_texts, items, k)


def test_lexical_in_blocks_and_empty(spark, odd_texts):
    items = [(i, f"w{i} w{i + 1} the") for i in range(12)]
    docs = spark.createDataFrame(odd_texts[:60], "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = lexical.search(docs, asked, k=3, block_bytes=60)
    assert sorted(map(tuple, found.collect()), key=str) == plain_ranking(odd_texts[:60], items, 3)
    assert lexical.search(docs.limit(0), asked).collect() == []
    assert lexical.search(docs, asked.limit(0)).collect() == []


def test_lexical_bounds_prune():
    """A bucket of short vectors is skipped, and rare coordinates alone choose what is scored."""
    block = lexical.Block([(1, b"rare common")])
    weight = np.zeros(2, np.int64)
    weight[block.terms[b"rare"]], weight[block.terms[b"common"]] = 1000, 10
    block.weigh(weight)
    terms, weights, rests = block.lists[0], block.weights[0], block.rests[0]
    ids = np.array([block.terms[b"common"]] * 99 + [block.terms[b"rare"]])
    bucket = lexical.Bucket(ids, np.full(100, 500), np.ones(100, np.int64), np.full(100, 500.0))
    assert bucket.candidates(terms, weights, rests, 600_000).tolist() == []
    assert bucket.candidates(terms, weights, rests, 400_000).tolist() == [99]
    assert len(bucket.candidates(terms, weights, rests, 1)) == 100


# nearest neighbours


def plain_nearest(rows, key, k):
    """Answers of brute force to the queries, components added from first to last."""
    usable = [
        (i, v) for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    out = []
    for query, asked in {(i, tuple(v)) for i, v in usable if key(i)}:
        scores = []
        for i, v in usable:
            if i != query and len(v) == len(asked):
                total = 0.0
                for a, b in zip(asked, v, strict=True):
                    total += a * b
                scores.append((-total, i))
        out += [(query, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def odd_vectors():
    rnd = random.Random(8)
    rows = [(i, [rnd.gauss(0, 1) + (i % 5) * (j == i % 3) for j in range(6)]) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(90)] + [rows[5], rows[5], (20, rows[40][1])]
    rows += [(600, None), (None, rows[1][1]), (601, [0.0] * 6), (602, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (603, [])]
    rows += [(604, [float("nan")] + [1.0] * 5), (605, [float("inf")] + [1.0] * 5)]
    rows += [(620, [1.0, 2.0]), (621, [3.0, 1.0]), (640, [2.0, 2.0]), (660, [9.0])]
    return rows


def test_vector_tree_is_exact_when_all_leaves_are_visited(spark, odd_vectors):
    df = clashing(spark.createDataFrame(odd_vectors, "vec_id long, embedding array<double>"), "leaf", "tag", "v", "id")
    found = vector_tree.search(df, df.where("vec_id % 20 = 0"), k=7, recall=1.1, leaf_rows=16)
    assert sorted(map(tuple, found.collect())) == plain_nearest(odd_vectors, lambda i: i % 20 == 0, 7)
    assert vector_tree.search(df.limit(0), df).collect() == []
    assert vector_tree.search(df, df.limit(0)).collect() == []


def test_rows_below_the_floor_of_a_query_are_left_out_and_ties_stay():
    random = np.random.default_rng(4)
    rows = random.integers(-2, 3, (200, 4)).astype(float)  # many ties and copies
    queries, ids, asking = rows[:9] + 0.0, np.arange(200), np.arange(9)
    everything = list(zip(*vector_tree.nearest(asking, queries, ids, rows, 20), strict=True))
    floor = np.array([[s for q, _, s in everything if q == n][11] for n in range(9)])
    found = list(zip(*vector_tree.nearest(asking, queries, ids, rows, 20, floor), strict=True))
    assert found == [a for a in everything if a[2] >= floor[a[0]]] and len(found) < len(everything)
    best = vector_tree._best([np.array(a) for a in zip(*everything, strict=True)], 20)
    raised = np.full(9, -np.inf)
    vector_tree._raise_floor(raised, best, 20)
    assert list(raised) == [min(s for q, _, s in everything if q == n) for n in range(9)]


def test_vector_tree_reaches_its_recall_with_fewer_leaves(spark):
    random_ = np.random.default_rng(1)
    centres = random_.normal(size=(40, 12)) * 5
    rows = [(i, (centres[i % 40] + random_.normal(size=12)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    usable = vector_tree.usable(df, "vec_id", "embedding")
    trees = vector_tree.fit(usable)
    index = vector_tree.indexed(usable, trees)
    asked = usable.where("id % 20 = 0").withColumn("tag", F.col("id"))
    most, reached = vector_tree.calibrate(index, asked, trees, 20, 0.95, 200)
    assert reached[12] >= 0.95 and most[12] < trees[12].leaves / 3
    found = {(r.query_id, r.vec_id) for r in vector_tree.search(df, df.where("vec_id % 20 = 0"), recall=0.95).collect()}
    exact = {(q, i) for q, _, i, _ in plain_nearest(rows, lambda i: i % 20 == 0, 20)}
    assert len(found & exact) >= 0.93 * len(exact)


def test_best_bin_first_visits_each_leaf_once():
    rows = np.random.default_rng(2).normal(size=(500, 4))
    tree = vector_tree.Tree(rows, leaf_rows=20)
    order = tree.visited(rows[0], tree.leaves)
    assert sorted(order) == list(range(tree.leaves)) and order[:5] == tree.visited(rows[0], 5)
    assert set(tree.assign(rows).tolist()) == set(range(tree.leaves))


def test_equal_vectors_make_one_leaf():
    tree = vector_tree.Tree(np.ones((300, 3)), leaf_rows=20)
    assert tree.leaves == 1 and tree.assign(np.ones((5, 3))).tolist() == [0] * 5


# collocations


def plain_phrases(rows, longest, least, top, covered=50):
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            sizes[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {
            p[i:j]
            for p, a in candidates.items()
            for i in range(len(p)) for j in range(i + 2, len(p) + 1)
            if j - i < len(p) and p[i:j] in candidates and 100 * a >= covered * candidates[p[i:j]]
        }
        rows_ = []
        for p, a in candidates.items():
            if p not in gone:
                score, _, cut = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, k) for k in range(1, len(p)))
                rows_.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_rows():
    rnd = random.Random(6)
    words = ["the", "The", "of", "new", "york", "city", "é", "漢", "x\x00y", "\x1c", "a-b", "‘q’"]
    rows = []
    for i in range(400):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", ""]) for _ in range(rnd.randrange(30)))
        rows.append((rnd.choice(["en", "en", "en", "fr", None, "und"]), text + rnd.choice(["", " new york city"])))
    rows += [("en", None), (None, ""), ("xx", " ... "), ("en", "of the " * 40_000)] + [("fr", "same same same same")] * 30
    return rows


@pytest.mark.parametrize("longest,shards,bits", [(3, 4, 22), (3, 1, 6), (4, 3, 10)])
def test_collocations(spark, phrase_rows, longest, shards, bits):
    df = spark.createDataFrame(phrase_rows, "lang string, text string").repartition(5)
    df = clashing(df, "phrase", "size", "slot", "n", "shard", "a.b")
    found = collocations.mine(df, top=25, longest=longest, shards=shards, slot_bits=bits)
    assert sorted(map(tuple, found.collect())) == plain_phrases(phrase_rows, longest, 10, 25)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(empty).collect() == []
    blank = spark.createDataFrame([("en", " \n"), (None, None)], "lang string, text string")
    assert collocations.mine(blank).collect() == []


def test_scores_pass_64_bits(spark):
    big = 3_000_000_007
    rows = [("en", "a b", 2, big), ("en", "a", 1, big + 5), ("en", "b", 1, big + 9)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, size int, a long")
    row = collocations.scored(counts).collect()[0]
    assert row.score == 1_000_000 * big * big // ((big + 5) * (big + 9))


def test_parts_are_looked_up_by_size(spark):
    """Lowest score wins, then the shorter first part; phrases of two words need words only, and are not moved."""
    rows = [("en", "a", 1, 40), ("en", "b", 1, 20), ("en", "c", 1, 40), ("en", "a b", 2, 20), ("en", "b c", 2, 20), ("en", "a b c", 3, 10)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, size int, a long")
    found = {r.phrase: (r.l, r.r, r.score) for r in collocations.scored(counts).collect()}
    assert found == {"a b": (40, 20, 500_000), "b c": (20, 40, 500_000), "a b c": (40, 20, 125_000)}
    assert collocations.scored(counts.where("size = 1")).collect() == []
    one = collocations.scored(counts, counts.where("phrase = 'a b c'"))
    assert [tuple(r) for r in one.collect()] == [("en", "a b c", 3, 10, 40, 20, 125_000)]
    assert "Exchange hashpartitioning" not in one._jdf.queryExecution().executedPlan().toString()


def test_longer_phrases_begin_after_their_parts():
    """In scan 0 words are counted alone; a pair begins after both words are reached and closes after a cycle."""
    held = collocations.Slice(pc_array(["en"]), pc_array(["a b a b"]))
    reached = [np.full(64, 255, np.uint8)]
    slots = collocations._slots(held.hashes[held.ids[:2]], 6)
    reached[0][slots] = [0, 2]
    counted = []
    for scan in range(9):
        def active(size, inside, shorter, scan=scan):
            if size == 1:
                return inside if scan < 4 else np.zeros(len(inside), bool)
            since = reached[0][collocations._slots(shorter, 6)].astype(int)
            since = np.maximum(since[:-1], since[1:]) + 1
            return inside & (since <= scan) & (scan < since + 4)

        sizes = {size: len(places) for size, places, _ in collocations.phrases(held.ids, held.hashes, 2, active)}
        counted.append((sizes[1], sizes[2]))
    assert counted == [(4, 0)] * 3 + [(4, 3)] + [(0, 3)] * 3 + [(0, 0)] * 2


def test_scans_move_tables_and_not_slots(spark):
    """A task gives its counts by slot once, in blocks, however many phrases it has; their sums end at the threshold."""
    rows = [("en", " ".join(f"w{i}-{k}" for k in range(500)) + " the the") for i in range(12)]
    shard = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    shared = spark.sparkContext.broadcast([np.full(1 << 12, 255, np.uint8).tobytes()])
    scanned = collocations._scan(shard, shared, 0, 4, 2, 10, 64).where(f"kind = {collocations.SLOT}")
    assert scanned.count() == 2
    held = collocations._slot_sums(scanned, 10)["held"].to_pylist()
    words = collocations.Slice(pc_array(["en"] * 12), pc_array([t for _, t in rows]))
    counts = np.bincount(collocations._slots(words.hashes[words.ids[words.ids > 0]], 12), minlength=1 << 12)
    assert np.frombuffer(held[0], np.uint8).tolist() == np.minimum(counts, 10).tolist()


def test_hashes_are_packed_as_differences():
    rnd = np.random.default_rng(3)
    for rest in (np.zeros(0), np.array([0, 0, (1 << 24) - 1]), np.sort(rnd.integers(0, 1 << 24, 40_000))):
        packed = collocations._pack(rest.astype(np.uint32))
        assert collocations._unpack(packed, len(rest)).tolist() == rest.tolist()
    assert len(packed) < 2 * len(rest)


def test_table_of_frequent_hashes(spark):
    rnd = np.random.default_rng(4)
    hashed = rnd.integers(0, 1 << 63, 5_000, np.uint64) * 2
    sent = [np.repeat(hashed[:2_500], 4), np.repeat(hashed[:1_000], 6), hashed[2_500:]]
    parts = [collocations._hash_rows([p], 64) for p in sent]
    scanned = spark.createDataFrame(pa.Table.from_batches(parts).to_pandas(), collocations.SCANNED)
    packed = np.frombuffer(collocations._bitmap(scanned, 64, 10, 1 << 26), np.uint8)
    bucket, rest = collocations._split(hashed, 64)
    size = 8 * len(packed) // 64
    found = collocations._is_set(packed, bucket * size + collocations._place(rest, size))
    assert found[:1_000].all() and found[1_000:].sum() < 5


def pc_array(values):
    import pyarrow as pa

    return pa.array(values, pa.string())
