import random

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import sequences as seq
from corpuslab.operators import vocab


def stream(spark, n, pieces=None, seed=0):
    """A stream of the numbers 100, 101, … in documents of random size."""
    rng, rows, at = random.Random(seed), [], 0
    while at < n:
        size = rng.choice(pieces or [0, 1, 2, 5, 30])
        rows.append((len(rows) * 3, list(range(100 + at, 100 + min(at + size, n)))))
        at += size
    return spark.createDataFrame(rows, "doc_id long, ids array<long>").withColumn("n", F.size("ids"))


def in_batches(found):
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.batch, r.row)):
        got.setdefault(r.batch, []).append((r.x, r.y))
    return [got[b] for b in sorted(got)]


def plain_sequential(n, rows, steps, offset):
    ids = list(range(100, 100 + n))
    size = (n - offset - 1) // rows * rows
    length = size // rows
    xs = [ids[offset + r * length : offset + (r + 1) * length] for r in range(rows)]
    ys = [ids[offset + 1 + r * length : offset + 1 + (r + 1) * length] for r in range(rows)]
    return [
        [(x[b * steps : (b + 1) * steps], y[b * steps : (b + 1) * steps]) for x, y in zip(xs, ys)]
        for b in range(length // steps)
    ]


SIZES = [0, 1, 5, 15, 16, 17, 60, 61, 62, 200]


@pytest.mark.parametrize("n", SIZES)
@pytest.mark.parametrize("offset", [0, 4])
def test_sequential_batches(spark, n, offset):
    found = seq.batches(stream(spark, n, seed=n), "doc_id", 3, 5, "sequential", offset)
    assert in_batches(found) == plain_sequential(n, 3, 5, offset)


@pytest.mark.parametrize("n", SIZES)
@pytest.mark.parametrize("offset", [0, 4])
def test_random_subsequences(spark, n, offset):
    found = in_batches(seq.batches(stream(spark, n, seed=n), "doc_id", 3, 5, "random", offset, 9))
    count = max((n - offset - 1) // 5, 0)
    assert [len(b) for b in found] == [3] * (count // 3)
    starts = [x[0] - 100 for batch in found for x, _ in batch]
    assert len(set(starts)) == len(starts)
    for batch in found:
        for x, y in batch:
            assert (x[0] - 100 - offset) % 5 == 0
            assert x == list(range(x[0], x[0] + 5)) and y == [i + 1 for i in x]
    assert starts == sorted(starts) or len(starts) < 6 or starts != list(range(len(starts)))


def test_unknown_batch_mode(spark):
    with pytest.raises(ValueError):
        seq.batches(stream(spark, 5), "doc_id", 1, 1, "shuffled")


@pytest.mark.parametrize("bounds", [(0, -1), (2, 7), (-4, 90), (0, 10_000), (7, 3), (20, 40)])
def test_slice_by_position(spark, bounds):
    found = seq.slice_stream(stream(spark, 57), "doc_id", *bounds, relative=False)
    rows = found.orderBy("from_pos").collect()
    assert [i for r in rows for i in r.ids] == list(range(100, 157))[slice(*bounds)]
    assert all(r.to_pos - r.from_pos == len(r.ids) and r.ids[0] == 100 + r.from_pos for r in rows)


BOUNDS = [(0, None, False), (7, 48, False), (-50, -3, False), (0.2, 0.85, True), (0, 10_000, False), (30, 30, False)]


@pytest.mark.parametrize("bounds", BOUNDS)
@pytest.mark.parametrize("mode", ["random", "sequential"])
def test_batches_within_bounds(spark, mode, bounds):
    """Batches of a part are those of a stream that holds nothing else."""
    start, end, relative = bounds
    ids = list(range(100, 157))
    if relative:
        ids = ids[int(start * 57) : int(end * 57)]
    else:
        ids = ids[start:end]
    alone = spark.createDataFrame([(0, ids, len(ids))], "doc_id long, ids array<long>, n int")
    found = seq.batches(stream(spark, 57), "doc_id", 2, 4, mode, 1, 9, *bounds)
    assert in_batches(found) == in_batches(seq.batches(alone, "doc_id", 2, 4, mode, 1, 9))


def test_parts_of_parts(spark):
    """A part is a stream; rows that share a key keep their order in it."""
    ids = list(range(100, 157))
    whole = stream(spark, 57).withColumn("doc_id", F.floor(F.col("doc_id") / 9).cast("long"))
    order = [i for r in seq.slice_stream(whole, "doc_id", 0, 57, False).orderBy("from_pos").collect() for i in r.ids]
    assert sorted(order) == ids
    part = seq.bounded_stream(seq.bounded_stream(whole, "doc_id", 0.1, 0.9, True), "doc_id", 3, -4)
    rows = part.orderBy("doc_id").collect()
    assert [i for r in rows for i in r.ids] == order[5:51][3:-4]
    assert [r.doc_id for r in rows] == [sum(q.n for q in rows[:i]) for i in range(len(rows))]
    found = seq.slice_stream(part, "doc_id", 2, 9, relative=False)
    assert [i for r in found.orderBy("from_pos").collect() for i in r.ids] == order[5:51][3:-4][2:9]


def test_slice_by_share(spark):
    found = seq.slice_stream(stream(spark, 57), "doc_id", 0.25, 0.75, relative=True)
    ids = [i for r in found.orderBy("from_pos").collect() for i in r.ids]
    assert ids == list(range(100, 157))[14:42]


def token_lines(spark, sizes):
    rows = [(s, d, i, ["t"] * n) for s, d, i, n in sizes]
    return spark.createDataFrame(rows, "split string, doc_id long, line_no long, tokens array<string>")


def test_length_batches_and_padding(spark):
    rng = random.Random(8)
    sizes = [(rng.choice(["train", "val"]), d, i, rng.randint(1, 6)) for d in range(30) for i in range(4)]
    batched = seq.length_batches(token_lines(spark, sizes), {"train": 8, "val": 3})
    rows = batched.collect()
    assert len(rows) == len(sizes)
    for split, size in (("train", 8), ("val", 3)):
        got = sorted((r.batch * size + r.row, r.n, r.doc_id, r.line_no) for r in rows if r.split == split)
        want = sorted((n, d, i) for s, d, i, n in sizes if s == split)
        assert got == [(k, *w) for k, w in enumerate(want)]
    padded = seq.pad_batches(batched, ["split", "batch"]).collect()
    for r in padded:
        assert len(r.tokens) == r.width and r.tokens == ["t"] * r.n + ["<pad>"] * (r.width - r.n)
        assert r.width == max(q.n for q in padded if (q.split, q.batch) == (r.split, r.batch))


def test_pairs_are_shifted_by_one(spark):
    rows = token_lines(spark, []).unionByName(
        spark.createDataFrame([("a", 1, 0, list("xyz")), ("a", 1, 1, ["q"])], "split string, doc_id long, line_no long, tokens array<string>")
    )
    got = [(r.pos, r.prev, r.next) for r in seq.next_token_pairs(rows).orderBy("pos").collect()]
    assert got == [(0, "x", "y"), (1, "y", "z")]


def test_labels_and_truncation(spark):
    row = spark.range(1).select(
        seq.causal_labels(F.array(*map(F.lit, [4, 5, 0, 0])), 0),
        seq.truncate(F.array(*map(F.lit, range(40)))),
    ).first()
    assert row[0] == [4, 5, -100, -100]
    assert row[1] == list(range(32))


def test_code_characters(spark):
    small = spark.range(15).select(F.col("id").cast("string").alias("token"), F.col("id").alias("idx"))
    texts = spark.createDataFrame([("3x0",), ("",), ("99",)], "text string")
    got = [r[0] for r in texts.select(seq.code_characters(F.col("text"), small, 77)).collect()]
    assert got == [[3, 77, 0], [], [9, 9]]


def test_code_characters_of_a_large_alphabet(spark):
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 9_000)] + ["\U0001f600"]
    known = spark.createDataFrame(list(zip(letters, range(3, 10_000))), "token string, idx long")
    text = letters[0] + letters[8_999] + "a" + letters[9_000] + letters[4_095]
    row = spark.createDataFrame([(text,)], "text string")
    got = row.select(seq.code_characters(F.col("text"), known)).first()[0]
    assert got == [3, 9_002, 0, 9_003, 4_098]


def test_sizes_alone_are_batched_like_lists(spark):
    rows = [("train", d, n, ["x"] * ((d * n) % 5)) for d in range(6) for n in range(4)]
    lists = spark.createDataFrame(rows, "split string, doc_id long, line_no long, tokens array<string>")
    whole = seq.length_batches(lists, {"train": 7}).drop("tokens")
    sized = lists.select("split", "doc_id", "line_no", F.size("tokens").cast("long").alias("n"))
    slim = seq.length_batches(sized, {"train": 7}, size=F.col("n"))
    assert slim.columns == whole.columns and sorted(slim.collect()) == sorted(whole.collect())
