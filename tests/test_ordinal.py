import random

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import ordinal
from corpuslab.operators.lookup import lookup


@pytest.mark.parametrize("bits", [1, 2, 4, 16])
def test_running_offsets(spark, bits):
    rng = random.Random(bits)
    rows = [(g, k, rng.randint(0, 9)) for g in "ab" for k in rng.sample(range(-500, 100_000), 60)]
    df = spark.createDataFrame(rows, "g string, k long, n long")
    got = {(r.g, r.k): r.offset for r in ordinal.running_offsets(df, "k", "n", ["g"], bits).collect()}
    for g, k, _ in rows:
        assert got[g, k] == sum(n for h, j, n in rows if h == g and j < k)


def test_running_offsets_of_nothing(spark):
    empty = spark.createDataFrame([], "k long, n long")
    assert ordinal.running_offsets(empty, "k", "n").collect() == []


def test_global_rank(spark):
    rng = random.Random(2)
    rows = [(f"t{i}", rng.randint(1, 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "token string, freq long").repartition(7)
    ranked = ordinal.global_rank(df, [F.desc("freq"), F.asc("token")]).orderBy("rank").collect()
    assert [r.rank for r in ranked] == list(range(2000))
    assert [r.token for r in ranked] == [t for t, f in sorted(rows, key=lambda r: (-r[1], r[0]))]


def test_hash_rank_is_a_fixed_shuffle(spark):
    ids = spark.range(1000).withColumnRenamed("id", "k")
    one = {r.k: r["rank"] for r in ordinal.hash_rank(ids, "k", 1).collect()}
    again = {r.k: r["rank"] for r in ordinal.hash_rank(ids.repartition(5), "k", 1).collect()}
    other = {r.k: r["rank"] for r in ordinal.hash_rank(ids, "k", 2).collect()}
    assert one == again != other
    assert sorted(one.values()) == list(range(1000))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7, 8, 100])
@pytest.mark.parametrize("parity", [True, False])
def test_positional_split(spark, n, parity):
    lines = [str(i) for i in range(n)]
    docs = [(i, lines[a : a + 3]) for i, a in enumerate(range(0, n, 3))]
    df = spark.createDataFrame(docs, "doc_id long, lines array<string>")
    rows = ordinal.positional_split(df, parity).collect()
    got = {s: [] for s in ("train", "val", "test")}
    for r in sorted(rows, key=lambda r: int(r.text)):
        got[r.split].append(r.text)
    half, quarters, gap = int(n / 2), int(n / 4 * 3), int(parity)
    assert got == {
        "train": lines[:half], "val": lines[half + gap : quarters], "test": lines[quarters + gap :]
    }


@pytest.mark.parametrize("max_rows, heavy_rows", [(1000, 1000), (1, 1), (1, 3), (1, 1000)])
def test_lookup_gives_the_same_by_every_way(spark, max_rows, heavy_rows):
    rng = random.Random(4)
    keys = ["the"] * 300 + [f"w{rng.randint(0, 50)}" for _ in range(200)] + ["gone"] * 50 + [None] * 5
    rows = spark.createDataFrame(list(enumerate(keys)), "i int, token string")
    table = rows.filter("token != 'gone'").groupBy("token").agg(F.count("*").alias("freq"))
    table = table.withColumn("idx", F.xxhash64("token"))
    known = {r.token: r.idx for r in table.collect()}
    got = lookup(rows, table, ["token"], "freq", max_rows=max_rows, heavy_rows=heavy_rows)
    assert got.columns == ["token", "i", "idx"]
    assert sorted((r.i, str(r.idx)) for r in got.collect()) == [
        (i, str(known.get(k))) for i, k in enumerate(keys)
    ]


def test_place_with_repeated_and_far_keys(spark):
    rows = [(1, "a", 2), (1, "b", 1), (2, "c", 5), (-(2**63), "d", 3), (2**63 - 1, "e", 4), (1, "a", 2)]
    df = spark.createDataFrame(rows, "key long, name string, n int")
    placed, total = ordinal.place(df, "key", F.col("n"))
    got = sorted((r.start, r.n) for r in placed.collect())
    assert total == sum(r[2] for r in rows) == 17
    ends = [0]
    for start, n in got:
        assert start == ends[-1]
        ends.append(start + n)
    order = [r.key for r in placed.orderBy("start").collect()]
    assert order == sorted(order) and len(order) == 6


def test_lookup_reads_its_rows_once(spark, tmp_path):
    spark.range(100).selectExpr("id as i", "cast(id % 7 as string) as token").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    table = spark.createDataFrame([(str(k), 100 // (k + 1), k) for k in range(7)], "token string, freq long, idx int")
    joined = lookup(rows, table, ["token"], "freq", max_rows=1, heavy_rows=3)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert sorted((r.i, r.idx) for r in joined.collect()) == [(i, i % 7) for i in range(100)]
