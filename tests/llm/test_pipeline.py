"""The registered queries on the small tables, and the pipeline stage by stage."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402
from corpuslab.llm.oracle import ORACLE  # noqa: E402
from corpuslab.llm.queries import QUERIES  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_give_what_sql_gives(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    expected, got = con.sql(ORACLE[name]).df(), QUERIES[name](spark, SMALL).toPandas()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    rows = [sorted(map(tuple, t[columns].values.tolist())) for t in (expected, got)]
    assert rows[0] == rows[1]


def test_queries_give_a_row_for_each_row(spark):
    counts = {"op1_byte_pairs": 200, "op2_main_text": 50, "op3_token_files": 200, "op5_url_filter": 50, "op7_simhash": 200}
    for name, count in counts.items():
        assert QUERIES[name](spark, SMALL).count() == count


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SMALL)
        if number < 4:
            assert made.columns == columns
        made.write.parquet(f"{tmp_path}/{number}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{number}")
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        assert docs.select("doc_id").distinct().count() == docs.count() > 0
    assert docs.where("n_tokens != size(ids)").count() == 0
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rated = spark.read.parquet(f"{tmp_path}/0").join(labels, "doc_id", "right")
    clean = rated.where("toxic = 0 and quality = 1")
    assert clean.where("text is null").count() <= 0.1 * clean.count()


def test_pipeline_takes_an_empty_table(spark, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_and_repeated_numbers_keep_their_documents(spark):
    """Stages 2 and 3 on rows that share a number or have none, against plain Python."""
    from test_operators import plain_components, plain_removal

    from corpuslab.llm import simhash

    rnd = random.Random(11)
    new = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))
    clean, copied, split, other, alone, shared = (new() for _ in range(6))
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [
        (1, clean), (1, clean), (1, clean), (None, new()), (None, alone), (None, alone),
        (3, copied), (None, copied), (5, split), (5, other), (4, other), (6, f"{shared} {passage}"),
        (None, f"{new()} {passage}"), (8, None), (None, ""),
    ]
    rows = [(n, text, len(text or "")) for n, text in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(3)

    prints = [simhash.fingerprint_of((text or "").encode()) for _, text, _ in rows]
    near = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2]
    component = plain_components(near, set(prints))
    best = {}
    for row, fingerprint in zip(rows, prints, strict=True):
        root = component[fingerprint]
        best[root] = min(best.get(root, row), row, key=lambda r: (r[0] is None, r[0] or 0))
    first = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert first.columns == docs.columns
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(map(tuple, first.collect()), key=order) == sorted(best.values(), key=order)

    kept = list(best.values())
    removed = plain_removal([text for _, text, _ in kept], 35)
    expected = [
        (n, said if gone else text)
        for (n, text, _), (words, gone, said) in zip(kept, removed, strict=True)
        if not gone or gone < words
    ]
    done = corpus_pipeline.drop_repeats(spark, first, "").select("doc_id", "text").collect()
    assert sorted(map(tuple, done), key=order) == sorted(expected, key=order)


def test_columns_named_like_results_stay(spark, tmp_path):
    """No stage overwrites a column of the documents that has the name of one of its results."""
    names = "tails accepted expected_grade n_words n_removed kept hits items n_hit contaminated whole doc row a.b".split()
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plain = docs
    for name in names:
        docs = docs.withColumn(name, F.lit("old"))
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        made, expected = stage(spark, docs, SMALL), stage(spark, plain, SMALL)
        assert made.columns == docs.columns and [f.dataType for f in made.schema] == [f.dataType for f in docs.schema]
        rows, want = made.collect(), expected.collect()
        assert all(r[n] == "old" for r in rows for n in names)
        assert sorted((r.doc_id, r.text, r.n_chars) for r in rows) == sorted((r.doc_id, r.text, r.n_chars) for r in want)


def test_without_ratings_all_documents_stay(spark, tmp_path):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    labels.selectExpr("doc_id", "cast(null as int) quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert corpus_pipeline.keep_good(spark, docs, str(tmp_path)).count() == docs.count()
