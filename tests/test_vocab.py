import pytest
from pyspark.sql import functions as F

from corpuslab.functions.tokens import char_tokens
from corpuslab.operators import counting, vocab


def token_rows(spark, lists):
    rows = [(i, 0, tokens) for i, tokens in enumerate(lists)]
    return spark.createDataFrame(rows, "doc_id long, line_no long, tokens array<string>")


def test_vocab_order_markers_and_cut(spark):
    lists = [["b", "a", "a", "<BOS>"], ["c", "b", "d"], []]
    counts = vocab.count_tokens(token_rows(spark, lists))
    built = vocab.build_vocab(counts, 2, ["<BOS>", "<EOS>"]).orderBy("idx").collect()
    assert [(r.token, r.idx, r.freq) for r in built] == [
        ("<unk>", 0, 0), ("<BOS>", 1, 0), ("<EOS>", 2, 0), ("a", 3, 2), ("b", 4, 2)
    ]
    plain = vocab.build_vocab(counts, unk=None).orderBy("idx").collect()
    assert [r.token for r in plain] == ["a", "b", "<BOS>", "c", "d"]


@pytest.mark.parametrize("limits", [{}, {"max_rows": 1, "heavy_rows": 2}])
def test_encode_decode_round_trip(spark, limits):
    lists = [["a", "b", "a", "a"], ["c", "a"], ["b"] * 5]
    rows = token_rows(spark, lists)
    known = vocab.build_vocab(vocab.count_tokens(rows), 2)
    coded = vocab.encode(vocab.explode_tokens(rows), known, **limits).drop("token")
    back = vocab.gather(vocab.decode(coded, known, **limits), ["doc_id"], "token")
    got = [r.tokens for r in back.orderBy("doc_id").collect()]
    assert got == [["a", "b", "a", "a"], ["<unk>", "a"], ["b"] * 5]


def lines(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line_no long, text string")


def test_prompts(spark):
    texts = ["I am", "So. what", "So! then", "abc\\ x", "", "alone", '"Q" is', "A b", "..", "two  x"]
    got = [r.prompt for r in counting.prompts(lines(spark, texts)).collect()]
    assert got == ["So", "abc", "alone", "two"]


def test_check_prompts(spark):
    asked = spark.createDataFrame([("ab",), ("ab?zz",), ("zz,ab",), ("77",)], "prompt string")
    known = spark.createDataFrame([("ab", 1, 5), ("?", 2, 1), (",", 3, 1)], "token string, idx long, freq long")
    got = {r.prompt: (r.n_tokens, r.n_unknown, r.status) for r in counting.check_prompts(asked, known).collect()}
    assert got == {
        "ab": (1, 0, "ok"), "ab?zz": (3, 1, "later_unknown"),
        "zz,ab": (3, 1, "first_unknown"), "77": (0, 0, "no_tokens"),
    }


def test_lengths(spark):
    texts = ["a b", "a", "c", "", "  ", "x y z w"]
    histogram = counting.length_histogram(lines(spark, texts))
    assert [tuple(r) for r in histogram.collect()] == [(0, 1), (1, 2), (2, 1), (4, 1)]
    summary = counting.length_summary(histogram).first()
    assert (summary.n_bins, summary.n_lines) == (4, 5)
    assert (summary.mean_bin_count, summary.mean_words) == (1.25, 1.6)


def test_top_k_and_overlap(spark):
    truth = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1)], "token string, freq long")
    assert [r.token for r in counting.top_k(truth, 2).collect()] == ["a", "b"]
    runs = spark.createDataFrame(
        [("x", "c", 9), ("x", "b", 1), ("x", "a", 1), ("y", "q", 2), ("y", "r", 1)],
        "run string, token string, freq long",
    )
    got = {r.run: (r.n_top, r.overlap) for r in counting.top_k_overlap(truth, runs, 2).collect()}
    assert got == {"x": (2, 1), "y": (2, 0)}


def test_corpus_stats_of_empty_corpus(spark):
    empty = spark.createDataFrame([], "doc_id long, lines array<string>")
    assert list(counting.corpus_stats(empty).first()) == [0, 0, 0, 0, 0]


def test_characters_are_counted_without_a_row_each(spark):
    """As ``count_tokens`` counts them; texts that are empty, null or beyond the basic plane included."""
    texts = ["abba", "", None, "a 😀\u00e9😀\n", "\u0000b"] * 300
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = vocab.count_tokens(rows.select(char_tokens(F.col("text")).alias("tokens")))
    found = vocab.count_characters(rows)
    assert sorted(found.collect()) == sorted(plain.collect())
    assert "explode" not in found._jdf.queryExecution().executedPlan().toString()
