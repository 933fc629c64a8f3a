import random

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import bytelevel, tokens
from corpuslab.operators import dictionary, experiments, ordinal, subword, vocab
from corpuslab.sources import corpus


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def docs(spark):
    rnd = random.Random(3)
    rows = [(i, [[rnd.choice("abcdefg") for _ in range(rnd.randrange(5))] for _ in range(rnd.randrange(4))], "x") for i in range(40)]
    rows += [(None, [["a"], [], None], "n"), (7, [["g", "zz"]], "again"), (50, [], "e"), (51, None, "0"), (None, [["b"]], "m")]
    return spark.createDataFrame(rows, "doc_id long, lines array<array<string>>, other string")


def test_lists_are_coded_in_their_rows(spark, docs):
    table = spark.createDataFrame([(c, i, 1) for i, c in enumerate("abcdef")], "token string, idx long, freq long")
    known = {c: i for i, c in enumerate("abcdef")}
    coded = dictionary.code_lists(docs, ["doc_id"], "lines", table, "freq")
    want = [(str(r.doc_id), str([[known.get(t) for t in x or []] for x in r.lines or []]), r.other) for r in docs.collect()]
    assert sorted((str(r.doc_id), str(r.lines), r.other) for r in coded.collect()) == sorted(want)


@pytest.mark.parametrize("most", [0, 2, 4, 100])
def test_only_rare_items_are_shuffled(spark, docs, most):
    """Items of the greatest weights are coded in tasks, all others by a shuffle, with the same result."""
    weights = {"a": 9, "b": 9, "c": 5, "d": 5, "e": 5, "f": 1}
    rows = [(c, i, w) for i, (c, w) in enumerate(weights.items())] + [("zz", None, 9), (None, 77, 9)]
    table = spark.createDataFrame(rows, "token string, idx long, freq long")
    usual, rare = dictionary.common_and_rest(table.where("token is not null and idx is not null"), "freq", max_rows=most)
    want = {0: "", 2: "ab", 4: "ab", 100: "abcdef"}[most]
    assert "".join(sorted(r.token for r in usual.collect())) == want
    assert "".join(sorted(r.token for r in rare.collect())) == "abcdef"[len(want):]
    known = {c: i for i, c in enumerate("abcdef")}
    coded = dictionary.code_lists(docs, ["doc_id"], "lines", table, "freq", max_rows=most)
    lists = [(str(r.doc_id), str([[known.get(t) for t in x or []] for x in r.lines or []]), r.other) for r in docs.collect()]
    assert sorted((str(r.doc_id), str(r.lines), r.other) for r in coded.collect()) == sorted(lists)


def test_lists_come_back_from_their_indexes(spark, docs):
    whole = docs.where("lines is not null").withColumn("lines", F.filter("lines", lambda x: x.isNotNull()))
    words = whole.select(F.explode(F.flatten("lines")).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))
    known = vocab.build_vocab(words)
    coded = vocab.encode_lists(whole, ["doc_id"], "lines", known)
    back = vocab.decode_lists(coded, ["doc_id"], "lines", known)
    assert sorted(map(str, back.collect())) == sorted(map(str, whole.collect()))
    unknown = vocab.encode_lists(whole, ["doc_id"], "lines", known.where("token <> 'a'"), unknown=-9)
    ids = [i for r in unknown.collect() for line in r.lines for i in line]
    letters = [t for r in whole.collect() for line in r.lines for t in line]
    assert ids.count(-9) == letters.count("a") > 0


@pytest.mark.parametrize("cores", [1, 4])
def test_no_shuffle_by_line_or_of_single_tokens(spark, docs, cores):
    """The shuffles go by document and by item, never by line, whatever the number of splits."""
    table = spark.createDataFrame([("a", 1, 1)], "token string, idx long, freq long")
    coded = dictionary.code_lists(docs.coalesce(cores), ["doc_id"], "lines", table, "freq")
    exchanges = [line for line in plan_of(coded).splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("line_no" not in line and "pos" not in line for line in exchanges)


@pytest.mark.parametrize("text", ["é a🙂 b", "", "plain", "漢字\tx", "\x00\x7f\x80"])
def test_bytes_come_back_as_text(spark, text):
    row = spark.createDataFrame([(text,)], "text string").select(
        bytelevel.byte_text(F.array_join(bytelevel.byte_symbols(F.col("text")), "")).alias("t")
    )
    assert row.first().t == text


def test_broken_bytes_become_replacement_signs(spark):
    sign = dict(enumerate(bytelevel.printable_bytes()))
    given = sign[0x61] + sign[0xC3] + sign[0x62] + "漢" + sign[0xE6]
    row = spark.createDataFrame([(given,)], "s string").select(bytelevel.byte_text(F.col("s")).alias("t")).first()
    assert row.t == "a�b�"


def test_byte_pairs_give_back_every_line(spark):
    rows = [(1, ["é der  \t x", "", "🙂🙂 a"]), (2, ["漢字 漢字"]), (3, [])]
    docs = spark.createDataFrame(rows, "doc_id long, lines array<string>")
    lines = docs.select(F.explode("lines").alias("text"))
    merges, _ = subword.train_bpe(subword.piece_counts(lines), 300)
    coded = subword.encode_bpe_lines(docs, ["doc_id"], merges)
    back = coded.select("doc_id", F.transform("lines", lambda t: tokens.join_tokens(t, "byte-level")).alias("lines"))
    assert sorted(map(tuple, back.collect())) == rows


def test_rows_without_a_key_are_placed_first(spark):
    rows = [(None, 2), (None, 3), (4, 5), (1, 1), (4, 2)]
    df = spark.createDataFrame(rows, "doc_id long, n long")
    placed, total = ordinal.place(df, "doc_id", F.col("n"))
    spans = sorted((r.start, r.start + r.n, r.doc_id) for r in placed.collect())
    assert total == 13 and [s for s, _, _ in spans] == [0] + [e for _, e, _ in spans[:-1]]
    assert [d for _, _, d in spans] == [None, None, 1, 4, 4]


def test_lines_are_numbered_where_they_are(spark, tmp_path):
    for name, n in (("a.txt", 5000), ("b.txt", 3)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = corpus.read_lines(spark, str(tmp_path))
        got = {(r.file.rsplit("/", 1)[-1], r.line_no, r.text) for r in lines.collect()}
        assert got == {(f, i, f"{f} {i}") for f, n in (("a.txt", 5000), ("b.txt", 3)) for i in range(n)}
        assert "Exchange hashpartitioning" not in plan_of(lines)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# learning curves


def plain_curve(lines, mode_words, shares):
    """Losses by model and epoch, from lines of ``(split, share, tokens)``."""
    import math
    from collections import Counter

    lists = [(s, e, ["<BOS>", *t, "<EOS>"], mode_words(t)) for s, e, t in lines]
    size = len({t for _, _, w, _ in lists for t in w[1:]})
    found = {}
    for epoch in range(1, shares + 1):
        two, prevs, ones = Counter(), Counter(), Counter()
        for split, share, w, _ in lists:
            if split == "train" and share <= epoch:
                two.update(zip(w, w[1:]))
                prevs.update(w[:-1])
                ones.update(w[1:])
        for model in ("bigram", "unigram"):
            total, weighted, pairs, words = 0.0, 0.0, 0, 0
            for split, _, w, n in lists:
                if split == "val":
                    loss = 0.0
                    for a, b in zip(w, w[1:]):
                        top, below = (two[a, b], prevs[a]) if model == "bigram" else (ones[b], sum(ones.values()))
                        loss -= math.log((top + 1) / (below + size))
                    total, pairs, words = total + loss, pairs + len(w) - 1, words + n
                    weighted += loss / (len(w) - 1) * n
            ppl = round(math.exp(round(weighted / words, 6)), 2), round(math.exp(round(total / words, 6)), 2)
            found[model, epoch] = (round(math.exp(total / pairs), 6), *ppl)
    return found


def test_learning_curves_of_all_tokenizers(spark):
    rnd = random.Random(5)
    words = ["new", "york", "newer", "yorks", "a", "é"]
    texts = [" ".join(rnd.choices(words, k=rnd.randrange(1, 6))) for _ in range(40)]
    merges, _ = subword.train_bpe(subword.piece_counts(spark.createDataFrame([(t,) for t in texts], "text string")), 275)
    table = spark.createDataFrame([(w,) for w in ["new", "york", "a", "é", "##er", "##s"]], "token string")
    rows = [("train" if i % 4 else "val", i % 3 + 1, t, i) for i, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "split string, share int, text string, line_no long")
    pairs = subword.encode_bpe(lines, ["line_no"], merges).withColumnRenamed("tokens", "bp")
    split = lines.select("line_no", tokens.word_tokens(F.col("text")).alias("tokens"))
    parts = subword.encode_longest_match(split, ["line_no"], table).withColumnRenamed("tokens", "sw")
    coded = lines.join(pairs, "line_no").join(parts, "line_no")
    lists = experiments.token_lists({"byte-pair": F.col("bp"), "subword": F.col("sw")})
    held = coded.select("split", "share", lists.alias("lists"), "bp", "sw", "text").cache()
    got = {(r.tokenizer, r.model, r.epoch): r for r in experiments.learning_curves(held, "lists", 3).collect()}
    assert len(got) == 5 * 2 * 3
    count = {
        "word": (lambda r: r.text.split(), len),
        "byte-pair": (lambda r: r.bp, lambda t: "".join(t).count("Ġ") - 1),
        "subword": (lambda r: r.sw, lambda t: len(t) - sum(x.startswith("##") for x in t)),
        "char": (lambda r: list(r.text), lambda t: t.count(" ") + 1),
    }
    for name, (tokens_of, words_of) in count.items():
        listed = [(r.split, r.share, tokens_of(r)) for r in held.collect()]
        for (model, epoch), want in plain_curve(listed, words_of, 3).items():
            row = got[name, model, epoch]
            assert (row.val_ppl, row.val_ppl_word_weighted, row.val_ppl_word_normalised) == pytest.approx(want, rel=1e-5)
    best = {r.run: r for r in experiments.summarise_runs(
        experiments.learning_curves(held, "lists", 3).withColumn("seconds", F.lit(1.0))).collect()}
    assert len(best) == 10 and all(r.n_epochs == 3 and r.last_epoch == 3 for r in best.values())
