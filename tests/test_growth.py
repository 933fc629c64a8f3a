"""Steps that must not grow faster than their input: same rows as before, less moved or worked out."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslab.functions import cleaning, tokens
from corpuslab.operators import experiments, ngrams, ordinal, pair_counts, sequences, subword, vocab
from corpuslab.plans import corpus, models


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def word_docs(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("ab#é🙂") for _ in range(rnd.randrange(7)))
    rows = [(i // 2, [[word() for _ in range(rnd.randrange(4))] for _ in range(3)]) for i in range(60)]
    return spark.createDataFrame([*rows, (None, [["abab"], []]), (3, None), (4, [["a" * 101]])], "doc_id long, lines array<array<string>>")


def test_words_are_cut_in_tasks_as_by_joins(spark, word_docs, monkeypatch):
    entries = ["a", "b", "ab", "#", "##", "##a", "##b", "##ab#", "##🙂", "###", "é", "##é"]
    table = spark.createDataFrame([(e,) for e in entries], "token string")
    key = lambda rows: sorted((str(r.doc_id), str([x or [] for x in r.lines or []])) for r in rows)
    monkeypatch.setattr(subword, "MAX_ENTRIES", 0)
    joined = key(subword.encode_longest_match_lines(word_docs, ["doc_id"], table).collect())
    monkeypatch.undo()
    coded = subword.encode_longest_match_lines(word_docs, ["doc_id"], table)
    assert key(coded.collect()) == joined
    assert "Exchange" not in plan_of(coded)


def test_byte_pairs_are_put_in_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, ["abab é", ""]), (1, None), (None, ["a b"])], "doc_id long, lines array<string>")
    merges = spark.createDataFrame([(0, "a", "b"), (1, "ab", "ab")], "rank long, left string, right string")
    coded = subword.encode_bpe_lines(docs, ["doc_id"], merges)
    assert sorted(str(r.lines) for r in coded.collect()) == sorted(
        [str([["abab", "Ġ", "Ã", "©"], []]), "[]", str([["a", "Â", "ł", "b"]])]
    )
    assert "Exchange" not in plan_of(coded)


def test_pairs_of_tokens_are_not_written(spark, monkeypatch):
    """Only tokens are; a pair's loss is added up where it is counted, and comes out the same."""
    written = []
    cut = experiments.cut_lineage
    monkeypatch.setattr(experiments, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    rows = [("train", "a b a"), ("train", ""), ("val", "b a c")]
    lines = spark.createDataFrame(rows, "split string, text string")
    found = {r.run: r for r in experiments.compare_models(lines, ["word"]).collect()}
    assert written and not any("prev" in columns for columns in written)
    # Seen to follow: a 2, b 1, <EOS> 2; after <BOS>: a 1, <EOS> 1; after a: b 1, <EOS> 1; after b: a 1.
    assert [found["unigram-word"][c] for c in ("vocab_size", "train_tokens", "val_tokens")] == [4, 5, 4]
    assert found["unigram-word"].train_ppl == pytest.approx((3**4 * 2 / 9**5) ** -0.2, abs=1e-6)
    assert found["unigram-word"].val_ppl == pytest.approx((2 * 3 * 1 * 3 / 9**4) ** -0.25, abs=1e-6)
    assert found["bigram-word"].train_ppl == pytest.approx(((2 / 6) ** 4 * (2 / 5)) ** -0.2, abs=1e-6)
    assert found["bigram-word"].val_ppl == pytest.approx(((1 / 6) * (2 / 5) * (1 / 6) * (1 / 4)) ** -0.25, abs=1e-6)


def test_lines_of_a_learning_curve_are_cut_once(spark):
    """One pass over the lines gives all sums; before, tokens and pairs were derived from them in two."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cut(text):
        seen.add(1)
        return text.split()

    rows = [("train", 1, "a b a"), ("train", 2, ""), ("train", None, "d"), ("val", None, "b a c")]
    lines = spark.createDataFrame(rows, "split string, share int, text string").repartition(2)
    lists = experiments.token_lists({"byte-pair": cut("text")}).alias("lists")
    curve = experiments.learning_curves(lines.select("split", "share", lists), "lists", 2)
    found = {(r.model, r.tokenizer, r.epoch): r for r in curve.collect()}
    # A line is read by its tokenizer for its list and for its words.
    assert seen.value <= 2 * len(rows)
    # A training line without a share is in the vocabulary only: a, b, c, d and <EOS>.
    one = found["unigram", "byte-pair", 1]
    assert [one[c] for c in ("vocab_size", "train_tokens", "val_tokens")] == [5, 5, 4]
    # Share 1 is followed to: a 2, b 1, <EOS> 1, so 4; after <BOS>: a 1; after a: b 1, <EOS> 1; after b: a 1.
    assert one.val_ppl == pytest.approx((2 * 3 * 1 * 2 / 9**4) ** -0.25, abs=1e-6)
    assert found["bigram", "byte-pair", 1].val_ppl == pytest.approx(((1 / 6) * (2 / 6) * (1 / 7) * (1 / 5)) ** -0.25, abs=1e-6)
    assert found["bigram", "char", 1].val_words == found["bigram", "space", 1].val_words == 3


def test_perplexity_moves_no_token_rows(spark, folder, monkeypatch):
    """Losses are added up over distinct pairs: neither tokens nor their pairs are written or joined, and the sums stay those of batches."""
    expected = {}
    lines = [r for r in corpus.split_lines_by_position(spark, folder).collect() if r.split in ("train", "val")]
    words = {i: r[0] for i, r in enumerate(spark.createDataFrame([(i, r.text) for i, r in enumerate(lines)], "i int, t string")
             .orderBy("i").select(tokens.wrap(tokens.word_tokens(F.col("t")))).collect())}
    counts, totals, seen = Counter(), Counter(), set()
    for i, r in enumerate(lines):
        for x, y in zip(words[i], words[i][1:]):
            seen.add(y)
            counts[x, y] += r.split == "train"
            totals[x] += r.split == "train"
    for split, size in (("train", 64), ("val", 16)):
        order = sorted((i for i, r in enumerate(lines) if r.split == split), key=lambda i: (len(words[i]), lines[i].doc_id, lines[i].line_no))
        nll, n_tokens, n_words, weighted = 0.0, 0, 0, 0.0
        for start in range(0, len(order), size):
            batch = [words[i] for i in order[start : start + size]]
            loss = sum(math.log((totals[x] + len(seen)) / (counts[x, y] + 1)) for t in batch for x, y in zip(t, t[1:]))
            n, w = sum(len(t) - 1 for t in batch), sum(len(t) - 2 for t in batch)
            nll, n_tokens, n_words, weighted = nll + loss, n_tokens + n, n_words + w, weighted + loss / n * w
        expected[split] = [-(-len(order) // size), n_tokens, n_words, *(round(math.exp(x), 6) for x in (nll / n_tokens, weighted / n_words, nll / n_words))]
    written = []
    for module in (models, ngrams, sequences, experiments):
        if hasattr(module, "cut_lineage"):
            monkeypatch.setattr(module, "cut_lineage", lambda df, cut=module.cut_lineage: written.append(df.columns) or cut(df))
    found = models.perplexity(spark, folder)
    assert not {"tokens", "prev", "next"} & {c for columns in written for c in columns}
    names = ("n_batches", "n_tokens", "n_words", "ppl_token", "ppl_word_weighted", "ppl_word_normalised")
    got = {r.split: [r[c] for c in names] for r in found.collect()}
    assert {s: pytest.approx(v, abs=2e-6) for s, v in expected.items()} == got


@pytest.mark.parametrize("alphabet, width, mode, bounds", [
    ("ab é", 1, "random", ()), ("ab é", 1, "sequential", (0.1, 0.8, True)),
    ("".join(map(chr, range(0x4E00, 0x4E00 + 400))), 2, "sequential", ()), ("a🙂", 4, "random", (3, -4)),
])
def test_streams_of_texts_give_the_batches_of_lists(spark, alphabet, width, mode, bounds):
    """Texts move as a few bytes a character and become numbers at the end, repeated and null keys included."""
    rnd = random.Random(9)
    texts = [(rnd.choice([None, 1, 2, 3, 40]), "".join(rnd.choice(alphabet + "?") for _ in range(rnd.randrange(30)))) for _ in range(40)]
    first = 70_000 if width == 4 else 1  # indexes beyond two bytes
    known = spark.createDataFrame([(c, first + i) for i, c in enumerate(alphabet)], "token string, idx long")
    packed = sequences.PackedCharacters(known)
    assert packed.width == width
    rows = spark.createDataFrame(texts, "doc_id long, ids string").select("doc_id", F.length("ids").alias("n"), "ids")
    lists = rows.withColumn("ids", sequences.code_characters(F.col("ids"), known))
    sizes = "doc_id", 3, 4, mode, 2, 7, *bounds
    expected = sorted(map(tuple, sequences.batches(lists, *sizes).collect()))
    assert expected and sorted(map(tuple, sequences.batches(rows, *sizes, packed=packed).collect())) == expected
    whole = [sorted(map(tuple, sequences.slice_stream(r, "doc_id", 0.1, 0.9, True, packed=p).collect()), key=lambda r: r[1:])
             for r, p in ((lists, None), (rows, packed))]
    assert whole[0] == whole[1]


def test_letters_are_not_written(spark, folder, monkeypatch):
    written = []
    for module in (models, vocab, ordinal):
        if hasattr(module, "cut_lineage"):
            monkeypatch.setattr(module, "cut_lineage", lambda df, cut=module.cut_lineage: written.append(df.columns) or cut(df))
    found = models.random_subsequences(spark, folder)
    assert written and not {"letters", "ids", "text"} & {c for columns in written for c in columns}
    assert found.columns == ["batch", "row", "x_text", "y_text"]


def test_packed_counts_are_those_of_pairs():
    """Kept, packed, split by bucket and added up again, the sums of pairs and tokens are what counting one by one gives."""
    rnd = random.Random(3)
    lines = [[rnd.choice(["a", "b", "c", "é", "🙂", "<BOS>"]) for _ in range(rnd.randrange(6))] for _ in range(400)]
    part, weight = np.array([rnd.randrange(4) for _ in lines]), np.array([rnd.random() for _ in lines])
    expected = {kind: Counter() for kind in (pair_counts.PAIRS, pair_counts.BEFORE, pair_counts.FOLLOWS)}
    for line, p, w in zip(lines, part, weight):
        for x, y in zip(["<BOS>", *line], [*line, "<EOS>"]):
            for kind, key in ((pair_counts.PAIRS, (x, y)), (pair_counts.BEFORE, x), (pair_counts.FOLLOWS, y)):
                expected[kind][key, p] += 1
                expected[kind][key, "train_weight" if p else "weight"] += w
    found = {kind: Counter() for kind in expected}
    task, batches = pair_counts._Task("t", 2, 8), []
    for start, stop in ((0, 5), (5, 12), (12, 200), (200, 400)):
        lists = pa.array(lines[start:stop], pa.list_(pa.string()))
        batches += task.count(lists, None, part[start:stop], weight[start:stop])
    assert task.places.n > 0 and task.held[pair_counts.PAIRS].n > 0
    batches += task.rest()
    for row in pa.Table.from_batches(batches).to_pylist():
        for key, sums in zip(*pair_counts._unpack(row["keys"], row["parts"], row["counts"], row["weights"], row["train_weights"], 2)):
            for p, n in zip([0, 1, 2, 3, "weight", "train_weight"], sums):
                found[row["kind"]][(row["bucket"], key), p] += n
    for kind in expected:
        sums = [sorted(n for n in c[kind].values() if n > 1e-12) for c in (found, expected)]
        assert sums[0] == pytest.approx(sums[1])


def test_pieces_are_cut_from_distinct_parts(spark):
    """The pattern of pieces ran over all of a text; it now runs over its distinct parts, with the same counts."""
    rnd = random.Random(6)
    signs = ["a", "b", "é", "7", "'s", "'", "'ll", "!", " ", "  ", "\t", "\x1c", "\x85", "\u00a0", "\u2003", "\u200b", "\u180e", "\u3000", "🙂", "Ⅷ"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(25))) for _ in range(300)] + [None, "", " ", "it's  it's\t it's "]
    lines = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = lines.select(F.explode(subword.byte_pieces(F.col("text"))).alias("piece")).groupBy("piece").count()
    counts = subword.piece_counts(lines)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, plain.collect()))
    plan = plan_of(counts)
    assert "Exchange hashpartitioning(part#" in plan.split("regexp_extract_all")[-1]


def test_words_are_merged_as_by_one_merge_after_the_other():
    rnd = random.Random(4)
    for _ in range(100):
        symbols, merges = list("abcd"), {}
        for rank in range(rnd.randrange(30)):
            pair = rnd.choice(symbols), rnd.choice(symbols)
            if pair not in merges:
                merges[pair] = rank, "".join(pair)
                symbols.append("".join(pair))
        for _ in range(50):
            word = [rnd.choice("abcdx") for _ in range(rnd.randrange(12))]
            plain = list(word)
            while found := [p for p in zip(plain, plain[1:]) if p in merges]:
                best, done = min(found, key=merges.__getitem__), []
                for symbol in plain:
                    # Two symbols of a pair are merged from the left; what has been merged is no part of the pair.
                    if done and (done[-1], symbol) == best:
                        done[-1] = merges[best][1]
                    else:
                        done.append(symbol)
                plain = done
            assert subword._merge_word(word, merges) == plain


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, "s", f"One line {i}, <b>http://x.org/</b>\n\nTwo (lines) @me of it.\n12") for i in range(20)] + [(20, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_rules_of_a_required_text_run_once(spark, folder):
    rows = spark.createDataFrame([(1, " ", "ab"), (2, "x", "12"), (3, None, None)], "i int, source string, text string")
    kept = cleaning.drop_blank(rows.withColumn("clean", cleaning.clean_strict(F.col("text"))), "clean")
    assert [tuple(r) for r in kept.collect()] == [(1, None, "ab", "ab")]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("https?://") == 1


def test_characters_and_words_are_counted_as_they_are(spark, folder):
    counts = corpus.token_counts(spark, folder)
    assert "named_struct" not in plan_of(counts)
    found = {(r.kind, r.token): r.freq for r in counts.collect()}
    assert (found["char", "@"], found["word", "of"], found["word", "("]) == (20, 20, 20)


def test_what_is_sized_first_is_not_worked_out_twice(spark, folder):
    prepared, labels = corpus.prepared_corpus(spark, folder), models.causal_labels(spark, folder)
    assert "regexp_replace" not in plan_of(prepared) and "MapInArrow" not in plan_of(labels)
    assert prepared.count() == 58 and labels.count() > 0
