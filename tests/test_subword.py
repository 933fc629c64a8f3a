import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslab.functions.bytelevel import printable_bytes
from corpuslab.operators import subword
from corpuslab.operators.merge_round import RunMerges
from corpuslab.plans import models
from corpuslab.session import cut_lineage


def line_rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "line_no long, text string")


def random_texts(seed, letters="abcd", n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 7)))
    return [" ".join(word() for _ in range(rng.randint(1, 9))) for _ in range(n)]


def library_tokenizer(texts, size):
    """An independent trainer for the same kind of tokenizer."""
    from tokenizers.implementations import ByteLevelBPETokenizer

    trained = ByteLevelBPETokenizer()
    trained.train_from_iterator(
        texts, vocab_size=size, min_frequency=2, special_tokens=["<|endoftext|>"], show_progress=False
    )
    return trained


def merges_of(trained):
    import json

    merges = json.loads(trained._tokenizer.to_str())["model"]["merges"]
    return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]


CORPORA = {
    "random": (random_texts(1), 320),
    "self pairs": (["aaaa aaa aaaaa", "aa aaaa b"], 300),
    "two ways to one string": (["abc abc ab bc abc", "bc ab abc cab bca"] * 3, 300),
    "one symbol": (["a b c", "a"], 300),
    "wide": (random_texts(2, "aàé€😀z'", 30), 330),
    "real size": (random_texts(3, "etaoin shrdlu", 150), 360),
}


@pytest.mark.parametrize("name", list(CORPORA))
def test_training_and_encoding_match_a_library(spark, name):
    pytest.importorskip("tokenizers")
    texts, size = CORPORA[name]
    lines = line_rows(spark, texts)
    merges, table = subword.train_bpe(subword.piece_counts(lines), size)
    trained = library_tokenizer(texts, size)
    got = [(r.left, r.right) for r in merges.orderBy("rank").collect()]
    assert got == merges_of(trained)
    assert {r.token: r.idx for r in table.collect()} == trained.get_vocab()
    coded = subword.encode_bpe(lines, ["line_no"], merges).orderBy("line_no").collect()
    assert [r.tokens for r in coded] == [trained.encode(t).tokens for t in texts]


@pytest.mark.parametrize("candidates", [1, 3, 2_048])
def test_rounds_with_several_merges_equal_one_at_a_time(spark, monkeypatch, candidates):
    texts = random_texts(5, "abcdefgh", 120)
    pieces = subword.piece_counts(line_rows(spark, texts))
    monkeypatch.setattr(subword, "CANDIDATES", candidates)
    got = subword.train_bpe(pieces, 300)[0].orderBy("rank").collect()
    assert [(r.left, r.right) for r in got] == merges_of(library_tokenizer(texts, 300))


def test_rounds_agree_with_a_recount_after_each_merge():
    rng = random.Random(11)
    for case in range(300):
        letters = "abcdefghij"[: rng.choice([2, 3, 6, 10])]
        words = Counter("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(40))
        most = rng.choice([2, 5, 30, 1_000])
        ranked = Counter()
        for word, n in words.items():
            for i in range(len(word) - 1):
                ranked[word[i : i + 2]] += n
        leading = sorted(ranked.items(), key=lambda p: (-p[1], p[0]))[:most]
        lead = dict(leading)
        triples = Counter()
        for word, n in words.items():
            for i in range(len(word) - 2):
                if word[i : i + 2] in lead and word[i + 1 : i + 3] in lead:
                    triples[word[i : i + 3]] += n
        taken, sign = subword.MergeRound(lead, triples), 0x10000
        whole = len(leading) == len(ranked)
        while (best := taken.best()) is not None:
            pair, count = best
            if not count or not whole and (-count, pair) > (-leading[-1][1], leading[-1][0]):
                break
            now = Counter()
            for word, n in words.items():
                for i in range(len(word) - 1):
                    now[word[i : i + 2]] += n
            assert (pair, count) == min(now.items(), key=lambda p: (-p[1], p[0]))
            if pair[0] == pair[1]:
                break
            taken.merge(pair, chr(sign))
            words = Counter({w.replace(pair, chr(sign)): n for w, n in words.items()})
            sign += 1


def test_runs_give_what_a_recount_after_each_merge_gives():
    rng = random.Random(12)
    for _ in range(200):
        letters = "abcdefghij"[: rng.choice([2, 3, 6, 10])]
        words = Counter("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(40))
        ranked = Counter()
        for word, n in words.items():
            for i in range(len(word) - 1):
                ranked[word[i : i + 2]] += n
        leading = sorted(ranked.items(), key=lambda p: (-p[1], p[0]))[: rng.choice([1, 4, 20, 1_000])]
        known, runs = dict(leading), Counter()
        for word, n in words.items():
            cut = "".join(c + ("" if word[i : i + 2] in known else " ") for i, c in enumerate(word))
            runs.update({run: 0 for run in cut.split()})
            for run in cut.split():
                runs[run] += n
        taken, sign = RunMerges({r: n for r, n in runs.items() if len(r) > 1}), 0x10000
        while (best := taken.best()) is not None:
            pair, count = best
            if len(leading) < len(ranked) and (-count, pair) > (-leading[-1][1], leading[-1][0]):
                break
            now = Counter()
            for word, n in words.items():
                for i in range(len(word) - 1):
                    now[word[i : i + 2]] += n
            assert (pair, count) == min(now.items(), key=lambda p: (-p[1], p[0]))
            taken.merge(pair, chr(sign))
            words = Counter({w.replace(pair, chr(sign)): n for w, n in words.items()})
            sign += 1


@pytest.mark.parametrize("runs, rounds", [(100_000, 2), (25, 60)])
def test_a_round_takes_all_merges_that_its_runs_hold(spark, monkeypatch, runs, rounds):
    """Few rounds also where pairs overlap and repeat their symbols; few runs only make more rounds."""
    texts = random_texts(9, "abc", 100) + ["aaaaaaa aaaa bbbbb ababab"] * 3
    written = []
    monkeypatch.setattr(subword, "RUNS", runs)
    monkeypatch.setattr(subword, "PLACES", runs * 10)
    monkeypatch.setattr(subword, "cut_lineage", lambda df: written.append(df) or cut_lineage(df))
    merges, _ = subword.train_bpe(subword.piece_counts(line_rows(spark, texts)), 300)
    assert [(r.left, r.right) for r in merges.orderBy("rank").collect()] == merges_of(library_tokenizer(texts, 300))
    assert len(written) <= 1 + rounds


def test_min_frequency_stops_training(spark):
    merges, table = subword.train_bpe(subword.piece_counts(line_rows(spark, ["ab cd ef"])), 400)
    assert merges.count() == 0 and table.count() == 257


def test_tokenizer_tables_round_trip(spark, tmp_path):
    merges, table = subword.train_bpe(subword.piece_counts(line_rows(spark, ["abab abab"])), 259)
    subword.save_tokenizer(merges, table, str(tmp_path / "t"))
    again, vocab = subword.load_tokenizer(spark, str(tmp_path / "t"))
    assert sorted(again.collect()) == sorted(merges.collect())
    assert vocab.count() == 259


def test_longest_match(spark):
    rows = spark.createDataFrame(
        [(0, ["unaffable", "aff", "xyz", "un"]), (1, ["a" * 101]), (2, ["affun"])],
        "line_no long, tokens array<string>",
    )
    entries = ["un", "##aff", "##able", "aff", "##un", "a", "##a"]
    vocab = spark.createDataFrame([(e,) for e in entries], "token string")
    got = subword.encode_longest_match(rows, ["line_no"], vocab).orderBy("line_no").collect()
    assert [r.tokens for r in got] == [
        ["un", "##aff", "##able", "aff", "[UNK]", "un"], ["[UNK]"], ["aff", "##un"]
    ]


def test_vocabulary_sizes_are_checked(spark, monkeypatch):
    monkeypatch.setattr(subword, "MAX_VOCAB", 2)
    with pytest.raises(ValueError):
        subword.train_bpe(subword.piece_counts(line_rows(spark, ["a"])), 300)


def test_longest_match_of_nothing(spark):
    rows = spark.createDataFrame([(0, ["ab", ""])], "line_no long, tokens array<string>")
    vocab = spark.createDataFrame([], "token string")
    assert subword.encode_longest_match(rows, ["line_no"], vocab).first().tokens == ["[UNK]"]


def test_training_lines_are_cut_on_byte_pairs(spark, tmp_path):
    """Lines keep their first 32 byte-pair tokens, as a library cuts them; blank lines go, empty documents too."""
    pytest.importorskip("tokenizers")
    rng = random.Random(8)
    texts = random_texts(4, "etaoin é😀", 30) + ["", "   ", "\t\n \nlast"] + [" ".join(random_texts(5, n=12))]
    docs = ["\n".join(rng.choice(texts) for _ in range(rng.randint(1, 6))) for _ in range(25)] + ["", None]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    lines = {(i, n): line for i, d in enumerate(docs) if d for n, line in enumerate(d.removesuffix("\n").split("\n"))}
    trained = library_tokenizer(lines.values(), models.ROUND_TRIP_VOCAB)
    want = {k: trained.encode(line).tokens[:32] for k, line in lines.items() if line.strip(" \t")}
    rows = models.block_byte_pairs(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.line_no): r.tokens_text for r in rows} == {k: " ".join(t) for k, t in want.items()}
    assert all(r.n == len(want[r.doc_id, r.line_no]) <= 32 for r in rows) and max(r.n for r in rows) == 32
