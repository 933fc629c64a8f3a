import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import evaluate, experiments, ngrams, sequences, vocab

BOS, EOS = "<BOS>", "<EOS>"


def pair_rows(spark, lists, split="train"):
    rows = [(split, i, 0, [BOS, *t, EOS]) for i, t in enumerate(lists)]
    df = spark.createDataFrame(rows, "split string, doc_id long, line_no long, tokens array<string>")
    return sequences.next_token_pairs(df)


def plain_counts(lists):
    counts = defaultdict(Counter)
    for t in lists:
        for a, b in zip([BOS, *t], [*t, EOS]):
            counts[a][b] += 1
    return counts


def random_lists(seed, n=60):
    rng = random.Random(seed)
    return [[rng.choice("aaabcdef") for _ in range(rng.randint(0, 8))] for _ in range(n)]


@pytest.mark.parametrize("limits", [{}, {"max_rows": 1, "heavy_rows": 3}])
def test_scores(spark, limits):
    train, val = random_lists(1), random_lists(2, 20) + [["z", "a"]]
    pairs = pair_rows(spark, train).unionByName(pair_rows(spark, val, "val"))
    table = ngrams.score_table(pairs, F.col("split") == "train", alpha=0.5)
    got = ngrams.score(pairs.filter("split = 'val'"), table, **limits).collect()
    counts = plain_counts(train)
    size = len({t for l in train + val for t in l} | {EOS})
    assert len(got) == sum(len(t) + 1 for t in val)
    for r in got:
        p = (counts[r.prev][r.next] + 0.5) / (sum(counts[r.prev].values()) + 0.5 * size)
        assert r.nll == pytest.approx(-math.log(p))


def test_top_successors(spark):
    bigrams = spark.createDataFrame(
        [("a", "x", 3), ("a", "y", 3), ("a", "z", 9), ("b", "x", 1)], "prev string, next string, n long"
    )
    got = {(r.prev, r["rank"]): r.next for r in ngrams.top_successors(bigrams).collect()}
    assert got == {("a", 1): "z", ("a", 2): "x", ("b", 1): "x"}


def plain_greedy(counts, tokens, steps, policy):
    path = []
    for _ in range(steps):
        last = (tokens + path)[-1]
        options = {t: n for t, n in counts.get(last, {}).items() if policy == "stop_at_eos" or t != EOS}
        if not options:
            break
        path.append(min(options, key=lambda t: (-options[t], t)))
    return path


@pytest.mark.parametrize("policy", ["stop_at_eos", "suppress_eos"])
@pytest.mark.parametrize("steps", [0, 1, 5, 12, 50])
def test_greedy(spark, policy, steps):
    lists = random_lists(3) + [["only", "end"], ["end"]]
    bigrams = ngrams.count_bigrams(pair_rows(spark, lists))
    asked = [["a"], ["b", "c"], ["only"], ["end"], ["stranger"]]
    prompts = spark.createDataFrame([(str(t), t) for t in asked], "prompt string, tokens array<string>")
    found = ngrams.generate_greedy(prompts, bigrams, steps, policy).collect()
    counts = plain_counts(lists)
    assert len(found) == len(asked)
    for r in found:
        assert list(r.generated) == plain_greedy(counts, r.tokens, steps, policy)


def test_greedy_beyond_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "fits_broadcast", lambda *_: False)
    test_greedy(spark, policy="suppress_eos", steps=13)


@pytest.mark.parametrize("steps", [0, 1, 3, 4, 9, 50])
def test_reachable_successors(spark, steps):
    """Each token that a walk comes to once, with all of a cycle, and nothing else."""
    rng = random.Random(6)
    after = {i: rng.randrange(0, 400) for i in range(300)} | {i: i + 1 for i in range(1000, 1012)} | {2000: 2001, 2001: 2000}
    asked = [5, 9, 1000, 2001, 250, 399, 7000]
    rows = spark.createDataFrame([(str(a), str(b)) for a, b in after.items()], "prev string, next string")
    starts = spark.createDataFrame([(str(a),) for a in asked], "start string")
    got = [(int(r.prev), int(r.next)) for r in ngrams.reachable(rows, starts, steps).collect()]
    want, at = set(), set(asked)
    for _ in range(steps):
        want |= {(t, after[t]) for t in at if t in after}
        at = {after[t] for t in at if t in after}
    assert len(got) == len(set(got)) and set(got) == want


def test_unknown_policy(spark):
    with pytest.raises(ValueError):
        ngrams.best_successor(spark.createDataFrame([], "prev string, next string, n long"), "x")


def plain_sample(counts, order, prompt, tokens, sample, limit, seed):
    tokens = list(tokens)
    while len(tokens) < limit and tokens[-1] in counts:
        options = sorted(counts[tokens[-1]].items(), key=lambda o: order.get(o[0], -1))
        text = f"{seed}|{prompt}|{sample}|{len(tokens)}"
        drawn = int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % sum(n for _, n in options)
        for token, n in options:
            drawn -= n
            if drawn < 0:
                break
        if token == EOS:
            break
        tokens.append(token)
    return tokens


def test_sampled(spark):
    lists = random_lists(4, 200)
    pairs = pair_rows(spark, lists)
    bigrams = ngrams.count_bigrams(pairs)
    counts = pairs.filter(F.col("next") != EOS).groupBy(F.col("next").alias("token")).agg(
        F.count("*").alias("freq")
    )
    known = vocab.build_vocab(counts, 0, [BOS, EOS])
    order = {r.token: r.idx for r in known.collect()}
    asked = [["a"], ["b", "c"], ["nowhere"]]
    prompts = spark.createDataFrame([(str(t), t) for t in asked], "prompt string, tokens array<string>")
    found = ngrams.generate_sampled(prompts, bigrams, known, 3, 9, seed=5).collect()
    assert len(found) == 9
    plain = plain_counts(lists)
    for r in found:
        tokens = next(t for t in asked if str(t) == r.prompt)
        assert r.tokens == plain_sample(plain, order, r.prompt, tokens, r.sample_no, 9, 5)


def test_perplexity_definitions(spark):
    rows = [("val", 0, 10.0, 5, 2), ("val", 1, 6.0, 2, 4), ("zero", 0, 0.0, 3, 3), ("huge", 0, 3000.0, 3, 1)]
    df = spark.createDataFrame(rows, "split string, batch int, nll double, n_tokens long, n_words long")
    got = {r.split: r for r in evaluate.perplexity(df).collect()}
    val = got["val"]
    assert val.loss == round(16 / 7, 6)
    assert val.ppl_token == round(math.exp(16 / 7), 6)
    assert val.ppl_word_weighted == round(math.exp((2 * 2 + 3 * 4) / 6), 6)
    assert val.ppl_word_normalised == round(math.exp(16 / 6), 6)
    assert got["zero"].ppl_token == 1.0
    assert got["huge"].ppl_token == math.inf


def test_compare_models(spark):
    rows = [("train", "ab ab"), ("train", "b"), ("val", "ab c")]
    lines = spark.createDataFrame(rows, "split string, text string")
    got = {r.run: r for r in experiments.compare_models(lines, ["word"]).collect()}
    train, val = [["ab", "ab"], ["b"]], [["ab", "c"]]
    size = len({"ab", "b", "c", EOS})
    counts = plain_counts(train)
    ones = Counter(t for l in train for t in [*l, EOS])
    two = one = 0.0
    for a, b in zip([BOS, "ab", "c"], ["ab", "c", EOS]):
        two -= math.log((counts[a][b] + 1) / (sum(counts[a].values()) + size))
        one -= math.log((ones[b] + 1) / (sum(ones.values()) + size))
    assert got["bigram-word"].val_ppl == round(math.exp(two / 3), 6)
    assert got["unigram-word"].val_ppl == round(math.exp(one / 3), 6)
    assert got["bigram-word"].vocab_size == size and got["bigram-word"].train_tokens == 5


def test_run_grid_keeps_runs_without_results(spark):
    runs = spark.createDataFrame([("a",), ("b",), ("a",)], "model string")
    got = {tuple(r) for r in experiments.run_grid(runs, ["x", "y"], "tokenizer").collect()}
    assert got == {("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")}


def test_summarise_runs(spark):
    rows = [("r", 0, 9.0, 9.5, 10.0), ("r", 1, 4.0, 4.5, 6000.0), ("r", 2, 4.0, 3.5, 11.0), ("r", 3, 5.0, 3.0, 12.0)]
    df = spark.createDataFrame(rows, "run string, epoch int, val_ppl double, train_ppl double, seconds double")
    r = experiments.summarise_runs(df).first()
    assert (r.n_epochs, r.last_epoch, r.final_val_ppl, r.final_train_ppl) == (4, 3, 5.0, 3.0)
    assert (r.best_val_ppl, r.best_epoch, r.median_seconds) == (4.0, 1, 11.5)


def test_sampling_table_is_laid_out_once(spark, monkeypatch):
    """Beyond the broadcast limit a step moves its state only: one exchange a step, and the table is not sorted again."""
    monkeypatch.setattr(ngrams, "fits_broadcast", lambda *_: False)
    bigrams = ngrams.count_bigrams(pair_rows(spark, random_lists(4, 200)))
    known = vocab.build_vocab(bigrams.groupBy(F.col("next").alias("token")).agg(F.sum("n").alias("freq")), 0)
    prompts = spark.createDataFrame([("a", ["a"]), ("b", ["b"])], "prompt string, tokens array<string>")
    found = ngrams.generate_sampled(prompts, bigrams, known, 2, 4, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3
    assert plan.count("Exchange hashpartitioning(prev#") == 3 == plan.count("- Sort [prev#")
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_sampled_beyond_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "fits_broadcast", lambda *_: False)
    test_sampled(spark)
