"""Grids of runs, and one result row per run."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.rows import item_rows
from corpuslab.functions.tokens import BOS, TOKENIZERS, get_tokenizer, words_in_sequence, words_of_characters
from corpuslab.operators import pair_counts
from corpuslab.operators.evaluate import perplexity_of
from corpuslab.session import cut_lineage


def run_grid(runs: DataFrame, choices: Sequence[str], name: str) -> DataFrame:
    """Every run with every choice, whether or not results for it exist."""
    listed = F.explode(F.array(*[F.lit(c) for c in choices]))
    return runs.distinct().withColumn(name, listed)


def summarise_runs(epochs: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Final and best validation result and the usual seconds of each run.

    ``epochs`` has ``epoch``, ``val_ppl``, ``train_ppl`` and ``seconds``. The best
    epoch is the first with the lowest value; the median ignores odd epochs.
    """
    return epochs.groupBy(*by).agg(
        F.count("*").alias("n_epochs"),
        F.max("epoch").alias("last_epoch"),
        F.max_by("val_ppl", "epoch").alias("final_val_ppl"),
        F.max_by("train_ppl", "epoch").alias("final_train_ppl"),
        F.min("val_ppl").alias("best_val_ppl"),
        F.min_by("epoch", F.struct("val_ppl", "epoch")).alias("best_epoch"),
        F.avg("seconds").alias("mean_seconds"),
        F.median("seconds").alias("median_seconds"),
    )


def compare_models(
    lines: DataFrame, tokenizers: Sequence[str], alpha: float = 1.0
) -> DataFrame:
    """Fit next-token tables of order 1 and 2 on ``train``, score train and ``val``.

    All tokenizers are counted in one pass, see ``pair_losses``. One row per model and tokenizer.
    """
    tokens = F.array(*[_tokens_of(t, lambda text, t=t: get_tokenizer(t)(text)) for t in tokenizers])
    flat = item_rows(lines, ["split"], tokens, "t").select("split", "t.*")
    part = F.when(F.col("split") == "train", 1).when(F.col("split") == "val", 0).otherwise(2)
    rows = flat.select("tokenizer", "tokens", "text", part.alias("part"), F.lit(0.0).alias("weight"), F.lit(0).alias("words"))
    results = pair_losses(rows, 1, alpha)
    return results.select(
        F.concat_ws("-", "model", "tokenizer").alias("run"),
        "model",
        "tokenizer",
        "vocab_size",
        "train_tokens",
        "val_tokens",
        F.round(perplexity_of(F.col("train1") / F.col("train_tokens")), 6).alias("train_ppl"),
        F.round(perplexity_of(F.col("val1") / F.col("val_tokens")), 6).alias("val_ppl"),
    )


def _tokens_of(name: str, rule: Callable[[Column], Column], *others: Column) -> Column:
    """A tokenizer's name with the tokens of ``text``; characters stay in the ``text``, which is their list already."""
    in_text = name == "char"
    none = F.lit(None).cast("array<string>")
    return F.struct(
        F.lit(name).alias("tokenizer"),
        (none if in_text else rule(F.col("text"))).alias("tokens"),
        (F.col("text") if in_text else F.lit(None).cast("string")).alias("text"),
        *others,
    )


def pair_losses(rows: DataFrame, shares: int, alpha: float, scored: int | None = None) -> DataFrame:
    """Total losses of both models, fitted on growing shares of the training lines, per tokenizer.

    ``rows`` are a line's ``tokenizer`` and ``tokens`` (or ``text``, if those are its characters), its ``part``, 0 for
    validation, 1 to ``shares`` for training and one more for lines that are in the vocabulary only, the ``weight`` of
    each of its pairs and its ``words``; begin and end markers are put around the tokens here. Rows without a list do not count.

    The loss of a pair is ``log(total + alpha * size) - log(n + alpha)``. The second part is added up over
    distinct pairs, where they are summed (``pair_counts``). The first depends on the token before only, by
    its total, and there are few different totals: sums per total wait for the size of the vocabulary. So lines are read and
    cut into tokens once, and neither pairs nor tokens are written.

    A row per model and tokenizer: ``vocab_size``, ``train_tokens``, ``val_tokens``, ``val_words``, and for each share ``e``
    ``train{e}`` and ``val{e}``, over the training lines of the first ``scored`` shares (all) and over validation, ``weighted{e}``, that by weights, and
    ``train_weighted{e}``, the losses of all other lines by theirs.
    """
    scored = shares if scored is None else scored
    found = cut_lineage(pair_counts.losses(rows, shares, alpha, scored))
    fits = range(1, shares + 1)
    names = [(s, e) for e in fits for s in pair_counts.SUMS]
    of = lambda kind: F.col("kind") == kind
    logs = lambda kind: [F.sum(F.when(of(kind), F.col(f"{s}{e}"))).alias(f"log_{kind}_{s}{e}") for s, e in names]
    follows = of(pair_counts.FOLLOWS)
    sizes = found.groupBy("tokenizer").agg(
        F.coalesce(F.sum(F.when(follows, F.col("n"))), F.lit(0)).alias("vocab_size"),
        *[F.coalesce(F.sum(F.when(follows, F.col(f"n{e}"))), F.lit(0)).alias(f"n{e}") for e in fits],
        F.coalesce(F.sum(F.when(follows, F.col("m"))), F.lit(0)).alias("val_tokens"),
        *[F.coalesce(F.sum(F.when(follows, F.col(c))), F.lit(0.0)).alias(c) for c in ("weight", "train_weight")],
        F.coalesce(F.sum(F.when(of(pair_counts.LINES), F.col("m"))), F.lit(0)).alias("val_words"),
        *logs(pair_counts.PAIRS), *logs(pair_counts.FOLLOWS),
    )
    smooth = alpha * F.col("vocab_size")
    totals = {"train": F.col(f"n{scored}"), "val": F.col("val_tokens"), "weighted": F.col("weight"), "train_weighted": F.col("train_weight")}
    before = found.where(of(pair_counts.BEFORE)).join(F.broadcast(sizes.select("tokenizer", "vocab_size")), "tokenizer")
    over = before.groupBy("tokenizer").agg(
        *[F.sum(F.when(F.col("fit") == e, F.col(f"{s}{e}") * F.log(F.col("total") + smooth))).alias(f"over_{s}{e}") for s, e in names]
    )

    def model(name: str, loss: Callable[[str, int], Column]) -> Column:
        return F.struct(F.lit(name).alias("model"), *[loss(s, e).alias(f"{s}{e}") for s, e in names])

    models = F.array(
        model("bigram", lambda s, e: F.col(f"over_{s}{e}") - F.col(f"log_{pair_counts.PAIRS}_{s}{e}")),
        model("unigram", lambda s, e: totals[s] * F.log(F.col(f"n{e}") + smooth) - F.col(f"log_{pair_counts.FOLLOWS}_{s}{e}")),
    )
    counts = ["tokenizer", "vocab_size", F.col(f"n{shares}").alias("train_tokens"), "val_tokens", "val_words"]
    return sizes.join(over, "tokenizer").select(*counts, F.explode(models).alias("x")).select(
        "tokenizer", "vocab_size", "train_tokens", "val_tokens", "val_words", "x.*"
    )


#: How the words of a token list are counted, by tokenizer.
MODES = {"char": "char", "space": "word", "word": "word", "byte-pair": "byte-level", "subword": "subword"}


def token_lists(learned: dict[str, Column]) -> Column:
    """Every tokenizer's list of a line's ``text``, with its number of words, as an array of structs.

    Tokenizers that are column expressions read the text; the lists of ``learned`` ones are columns already. The
    lists are without markers, see ``pair_losses``.
    """
    rules = TOKENIZERS | {name: lambda _, found=found: found for name, found in learned.items()}

    def words(name: str, rule: Callable[[Column], Column]) -> Column:
        if name == "char":
            return words_of_characters(F.col("text"))
        return words_in_sequence(F.concat(F.array(F.lit(BOS)), rule(F.col("text"))), MODES[name])

    return F.array(*[_tokens_of(name, rule, words(name, rule).alias("words")) for name, rule in rules.items()])


def learning_curves(lines: DataFrame, lists: str, shares: int = 4, alpha: float = 1.0) -> DataFrame:
    """Next-token tables of order 1 and 2 fitted on growing shares of the training lines.

    ``lines`` has ``split`` (``train`` or ``val``), ``share`` (1 to ``shares``, for training lines) and ``lists``,
    see ``token_lists``. Epoch ``e`` fits on the shares up to ``e``. All tokenizers, epochs and models are read
    off one pass over the lines, see ``pair_losses``. The words of a line are divided by its pairs as their weight,
    so that they add up to words. The vocabulary is that of all lines.

    A row per model, tokenizer and epoch: ``val_ppl`` and ``train_ppl`` (over all training lines) per token;
    ``val_ppl_word_weighted`` weights each line's mean loss per token by its words,
    ``val_ppl_word_normalised`` divides the total loss by the total words.
    """
    epochs = range(1, shares + 1)
    flat = item_rows(lines, ["split", "share"], lists, "t").select("split", "share", "t.*")
    in_share = F.when(F.col("share") <= shares, F.greatest(F.col("share"), F.lit(1)))
    part = F.coalesce(F.when(F.col("split") == "train", in_share).when(F.col("split") == "val", 0), F.lit(shares + 1))
    pairs = F.coalesce(F.size("tokens"), F.length("text")) + 1
    weight = F.when(F.col("split") == "val", F.col("words") / pairs).otherwise(0.0)
    found = pair_losses(
        flat.select("tokenizer", "tokens", "text", part.alias("part"), weight.alias("weight"), "words"),
        shares, alpha,
    )

    by = ["model", "tokenizer", "vocab_size", "val_tokens", "val_words"]
    curve = F.array(
        *[F.struct(F.lit(e).cast("long").alias("epoch"), *[F.col(f"{c}{e}").alias(c) for c in pair_counts.SUMS]) for e in epochs]
    )
    rows = found.select(*by, "train_tokens", F.explode(curve).alias("x"))
    ppl = lambda loss, by: F.round(perplexity_of(F.col(loss) / F.col(by)), 6)
    # A word of many tokens has a large perplexity, so it is taken from a rounded loss.
    per_word = lambda loss: F.round(perplexity_of(F.round(F.col(loss) / F.col("val_words"), 6)), 2)
    return rows.select(
        F.concat_ws("-", "model", "tokenizer").alias("run"), *by, "train_tokens", "x.epoch",
        ppl("x.train", "train_tokens").alias("train_ppl"),
        ppl("x.val", "val_tokens").alias("val_ppl"),
        per_word("x.weighted").alias("val_ppl_word_weighted"),
        per_word("x.val").alias("val_ppl_word_normalised"),
    )
