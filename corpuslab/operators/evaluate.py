"""Perplexity, at token and at word level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST_EXPONENT = 709.78  # exp() of anything larger overflows a double


def perplexity_of(loss: Column) -> Column:
    """``exp(loss)``, infinite where that overflows."""
    return F.when(loss > LARGEST_EXPONENT, F.lit(float("inf"))).otherwise(F.exp(loss))


def perplexity(batches: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Perplexities from per-batch sums ``nll``, ``n_tokens`` and ``n_words``.

    ``ppl_word_weighted`` weights each batch's mean loss per *token* by its words;
    ``ppl_word_normalised`` divides the total loss by the total number of words.
    """
    mean = F.col("nll") / F.col("n_tokens")
    return of_sums(batches.groupBy(*by).agg(
        F.count("*").alias("n_batches"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_words").alias("n_words"),
        F.sum("nll").alias("nll"),
        F.sum(mean * F.col("n_words")).alias("weighted"),
    ), by)


def of_sums(sums: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """``perplexity`` from ``n_batches``, the sums of all batches and ``weighted``, the sum of their mean losses times words."""
    tokens, words = F.col("n_tokens"), F.col("n_words")
    return sums.select(
        *by, "n_batches", "n_tokens", "n_words",
        F.round(F.col("nll") / tokens, 6).alias("loss"),
        F.round(perplexity_of(F.col("nll") / tokens), 6).alias("ppl_token"),
        F.round(perplexity_of(F.col("weighted") / words), 6).alias("ppl_word_weighted"),
        F.round(perplexity_of(F.col("nll") / words), 6).alias("ppl_word_normalised"),
    )


def word_shares(batched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes of batches per split, and the words per token of lines whose batch has lines of several sizes.

    ``batched`` has ``n`` tokens a line, markers included, and should be written already. The mean loss of a batch times its words
    is the loss of its lines times its words per token. In a batch of lines of one size these are
    ``(n - 2) / (n - 1)``; the second table has a row for others, by ``split``, ``n``, ``doc_id`` and ``line_no``, with the
    mean of all lines that share these. As lines are batched by size, those are a few batches per size.
    """
    sizes = batched.groupBy("split", "batch").agg(
        F.sum(F.col("n") - 1).alias("n_tokens"), F.sum(F.col("n") - 2).alias("n_words"), (F.min("n") < F.max("n")).alias("mixed")
    )
    whole = sizes.groupBy("split").agg(
        F.count("*").alias("n_batches"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_words").alias("n_words")
    )
    mixed = sizes.where("mixed").select("split", "batch", (F.col("n_words") / F.col("n_tokens")).alias("share"))
    key = ["split", "n", "doc_id", "line_no"]
    wanted = batched.join(mixed, ["split", "batch"]).select(*key).distinct()
    lines = batched.join(wanted, key).join(mixed, ["split", "batch"], "left").groupBy(*key)
    share = F.coalesce("share", (F.col("n") - 2) / (F.col("n") - 1))
    return whole, lines.agg(F.avg(share).alias("share"), F.count("*").alias("lines"))
