"""Reports over lines and tokens: histograms, top words, overlap, sizes, prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.rows import item_rows, list_rows
from corpuslab.functions.tokens import first_word, space_tokens, word_tokens
from corpuslab.operators.lookup import lookup
from corpuslab.session import cut_lineage


def length_histogram(lines: DataFrame) -> DataFrame:
    """How many lines have how many words; empty lines are left out."""
    words = F.size(space_tokens(F.col("text"))).cast("long")
    return (
        lines.filter("text != ''")
        .groupBy(words.alias("n_words"))
        .agg(F.count("*").alias("n_lines"))
        .orderBy("n_words")
    )


def length_summary(histogram: DataFrame) -> DataFrame:
    """The mean of the histogram's counts, and the mean number of words per line."""
    return histogram.agg(
        F.count("*").alias("n_bins"),
        F.sum("n_lines").alias("n_lines"),
        F.round(F.avg("n_lines"), 6).alias("mean_bin_count"),
        F.round(F.sum(F.col("n_words") * F.col("n_lines")) / F.sum("n_lines"), 6).alias(
            "mean_words"
        ),
    )


def top_k(counts: DataFrame, k: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` most frequent tokens, per ``by`` group if given; ties by token."""
    if not by:
        return counts.orderBy(F.desc("freq"), F.asc("token")).limit(k)
    order = Window.partitionBy(*by).orderBy(F.desc("freq"), F.asc("token"))
    ranked = counts.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.filter(F.col("rank") <= k)


def top_k_overlap(truth: DataFrame, runs: DataFrame, k: int = 100) -> DataFrame:
    """Per run, how many of its top ``k`` tokens are in the top ``k`` of ``truth``.

    Both inputs are token counts; ``runs`` has a ``run`` column. A run without a
    shared token is kept, with 0.
    """
    wanted = top_k(truth, k).select("token", F.lit(1).alias("shared"))
    tops = top_k(runs, k, ["run"]).select("run", "token")
    return (
        tops.join(F.broadcast(wanted), "token", "left")
        .groupBy("run")
        .agg(
            F.count("*").alias("n_top"),
            F.coalesce(F.sum("shared"), F.lit(0)).cast("long").alias("overlap"),
        )
    )


def prompts(lines: DataFrame) -> DataFrame:
    """Distinct first words of lines, longer than one character, sorted."""
    return (
        lines.select(first_word(F.col("text")).alias("prompt"))
        .filter(F.length("prompt") > 1)
        .distinct()
        .orderBy("prompt")
    )


def check_prompts(found: DataFrame, vocab: DataFrame) -> DataFrame:
    """Say of each prompt whether a model with this vocabulary can start from it.

    A prompt passes only if all its tokens are known; the first reason against it
    is recorded otherwise.
    """
    listed = cut_lineage(found.withColumn("tokens", word_tokens(F.col("prompt"))))
    flat = list_rows(listed, ["prompt"], "tokens", "token")
    known = lookup(flat, vocab, ["token"], "freq")
    unknown = known.groupBy("prompt").agg(
        F.count_if(F.col("idx").isNull()).alias("n_unknown"),
        F.min(F.when(F.col("idx").isNull(), F.col("pos"))).alias("first_unknown"),
    )
    status = (
        F.when(F.size("tokens") == 0, "no_tokens")
        .when(F.col("first_unknown") == 0, "first_unknown")
        .when(F.col("n_unknown") > 0, "later_unknown")
        .otherwise("ok")
    )
    return listed.join(unknown, "prompt", "left").select(
        "prompt",
        "tokens",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"),
        status.alias("status"),
    )


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row of sizes for documents with an array column ``lines``.

    Tokens are counted per type first, so distinct tokens need no second pass
    over the occurrences.
    """
    lines = item_rows(docs, [], "lines", "text")
    types = (
        item_rows(lines, [], word_tokens(F.col("text")), "token")
        .groupBy("token")
        .agg(F.count("*").alias("freq"))
        .agg(
            F.coalesce(F.sum("freq"), F.lit(0)).alias("n_tokens"),
            F.count("*").alias("n_types"),
            F.coalesce(F.max("freq"), F.lit(0)).alias("max_freq"),
        )
    )
    sizes = docs.agg(
        F.count("*").alias("n_docs"),
        F.coalesce(F.sum(F.size("lines")), F.lit(0)).cast("long").alias("n_lines"),
    )
    both = sizes.unionByName(types, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
