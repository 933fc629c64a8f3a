"""Named queries over cleaned lines, tokens, counts and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import cleaning, tokens
from corpuslab.functions.rows import item_rows, list_rows
from corpuslab.operators import counting, experiments, ordinal, vocab
from corpuslab.session import cut_lineage
from corpuslab.sources.corpus import load_table, split_lines, to_lines

MIN_FREQ = 2
TOP = 100


def document_lines(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return to_lines(load_table(spark, folder, "documents", ["doc_id", *columns, "text"]))


def document_arrays(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """One row per document, its lines as an array."""
    docs = load_table(spark, folder, "documents", ["doc_id", *columns, "text"])
    return docs.select("doc_id", *columns, split_lines(F.col("text")).alias("lines"))


def split_lines_by_position(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return ordinal.positional_split(document_arrays(spark, folder, *columns))


def document_vocab(spark: SparkSession, folder: str, min_freq: int = 0) -> DataFrame:
    """Word vocabulary of all documents, begin and end markers reserved."""
    lines = document_lines(spark, folder)
    counts = vocab.count_tokens(lines.select(tokens.word_tokens(F.col("text")).alias("tokens")))
    return vocab.build_vocab(counts, min_freq, [tokens.BOS, tokens.EOS])


def word_rows(spark: SparkSession, folder: str) -> DataFrame:
    lines = document_lines(spark, folder)
    words = tokens.word_tokens(F.col("text")).alias("tokens")
    return vocab.explode_tokens(lines.select("doc_id", "line_no", words))


# scans and unions


def corpus_lines(spark: SparkSession, folder: str) -> DataFrame:
    return document_lines(spark, folder, "source")


def union_corpora(spark: SparkSession, folder: str) -> DataFrame:
    docs = document_lines(spark, folder, "source").select(
        F.lit("documents").alias("corpus"), F.col("doc_id").alias("id"), "source", "line_no", "text"
    )
    talks = to_lines(load_table(spark, folder, "conversations", ["conv_id", "turn", "role", "text"]))
    talks = talks.select(
        F.lit("conversations").alias("corpus"), F.col("conv_id").alias("id"), "turn", "role",
        "line_no", "text",
    )
    return docs.unionByName(talks, allowMissingColumns=True)


# cleaning


def _cleaned(spark: SparkSession, folder: str, rule) -> DataFrame:
    lines = document_lines(spark, folder)
    return lines.select("doc_id", "line_no", rule(F.col("text")).alias("text_clean"))


def clean_general(spark: SparkSession, folder: str) -> DataFrame:
    return _cleaned(spark, folder, cleaning.clean_general)


def clean_strict(spark: SparkSession, folder: str) -> DataFrame:
    return _cleaned(spark, folder, cleaning.clean_strict)


def clean_letters(spark: SparkSession, folder: str) -> DataFrame:
    return _cleaned(spark, folder, cleaning.clean_letters)


def drop_blank(spark: SparkSession, folder: str) -> DataFrame:
    lines = document_lines(spark, folder, "source")
    return cleaning.drop_blank(
        lines.withColumn("text_clean", cleaning.clean_strict(F.col("text"))), "text_clean"
    )


def positional_split(spark: SparkSession, folder: str) -> DataFrame:
    return split_lines_by_position(spark, folder).select("doc_id", "line_no", "split", "text")


def prepared_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Both cleaners, blank lines dropped, then the split, as one flow."""
    arrays = document_arrays(spark, folder)
    rule = lambda line: cleaning.clean_strict(cleaning.clean_general(line))
    cleaned = F.filter(F.transform("lines", rule), lambda line: ~cleaning.is_blank(line))
    # Written, as sizes are taken first: the cleaners cost more than their result takes.
    split = ordinal.positional_split(cut_lineage(arrays.select("doc_id", cleaned.alias("lines"))))
    return split.select("doc_id", "line_no", "split", F.col("text").alias("text_clean"))


# tokenizers


def _tokenized(spark: SparkSession, folder: str, name: str, separator: str) -> DataFrame:
    found = tokens.get_tokenizer(name)(F.col("text"))
    lines = document_lines(spark, folder).select("doc_id", "line_no", found.alias("tokens"))
    return lines.select(
        "doc_id", "line_no", F.size("tokens").cast("long").alias("n_tokens"),
        F.array_join("tokens", separator).alias("tokens_text"),
    )


def tokenize_char(spark: SparkSession, folder: str) -> DataFrame:
    return _tokenized(spark, folder, "char", "|")


def tokenize_space(spark: SparkSession, folder: str) -> DataFrame:
    return _tokenized(spark, folder, "space", " ")


def tokenize_word(spark: SparkSession, folder: str) -> DataFrame:
    return _tokenized(spark, folder, "word", " ")


def words_per_sequence(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    begin = F.array(F.lit(tokens.BOS))
    chars = F.concat(begin, tokens.char_tokens(text))
    marked = F.concat(begin, tokens.char_tokens(F.replace(text, F.lit(" "), F.lit(tokens.WORD_START))))
    words = F.concat(begin, tokens.word_tokens(text))
    pieces = F.concat(begin, tokens.space_tokens(text))
    return document_lines(spark, folder).select(
        "doc_id", "line_no",
        tokens.words_in_sequence(chars, "char").alias("char_words"),
        tokens.words_in_sequence(words, "word").alias("word_words"),
        tokens.words_in_sequence(marked, "byte-level").alias("byte_level_words"),
        tokens.words_in_sequence(pieces, "subword").alias("subword_words"),
    )


# counts


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Characters and words counted by themselves, so that a row in the count is no more than a token."""
    lines = document_lines(spark, folder)
    counts = [
        vocab.count_tokens(lines.select(tokens.get_tokenizer(kind)(F.col("text")).alias("tokens"))).select(
            F.lit(kind).alias("kind"), "token", "freq"
        )
        for kind in ("char", "word")
    ]
    return counts[0].unionByName(counts[1])


def _source_counts(spark: SparkSession, folder: str) -> DataFrame:
    lines = document_lines(spark, folder, "source")
    words = lines.select("source", tokens.word_tokens(F.col("text")).alias("tokens"))
    return vocab.count_tokens(words, by=["source"])


def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _source_counts(spark, folder)


def top_words(spark: SparkSession, folder: str) -> DataFrame:
    lines = document_lines(spark, folder)
    counts = vocab.count_tokens(lines.select(tokens.word_tokens(F.col("text")).alias("tokens")))
    return counting.top_k(counts, TOP)


def topk_words(spark: SparkSession, folder: str) -> DataFrame:
    return counting.top_k(_source_counts(spark, folder), TOP, ["source"])


def topk_overlap(spark: SparkSession, folder: str) -> DataFrame:
    truth = document_lines(spark, folder)
    truth = vocab.count_tokens(truth.select(tokens.word_tokens(F.col("text")).alias("tokens")))
    bench = load_table(spark, folder, "benchmark", ["item_id", "text"])
    talks = load_table(spark, folder, "conversations", ["conv_id", "role", "text"])
    runs = to_lines(bench.select(F.lit("benchmark").alias("run"), "text")).unionByName(
        to_lines(talks.select(F.col("role").alias("run"), "text"))
    )
    runs = runs.select("run", tokens.word_tokens(F.col("text")).alias("tokens"))
    return counting.top_k_overlap(truth, vocab.count_tokens(runs, by=["run"]), TOP)


def length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return counting.length_histogram(document_lines(spark, folder))


def length_summary(spark: SparkSession, folder: str) -> DataFrame:
    return counting.length_summary(length_histogram(spark, folder))


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return counting.corpus_stats(document_arrays(spark, folder))


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    return counting.prompts(document_lines(spark, folder))


def prompts_in_vocab(spark: SparkSession, folder: str) -> DataFrame:
    checked = counting.check_prompts(prompts(spark, folder), document_vocab(spark, folder))
    return checked.drop("tokens")


def run_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Every source with every tokenizer and its token count, 0 where it has none."""
    lines = document_lines(spark, folder, "source")
    sizes = F.array(
        *[
            F.struct(
                F.lit(name).alias("tokenizer"),
                F.size(tokens.get_tokenizer(name)(F.col("text"))).cast("long").alias("n"),
            )
            for name in tokens.TOKENIZERS
        ]
    )
    found = item_rows(lines, ["source"], sizes, "t").groupBy("source", "t.tokenizer")
    found = found.agg(F.sum("t.n").alias("n_tokens"))
    # Read as it comes: names are aggregated before they are shuffled, so a hot one is no harm.
    sources = spark.read.parquet(f"{folder}/documents.parquet").select("source")
    grid = experiments.run_grid(sources, list(tokens.TOKENIZERS), "tokenizer")
    return grid.join(found, ["source", "tokenizer"], "left").select(
        "source", "tokenizer", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")
    )


# vocabularies and codes


def build_vocab(spark: SparkSession, folder: str) -> DataFrame:
    """Vocabulary of train and validation lines together."""
    lines = split_lines_by_position(spark, folder).filter("split in ('train', 'val')")
    counts = vocab.count_tokens(lines.select(tokens.word_tokens(F.col("text")).alias("tokens")))
    return vocab.build_vocab(counts, MIN_FREQ, [tokens.BOS, tokens.EOS])


def encode(spark: SparkSession, folder: str) -> DataFrame:
    coded = vocab.encode(word_rows(spark, folder), document_vocab(spark, folder))
    return coded.select("doc_id", "line_no", "pos", "idx")


def decode(spark: SparkSession, folder: str) -> DataFrame:
    """Lines encoded, decoded and put back together as text, document by document."""
    known = document_vocab(spark, folder)
    docs = document_arrays(spark, folder).select("doc_id", F.transform("lines", tokens.word_tokens).alias("lines"))
    coded = vocab.encode_lists(docs, ["doc_id"], "lines", known)
    words = vocab.decode_lists(coded, ["doc_id"], "lines", known)
    lines = list_rows(words, ["doc_id"], "lines", "tokens", "line_no").where(F.size("tokens") > 0)
    return lines.select(
        "doc_id", "line_no", tokens.join_tokens(F.col("tokens"), "word").alias("text")
    )


def global_position(spark: SparkSession, folder: str) -> DataFrame:
    arrays = document_arrays(spark, folder)
    words = F.transform("lines", tokens.word_tokens)
    flat = arrays.select("doc_id", F.flatten(words).alias("tokens"))
    placed, _ = ordinal.place(flat, "doc_id", F.size("tokens"))
    rows = vocab.explode_tokens(placed)
    return rows.select("doc_id", "token", (F.col("start") + F.col("pos")).alias("global_pos"))
