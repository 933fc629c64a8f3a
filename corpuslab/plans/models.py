"""Named queries over sequences, batches, next-token tables and generated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.functions import cleaning, tokens
from corpuslab.functions.rows import item_rows, list_rows
from corpuslab.operators import (
    counting, evaluate, experiments, ngrams, ordinal, sequences, similarity, subword, vocab,
)
from corpuslab.operators.lookup import lookup
from corpuslab.plans.corpus import (
    document_arrays, document_lines, document_vocab, prompts, split_lines_by_position,
)
from corpuslab.session import cut_lineage
from corpuslab.sources.corpus import load_table, to_lines

BATCH_ROWS, STEPS, OFFSET, SEED = 32, 35, 5, 7
SLICE = (0.1, 0.9)
POSITIONS = (1_000, -500)
LENGTH_BATCH = {"train": 64, "val": 16, "test": 16}
GREEDY_STEPS, PROBE_STEPS = 50, 100
SAMPLES, SAMPLE_TOKENS = 2, 30
PROBE_IDS, RANDOM_PROBES = (21, 22), 4
BPE_VOCAB = 10_000
ROUND_TRIP_VOCAB = 512
CURVE_VOCAB, SHARES = 1_000, 4


def _joined(column: str, name: str):
    return F.array_join(F.col(column).cast("array<string>"), " ").alias(name)


# sequences


def wrap_sequences(spark: SparkSession, folder: str) -> DataFrame:
    wrapped = tokens.wrap(tokens.word_tokens(F.col("text")))
    lines = document_lines(spark, folder).select("doc_id", "line_no", wrapped.alias("tokens"))
    return lines.select(
        "doc_id", "line_no", F.size("tokens").cast("long").alias("n"), _joined("tokens", "tokens_text")
    )


def block_truncate(spark: SparkSession, folder: str) -> DataFrame:
    lines = document_lines(spark, folder).filter(~cleaning.is_blank(F.col("text")))
    block = sequences.truncate(tokens.word_tokens(F.col("text")))
    rows = lines.select("doc_id", "line_no", block.alias("tokens"))
    return rows.select(
        "doc_id", "line_no", F.size("tokens").cast("long").alias("n"), _joined("tokens", "tokens_text")
    )


def _wrapped(lines: DataFrame, *columns: str) -> DataFrame:
    return lines.select(*columns, tokens.wrap(tokens.word_tokens(F.col("text"))).alias("tokens"))


def next_token_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.next_token_pairs(
        _wrapped(document_lines(spark, folder), "doc_id", "line_no")
    )


def _letter_stream(spark: SparkSession, folder: str) -> tuple[DataFrame, sequences.PackedCharacters]:
    """Documents as their letters-only text, and what makes ids of its characters.

    The texts are cleaned anew where they are placed; written, they would be a large part of the disk in use.
    """
    letters = F.array_join(F.transform("lines", cleaning.clean_letters), "")
    rows = document_arrays(spark, folder).select("doc_id", letters.alias("ids"))
    known = vocab.build_vocab(vocab.count_characters(rows, "ids"))
    return rows.select("doc_id", F.length("ids").alias("n"), "ids"), sequences.PackedCharacters(known)


def slice_corpus(spark: SparkSession, folder: str) -> DataFrame:
    stream, packed = _letter_stream(spark, folder)
    part = sequences.slice_stream(stream, "doc_id", *SLICE, relative=True, packed=packed)
    return part.select("doc_id", "from_pos", "to_pos", _joined("ids", "ids_text"))


def _stream_batches(spark: SparkSession, folder: str, mode: str, *bounds) -> DataFrame:
    stream, packed = _letter_stream(spark, folder)
    found = sequences.batches(stream, "doc_id", BATCH_ROWS, STEPS, mode, OFFSET, SEED, *bounds, packed=packed)
    return found.select("batch", "row", _joined("x", "x_text"), _joined("y", "y_text"))


def random_subsequences(spark: SparkSession, folder: str) -> DataFrame:
    return _stream_batches(spark, folder, "random")


def sequential_batches(spark: SparkSession, folder: str) -> DataFrame:
    return _stream_batches(spark, folder, "sequential")


def random_subsequences_part(spark: SparkSession, folder: str) -> DataFrame:
    """Subsequences of the part of the stream that ``slice_corpus`` gives."""
    return _stream_batches(spark, folder, "random", *SLICE, True)


def sequential_batches_part(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of the stream from one position to another, the second counted from its end."""
    return _stream_batches(spark, folder, "sequential", *POSITIONS)


def _length_batches(spark: SparkSession, folder: str) -> DataFrame:
    lines = split_lines_by_position(spark, folder)
    return sequences.length_batches(_wrapped(lines, "split", "doc_id", "line_no"), LENGTH_BATCH)


def length_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Only keys and sizes of lines are batched; written once, so that lines are placed and cut into words once."""
    lines = _wrapped(split_lines_by_position(spark, folder), "split", "doc_id", "line_no")
    sized = lines.select("split", "doc_id", "line_no", F.size("tokens").cast("long").alias("n"))
    return sequences.length_batches(cut_lineage(sized), LENGTH_BATCH, size=F.col("n"))


def pad_batches(spark: SparkSession, folder: str) -> DataFrame:
    padded = sequences.pad_batches(_length_batches(spark, folder), ["split", "batch"])
    return padded.select("split", "batch", "row", "n", "width", _joined("tokens", "tokens_text"))


def causal_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Truncated lines as ids, filled up per batch, and their labels."""
    known = document_vocab(spark, folder)
    block = lambda line: sequences.truncate(tokens.word_tokens(line))
    docs = document_arrays(spark, folder).select("doc_id", F.transform("lines", block).alias("lines"))
    split = ordinal.positional_split(cut_lineage(vocab.encode_lists(docs, ["doc_id"], "lines", known)))
    rows = split.withColumnRenamed("text", "ids").filter(F.size("ids") > 0)
    batched = sequences.length_batches(rows, LENGTH_BATCH, "ids")
    padded = sequences.pad_batches(batched, ["split", "batch"], "ids", pad=-1)
    labels = sequences.causal_labels(F.col("ids"), -1)
    return padded.select(
        "split", "batch", "row", "n", _joined("ids", "ids_text"),
        F.array_join(labels.cast("array<string>"), " ").alias("labels_text"),
    )


# next-token tables


def _split_pairs(spark: SparkSession, folder: str) -> DataFrame:
    lines = split_lines_by_position(spark, folder).filter("split in ('train', 'val')")
    return sequences.next_token_pairs(_wrapped(lines, "split", "doc_id", "line_no"))


def bigram_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.count_bigrams(_split_pairs(spark, folder).filter("split = 'train'"))


def next_token_top2(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.top_successors(bigram_counts(spark, folder))


def score_tokens(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _split_pairs(spark, folder)
    table = ngrams.score_table(pairs, F.col("split") == "train")
    scored = ngrams.score(pairs.filter("split = 'val'"), table)
    return scored.select(
        "doc_id", "line_no", "pos", "prev", "next", F.round("nll", 6).alias("nll")
    )


def perplexity(spark: SparkSession, folder: str) -> DataFrame:
    """Train and validation perplexities, in batches of similar length.

    A line of words has one pair more than it has words. Only sizes of lines are batched; a line's pairs then weigh as
    much as its batch has words per token, so that losses are added up over distinct pairs.
    """
    lines = split_lines_by_position(spark, folder).filter("split in ('train', 'val')")
    lines = lines.select("split", "doc_id", "line_no", tokens.word_tokens(F.col("text")).alias("tokens"))
    lines = lines.withColumn("n", (F.size("tokens") + 2).cast("long"))
    batched = cut_lineage(sequences.length_batches(cut_lineage(lines.drop("tokens")), LENGTH_BATCH, size=F.col("n")))
    sizes, mixed = evaluate.word_shares(batched)
    lines = lookup(lines, cut_lineage(mixed), ["split", "n", "doc_id", "line_no"], "lines")
    # Lines without a document are in no batch: they count for the table and are not scored.
    in_batch, share = F.col("doc_id").isNotNull(), F.coalesce("share", (F.col("n") - 2) / (F.col("n") - 1))
    part = F.when(F.col("split") == "train", F.when(in_batch, 1).otherwise(2)).otherwise(F.when(in_batch, 0).otherwise(3))
    rows = lines.select(
        F.lit("word").alias("tokenizer"), "tokens", F.lit(None).cast("string").alias("text"), part.alias("part"),
        F.when(in_batch, share).otherwise(0.0).alias("weight"), F.lit(0).alias("words"),
    )
    found = experiments.pair_losses(rows, 2, 1.0, scored=1).filter("model = 'bigram'")
    side = lambda name, nll, weighted: F.struct(F.lit(name).alias("split"), F.col(nll).alias("nll"), F.col(weighted).alias("weighted"))
    sides = F.array(side("train", "train2", "train_weighted2"), side("val", "val2", "weighted2"))
    return evaluate.of_sums(sizes.join(found.select(F.explode(sides).alias("x")).select("x.*"), "split"))


def experiment_summary(spark: SparkSession, folder: str) -> DataFrame:
    lines = split_lines_by_position(spark, folder).filter("split in ('train', 'val')")
    return experiments.compare_models(lines, list(tokens.TOKENIZERS))


def _curves(spark: SparkSession, folder: str, byte_pairs: bool) -> DataFrame:
    """Learning curves of the tokenizers; learned ones code distinct words once and lines in their rows."""
    plain = document_arrays(spark, folder)
    table = _match_vocab(spark, folder, plain)
    docs, total = ordinal.place(plain, "doc_id", F.size("lines"))
    words = lambda line: tokens.word_tokens(F.lower(line))
    docs = docs.withColumns({"texts": F.col("lines"), "lines": F.transform("lines", words)})
    docs = subword.encode_longest_match_lines(docs, ["doc_id"], table).withColumnRenamed("lines", "subword")
    learned = ["subword"]
    if byte_pairs:
        merges, _ = subword.train_bpe(subword.piece_counts(document_lines(spark, folder)), CURVE_VOCAB)
        docs = subword.encode_bpe_lines(docs.withColumn("lines", F.col("texts")), ["doc_id"], merges)
        docs = docs.withColumnRenamed("lines", "byte-pair")
        learned.append("byte-pair")
    zipped = F.arrays_zip(F.col("texts").alias("text"), *[F.col(c) for c in learned])
    rows = list_rows(docs.select("doc_id", "start", zipped.alias("lines")), ["doc_id", "start"], "lines", "text", "line_no")
    split = rows.withColumn("split", ordinal.split_at(F.col("start") + F.col("line_no"), total, True))
    share = F.pmod(F.col("doc_id") * 31 + F.col("line_no"), F.lit(SHARES)) + 1
    lines = split.filter("split in ('train', 'val')").select("split", share.alias("share"), "text.*")
    lists = experiments.token_lists({c: F.col(c) for c in learned}).alias("lists")
    return experiments.learning_curves(lines.select("split", "share", lists), "lists", SHARES)


def experiment_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Perplexities by growing shares of the training lines, at token and at word level."""
    return _curves(spark, folder, byte_pairs=False)


def experiment_best(spark: SparkSession, folder: str) -> DataFrame:
    """The final and the best epoch of each run."""
    curve = experiment_curve(spark, folder).withColumn("seconds", F.lit(None).cast("double"))
    return experiments.summarise_runs(curve).drop("mean_seconds", "median_seconds")


def experiment_learned(spark: SparkSession, folder: str) -> DataFrame:
    """The same curves for all five tokenizers, byte pairs learned here among them."""
    return _curves(spark, folder, byte_pairs=True)


def _train_bigrams(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Bigrams of the training lines, written, and the vocabulary they give."""
    bigrams = cut_lineage(bigram_counts(spark, folder))
    seen = bigrams.filter(F.col("next") != tokens.EOS)
    counts = seen.groupBy(F.col("next").alias("token")).agg(F.sum("n").alias("freq"))
    return bigrams, vocab.build_vocab(counts, 0, [tokens.BOS, tokens.EOS])


def _good_prompts(spark: SparkSession, folder: str, known: DataFrame) -> DataFrame:
    checked = counting.check_prompts(prompts(spark, folder), known)
    return cut_lineage(checked.filter("status = 'ok'").select("prompt", "tokens"))


def generate_greedy(spark: SparkSession, folder: str) -> DataFrame:
    bigrams, known = _train_bigrams(spark, folder)
    asked = _good_prompts(spark, folder, known)
    found = ngrams.generate_greedy(asked, bigrams, GREEDY_STEPS, "suppress_eos")
    output = tokens.join_tokens(F.concat("tokens", "generated"), "word")
    return found.select(
        "prompt", F.size("generated").cast("long").alias("n_generated"), output.alias("output")
    ).filter("output != ''")


def generate_sampled(spark: SparkSession, folder: str) -> DataFrame:
    bigrams, known = _train_bigrams(spark, folder)
    asked = _good_prompts(spark, folder, known)
    found = ngrams.generate_sampled(asked, bigrams, known, SAMPLES, SAMPLE_TOKENS, SEED)
    return found.select("prompt", "sample_no", _joined("tokens", "output"))


def probe_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts from the begin marker alone, with fixed and with drawn vocabulary words."""
    bigrams, known = _train_bigrams(spark, folder)
    order = F.md5(F.concat(F.lit(f"{SEED}:"), "token"))
    drawn = known.orderBy(order, "token").limit(RANDOM_PROBES)
    rank = F.row_number().over(Window.orderBy(order, "token"))
    begin = F.array(F.lit(tokens.BOS))
    first = spark.range(1).select(F.lit(0).cast("long").alias("probe"), begin.alias("tokens"))
    fixed = known.filter(F.col("idx").isin(list(PROBE_IDS))).select(
        (F.col("idx") - PROBE_IDS[0] + 1).alias("probe"), F.array(F.lit(tokens.BOS), "token").alias("tokens")
    )
    random = drawn.select(
        (rank + len(PROBE_IDS)).cast("long").alias("probe"),
        F.array(F.lit(tokens.BOS), "token").alias("tokens"),
    )
    probes = cut_lineage(first.unionByName(fixed).unionByName(random))
    found = ngrams.generate_greedy(probes, bigrams, PROBE_STEPS, "stop_at_eos")
    return found.select(
        "probe", _joined("tokens", "prompt"),
        F.array_join(F.concat("tokens", "generated"), " ").alias("output"),
    )


# generated text against its originals


def _benchmark_lines(spark: SparkSession, folder: str) -> DataFrame:
    return to_lines(load_table(spark, folder, "benchmark", ["item_id", "text"]))


def _nearest(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    generated = _benchmark_lines(spark, folder)
    originals = document_lines(spark, folder)
    return generated, similarity.nearest_original(generated, originals, ["doc_id", "line_no"])


def nearest_original(spark: SparkSession, folder: str) -> DataFrame:
    _, nearest = _nearest(spark, folder)
    return nearest.select(
        F.col("gen").alias("generated"), "distance", F.col("key.doc_id").alias("doc_id"),
        F.col("key.line_no").alias("line_no"), F.col("text").alias("original"),
    )


def similarity_by_run(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.similarity_by_run(*_nearest(spark, folder), "item_id")


# subwords


def bpe_train(spark: SparkSession, folder: str) -> DataFrame:
    pieces = subword.piece_counts(document_lines(spark, folder))
    merges, _ = subword.train_bpe(pieces, BPE_VOCAB)
    return merges


def _line_tokens(docs: DataFrame) -> DataFrame:
    """One row per line with its ``tokens``; lines without any are left out."""
    rows = list_rows(docs, ["doc_id"], "lines", "tokens", "line_no")
    return rows.where(F.size("tokens") > 0)


def bpe_encode(spark: SparkSession, folder: str) -> DataFrame:
    docs = document_arrays(spark, folder)
    coded = _line_tokens(subword.encode_bpe_lines(docs, ["doc_id"], bpe_train(spark, folder)))
    return coded.select(
        "doc_id", "line_no", F.size("tokens").cast("long").alias("n_tokens"),
        _joined("tokens", "tokens_text"),
        tokens.words_in_sequence(F.concat(F.array(F.lit(tokens.BOS)), "tokens"), "byte-level").alias(
            "n_words"
        ),
    )


def _byte_pair_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line with its ``tokens`` by byte pairs learned here."""
    merges, _ = subword.train_bpe(subword.piece_counts(document_lines(spark, folder)), ROUND_TRIP_VOCAB)
    coded = subword.encode_bpe_lines(document_arrays(spark, folder), ["doc_id"], merges)
    return list_rows(coded, ["doc_id"], "lines", "tokens", "line_no")


def _blocks(lines: DataFrame) -> DataFrame:
    block = lines.withColumn("tokens", sequences.truncate(F.col("tokens")))
    return block.select(
        "doc_id", "line_no", F.size("tokens").cast("long").alias("n"), _joined("tokens", "tokens_text")
    )


def block_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The first byte-pair tokens of each training line; lines are blank by the text their tokens stand for."""
    lines = _byte_pair_lines(spark, folder)
    text = tokens.join_tokens(F.col("tokens"), "byte-level")
    return _blocks(lines.where(~cleaning.is_blank(text)))


def block_longest_match(spark: SparkSession, folder: str) -> DataFrame:
    """The first subwords of each training line."""
    plain = document_arrays(spark, folder)
    docs, table = _word_lines(plain), _match_vocab(spark, folder, plain)
    return _blocks(_line_tokens(subword.encode_longest_match_lines(docs, ["doc_id"], table)))


def bpe_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Lines encoded by byte pairs learned here and given back from their subwords."""
    lines = _byte_pair_lines(spark, folder)
    return lines.select("doc_id", "line_no", tokens.join_tokens(F.col("tokens"), "byte-level").alias("text"))


def _word_lines(docs: DataFrame) -> DataFrame:
    words = lambda line: tokens.word_tokens(F.lower(line))
    return docs.select("doc_id", F.transform("lines", words).alias("lines"))


def _match_vocab(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    """The words of the conversations and all characters of the documents' words, to begin and to go on with."""
    talks = to_lines(load_table(spark, folder, "conversations", ["conv_id", "text"]))
    talks = talks.select(tokens.word_tokens(F.lower("text")).alias("tokens"))
    # The rules of words go from character to character, so those in words are those that are words by themselves.
    text = F.array_join(F.transform("lines", F.lower), "")
    letters = vocab.count_characters(docs.select(text.alias("text")))
    letters = item_rows(letters, [], tokens.word_tokens(F.col("token")), "token")
    whole = item_rows(talks, [], "tokens", "token").distinct().unionByName(letters)
    whole = cut_lineage(whole.distinct())
    return whole.unionByName(
        whole.select(F.concat(F.lit(tokens.CONTINUED), "token").alias("token"))
    )


def subword_longest_match(spark: SparkSession, folder: str) -> DataFrame:
    """Document words split with the words of the conversations and all single characters."""
    plain = document_arrays(spark, folder)
    docs, table = _word_lines(plain), _match_vocab(spark, folder, plain)
    coded = _line_tokens(subword.encode_longest_match_lines(docs, ["doc_id"], table))
    return coded.select(
        "doc_id", "line_no", F.size("tokens").cast("long").alias("n_tokens"),
        _joined("tokens", "tokens_text"),
        tokens.join_tokens(F.col("tokens"), "subword").alias("text"),
    )
