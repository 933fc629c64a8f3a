"""The operators applied to the test tables: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import (
    byte_pairs,
    collocations,
    decontaminate,
    html_text,
    lexical,
    quality,
    simhash,
    substring,
    token_files,
    topk,
    url_filter,
    vector_tree,
    word_pieces,
)
from corpuslab.llm.batches import scratch_folder

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def _sha256(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def op1_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text")
    encoded = byte_pairs.encode(docs, "text", RANKS, public_tokenizers.PATTERN)
    decoded = byte_pairs.decode(encoded.select("doc_id", "ids"), "ids", RANKS)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("content", 256).alias("decoded_sha256"),
    )


def op2_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages", "page_id", "url", "html")
    return html_text.with_length(
        html_text.extract(pages, "html", "text").select("page_id", "url", "text")
    )


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_folder(spark, "token-files")
    token_files.write(_table(spark, folder, "documents", "doc_id", "text"), out, WORDS)
    index = spark.read.parquet(f"{out}/index")
    read = token_files.positions(token_files.read(spark, out), index)
    return read.select(
        F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32"
    )


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text")
    items = _table(spark, folder, "benchmark", "item_id", "text")
    scanned = decontaminate.verdicts(decontaminate.scan(docs, items))
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        "contaminated",
    )


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_filter.judge(_table(spark, folder, "pages", "page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings", "vec_id", "embedding")
    whole = topk.quantised(vectors, "embedding", "vector").select("vec_id", "vector")
    return topk.search(whole, whole.where("vec_id % 20 = 0"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_copies(_table(spark, folder, "documents", "doc_id", "text"))
    bits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", bits.alias("fingerprint"), "component_id")


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text")
    grades = quality.grades_of(_table(spark, folder, "labels", "doc_id", "quality", "toxic"))
    scored = quality.accepted(quality.score(docs, quality.train(docs, grades)))
    return scored.select("doc_id", "expected_grade", "tails", "accepted")


def op9_word_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text")
    with open(PIECES, "rb") as file:
        pieces = word_pieces.vocabulary(list(byte_pairs.read_ranks(file.read())))
    return word_pieces.count_pieces(docs, "text", *pieces).select("doc_id", "n_words", "n_pieces")


def op10_substring(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text")
    return substring.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", _sha256(F.col("kept")).alias("kept_sha256")
    )


def op11_lexical(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text")
    return lexical.search(docs, _table(spark, folder, "benchmark", "item_id", "text"))


def op12_vector_tree(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings", "vec_id", "embedding")
    return vector_tree.search(vectors, vectors.where("vec_id % 20 = 0"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(_table(spark, folder, "documents", "text", "lang"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_pairs,
        op2_main_text,
        op3_token_files,
        op4_decontaminate,
        op5_url_filter,
        op6_topk,
        op7_simhash,
        op8_quality,
        op9_word_pieces,
        op10_substring,
        op11_lexical,
        op12_vector_tree,
        op13_collocations,
    )
}
