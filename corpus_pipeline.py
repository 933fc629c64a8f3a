"""A corpus pipeline of five stages, each written and reread before the next one runs.

``STAGES`` lists them as ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and gives
a DataFrame with the columns of ``documents``, but for the last, which gives token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import byte_pairs, decontaminate, quality, simhash, substring
from corpuslab.llm.batches import field, scratch_folder
from corpuslab.llm.queries import RANKS


def _held(docs: DataFrame) -> DataFrame:
    """``whole``, a document's row but for the text, next to its number and text: no result can meet its columns."""
    row = F.struct(F.lit(True).alias("_"), *(field(c) for c in docs.columns if c != "text")).alias("whole")
    return docs.select(row, "doc_id", "text")


def _rows(held: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` from ``whole``, but for the text and those that are given."""
    changed = {"text": F.col("text"), **changed}
    return held.select(*((changed[c] if c in changed else F.col("whole").getField(c)).alias(c) for c in docs.columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is likely the best one, judged by the whole text; all, if there is no usable rating."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, quality.grades_of(labels))
    if not model.rated:
        return docs
    return _rows(quality.accepted(quality.score(_held(docs), model)).where("accepted"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked fingerprints: the one with the smallest number.

    Rows have an identity of their own, so a null number never costs a document: it comes after all
    others, and stays if its component has no other. Of rows with the same number the one with
    the smallest hash of all columns stays. Different texts under one number are documents of their own.
    """
    rows = substring.identified(docs, "doc_id", "text")
    row = {c: F.col("text") if c == "text" else F.col("whole").getField(c) for c in docs.columns}
    number = row["doc_id"]
    ranked = rows.select("doc", number.isNull().alias("last"), number.alias("n"), F.xxhash64(*row.values()).alias("h"))
    found = simhash.near_copies(rows, "doc", "text").select("doc", "component_id").join(ranked, "doc")
    first = found.groupBy("component_id").agg(F.min(F.struct("last", "n", "h", "doc")).alias("best"))
    kept = rows.join(first.select("best.doc"), "doc", "left_semi")
    return kept.select(*(value.alias(c) for c, value in row.items()))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without word sequences that stand elsewhere, too; those left without words go.

    Texts that lose nothing stay as they are, with all their white space.
    """
    done = substring.remove_repeats(_held(docs)).where("n_removed = 0 or n_removed < n_words")
    less = F.col("n_removed") > 0
    text = F.when(less, F.col("kept")).otherwise(F.col("text"))
    n_chars = F.when(less, F.length("kept").cast("long")).otherwise(F.col("whole").getField("n_chars"))
    return _rows(done, docs, text=text, n_chars=n_chars)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is in benchmark items."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    scanned = decontaminate.verdicts(decontaminate.scan(_held(docs), items))
    return _rows(scanned.where("not contaminated"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text."""
    encoded = byte_pairs.encode(docs.select("doc_id", "lang", "source", "text"), "text", RANKS, public_tokenizers.PATTERN)
    return encoded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids"
    )


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE encoding", encode),
]

#: The classifier and the fingerprints cannot be expressed in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's rows written as Parquet and read again."""
    folder = scratch_folder(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
