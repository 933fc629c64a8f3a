"""Line corpora: one row per line, with explicit keys for their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.functions.rows import list_rows
from corpuslab.session import cut_lineage

MAX_SPLITS = 200_000  # file splits whose starts are broadcast, a short row each


def load_table(spark: SparkSession, folder: str, name: str, columns: list[str]) -> DataFrame:
    """Read the wanted columns of a parquet table, spread over the cores.

    Large tables come in many splits and are left as they are. A table with fewer
    splits than cores is small, so spreading it by its first column costs little.
    """
    table = spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)
    cores = spark.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() < cores:
        table = table.repartition(cores, columns[0])
    return table


def split_lines(text):
    """The lines of a text as an array; a final newline starts no further line."""
    parts = F.split(text, "\n")
    return F.when(
        F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)
    ).otherwise(parts)


def to_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per line: the other columns, ``line_no`` from 0, and ``text``."""
    others = [c for c in texts.columns if c != text]
    return list_rows(texts, others, split_lines(F.col(text)), "text", "line_no")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as ``(file, line_no, text)``; the lines themselves are not shuffled.

    A line knows its number in its file split from its id, which grows by one from line to line of a task;
    what a split starts with, its first id and the lines before it in its file, is one row per split.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seen"),
        F.col("value").alias("text"),
    )
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("lines"), F.min("seen").alias("first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = blocks.select(
        "file", "block", (F.coalesce(F.sum("lines").over(earlier), F.lit(0)) - F.col("first")).alias("shift")
    )
    starts = cut_lineage(starts)
    if starts.count() <= MAX_SPLITS:
        starts = F.broadcast(starts)
    return raw.join(starts, ["file", "block"]).select(
        "file", (F.col("shift") + F.col("seen")).alias("line_no"), "text"
    )
