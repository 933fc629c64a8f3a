"""Tweet files end to end: read, clean, drop what is left blank, split by position, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import cleaning
from corpuslab.operators import ordinal
from corpuslab.sources import sinks, tweets


def clean_tweets(table: DataFrame, text: str = "tweet", cleaned: str = "tweet_clean") -> DataFrame:
    """All columns of a tweet table and its ``cleaned`` text: the general rules, then the strict ones.

    Blank strings become null in every column; tweets of which nothing is left go, as do those without a text.
    """
    strict = cleaning.clean_strict(cleaning.clean_general(F.col(text)))
    return cleaning.drop_blank(table.withColumn(cleaned, strict), cleaned)


def split_tweets(table: DataFrame, parity: bool = True) -> DataFrame:
    """Add ``split``: a half and two quarters of the rows, files by name and their rows in order.

    ``row``, the index column of a file, gives the order in it. It may repeat, be null (first) or be
    missing, and then ``id`` decides, and then all columns, so the same files give the same split.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("file", "row", "id") if c in table.columns]
    return ordinal.split_rows(table, keys, parity)


def prepare_tweets(
    spark: SparkSession, groups: list[tuple[str, str]], combined: str, splits: str, parity: bool = True
) -> None:
    """Tweet files of ``(path, schema)`` groups to one CSV table and one folder per split.

    The ``combined`` table of all cleaned tweets is written only if absent; the ``splits`` are
    written anew, from the files.
    """
    table = clean_tweets(tweets.read_tweet_groups(spark, groups))
    sinks.write_csv(table, combined, only_if_absent=True)
    sinks.write_splits(split_tweets(table, parity), splits)
