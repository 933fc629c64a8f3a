"""Tweet tables and training sets in CSV files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions.cleaning import is_blank

# The columns of a yearly tweet file, in order.
TWEET_SCHEMA = """
    row int, id long, conversation_id long, created_at double, date timestamp,
    timezone string, place string, tweet string, language string, hashtags string,
    cashtags string, user_id long, user_id_str long, username string, name string,
    day int, hour int, link string, urls string, photos string, video int,
    thumbnail string, retweet boolean, nlikes int, nreplies int, nretweets int,
    quote_url string, search string, near string, geo string, source string,
    user_rt_id string, user_rt string, retweet_id string, reply_to string,
    retweet_date string, translate string, trans_src string, trans_dest string
"""

# Quoted fields may hold line breaks and doubled quotes.
CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def read_tweets(
    spark: SparkSession, path: str | list[str], schema: str = TWEET_SCHEMA
) -> DataFrame:
    """All tweet files of one layout as one table, with the file each row is from."""
    reader = spark.read.schema(schema).options(**CSV)
    return reader.csv(path).withColumn("file", F.col("_metadata.file_name"))


def read_tweet_groups(spark: SparkSession, groups: list[tuple[str, str]]) -> DataFrame:
    """Tweet files of several layouts, matched by column name; absent columns are null."""
    tables = [read_tweets(spark, path, schema) for path, schema in groups]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def created(df: DataFrame) -> DataFrame:
    """Add the time of creation, given as milliseconds in a number column."""
    return df.withColumn("created", F.timestamp_millis(F.col("created_at").cast("long")))


def drop_repeats(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per id, for inputs that list a tweet in two files."""
    return df.dropDuplicates([key])


def read_training_set(spark: SparkSession, splits: dict[str, str]) -> DataFrame:
    """Two-column training files as ``(split, content)``; the index column is not read on."""
    schema = "row int, content string"
    parts = [
        spark.read.schema(schema).options(**CSV).csv(path).select(
            F.lit(name).alias("split"), "content"
        )
        for name, path in splits.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def read_training_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as training lines, blank ones left out."""
    return spark.read.text(path).select(F.col("value").alias("text")).filter(
        ~is_blank(F.col("text"))
    )
