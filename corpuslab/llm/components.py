"""Connected components of links, without ever holding them in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.session import cut_lineage


def connected(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for all nodes of the links ``a``, ``b``.

    Alternates two steps until no link changes: each node hands its larger neighbours to the
    smallest node it knows, then its smaller ones. Neither adds links, and both keep what is
    connected, so in the end every node is linked with the smallest of its component alone.
    Minima are aggregated before they are shuffled; nodes with many links are split by
    adaptive skew joins.
    """
    edges = links.select(
        F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")
    ).where("high != low")
    edges = cut_lineage(edges.distinct())
    state = _state(edges)
    while state[0]:
        edges = _towards_smallest(edges)
        after = _state(edges)
        if after == state:
            break
        state = after
    roots = edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).union(roots)


def _state(edges: DataFrame) -> tuple:
    """Number of links and a sum over them; the same twice only if nothing has changed."""
    return tuple(
        edges.agg(
            F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(20,0)"))
        ).head()
    )


def _towards_smallest(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("high").alias("node"), F.col("low").alias("other")).union(
        edges.select(F.col("low").alias("node"), F.col("high").alias("other"))
    )
    least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    large = both.where("other > node").join(least, "node")
    large = cut_lineage(
        large.select(F.col("other").alias("high"), F.col("least").alias("low")).distinct()
    )
    least = large.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
    small = large.withColumnRenamed("high", "node").join(least, "node")
    small = small.select(F.col("low").alias("high"), F.col("least").alias("low"))
    direct = least.select(F.col("node").alias("high"), F.col("least").alias("low"))
    return cut_lineage(small.where("high != low").union(direct).distinct())
