"""Lists to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_rows(
    df: DataFrame, keep: Sequence, items: Column | str, name: str, pos: str = "pos"
) -> DataFrame:
    """One row per list item, with its place ``pos`` from 0, next to the kept columns.

    Items often are costly to derive from a text. A plain explode makes the
    optimizer test the list for being empty in a filter below it, which derives
    the list a second and third time; the outer form with a test above does not.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias(pos, name))
    return rows.filter(F.col(pos).isNotNull()).withColumn(pos, F.col(pos).cast("long"))


def item_rows(df: DataFrame, keep: Sequence, items: Column | str, name: str) -> DataFrame:
    """One row per list item where its place does not matter; items are not null."""
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())
