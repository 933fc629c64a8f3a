"""Joins of many rows to a table with one row per key, safe against hot keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ROWS = 500_000
MAX_BYTES = 32 << 20
HEAVY_ROWS = 10_000
SALTS = 1_000


def row_bytes(df: DataFrame) -> Column:
    """Upper bound of the text bytes of a row, plus eight per other column."""
    size = F.lit(16)
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            size = size + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            joined = F.array_join(column.cast("array<string>"), " ")
            size = size + F.coalesce(F.octet_length(joined), F.lit(0)) + 16 * F.size(column)
        else:
            size = size + 8
    return size


def fits_broadcast(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """Measure a table that has already been written; true if it may be broadcast."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def prepare_lookup(
    table: DataFrame,
    on: Sequence[str],
    weight: str,
    max_rows: int = MAX_ROWS,
    heavy_rows: int = HEAVY_ROWS,
) -> Callable[[DataFrame], DataFrame]:
    """A left join to ``table``, which has one row per key and is measured once.

    ``table`` should be written already. If it is small it is broadcast whole. If
    not, only its heavy keys are: ``weight`` says how often a key is expected, and
    fewer than ``heavy_rows`` keys can each hold more than that share of the total.
    One shuffle then joins all other keys, none of them hot; rows that have found their key are
    salted in it, so they spread. The rows are read once, and what is broadcast has been
    measured, its other columns included. ``weight`` is not in the result.
    """
    on = list(on)
    added = [c for c in table.columns if c not in on and c != weight]
    found = table.withColumn("found_", F.lit(True))
    if fits_broadcast(table, max_rows):
        small = F.broadcast(found.drop(weight))
        return lambda rows: rows.join(small, on, "left").drop("found_")
    total = table.agg(F.sum(weight)).first()[0]
    is_heavy = F.coalesce(F.col(weight) * F.lit(heavy_rows) > F.lit(total), F.lit(False))
    heavy = found.filter(is_heavy).drop(weight)
    if fits_broadcast(heavy, heavy_rows):
        heavy = F.broadcast(heavy)
    light = found.filter(~is_heavy).drop(weight, "found_").withColumn("salt_", F.lit(0))
    light = light.withColumnsRenamed({c: f"{c}_light" for c in added})

    def join(rows: DataFrame) -> DataFrame:
        spread = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int") + 1
        first = rows.join(heavy, on, "left").withColumn(
            "salt_", F.when(F.col("found_"), spread).otherwise(0)
        )
        both = first.join(light, [*on, "salt_"], "left")
        return both.select(
            *on,
            *(c for c in rows.columns if c not in on),
            *(F.when(F.col("found_"), F.col(c)).otherwise(F.col(f"{c}_light")).alias(c) for c in added),
        )

    return join


def lookup(
    rows: DataFrame, table: DataFrame, on: Sequence[str], weight: str, **limits: int
) -> DataFrame:
    """Left join of ``rows`` to a table with one row per key, see ``prepare_lookup``."""
    return prepare_lookup(table, on, weight, **limits)(rows)
