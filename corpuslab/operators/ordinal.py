"""Positions in one global order, without passing the data through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.rows import list_rows
from corpuslab.session import cut_lineage

BUCKET_BITS = 16
RANK_BITS = 33  # monotonically_increasing_id keeps the row number in the low bits


def running_offsets(
    sizes: DataFrame,
    key: str,
    value: str,
    by: Sequence[str] = (),
    bits: int = BUCKET_BITS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per ``by`` group, the sum of ``value`` over all smaller keys, as ``offset``.

    ``key`` is an integer, unique within its group. Keys are cut into buckets of
    ``2**bits`` values; running sums are taken inside buckets, and over the bucket
    totals in the same way, until one bucket is left. No window partition holds
    more than ``2**bits`` rows, however many rows a group has. The input is a slim
    table (keys and sizes), so it is written once rather than derived per level.
    """
    by = list(by)
    sizes = cut_lineage(
        sizes.select(*by, F.col(key).cast("long"), F.col(value).cast("long"), *carry)
    )
    low, high = sizes.agg(F.min(key), F.max(key)).first()
    if low is None:
        return sizes.withColumn("offset", F.lit(0).cast("long"))
    return _offsets(sizes, key, value, by, low, high, bits)


def _offsets(
    sizes: DataFrame, key: str, value: str, by: list[str], low: int, high: int, bits: int
) -> DataFrame:
    def before(groups: list) -> Column:
        rows = Window.partitionBy(*groups).orderBy(key)
        earlier = rows.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(earlier), F.lit(0)).cast("long")

    if high - low < 1 << bits:
        # At most 2**bits rows per group, so that one task may hold them.
        return sizes.withColumn("offset", before(by or [F.lit(0)]))
    bucket = f"{key}_"
    bucketed = sizes.withColumn(bucket, F.shiftright(F.col(key), bits))
    totals = bucketed.groupBy(*by, bucket).agg(F.sum(value).alias(value))
    starts = _offsets(totals, bucket, value, by, low >> bits, high >> bits, bits)
    starts = starts.select(*by, bucket, F.col("offset").alias("start"))
    inside = bucketed.withColumn("inside", before([*by, bucket]))
    return inside.join(starts, [*by, bucket]).select(
        *sizes.columns, (F.col("inside") + F.col("start")).alias("offset")
    )


def place(rows: DataFrame, key: str, size: Column, tie: Column | None = None) -> tuple[DataFrame, int]:
    """Add ``start``, the global position of each row's first item; also the total.

    Rows are ordered by their integer ``key``, null first, rows of one key by a hash of all their columns, or by ``tie``,
    which is worked out for these only.
    Only ``(key, size)`` goes through the running sum; the rows themselves are joined back once, and rows
    of one key are numbered where that join brings them together. Null is a key like any other: no row is lost.
    """
    sized = rows.select(F.col(key).cast("long").alias(key), size.cast("long").alias("size"))
    sums = cut_lineage(sized.groupBy(key).agg(F.sum("size").alias("size")))
    nulls = sums.filter(F.col(key).isNull()).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    sizes = running_offsets(sums.filter(F.col(key).isNotNull()), key, "size")
    total = nulls + sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    starts = sizes.select(F.col(key).alias("key_"), (F.col("offset") + F.lit(nulls)).alias("start_"))
    placed = rows.join(starts, F.col(key) == F.col("key_"), "left")
    if tie is None:
        tie = F.xxhash64(*rows.columns)
    else:
        placed = placed.withColumn("alike_", F.count("*").over(Window.partitionBy(key)))
        placed = placed.withColumn("tie_", F.when(F.col("alike_") > 1, tie))
        tie = F.col("tie_")
    alike = Window.partitionBy(key).orderBy(tie)
    before = F.sum(size.cast("long")).over(alike.rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce("start_", F.lit(0).cast("long")) + F.coalesce(before, F.lit(0).cast("long"))
    return placed.withColumn("start", start).drop("key_", "start_", "alike_", "tie_"), int(total)


def global_rank(rows: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number rows from 0 in the given order, which must leave no ties.

    A range-partitioned sort is written once; each row then knows its place inside
    its range, and ranges are shifted by the sizes of the earlier ones. There is
    one size per shuffle partition, so that table is small by construction.
    """
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = cut_lineage(
        ranges.withColumn("range_", F.spark_partition_id()).withColumn(
            "seen_", F.monotonically_increasing_id()
        )
    )
    sizes = tagged.groupBy("range_").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("range_").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = sizes.select(
        "range_", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start_")
    )
    inside = F.col("seen_").bitwiseAND(F.lit((1 << RANK_BITS) - 1))
    return tagged.join(F.broadcast(starts), "range_").select(
        *rows.columns, (F.col("start_") + inside).cast("long").alias(name)
    )


HASH_DIGITS = 4  # hash buckets: 16**4 of them, evenly filled because keys are unique


def hash_rank(rows: DataFrame, key: str, seed: int, name: str = "rank") -> DataFrame:
    """Number rows from 0 in a seeded hash order of their unique key: a fixed shuffle."""
    hashed = rows.withColumn("hash_", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    hashed = hashed.withColumn("bucket_", F.substring("hash_", 1, HASH_DIGITS))
    sizes = hashed.groupBy("bucket_").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("bucket_").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = sizes.select(
        "bucket_", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start_")
    )
    inside = F.row_number().over(Window.partitionBy("bucket_").orderBy("hash_", key)) - 1
    return hashed.withColumn("inside_", inside).join(F.broadcast(starts), "bucket_").select(
        *rows.columns, (F.col("start_") + F.col("inside_")).cast("long").alias(name)
    )


def positional_split(lines: DataFrame, parity: bool = True) -> DataFrame:
    """Cut lines into train, val and test (a half and two quarters) by position.

    ``lines`` is one row per document with its lines as an array column ``lines``;
    the result is one row per line. With ``parity`` the first line after each of
    the first two parts belongs to no part, as in the data this must agree with.
    """
    placed, total = place(lines, "doc_id", F.size("lines"))
    others = [c for c in lines.columns if c not in ("doc_id", "lines")]
    rows = list_rows(placed, ["doc_id", *others, "start"], "lines", "text", "line_no")
    split = split_at(F.col("start") + F.col("line_no"), total, parity)
    return rows.withColumn("split", split).filter("split is not null").drop("start")


def split_at(at: Column, total: int, parity: bool) -> Column:
    """The part that position ``at`` of ``total`` is in; null between parts with ``parity``."""
    half, three_quarters = total // 2, total * 3 // 4
    gap = 1 if parity else 0
    return (
        F.when(at < half, "train")
        .when((at >= half + gap) & (at < three_quarters), "val")
        .when(at >= three_quarters + gap, "test")
    )


def split_rows(rows: DataFrame, order: Sequence[Column], parity: bool = True) -> DataFrame:
    """Cut the rows of any table into train, val and test by their place in ``order``.

    The keys may be of any type, several, null and repeated. Ties are put in order by a hash of
    all columns, which also spreads a frequent key over ranges; rows still equal there can stand for each
    other. All columns are kept, and one sort by ranges is the only shuffle.
    """
    tie = F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns))
    ranked = global_rank(rows.withColumn("tie_", tie), [*order, F.col("tie_")], "at_")
    split = split_at(F.col("at_"), ranked.count(), parity)
    return ranked.withColumn("split", split).filter("split is not null").drop("tie_", "at_")
