"""Lists coded in their rows by dictionaries, without a row per token in any shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.functions.rows import item_rows
from corpuslab.operators.lookup import MAX_BYTES, MAX_ROWS, lookup, row_bytes
from corpuslab.session import cut_lineage

SLICE_ROWS = 256  # rows coded at a time
REMEMBERED = 200_000  # items whose parts a task remembers


def _leaf(kind: T.DataType, value: T.DataType) -> T.DataType:
    """The type of nested lists when their items become ``value``."""
    return T.ArrayType(_leaf(kind.elementType, value)) if isinstance(kind, T.ArrayType) else value


def _flat(column: Column, kind: T.DataType) -> Column:
    while isinstance(kind.elementType, T.ArrayType):
        column, kind = F.flatten(column), kind.elementType
    return column


def _replaced(lists: pa.Array, keys: pa.Array, values: pa.Array) -> pa.Array:
    """The nested ``lists`` with each item replaced by the value of its key; null where it has none."""
    if pa.types.is_list(lists.type):
        sizes = pc.fill_null(pc.list_value_length(lists), 0)
        offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(sizes.cast(pa.int64()))])
        return pa.ListArray.from_arrays(offsets.cast(pa.int32()), _replaced(lists.flatten(), keys, values))
    return values.take(pc.index_in(lists, value_set=keys))


def common_and_rest(table: DataFrame, weight: str, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """The rows of the greatest weights, as many whole weights as may be broadcast, and the other rows.

    The weights are counted first; different ones are few, as their sum is the number of all items.
    """
    sizes = table.groupBy(weight).agg(F.count("*").alias("rows"), F.sum(row_bytes(table)).alias("bytes"))
    rows, size, least = 0, 0, None
    for found in sizes.where(F.col(weight).isNotNull()).orderBy(F.desc(weight)).toLocalIterator():
        rows, size = rows + found["rows"], size + found["bytes"]
        if rows > max_rows or size > max_bytes:
            break
        least = found[weight]
    common = F.lit(False) if least is None else F.coalesce(F.col(weight) >= F.lit(least), F.lit(False))
    return table.where(common), table.where(~common)


def code_lists(
    rows: DataFrame, keys: Sequence[str], items: str, table: DataFrame, weight: str, **limits: int
) -> DataFrame:
    """``rows`` with every item of the lists in column ``items`` replaced by its value in ``table``.

    ``table`` holds the item, the value and ``weight``, how often the item is expected; it has one row
    per item. Lists may be nested, as the lines of a document are. The common items go to every task
    (``common_and_rest``, ``limits``). A row's other distinct items are looked up, its part of the
    table is gathered under its ``keys``, and the row is coded by both, so that a shuffle carries distinct rare
    items of a document and the document itself, once. Items without a value become null; null lists become
    empty; rows that share their keys, null keys included, share their part of the table.
    """
    keys = list(keys)
    item, value = (c for c in table.columns if c != weight)
    kind = rows.schema[items].dataType
    flat = F.filter(F.array_distinct(_flat(F.col(items), kind)), lambda t: t.isNotNull())
    usual, rare = common_and_rest(table.where(F.col(item).isNotNull() & F.col(value).isNotNull()), weight, **limits)
    usual = cut_lineage(usual.select(item, value))
    sent = rows.sparkSession.sparkContext.broadcast(usual.toArrow().combine_chunks())
    wanted = item_rows(rows, keys, flat, item).join(F.broadcast(usual.select(item)), item, "left_anti")
    known = lookup(wanted.select(*keys, item).distinct(), rare, [item], weight).where(F.col(value).isNotNull())
    parts = known.groupBy(*keys).agg(F.collect_list(F.struct(F.col(item).alias("k"), F.col(value).alias("v"))).alias("part_"))
    parts = parts.select(*[F.col(k).alias(f"{k}__") for k in keys], "part_")
    match = [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys]
    joined = rows.join(parts, match, "left").select(
        *rows.columns, F.col("part_.k").alias("part_keys_"), F.col("part_.v").alias("part_values_")
    )
    schema = T.StructType(
        [T.StructField(f.name, _leaf(kind, table.schema[value].dataType) if f.name == items else f.dataType) for f in rows.schema]
    )
    place = rows.columns.index(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            part_values, part_keys = columns.pop().flatten(), columns.pop().flatten()
            found, values = (
                pa.concat_arrays([part, *(c.cast(part.type) for c in sent.value[name].chunks)])
                for part, name in ((part_keys, item), (part_values, value))
            )
            columns[place] = _replaced(columns[place], found, values)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(run, schema)


def _cut(lists: pa.Array, keys: pa.Array, parts: pa.Array) -> pa.Array:
    """Lists of lists of items with each item replaced by its own list of parts, in the place of the item."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0)
    outer = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(sizes.cast(pa.int64()))])
    lines = lists.flatten()
    sizes = pc.fill_null(pc.list_value_length(lines), 0)
    inner = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(sizes.cast(pa.int64()))])
    found = parts.take(pc.index_in(lines.flatten(), value_set=keys))
    sizes = pc.fill_null(pc.list_value_length(found), 0)
    cut = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(sizes.cast(pa.int64()))])
    lines = pa.ListArray.from_arrays(cut.take(inner).cast(pa.int32()), found.flatten())
    return pa.ListArray.from_arrays(outer.cast(pa.int32()), lines)


def cut_lists(rows: DataFrame, items: str, make_cut: Callable[[], Callable[[str], list[str]]]) -> DataFrame:
    """``rows`` with every item of the lists of lists in column ``items`` replaced by its parts, nothing shuffled.

    ``make_cut`` is called once a task and gives the function from an item to its parts. A task works out the
    distinct items of some rows at a time and remembers a bounded number of them.
    """
    place = rows.columns.index(items)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = make_cut(), {}
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                columns = list(batch.slice(start, SLICE_ROWS).columns)
                found = pc.drop_null(columns[place].flatten().flatten().unique())
                parts = []
                for item in found.to_pylist():
                    if (done := known.get(item)) is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        done = known[item] = cut(item)
                    parts.append(done)
                columns[place] = _cut(columns[place], found, pa.array(parts, pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, rows.schema)
