"""New columns made by Python from Arrow batches, and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.session import cut_lineage, ensure_checkpoint_dir

CHUNK_BYTES = 4 << 20
"""Rows are handed to Python code in slices of about so many bytes of text."""


def field(name: str):
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def sliced(batch: pa.RecordBatch, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``most`` bytes each, one row at least."""
    rows = batch.num_rows
    if rows:
        step = max(1, min(rows, rows * most // max(1, batch.nbytes)))
        for start in range(0, rows, step):
            yield batch.slice(start, step)


def with_python(
    df: DataFrame,
    inputs: list,
    added: T.StructType,
    setup: Callable[[], Callable[..., list[pa.Array]]],
) -> DataFrame:
    """``df`` and the columns ``added``, made from the expressions ``inputs``.

    ``setup`` runs once per task and gives a function from Arrow arrays to Arrow arrays of
    as many rows. An input column with the name of an added one is replaced by it.
    """
    kept = [c for c in df.columns if c not in added.names]
    packed = df.select(
        F.struct(F.lit(True).alias("here"), *(field(c) for c in kept)).alias("row"),
        *(c.alias(f"in{i}") for i, c in enumerate(inputs)),
    )
    schema = T.StructType([packed.schema["row"], *added.fields])

    def run(batches):
        make = setup()
        for batch in batches:
            for part in sliced(batch):
                made = make(*part.columns[1:])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *made], names=["row", *added.names]
                )

    out = packed.mapInArrow(run, schema)
    return out.select(
        *(F.col("row").getField(c).alias(c) for c in kept), *(field(c) for c in added.names)
    )


def list_array(values, lengths) -> pa.ListArray:
    """Lists of the given lengths cut from one flat numpy array."""
    import numpy as np

    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """The texts; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the checkpoint folder that the executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{purpose}-{uuid.uuid4().hex}"


def smallest_by_hash(rows: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """The ``most`` distinct rows with the smallest hashes of ``keys``, in that order.

    Rows are counted, and those below a hash that leaves a little more than ``most`` go on, so only few of
    them are ever made distinct, written and sorted, however many tasks there are. Where
    rows repeat so often that too few are left, the bound is raised until there are enough.
    """
    at = F.xxhash64(*(field(k) for k in keys))
    total, share = rows.count(), 1.0
    if total:
        share = min(1.0, (1.1 * most + 1_000) / total)
    while True:
        below = rows if share >= 1 else rows.where(at < min(int(share * 2.0**64) - 2**63, 2**63 - 1))
        part = cut_lineage(below.distinct())
        if share >= 1 or part.count() >= most:
            return part.orderBy(at, *rows.columns).limit(most)
        share = min(1.0, 4 * share)
