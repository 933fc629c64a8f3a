"""Token counts, vocabularies, encoding and decoding."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.functions.rows import item_rows, list_rows
from corpuslab.functions.tokens import UNK
from corpuslab.operators.dictionary import SLICE_ROWS, code_lists
from corpuslab.operators.lookup import lookup
from corpuslab.operators.ordinal import global_rank


def explode_tokens(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """One row per token, with its place ``pos`` in its list."""
    others = [c for c in rows.columns if c != tokens]
    return list_rows(rows, others, tokens, "token")


def count_tokens(rows: DataFrame, tokens: str = "tokens", by: Sequence[str] = ()) -> DataFrame:
    """How often each token occurs, per ``by`` group, as ``freq``."""
    flat = item_rows(rows, by, tokens, "token")
    return flat.groupBy(*by, "token").agg(F.count("*").alias("freq"))


def count_characters(rows: DataFrame, text: str = "text") -> DataFrame:
    """How often each character occurs, as ``token`` and ``freq``; a task counts some rows at a time, without a row per character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter()
            for start in range(0, batch.num_rows, SLICE_ROWS):
                texts = pc.drop_null(batch.column(0).slice(start, SLICE_ROWS)).to_pylist()
                codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
                freqs = np.bincount(codes)
                found = np.flatnonzero(freqs)
                counts.update(dict(zip(map(chr, found.tolist()), freqs[found].tolist())))
            columns = [pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "freq"])

    found = rows.select(text).mapInArrow(run, "token string, freq long")
    return found.groupBy("token").agg(F.sum("freq").alias("freq"))


def build_vocab(
    counts: DataFrame,
    min_freq: int = 0,
    reserved: Sequence[str] = (),
    unk: str | None = UNK,
) -> DataFrame:
    """``(token, idx, freq)``: marker tokens first, then by frequency, ties by token."""
    spark = counts.sparkSession
    markers = ([unk] if unk is not None else []) + list(reserved)
    kept = counts.filter((F.col("freq") >= min_freq) & ~F.col("token").isin(markers))
    ranked = global_rank(kept, [F.desc("freq"), F.asc("token")], "idx")
    ranked = ranked.select("token", (F.col("idx") + len(markers)).alias("idx"), "freq")
    if not markers:
        return ranked
    fixed = spark.createDataFrame(
        [(m, i, 0) for i, m in enumerate(markers)], "token string, idx long, freq long"
    )
    return fixed.unionByName(ranked)


def encode(
    tokens: DataFrame, vocab: DataFrame, unknown: int = 0, **limits: int
) -> DataFrame:
    """Add ``idx`` to token rows; tokens outside the vocabulary get ``unknown``."""
    coded = lookup(tokens, vocab, ["token"], "freq", **limits)
    return coded.withColumn("idx", F.coalesce("idx", F.lit(unknown)).cast("long"))


def decode(coded: DataFrame, vocab: DataFrame, **limits: int) -> DataFrame:
    """Add ``token`` to rows that hold an ``idx``."""
    return lookup(coded, vocab, ["idx"], "freq", **limits)


def gather(tokens: DataFrame, keys: Sequence[str], value: str, name: str = "tokens") -> DataFrame:
    """Put token rows back together in order, one list per key (a line, a sequence)."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", value)))
    return tokens.groupBy(*keys).agg(F.transform(pairs, lambda p: p[value]).alias(name))


def encode_lists(docs: DataFrame, keys: Sequence[str], tokens: str, vocab: DataFrame, unknown: int = 0) -> DataFrame:
    """Lists of tokens, or lists of such lists, as lists of indexes, coded in their rows."""
    coded = code_lists(docs, keys, tokens, vocab.select("token", "idx", "freq"), "freq")
    fill = lambda ids: F.transform(ids, lambda i: F.coalesce(i, F.lit(unknown).cast("long")))
    nested = isinstance(coded.schema[tokens].dataType.elementType, T.ArrayType)
    return coded.withColumn(tokens, F.transform(tokens, fill) if nested else fill(F.col(tokens)))


def decode_lists(docs: DataFrame, keys: Sequence[str], ids: str, vocab: DataFrame) -> DataFrame:
    """The tokens of lists of indexes, or of lists of such lists, put in in their rows."""
    return code_lists(docs, keys, ids, vocab.select("idx", "token", "freq"), "freq")
