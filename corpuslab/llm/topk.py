"""Exact top-k by inner product, from sorted lists read from their ends.

Queries and candidates meet in blocks. For every dimension a block of candidates has a sorted list; a
query reads it from both ends, entry after entry, and never looks a candidate up. What it has read of a
candidate adds up, and what it has not read lies between the two values last read, as components have
either sign: so after each round of reading there are bounds for every score. A query stops as soon as
the candidates whose upper bound reaches its k-th largest lower bound are few; only these have their
scores resolved. A query whose bounds never get that far reads its lists to the end, and the sums it
has then are the scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm.batches import field
from corpuslab.operators.lookup import lookup
from corpuslab.session import cut_lineage

K = 20
BLOCK = 4096
"""Vectors in a block; a task holds one block of candidates and one of queries at a time."""
ROUNDS = (1 / 64, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 1)
"""How far the lists are read each time before the bounds are compared."""
FEW = 4
"""Reading stops when at most so many times ``k`` candidates may still qualify."""


class SortedLists:
    """The entries of each dimension in order of value, for one block of candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.copies = ids[order], vectors[order], copies[order]
        self.places = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.places, axis=0)


class Reading:
    """What a group of queries has read of the lists, all to the same depth."""

    def __init__(self, lists: SortedLists, queries: np.ndarray):
        self.lists, self.depth, self.queries = lists, 0, queries
        self.sums = np.zeros((len(queries), len(lists.ids)), queries.dtype)
        self.unread = np.ones(lists.vectors.shape, queries.dtype)

    def advance(self, depth: int) -> None:
        """Read on to ``depth`` entries of each list, half of them from its lower end."""
        places, values, last = self.lists.places, self.lists.values, len(self.lists.ids)
        lower = slice((self.depth + 1) // 2, (depth + 1) // 2)
        upper = slice(last - depth // 2, last - self.depth // 2)
        fresh = np.zeros_like(self.unread)
        for entries in (lower, upper):
            np.put_along_axis(fresh, places[entries], values[entries], axis=0)
            np.put_along_axis(self.unread, places[entries], 0, axis=0)
        self.sums += self.queries @ fresh.T
        self.depth = depth

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores, a row per query: what is unread lies between the cursors."""
        values, last = self.lists.values, len(self.lists.ids) - 1
        bottom, top = values[max(0, (self.depth + 1) // 2 - 1)], values[min(last, last + 1 - self.depth // 2)]
        up, down = np.maximum(self.queries, 0), np.minimum(self.queries, 0)
        least = (up * bottom + down * top) @ self.unread.T
        most = (up * top + down * bottom) @ self.unread.T
        return self.sums + least, self.sums + most

    def keep(self, which: np.ndarray) -> None:
        """Go on with some of the queries only."""
        self.queries, self.sums = self.queries[which], self.sums[which]


def best(
    query_ids: np.ndarray, queries: np.ndarray, lists: SortedLists, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block's ``k`` best candidates of each query: places of query and candidate, and score.

    Ties go to the smaller id; rows with a query's own id are no candidates. The last array
    holds how many entries of each of its lists a query has read.
    """
    rows = len(lists.ids)
    going, read = np.arange(len(query_ids)), np.zeros(len(query_ids), np.int64)
    reading = Reading(lists, queries)
    alive = lists.ids[None, :] != query_ids[:, None]
    out_q, out_c, out_s = [], [], []
    for depth in sorted({max(1, int(rows * share)) for share in ROUNDS}):
        reading.advance(depth)
        lower, upper = reading.bounds()
        own = lists.ids[None, :] == query_ids[going][:, None]
        lower[own] = -np.inf if lower.dtype.kind == "f" else np.iinfo(lower.dtype).min
        if rows > k:
            alive &= upper >= np.partition(lower, rows - k, axis=1)[:, rows - k, None]
        ended = (alive.sum(axis=1) <= FEW * k) | (depth == rows)
        for at in np.flatnonzero(ended):
            left = np.flatnonzero(alive[at])
            scores = lower[at, left] if depth == rows else lists.vectors[left] @ queries[going[at]]
            order = np.lexsort((left, -scores))[:k]
            out_q.append(np.full(len(order), going[at]))
            out_c.append(left[order])
            out_s.append(scores[order])
        read[going[ended]] = depth
        going, alive = going[~ended], alive[~ended]
        if not len(going):
            break
        reading.keep(~ended)
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s), read


def _kind(queries: np.ndarray, vectors: np.ndarray) -> type:
    """A number type that holds every score and bound, and every sum on the way to them, exactly."""
    most = lambda x: float(np.abs(x).max(initial=0))
    bound = 4 * most(queries) * most(vectors) * max(1, vectors.shape[1])
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


FOUND = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("query", "query_id", "vec_id", "score", "copies")]
)


def _stacked(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat).astype(np.int64).reshape(len(column), width)


def block_of(blocks: Column) -> Column:
    """The block of a candidate; no key or vector sends all its rows to one."""
    return F.pmod(F.xxhash64("id", "v"), blocks)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    key: str = "vec_id",
    vector: str = "vector",
    k: int = K,
    block: int = BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` rows of ``vectors`` for each query.

    Vectors are arrays of whole numbers (long); rows whose key or vector is null or holds null take no
    part. Only vectors of one length have an inner product, so each length is searched by itself. Both sides of
    it are dealt into blocks of at most about ``block`` rows, each block of candidates is read with
    each block of queries, and only ``k`` rows per query come out of it.

    Query rows that repeat key and vector are one query with ``k`` results; different vectors of one
    key are queries of their own, each with ``k`` results and ranks under that key. As candidates
    all rows of a repeated key take part: one that stands twice has two ranks, and none of
    them is a candidate of its own key. Equal rows meet the queries once, with their number.
    """
    usable = vectors.where(
        field(key).isNotNull() & field(vector).isNotNull() & ~F.exists(field(vector), F.isnull)
    ).select(field(key).cast("long").alias("id"), field(vector).cast("array<long>").alias("v"))
    asked = queries.where(
        field(key).isNotNull() & field(vector).isNotNull() & ~F.exists(field(vector), F.isnull)
    ).select(field(key).cast("long").alias("id"), field(vector).cast("array<long>").alias("v"))
    usable = usable.groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("tag"))
    usable = cut_lineage(usable.withColumn("width", F.size("v")))
    asked = cut_lineage(asked.distinct().select("*", F.monotonically_increasing_id().alias("tag"), F.size("v").alias("width")))

    def dealt(n: Column) -> Column:
        return F.ceil(n / block).cast("long")

    # One row per length of vectors: the number of blocks on both sides.
    inside = usable.groupBy("width").agg(F.count("*").alias("n"), dealt(F.count("*")).alias("blocks"))
    outside = asked.groupBy("width").agg(dealt(F.count("*")).alias("groups"))
    parts = cut_lineage(inside.join(outside, "width"))

    # The tag is a candidate's number of rows, or a query's own number.
    meeting = ("width", "block", "group")
    row = ("tag", "id", "v")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    left = lookup(usable, parts, ["width"], "n").where("blocks is not null")
    left = left.withColumns({"block": block_of(F.col("blocks")), "group": every("groups")})
    right = lookup(asked, parts, ["width"], "n").where("blocks is not null")
    right = right.withColumns({"group": F.pmod(F.xxhash64("tag"), "groups"), "block": every("blocks")})
    both = left.select(*meeting, F.lit(False).alias("asks"), *row).union(
        right.select(*meeting, F.lit(True).alias("asks"), *row)
    )

    def run(table: pa.Table) -> pa.Table:
        asks = np.asarray(table["asks"])
        ids, tags = np.asarray(table["id"]), np.asarray(table["tag"])
        values = _stacked(table["v"].combine_chunks(), table["width"][0].as_py())
        inside, outside = np.flatnonzero(~asks), np.flatnonzero(asks)
        if not len(inside) or not len(outside):
            return pa.table([pa.array([], pa.int64())] * 5, names=FOUND.names)
        kind = _kind(values[outside], values[inside])
        lists = SortedLists(ids[inside], values[inside].astype(kind), tags[inside])
        parts = []
        for part in np.array_split(outside, -(-len(outside) // 256)):
            asking, chosen, scores, _ = best(ids[part], values[part].astype(kind), lists, k)
            asking = part[asking]
            parts.append((tags[asking], ids[asking], lists.ids[chosen], scores, lists.copies[chosen]))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=FOUND.names)

    found = both.groupBy(*meeting).applyInArrow(run, FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best_rows = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    each = best_rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return (
        each.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def quantised(vectors: DataFrame, vector: str, name: str, factor: int = 64) -> DataFrame:
    """``name``: the components times ``factor``, rounded down; null if one is null or not finite."""
    x = field(vector).cast("array<double>")
    fine = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    floors = F.transform(x, lambda c: F.floor(c * factor).cast("long"))
    return vectors.withColumn(name, F.when(fine, floors))
