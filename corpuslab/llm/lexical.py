"""Ranked lexical search: inner products of term weights and impacts, pruned by lengths of vectors.

A document is a vector of impacts, an item a vector of weights, both over the terms of the items. Documents
are put in order of their vectors' lengths and go, longest first, through buckets. For each
item a score is known that its result cannot fall below: the k-th best one so far. By Cauchy and Schwarz no
document of a bucket scores more than the lengths of the item and of the bucket's longest vector allow, so
the item may skip the whole bucket. Else its heaviest coordinates are looked at, as many as
make the others too short to matter alone: only documents that hold one of these can qualify, and only those
stay whose part of the score on these coordinates, and the lengths of what is left of both vectors, can reach
the known score. What stays is scored in whole numbers from all coordinates.

Buckets go in rounds, a small share of the longest vectors first, as the k-th scores of one round are the known
scores of the next. Lengths that no item can use are left out of a round's scan.
"""

from __future__ import annotations

import math
import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm.batches import field, list_array, scratch_folder, sliced, utf8
from corpuslab.llm.decontaminate import words_of

K = 50
BUCKET = 4096
"""Documents in a bucket, at most."""
ROUNDS = (1 / 64, 1 / 8)
"""Shares of the documents, by length of their vectors, that the rounds before the last reach to."""
BLOCK_BYTES = 4 << 20
"""Texts of items go through the search in blocks of about so many bytes, and of ``BLOCK_ITEMS`` items."""
BLOCK_ITEMS = 1024
_SLACK = 1 + 1e-9


class Block:
    """The items of one block: numbers of their terms, and weights in falling order."""

    def __init__(self, items: list[tuple[int, bytes]]):
        held: dict[int, set[bytes]] = {}
        for item, text in items:
            held.setdefault(item, set()).update(words_of(text))
        held = {i: t for i, t in held.items() if t}
        self.terms = {t: n for n, t in enumerate(sorted(set().union(*held.values())))}
        self.items = sorted(held)
        self.lists = [np.array(sorted(self.terms[t] for t in held[i]), np.int64) for i in self.items]
        self.weights: list[np.ndarray] = []
        self.rests: list[np.ndarray] = []

    def weigh(self, weight: np.ndarray) -> None:
        for n, terms in enumerate(self.lists):
            self.lists[n] = terms[np.lexsort((terms, -weight[terms]))]
        self.weights = [weight[terms] for terms in self.lists]
        squares = [np.append(w, 0).astype(np.float64)[::-1] ** 2 for w in self.weights]
        #: Lengths of an item's vector without its first coordinates.
        self.rests = [np.sqrt(np.cumsum(s))[::-1] for s in squares]


class Bucket:
    """Vectors of some documents, by document and by coordinate."""

    def __init__(self, ids: np.ndarray, impacts: np.ndarray, sizes: np.ndarray, lengths: np.ndarray):
        self.ids, self.impacts, self.sizes, self.lengths = ids, impacts, sizes, lengths
        self.stops = np.cumsum(sizes)
        self.longest = float(lengths.max(initial=0))
        order = np.argsort(ids, kind="stable")
        self.sorted_ids = ids[order]
        self.rows = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.values = impacts[order].astype(np.float64)

    def candidates(self, terms: np.ndarray, weights: np.ndarray, rests: np.ndarray, least: int) -> np.ndarray:
        """Documents that may reach the score ``least``, which is 1 at least."""
        if rests[0] * self.longest * _SLACK < least:
            return np.zeros(0, np.int64)
        focus = len(terms) - int(np.searchsorted(rests[::-1] * self.longest * _SLACK, least)) + 1
        focus = min(focus, len(terms))
        starts = np.searchsorted(self.sorted_ids, terms[:focus])
        stops = np.searchsorted(self.sorted_ids, terms[:focus], side="right")
        places = np.concatenate([np.arange(a, b) for a, b in zip(starts, stops, strict=True)])
        rows, values = self.rows[places], self.values[places]
        width = len(self.sizes)
        part = np.bincount(rows, values * np.repeat(weights[:focus], stops - starts), width)
        known = np.bincount(rows, values * values, width)
        other = np.sqrt(np.maximum(self.lengths**2 * _SLACK - known, 0))
        return np.flatnonzero((part > 0) & ((part + rests[focus] * other) * _SLACK >= least))

    def scores(self, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of the documents ``rows`` for the weights by term."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        at = np.arange(int(sizes.sum())) + np.repeat(self.stops[rows] - ends, sizes)
        return np.add.reduceat(weight[self.ids[at]] * self.impacts[at], ends - sizes)


VECTOR = T.StructType(
    [
        T.StructField("doc", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("tfs", T.ArrayType(T.IntegerType())),
    ]
)
FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("item", "doc", "score")])


def _vectors(docs: DataFrame, shared) -> DataFrame:
    """Documents with a term: their number of terms, and the items' terms in them with their counts."""

    def run(batches):
        numbers = pickle.loads(shared.value)
        for batch in batches:
            for part in sliced(batch):
                sizes, ids, tfs, lengths = [], [], [], []
                for text in utf8(part.column(1)):
                    words = words_of(text)
                    known = np.fromiter((n for n in map(numbers.get, words) if n is not None), np.int32)
                    found, counts = np.unique(known, return_counts=True)
                    sizes.append(len(words))
                    ids.append(found)
                    tfs.append(counts)
                    lengths.append(len(found))
                made = pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes, pa.int64()),
                        list_array(np.concatenate(ids).astype(np.int32), lengths),
                        list_array(np.concatenate(tfs).astype(np.int32), lengths),
                    ],
                    names=VECTOR.names,
                )
                yield made.filter(pa.array(np.array(sizes) > 0))

    return docs.mapInArrow(run, VECTOR)


def _ranked(docs: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((docs, -scores))[:k]


def _search(buckets: DataFrame, shared, least: dict[int, int], terms: int, k: int, size: int) -> DataFrame:
    """Each task's best documents of each item; those under the known scores are left out."""

    def run(batches):
        block: Block = pickle.loads(shared.value)
        none = np.zeros(0, np.int64)
        known = [max(1, least.get(i, 0)) for i in block.items]
        best = [(none, none) for _ in block.items]
        weight = np.zeros(terms, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                docs = part.column(0).fill_null(_NULL).to_numpy(zero_copy_only=False)
                sizes = np.asarray(pc.list_value_length(part.column(1))).astype(np.int64)
                ids, impacts = (np.asarray(part.column(i).flatten()).astype(np.int64) for i in (1, 2))
                bucket = Bucket(ids, impacts, sizes, np.asarray(part.column(3)))
                for i, chosen in enumerate(block.lists):
                    rows = bucket.candidates(chosen, block.weights[i], block.rests[i], known[i])
                    if not len(rows):
                        continue
                    weight[chosen] = block.weights[i]
                    scores = bucket.scores(rows, weight)
                    weight[chosen] = 0
                    good = scores >= known[i]
                    held = np.concatenate((best[i][0], docs[rows[good]])), np.concatenate((best[i][1], scores[good]))
                    order = _ranked(*held, k)
                    best[i] = held[0][order], held[1][order]
                    if len(order) == k:
                        known[i] = max(known[i], int(best[i][1][-1]))
        counts = [len(d) for d, _ in best]
        docs = np.concatenate([d for d, _ in best] or [none])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array(block.items, np.int64), counts)),
                pa.array(docs, mask=docs == _NULL),
                pa.array(np.concatenate([s for _, s in best] or [none])),
            ],
            names=FOUND.names,
        )

    return buckets.select("doc", "ids", "impacts", "length").mapInArrow(run, FOUND)


_NULL = np.iinfo(np.int64).min


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    k: int = K,
    bucket: int = BUCKET,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item with a score above 0.

    Terms are runs of ASCII letters and digits, A-Z lower-cased, and of what lies beyond ASCII. Null and empty
    texts have none and do not count as documents. Equal scores go by ascending key, a null key first; every
    row is a document of its own, so rows that share a key each have a rank. Rows of an item id
    are one item with all their terms; rows without an id or a term ask nothing. Empty tables give no rows.
    Other columns, whatever their names, are not looked at.

    The items are measured first and go in blocks of about ``block_bytes`` and of at most ``BLOCK_ITEMS`` ids on
    average, with one search each; a block's terms, and one score per item, are what comes to the driver.
    """
    spark = docs.sparkSession
    asked = items.select(field(item).cast("long").alias("i"), field(item_text).cast("binary").alias("t"))
    asked = asked.where("i is not null and t is not null")
    size, ids = asked.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)), F.count_distinct("i")).head()
    blocks = max(size // block_bytes, ids // BLOCK_ITEMS) + 1
    rows = docs.select(field(key).cast("long").alias("doc"), field(text).alias("text"))
    parts = []
    for number in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == number).collect()
        block = Block([(r[0], bytes(r[1])) for r in held])
        if block.items:
            parts += _search_block(rows, block, k, bucket)
    empty = spark.createDataFrame([], FOUND)
    top = _top(reduce(DataFrame.unionByName, parts, empty), k)
    return top.select(
        F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score"
    )


def _search_block(rows: DataFrame, block: Block, k: int, bucket: int) -> list[DataFrame]:
    """What each round found, as written tables."""
    spark = rows.sparkSession
    folder = scratch_folder(spark, "lexical")
    shared = spark.sparkContext.broadcast(pickle.dumps(block.terms))
    _vectors(rows, shared).write.parquet(f"{folder}/vectors")
    vectors = spark.read.parquet(f"{folder}/vectors")
    docs, terms = vectors.agg(F.count("*"), F.sum("n")).head()
    if not docs:
        return []
    counts = vectors.select(F.explode("ids").alias("t")).groupBy("t").count().collect()
    weight = np.zeros(len(block.terms), np.int64)
    for t, df in counts:
        weight[t] = math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))
    block.weigh(weight)
    shared = spark.sparkContext.broadcast(pickle.dumps(block))

    m = F.expr(f"100 - 50 + ((50L * n * {docs}L) div {terms}L)")
    impacts = F.expr("transform(tfs, f -> (1000000000L * f) div (1000L * f + 20L * m))")
    square = F.expr("aggregate(impacts, 0D, (s, x) -> s + double(x) * double(x))")
    made = vectors.where("size(ids) > 0").withColumn("m", m).withColumn("impacts", impacts)
    made = made.select("doc", "ids", F.expr("transform(impacts, x -> int(x))").alias("impacts"), F.sqrt(square).alias("length"))
    # Vectors of one length are dealt to ranges by a hash, so that copies are no single task.
    ordered = made.repartitionByRange(F.desc("length"), F.xxhash64("doc")).sortWithinPartitions(F.desc("length"))
    ordered.write.parquet(f"{folder}/buckets")
    buckets = spark.read.parquet(f"{folder}/buckets")

    edges = buckets.agg(F.percentile_approx("length", [1 - s for s in ROUNDS], 10_000)).head()[0] or []
    parts, least, above = [], {}, float("inf")
    for number, below in enumerate([*edges, 0.0]):
        # The longest vector that no item can use any more; 0 while an item has fewer than k documents.
        usable = min(
            (least.get(i, 0) / (r[0] * _SLACK) if r[0] else float("inf") for i, r in zip(block.items, block.rests, strict=True)),
            default=float("inf"),
        )
        chosen = buckets.where((F.col("length") >= max(below, usable * (1 - 1e-9))) & (F.col("length") < above))
        _search(chosen, shared, least, len(block.terms), k, bucket).write.parquet(f"{folder}/round={number}")
        parts.append(spark.read.schema(FOUND).parquet(f"{folder}/round={number}"))
        above = min(above, below)
        if number < len(edges):
            known = _top(reduce(DataFrame.unionByName, parts), k).groupBy("item")
            known = known.agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == k)
            least = {r.item: r.score for r in known.collect()}
    return parts
