"""Approximate nearest neighbours by inner product, from a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is then put into a leaf. A query goes through the tree best bin
first: a priority queue holds nodes by the inner product of their centres with the query, the best one is
opened, and leaves are visited in the order they come out. How many leaves a search visits is calibrated:
a bounded set of queries is answered by brute force over all rows, and visits are widened until the leaves hold the
wanted share of these answers.

The index is kept in order of leaves. Queries go over it in blocks of bounded size, each with the leaves it
visits: a task meets each leaf's rows with the queries that visit it, and gives its best rows of each query.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm.batches import field, list_array, scratch_folder, with_python
from corpuslab.session import cut_lineage

K = 20
SAMPLE = 20_000
"""Rows the tree is fitted on, about; of wide vectors fewer, so that they take ``SAMPLE_BYTES``."""
SAMPLE_BYTES = 16 << 20
BRANCH = 8
LEAF_ROWS = 48
"""A node with so many rows of the sample, or fewer, is a leaf."""
CALIBRATED = 256
"""Queries answered by brute force to calibrate the visits, about."""
RECALL = 0.95
"""The share of the calibration's answers that the visited leaves must hold."""
BLOCK_BYTES = 16 << 20
"""Queries go over the index in blocks of about so many bytes of vectors and visited leaves."""
CELL_QUERIES = 512
"""Queries that meet the rows of a leaf in one matrix product, at most."""
_TURNS = 12


class Tree:
    """Centres of nested clusters; node 0 is the root."""

    def __init__(self, rows: np.ndarray, branch: int = BRANCH, leaf_rows: int = LEAF_ROWS):
        self.centres: list = [rows.mean(axis=0)]
        self.children: list[list[int]] = [[]]
        self.leaf = [-1]
        self.leaves = 0
        random = np.random.default_rng(0)
        open_nodes = [(0, rows)]
        while open_nodes:
            node, held = open_nodes.pop()
            parts = _clusters(held, branch, random) if len(held) > leaf_rows else []
            if len(parts) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
            for part in parts if len(parts) > 1 else []:
                self.children[node].append(len(self.centres))
                open_nodes.append((len(self.centres), part))
                self.centres.append(part.mean(axis=0))
                self.children.append([])
                self.leaf.append(-1)
        self.centres = np.array(self.centres)
        self.squares = np.einsum("ij,ij->i", self.centres, self.centres)

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: down to the nearest centre on every level."""
        at, open_nodes = np.zeros(len(rows), np.int64), [0]
        while open_nodes:
            node = open_nodes.pop()
            children = np.array(self.children[node], np.int64)
            here = np.flatnonzero(at == node)
            if len(children) and len(here):
                far = self.squares[children] - 2 * (rows[here] @ self.centres[children].T)
                at[here] = children[np.argmin(far, axis=1)]
                open_nodes += children.tolist()
        return np.array(self.leaf)[at]

    def visited(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        worth = self.centres @ query
        queue, found = [(-worth[0], 0)], []
        while queue and len(found) < most:
            node = heapq.heappop(queue)[1]
            if self.leaf[node] >= 0:
                found.append(self.leaf[node])
            for child in self.children[node]:
                heapq.heappush(queue, (-worth[child], child))
        return found


def _clusters(rows: np.ndarray, branch: int, random) -> list[np.ndarray]:
    """The rows in at most ``branch`` clusters by k-means; one if they are all equal."""
    centres = rows[[random.integers(len(rows))]]
    near = ((rows - centres[0]) ** 2).sum(axis=1)
    while len(centres) < branch and near.max() > 0:
        new = rows[random.choice(len(rows), p=near / near.sum())]
        centres = np.vstack([centres, new])
        near = np.minimum(near, ((rows - new) ** 2).sum(axis=1))
    for _ in range(_TURNS):
        far = (centres**2).sum(axis=1) - 2 * (rows @ centres.T)
        owner = np.argmin(far, axis=1)
        kept = np.unique(owner)
        made = np.array([rows[owner == c].mean(axis=0) for c in kept])
        if made.shape == centres.shape and np.allclose(made, centres):
            break
        centres = made
    return [rows[owner == c] for c in np.unique(owner)]


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first component to the last."""
    total = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        total += queries[:, d] * rows[:, d]
    return total


def nearest(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, floor: np.ndarray | None = None
):
    """The ``k`` nearest rows of each query: places of query and row, and score.

    With ``floor``, a score for each query, rows that score less are left out: a query that has ``k`` better rows
    already has no use for them. A matrix product says which rows may be among them; these are scored component by component, so
    that equal vectors have equal scores. Ties go to the smaller id, rows of a query's own id are left out.
    """
    rough = queries @ rows.T
    size = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1])
    kept = np.arange(len(ids))
    if floor is not None:
        # A row that no query has use for is no candidate, nor is a query without any: most go here.
        near = rough >= (floor - size * 1e-12)[:, None]
        kept, wanting = np.flatnonzero(near.any(axis=0)), np.flatnonzero(near.any(axis=1))
    else:
        wanting = np.arange(len(queries))
    kept = kept[_few_copies(ids[kept], rows[kept], k)]
    rough = rough[np.ix_(wanting, kept)]
    ids, rows = ids[kept], rows[kept]
    own = ids[None, :] == query_ids[wanting][:, None]
    rough[own] = -np.inf
    least = np.full(len(wanting), -np.inf)
    if len(ids) > k:
        least = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] - size * 1e-12
    if floor is not None:
        least = np.maximum(least, floor[wanting] - size * 1e-12)
    asking, chosen = np.nonzero((rough >= least[:, None]) & ~own)
    asking = wanting[asking]
    scores = products(queries[asking], rows[chosen])
    order = np.lexsort((ids[chosen], -scores, asking))
    asking, chosen, scores = asking[order], chosen[order], scores[order]
    place = np.arange(len(asking)) - np.searchsorted(asking, asking)
    first = place < k
    return asking[first], kept[chosen[first]], scores[first]


def _few_copies(ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of all rows but copies that cannot be among the ``k`` nearest of any query.

    Of a vector ``k`` rows of one id are enough, and of these the first ``2 * k`` by id, as a query
    leaves out the rows of its own id only.
    """
    if not len(ids):
        return np.zeros(0, np.int64)
    packed = np.ascontiguousarray(rows + 0.0).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    group = np.unique(packed, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, group))

    def place(starts: np.ndarray) -> np.ndarray:
        heads = np.flatnonzero(starts)
        return np.arange(len(starts)) - np.repeat(heads, np.diff(np.append(heads, len(starts))))

    new = np.diff(group[order], prepend=-1) != 0
    fresh = new | (np.diff(ids[order], prepend=0) != 0)
    order = order[place(fresh) < k]
    new = np.diff(group[order], prepend=-1) != 0
    return np.sort(order[place(new) < 2 * k])


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix of doubles."""
    flat = np.asarray(column.flatten()).astype(np.float64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _by_width(column: pa.Array):
    """The places of the vectors of each length, with their matrix."""
    widths = np.asarray(pc.list_value_length(column))
    for width in np.unique(widths):
        places = np.flatnonzero(widths == width)
        yield int(width), places, matrix(column.take(pa.array(places)))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v`` of the rows that take part: with a key, and neither null, zero, nor null or non-finite inside."""
    kind = vectors.schema[vector].dataType.elementType
    v = field(vector) if isinstance(kind, (T.FloatType, T.DoubleType)) else field(vector).cast("array<double>")
    rows = vectors.select(field(key).cast("long").alias("id"), v.alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0))


def fit(rows: DataFrame, sample: int = SAMPLE, branch: int = BRANCH, leaf_rows: int = LEAF_ROWS) -> dict[int, Tree]:
    """A tree for each length of vectors that the sample holds more than a leaf of.

    The sample is the rows whose hash is below a threshold that lets ``sample`` rows through, about.
    """
    count, widest = rows.agg(F.count("*"), F.max(F.size("v"))).head()
    if not count:
        return {}
    wanted = max(leaf_rows, min(sample, SAMPLE_BYTES // (8 * widest)))
    share = F.lit(int(min(1.0, wanted / count) * (1 << 30)))
    drawn = rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < share).limit(2 * wanted)
    column = drawn.select("v").toArrow()["v"].combine_chunks()
    return {w: Tree(m, branch, leaf_rows) for w, places, m in _by_width(column) if len(places) > leaf_rows}


LEAF = T.StructType([T.StructField("leaf", T.IntegerType())])
LEAVES = T.StructType([T.StructField("leaves", T.ArrayType(T.IntegerType()))])


def indexed(rows: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """Add ``leaf``; vectors of a length without a tree are all in leaf 0 of their length."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(trees))

    def setup():
        held = pickle.loads(shared.value)

        def make(column):
            leaf = np.zeros(len(column), np.int32)
            for width, places, m in _by_width(column):
                if width in held:
                    leaf[places] = held[width].assign(m)
            return [pa.array(leaf)]

        return make

    return with_python(rows, [F.col("v")], LEAF, setup)


def visits(queries: DataFrame, trees: dict[int, Tree], most: dict[int, int]) -> DataFrame:
    """Add ``leaves``, the leaves each query visits in their order."""
    shared = queries.sparkSession.sparkContext.broadcast(pickle.dumps((trees, most)))

    def setup():
        held, limits = pickle.loads(shared.value)

        def make(column):
            lists: list = [[0]] * len(column)
            for width, places, m in _by_width(column):
                if width in held:
                    for place, row in zip(places.tolist(), m, strict=True):
                        lists[place] = held[width].visited(row, limits[width])
            return [list_array(np.array([x for found in lists for x in found], np.int32), [len(x) for x in lists])]

        return make

    return with_python(queries, [F.col("v")], LEAVES, setup)


ANSWER = T.StructType(
    [
        T.StructField("query", T.LongType()),
        T.StructField("query_id", T.LongType()),
        T.StructField("vec_id", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("leaf", T.IntegerType()),
    ]
)


def brute_force(index: DataFrame, queries: list, k: int) -> DataFrame:
    """Exact answers to a bounded list of queries ``(number, id, vector)``, with the leaves they are in."""
    asked: dict[int, list] = {}
    for number, key, vector in queries:
        asked.setdefault(len(vector), []).append((number, key, vector))
    shared = index.sparkSession.sparkContext.broadcast(pickle.dumps(asked))

    def run(batches):
        held = {
            w: (np.array([q[0] for q in r]), np.array([q[1] for q in r]), np.array([q[2] for q in r], np.float64))
            for w, r in pickle.loads(shared.value).items()
        }
        for batch in batches:
            ids, leaves = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            for width, places, m in _by_width(batch.column(1)):
                if width in held:
                    numbers, keys, wanted = held[width]
                    asking, chosen, scores = nearest(keys, wanted, ids[places], m, k)
                    chosen = places[chosen]
                    columns = (numbers[asking], keys[asking], ids[chosen], scores, leaves[chosen])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=ANSWER.names)

    return _ranked(index.select("id", "v", "leaf").mapInArrow(run, ANSWER), k)


def calibrate(
    index: DataFrame, queries: DataFrame, trees: dict[int, Tree], k: int, recall: float, calibrated: int
) -> tuple[dict[int, int], dict[int, float]]:
    """How many leaves to visit, and the recall reached on the calibration's queries, by length of vectors.

    Queries are those whose hash is below a threshold. Without queries of a length all leaves are visited.
    """
    count = queries.count()
    share = int(min(1.0, calibrated / max(1, count)) * (1 << 30))
    drawn = queries.where(F.pmod(F.xxhash64("tag"), F.lit(1 << 30)) < share).limit(2 * calibrated).collect()
    asked = {q.tag: np.array(q.v, np.float64) for q in drawn}
    order = {t: trees[len(v)].visited(v, trees[len(v)].leaves) for t, v in asked.items() if len(v) in trees}
    answers = brute_force(index, [(q.tag, q.id, q.v) for q in drawn if q.tag in order], k).collect()
    depths: dict[int, list[int]] = {}
    for a in answers:
        depths.setdefault(len(asked[a.query]), []).append(order[a.query].index(a.leaf) + 1)
    most, reached = {}, {}
    for width, tree in trees.items():
        found, visited = sorted(depths.get(width, [])), 1
        held = lambda n, found=found: sum(d <= n for d in found) / len(found)
        while found and visited < tree.leaves and held(visited) < recall:
            visited += max(1, visited // 16)
        most[width] = min(visited, tree.leaves) if found else tree.leaves
        reached[width] = held(most[width]) if found else 1.0
    return most, reached


def search(
    vectors: DataFrame,
    queries: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    recall: float = RECALL,
    sample: int = SAMPLE,
    leaf_rows: int = LEAF_ROWS,
    calibrated: int = CALIBRATED,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each query, by inner product.

    Rows whose key or vector is null, and vectors that are zero, empty or hold null or a non-finite number take no part.
    Vectors are compared with those of their own length only. Query rows that repeat key and vector are one query;
    different vectors of one key are queries of their own. Rows of a query's key are none of its
    candidates; other rows that repeat have a rank each. Ties go to the smaller key. Empty tables give no rows.
    Other columns, whatever their names, are not looked at. Scores are sums of double products in component order.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    trees = fit(rows, sample, leaf_rows=leaf_rows)
    folder = scratch_folder(spark, "vector-tree")
    # Rows of one leaf may be cut between ranges, so that a leaf with many copies is no single task.
    ordered = indexed(rows, trees).repartitionByRange("leaf", F.xxhash64("id", "v")).sortWithinPartitions("leaf")
    ordered.write.parquet(f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")
    asked = usable(queries, key, vector).distinct()
    asked = cut_lineage(asked.withColumn("tag", F.monotonically_increasing_id()))
    most, _ = calibrate(index, asked, trees, k, recall, calibrated)
    visiting = cut_lineage(visits(asked, trees, most))
    size = visiting.agg(F.coalesce(F.sum(8 * F.size("v") + 4 * F.size("leaves")), F.lit(0))).head()[0]
    blocks = size // BLOCK_BYTES + 1
    parts = []
    for number in range(blocks):
        block = visiting.where(F.pmod(F.xxhash64("tag"), F.lit(blocks)) == number)
        _answers(index, block.select("tag", "id", "v", "leaves").toArrow(), k).write.parquet(f"{folder}/{number}")
        parts.append(f"{folder}/{number}")
    return _ranked(spark.read.schema(ANSWER).parquet(*parts), k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(answers: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The ``k`` best answers ``(query, vec_id, score)`` of each query."""
    query, key, score = answers
    order = np.lexsort((key, -score, query))
    query = query[order]
    order = order[np.arange(len(query)) - np.searchsorted(query, query) < k]
    return [a[order] for a in answers]


def _raise_floor(floor: np.ndarray, best: list[np.ndarray], k: int) -> None:
    """Put in the lowest score of the queries that have ``k`` answers in ``best``, as ``_best`` gives them."""
    query, _, score = best
    last = np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query) == k - 1)
    last = last[np.isfinite(score[last])]
    floor[query[last]] = score[last]


def _answers(index: DataFrame, block: pa.Table, k: int) -> DataFrame:
    """Each task's best rows of the block's queries, from the leaves they visit."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        asked = shared.value
        tags, keys = np.asarray(asked["tag"]), np.asarray(asked["id"])
        held, visiting = {}, {}
        for width, places, m in _by_width(asked["v"].combine_chunks()):
            lists = asked["leaves"].combine_chunks().take(pa.array(places))
            owner = np.repeat(np.arange(len(places)), np.asarray(pc.list_value_length(lists)))
            leaves = np.asarray(lists.flatten())
            order = np.argsort(leaves, kind="stable")
            found, starts = np.unique(leaves[order], return_index=True)
            held[width] = places, m
            for leaf, some in zip(found.tolist(), np.split(owner[order], starts[1:]), strict=True):
                visiting[width, leaf] = some
        best = [np.zeros(0, t) for t in (np.int64, np.int64, np.float64)]
        floor = np.full(len(tags), -np.inf)  # the score of each query's last row, once it has k
        for batch in batches:
            ids, leaves = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            parts, waiting = [[b] for b in best], 0
            for width, places, m in _by_width(batch.column(1)):
                order = np.argsort(leaves[places], kind="stable")
                found, starts = np.unique(leaves[places][order], return_index=True)
                for leaf, rows in zip(found.tolist(), np.split(order, starts[1:]), strict=True):
                    some = visiting.get((width, leaf), ())
                    for start in range(0, len(some), CELL_QUERIES):
                        local = some[start : start + CELL_QUERIES]
                        where, queries = held[width]
                        asking = where[local]
                        own = ids[places[rows]]
                        q, chosen, scores = nearest(keys[asking], queries[local], own, m[rows], k, floor[asking])
                        for part, made in zip(parts, (asking[q], own[chosen], scores), strict=True):
                            part.append(made)
                        waiting += len(q)
                    if waiting > k * len(tags):
                        best = _best([np.concatenate(p) for p in parts], k)
                        parts, waiting = [[b] for b in best], 0
                        _raise_floor(floor, best, k)
            best = _best([np.concatenate(p) for p in parts], k)
            _raise_floor(floor, best, k)
        query, key, score = best
        columns = (tags[query], keys[query], key, score, np.zeros(len(query), np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=ANSWER.names)

    return index.select("id", "v", "leaf").mapInArrow(run, ANSWER)
