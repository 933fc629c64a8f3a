"""Removal of word sequences that repeat, found by doubling the length of what is compared.

A window of ``window`` words repeats only if every shorter sequence in it does. So sequences of a
quarter of its length are compared first; those that repeat alone are extended to twice the length, and
those that repeat then, to the window. The first level does not need all sequences: each window is
represented by the smallest (by hash) of its short sequences, a choice that depends on the window's words
only, so equal windows choose alike. Neighbouring windows mostly share their choice; a ``run`` of
them is one row. A run whose whole stretch of words also is a run elsewhere is settled at once,
all its windows repeat; only runs with a common short sequence in different surroundings go on.

Rows are thinned before they are shuffled: what repeats within one batch of documents is settled there, and
one row stands for it elsewhere. So a passage in a third of all documents sends one row per batch.

Stretches are compared by a hash of 64 bits within groups of an independent hash of 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm.batches import field, list_array, sliced, utf8, with_python
from corpuslab.session import cut_lineage

WINDOW = 35
MEMO = 1 << 17
"""Words whose hashes a worker remembers before it starts anew; not a limit on the input."""
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


CROWD = 8
"""A sequence with more different surroundings than this in one batch goes on without comparing them."""
#: What is known of a row: to be counted, settled, to be extended, or both of these.
COUNT, SETTLED, MARKED, BOTH = range(4)


def levels(window: int) -> tuple[int, int, int]:
    """Lengths to compare: a quarter of the window, a half, and all of it, rounded up."""
    return -(-window // 4), -(-window // 2), window


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return values ^ (values >> _U(33))


class _Words(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO:
            self.clear()
        made = self[word] = xxhash.xxh64_intdigest(word)
        return made


_WORDS = _Words()
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, count: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) <= count:
        grown = np.full(max(count, 1 << 16), base, np.uint64)
        grown[0] = 1
        _POWERS[base] = np.cumprod(grown)
    return _POWERS[base][:count]


class Texts:
    """The words of some texts one after the other, with hashes of any stretch of them."""

    def __init__(self, many: list[bytes]):
        split = [t.split() for t in many]
        self.counts = np.array([len(s) for s in split], np.int64)
        self.stops = np.cumsum(self.counts)
        self.starts = self.stops - self.counts
        flat = [w for words in split for w in words]
        self.size = len(flat)
        first = np.fromiter(map(_WORDS.__getitem__, flat), np.uint64, self.size)
        self.sums = []
        for base, values in zip(_BASES, (first, _mixed(first + _U(1))), strict=True):
            sums = np.zeros(self.size + 1, np.uint64)
            np.cumsum(values * _powers(base, self.size), out=sums[1:])
            self.sums.append(sums)

    def hashes(self, which: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the words from ``start`` up to ``stop``."""
        inverse = pow(_BASES[which], -1, 1 << 64)
        sums = self.sums[which]
        plain = (sums[stop] - sums[start]) * _powers(inverse, self.size + 1)[start]
        return _mixed(plain + (stop - start).astype(np.uint64))


def _rows(texts: Texts, owner, first, last, at, length, window):
    """Columns of the runs: two hashes, the owner, and places counted from its first word."""
    base = texts.starts[owner]
    key = texts.hashes(0, at, at + length)
    around = texts.hashes(1, first, last + window)
    return key.view(np.int64), around.view(np.int64), owner, first - base, last - base, at - base


def first_runs(texts: Texts, length: int, window: int):
    """Runs of windows that choose the same short sequence."""
    windows = np.maximum(texts.counts - window + 1, 0)
    owner = np.repeat(np.arange(len(windows)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = place + texts.starts[owner]
    grams = np.arange(max(0, texts.size - length + 1))
    value = texts.hashes(0, grams, grams + length)
    chosen, reach = grams, 1
    while reach < window - length + 1:
        step = min(reach, window - length + 1 - reach)
        left, right = chosen[:-step], chosen[step:]
        chosen = np.where(value[right] < value[left], right, left)
        reach += step
    chosen = chosen[at] if len(at) else at
    begins = np.flatnonzero(np.diff(chosen, prepend=-1))
    ends = np.append(begins[1:], len(at)) - 1 if len(begins) else begins
    return _rows(texts, owner[begins], at[begins], at[ends], chosen[begins], length, window)


def next_runs(texts: Texts, owner, first, last, at, length: int, longer: int, window: int):
    """Each run's windows again, cut into runs by the longer sequence around the known one."""
    base = texts.starts[owner]
    first, last, at = first + base, last + base, at + base
    counts = last - first + 1
    run = np.repeat(np.arange(len(first)), counts)
    place = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts) + first[run]
    known = at[run]
    wider = np.where(
        known <= place + window - longer, known, np.maximum(place, known + length - longer)
    )
    if len(run) == 0:
        begins = run
        ends = run
    else:
        begins = np.flatnonzero((np.diff(wider, prepend=-1) != 0) | (np.diff(run, prepend=-1) != 0))
        ends = np.append(begins[1:], len(run)) - 1
    return _rows(
        texts, owner[run[begins]], place[begins], place[ends], wider[begins], longer, window
    )


ROW = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("key", "around", "doc")]
    + [T.StructField(n, T.IntegerType()) for n in ("first", "last", "at")]
    + [T.StructField(n, T.IntegerType()) for n in ("kind", "n_key", "n_around", "loose")]
)
WINDOWS = T.StructType(
    [
        *ROW.fields,
        T.StructField("places", T.ArrayType(T.IntegerType())),
        T.StructField("keys", T.ArrayType(T.LongType())),
        T.StructField("arounds", T.ArrayType(T.LongType())),
    ]
)


def thinned(key: np.ndarray, around: np.ndarray):
    """What one batch knows of its rows: ``kind, n_key, n_around, loose``.

    Of rows with equal key and surroundings one is counted, with the number of all; the others are
    settled. A key with more than ``CROWD`` surroundings has one row counted, which is ``loose``: it
    tells of rows to be extended that are not counted.
    """
    size = len(key)
    kind, n_key, n_around, loose = (np.zeros(size, np.int32) for _ in range(4))
    if not size:
        return kind, n_key, n_around, loose
    order = np.lexsort((around, key))
    new_key = np.diff(key[order], prepend=0) != 0
    new_key[0] = True
    new = new_key | (np.diff(around[order], prepend=0) != 0)
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, size))
    group = np.cumsum(new_key) - 1
    crowded = np.bincount(group[heads])[group] > CROWD
    kind[order] = np.where(new, COUNT, SETTLED)
    later = crowded[heads] & ~new_key[heads]
    kind[order[heads[later]]] = np.where(sizes[later] > 1, BOTH, MARKED)
    n_around[order[heads]] = np.minimum(sizes, 2)
    n_key[order[heads]] = n_around[order[heads]]
    first = new_key & crowded
    loose[order[first]], n_key[order[first]] = 1, 2
    return kind, n_key, n_around, loose


def _columns(made, docs: np.ndarray) -> list[pa.Array]:
    key, around, owner, first, last, at = made
    doc = docs[owner]
    kind, n_key, n_around, loose = thinned(key, around)
    plain = kind != COUNT
    key, around = np.where(plain, doc, key), np.where(plain, 0, around)
    small = (first, last, at, kind, n_key, n_around, loose)
    return [pa.array(c) for c in (key, around, doc)] + [
        pa.array(c.astype(np.int32)) for c in small
    ]


def runs(docs: DataFrame, length: int, window: int) -> DataFrame:
    """All runs of all documents (``doc``, ``text``) at the first level."""

    def run(batches):
        for batch in batches:
            for part in sliced(batch):
                made = first_runs(Texts(utf8(part.column(1))), length, window)
                columns = _columns(made, np.asarray(part.column(0)))
                yield pa.RecordBatch.from_arrays(columns, names=ROW.names)

    return docs.select("doc", "text").mapInArrow(run, ROW)


def extended(marked: DataFrame, length: int, longer: int, window: int) -> DataFrame:
    """The marked runs of each document at the next level, with the hashes of their windows.

    ``marked`` has ``doc, text, firsts, lasts, ats``. Windows that repeat within the batch are
    given as settled rows of their own; only the first of them stays with its run. First is what has the
    smallest ``doc`` and place, as in ``resolve``: so the first of all rows that hold a window goes on,
    and goes on with it.
    """

    def run(batches):
        for batch in batches:
            for part in sliced(batch):
                docs, texts = np.asarray(part.column(0)), Texts(utf8(part.column(1)))
                lists = [part.column(i) for i in (2, 3, 4)]
                counts = np.asarray(pa.compute.list_value_length(lists[0]))
                owner = np.repeat(np.arange(len(counts)), counts)
                flat = [np.asarray(x.flatten()).astype(np.int64) for x in lists]
                in_turn = np.lexsort((flat[0], docs[owner]))
                owner, flat = owner[in_turn], [x[in_turn] for x in flat]
                made = next_runs(texts, owner, *flat, length, longer, window)
                _, _, owner, first, last, _ = made
                n = last - first + 1
                of = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]
                start = place + texts.starts[owner[of]]
                keys = texts.hashes(0, start, start + window).view(np.int64)
                arounds = texts.hashes(1, start, start + window).view(np.int64)
                order = np.lexsort((arounds, keys))
                same = (np.diff(keys[order]) == 0) & (np.diff(arounds[order]) == 0)
                again, known = np.zeros(len(of), bool), np.zeros(len(of), bool)
                again[order[1:][same]] = True
                known[order[1:][same]] = known[order[:-1][same]] = True
                kept = ~again
                lengths = np.bincount(of[kept], minlength=len(n))
                columns = _columns(made, docs) + [
                    list_array(place[kept].astype(np.int32), lengths),
                    list_array(keys[kept], lengths),
                    list_array(arounds[kept], lengths),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=WINDOWS.names)
                settled = np.flatnonzero(known)
                if len(settled):
                    joins = (np.diff(of[settled]) == 0) & (np.diff(place[settled]) == 1)
                    begins = settled[np.append(True, ~joins)]
                    ends = settled[np.append(~joins, True)]
                    doc, zero = docs[owner[of[begins]]], np.zeros(len(begins), np.int32)
                    none = pa.array([[]] * len(begins), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc), pa.array(zero.astype(np.int64)), pa.array(doc)]
                        + [pa.array(place[x].astype(np.int32)) for x in (begins, ends, begins)]
                        + [pa.array(c) for c in (zero + SETTLED, zero, zero, zero)]
                        + [none.cast(pa.list_(pa.int32())), none, none],
                        names=WINDOWS.names,
                    )

    return marked.select("doc", "text", "firsts", "lasts", "ats", "whole").mapInArrow(run, WINDOWS)


def resolve(rows: DataFrame) -> DataFrame:
    """The rows that repeat, with ``settled`` (all windows repeat) and ``marked`` (to be extended).

    The window by key comes first, so that its one exchange serves the windows by surroundings, too.
    Of rows that repeat as a whole one goes on with the open rows of the same sequence, since
    those may share windows with it.
    """
    by_key = Window.partitionBy("key", "kind")
    by_around = Window.partitionBy("key", "kind", "around")
    counted = (
        rows.withColumn("in_key", F.sum("n_key").over(by_key))
        .withColumn("in_around", F.sum("n_around").over(by_around))
        .withColumn("nth", F.row_number().over(by_around.orderBy("doc", "first")))
        .withColumn("open", (F.min("in_around").over(by_key) < 2) | (F.max("loose").over(by_key) > 0))
    )
    kind, alone = F.col("kind"), F.col("in_around") < 2
    settled = F.when(kind == COUNT, ~alone).otherwise(kind.isin(SETTLED, BOTH))
    goes_on = (F.col("in_key") > 1) & F.col("open") & (alone | (F.col("nth") == 1))
    marked = F.when(kind == COUNT, goes_on).otherwise(kind.isin(MARKED, BOTH))
    found = counted.withColumns({"settled": settled, "marked": marked})
    return found.where("settled or marked").drop("in_around", "nth", "in_key", "open")


def repeated_windows(rows: DataFrame) -> DataFrame:
    """``doc, first, last`` of the settled rows and of each marked row's windows that repeat."""
    empty = F.array().cast("array<struct<places:int,keys:bigint,arounds:bigint>>")
    windows = F.when(F.col("marked"), F.arrays_zip("places", "keys", "arounds")).otherwise(empty)
    own = F.struct(
        F.lit(None).cast("int").alias("places"), F.col("doc").alias("keys"), F.lit(0).cast("long").alias("arounds")
    )
    listed = rows.select(
        "doc",
        "first",
        "last",
        F.explode(F.concat(windows, F.when(F.col("settled"), F.array(own)).otherwise(empty))).alias("w"),
    )
    flat = listed.select(
        "doc",
        F.coalesce("w.places", "first").alias("first"),
        F.coalesce("w.places", "last").alias("last"),
        F.col("w.places").isNull().alias("known"),
        F.col("w.keys").alias("key"),
        F.col("w.arounds").alias("around"),
    )
    alike = Window.partitionBy("key", "around", "known")
    flat = flat.withColumn("n", F.count("*").over(alike))
    return flat.where("known or n > 1").select("doc", "first", "last")


def identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc`` (a long of its own for each row: the key, if it is one), ``text``, ``whole`` (the row)."""
    doubled = docs.groupBy(field(key).alias("k")).agg(F.count("*").alias("n"))
    whole_number = isinstance(docs.schema[key].dataType, T.IntegralType)
    unique = whole_number and not doubled.where("n > 1 or k is null").take(1)
    doc = field(key).cast("long") if unique else F.monotonically_increasing_id()
    made = docs.select(
        doc.alias("doc"),
        field(text).alias("text"),
        F.struct(F.lit(True).alias("_"), *(field(c) for c in docs.columns if c != text)).alias("whole"),
    )
    return made.where("doc is not null") if unique else cut_lineage(made).where("doc is not null")


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """Add ``n_words``, ``n_removed`` (long) and ``kept``, the words left, with single spaces.

    Words are runs without ASCII white space. A word goes if a window of ``window`` words that
    covers it also starts anywhere else, in the same document or another; rows with the same
    key are documents of their own. Null and short texts lose nothing. Input columns
    named like the new ones are replaced.
    """
    clean = docs.drop("n_words", "n_removed", "kept")
    whole = identified(clean, key, text)
    quarter, half, _ = levels(window)
    first = resolve(runs(whole, quarter, window)).select("doc", "first", "last", "at", "settled", "marked")
    known = cut_lineage(first.groupBy("doc").agg(F.collect_list(F.struct(*first.columns[1:])).alias("runs")))

    def listed(which: str, **names: str) -> list:
        chosen = F.filter("runs", lambda r: r[which])
        return [chosen.getField(c).alias(n) for n, c in names.items()]

    marks = known.where(F.exists("runs", lambda r: r["marked"])).select(
        "doc", *listed("marked", firsts="first", lasts="last", ats="at")
    )
    settled = known.select("doc", *listed("settled", firsts="first", lasts="last"))
    rest = repeated_windows(resolve(extended(whole.join(marks, "doc"), quarter, half, window)))
    rest = rest.groupBy("doc").agg(
        F.collect_list("first").alias("more_firsts"), F.collect_list("last").alias("more_lasts")
    )
    joined = whole.join(settled, "doc", "left").join(rest, "doc", "left")

    def setup():
        def make(column, *lists):
            n_words, n_removed, kept = [], [], []
            spans = zip(*(c.to_pylist() for c in lists), strict=True)
            for t, (a, b, c, d) in zip(utf8(column), spans, strict=True):
                words = t.split()
                n_words.append(len(words))
                if a or c:
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, np.array((a or []) + (c or [])), 1)
                    np.add.at(edges, np.array((b or []) + (d or [])) + window, -1)
                    left = np.flatnonzero(np.cumsum(edges)[:-1] == 0)
                    words = [words[i] for i in left.tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            return [
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ]

        return make

    added = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType()),
        ]
    )
    lists = [F.col(c) for c in ("firsts", "lasts", "more_firsts", "more_lasts")]
    made = with_python(joined, [F.col("text"), *lists], added, setup)
    old = (
        (F.col("text") if c == text else F.col("whole").getField(c)).alias(c)
        for c in clean.columns
    )
    return made.select(*old, *added.names)
