"""Passages of benchmark items in documents, found by one automaton in one scan of each text.

Texts become words in lower case joined by single spaces. The automaton holds every window
of an item's words, with a space on both sides, so that it matches whole words only. What
it finds is counted in words, and words are mapped to characters of the original text.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm.batches import field, list_array, utf8, with_python

WINDOW = 13
BLOCK_BYTES = 16 << 20
"""Benchmark texts go into automata of about so many bytes each."""

_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
SPAN = T.StructType(
    [
        T.StructField(name, T.LongType())
        for name in ("first_word", "last_word", "start", "stop")
    ]
)


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits, in lower case, and of bytes beyond ASCII."""
    return text.translate(_LETTERS).split()


def build(items: list[tuple[int, bytes]], window: int = WINDOW):
    """An automaton over all windows; each knows its number of words and its items."""
    import ahocorasick

    held: dict[str, tuple[int, set[int]]] = {}
    for item, text in items:
        words = words_of(text)
        for start in range(max(1, len(words) - window + 1) if words else 0):
            part = words[start : start + window]
            key = b" %b " % b" ".join(part)
            held.setdefault(key.decode(), (len(part), set()))[1].add(item)
    automaton = ahocorasick.Automaton()
    for key, (length, owners) in held.items():
        automaton.add_word(key, (length, sorted(owners)))
    if held:
        automaton.make_automaton()
    return automaton


def find(automaton, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, merged ranges ``[first, stop)`` of hit words, and items found."""
    words = words_of(text)
    if not words or not len(automaton):
        return len(words), [], set()
    line = f" {b' '.join(words).decode(errors='replace')} "
    ranges, items, spaces = [], set(), None
    for end, (length, owners) in automaton.iter(line):
        if spaces is None:
            spaces = [i for i, c in enumerate(line) if c == " "]
        stop = bisect_left(spaces, end)
        start = stop - length
        if ranges and start <= ranges[-1][1]:
            ranges[-1] = (min(start, ranges[-1][0]), max(stop, ranges[-1][1]))
        else:
            ranges.append((start, stop))
        items.update(owners)
    return len(words), merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges in order, those that meet made one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(stop, out[-1][1])
        else:
            out.append((start, stop))
    return out


def character_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where the word ranges begin and end in the original text, in characters."""
    if not ranges:
        return []
    word = np.frombuffer(text.translate(_LETTERS), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], word.view(np.int8), [0]))))
    before = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    starts, stops = before[edges[::2]], before[edges[1::2]]
    return [(int(starts[a]), int(stops[b - 1])) for a, b in ranges]


_WORKER: dict = {}


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add to each document what it shares with the benchmark.

    ``n_words`` (long); ``hits``, an array of merged spans with first and last word and the
    characters ``start`` to ``stop`` of the original text; ``items`` (array of long), the
    items with a window in the document, sorted. Input columns of these names are replaced.

    The benchmark is measured first. It is cut by a hash of the item into blocks of about
    ``block_bytes``, each of which is one automaton; a document is scanned once for each
    block, so an ordinary benchmark takes one scan. Null texts have no words; items
    without words or with a null id are never found; repeated items count once.
    """
    spark = docs.sparkSession
    items = benchmark.select(field(item).cast("long").alias("i"), field(item_text).alias("t"))
    items = items.where("i is not null and t is not null").select(
        "i", F.col("t").cast("binary").alias("t")
    )
    size = items.agg(F.sum(F.length("t"))).head()[0] or 0
    blocks = size // block_bytes + 1
    out = docs
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block)
        rows = sorted((r[0], bytes(r[1])) for r in part.collect())
        shared = spark.sparkContext.broadcast(pickle.dumps(rows))
        out = _scan_block(out, text, shared, window, first=not block)
    return out


def _scan_block(docs, text, shared, window, first):
    long, spans, ids = T.LongType(), T.ArrayType(SPAN), T.ArrayType(T.LongType())
    added = T.StructType(
        [
            T.StructField("n_words", long),
            T.StructField("hits", spans),
            T.StructField("items", ids),
        ]
    )
    earlier = [] if first else [F.col("hits"), F.col("items")]

    def setup():
        key = hash(shared.value), window
        if _WORKER.get("key") != key:
            _WORKER.update(key=key, automaton=build(pickle.loads(shared.value), window))
        automaton = _WORKER["automaton"]

        def make(column, *before):
            n_words, found, owners = [], [], []
            olds = zip(*(b.to_pylist() for b in before), strict=True) if before else None
            for t in utf8(column):
                n, ranges, items = find(automaton, t)
                if olds:
                    hits, held = next(olds)
                    ranges = merged(ranges + [(h["first_word"], h["last_word"] + 1) for h in hits])
                    items |= set(held)
                n_words.append(n)
                owners.append(sorted(items))
                found.append(
                    [
                        (a, b - 1, c, d)
                        for (a, b), (c, d) in zip(ranges, character_spans(t, ranges), strict=True)
                    ]
                )
            flat = np.array([s for spans in found for s in spans], np.int64).reshape(-1, 4)
            structs = pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(flat[:, i])) for i in range(4)], SPAN.names
            )
            return [
                pa.array(n_words, pa.int64()),
                pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), structs
                ),
                list_array(
                    np.array([i for o in owners for i in o], np.int64), [len(o) for o in owners]
                ),
            ]

        return make

    return with_python(docs, [field(text), *earlier], added, setup)


def verdicts(scanned: DataFrame) -> DataFrame:
    """Add ``n_hit`` (hit words) and ``contaminated``: a twentieth of the words or more."""
    hit = F.aggregate(
        "hits", F.lit(0).cast("long"), lambda n, h: n + h["last_word"] - h["first_word"] + 1
    )
    return scanned.withColumn("n_hit", hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )
