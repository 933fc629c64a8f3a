"""Counts of next-token pairs by share of the lines, summed in tasks and never written.

A task counts the tokens of some lines at a time as numbers. What goes on from it are keys of 64 bits beside a
bucket, which is taken from other bits of the same 128-bit hash, with their counts in packed columns; buckets are dealt to tasks, which add
up one bucket at a time. Two of a billion distinct pairs share bucket and key with a chance of about one to 60,000 at 1,600 buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.tokens import BOS, EOS

#: What is summed under a key: pairs, tokens by what follows them, tokens by what goes before them, words of lines.
PAIRS, BEFORE, FOLLOWS, LINES = range(4)
SUMS = ("train", "val", "weighted", "train_weighted")
HELD = 200_000  # keys of a tokenizer and kind that a task holds before it hands them on
PLACES = 500_000  # places of pairs that it holds where there are too many tokens for a table of all their pairs
BUCKETS = 16  # per shuffle partition, so that a bucket is a small part of a task's share
SEVERAL = 255  # stands for the part of a key that has been counted more than once
HASH_KEYS = ("next-token pairs", "of a 128-bit key")
ODD = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
PACKED_COLUMNS = ("keys", "parts", "counts", "weights", "train_weights")
PACKED = "tokenizer string, kind int, bucket int, keys binary, parts binary, counts binary, weights binary, train_weights binary"


def _hashes(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each token."""
    low, high = (hash_array(tokens, hash_key=key, categorize=False) for key in HASH_KEYS)
    return low, high


def _codes(tokens: pa.Array | None, text: pa.Array | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The flat tokens of lists, or characters of texts, as numbers, the size of each list, and the distinct tokens."""
    if text is not None:
        points = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
        codes, found = pd.factorize(points)
        distinct = np.array(list(map(chr, found.tolist())), dtype=object)
        return codes, pc.utf8_length(text).to_numpy(zero_copy_only=False), distinct
    flat = tokens.flatten().dictionary_encode()
    distinct = flat.dictionary.to_numpy(zero_copy_only=False)
    return flat.indices.to_numpy(zero_copy_only=False), pc.list_value_length(tokens).to_numpy(zero_copy_only=False), distinct


def _marked(codes: np.ndarray, sizes: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours in each list after markers have been put around it."""
    last = np.cumsum(sizes + 2) - 1
    first = last - sizes - 1
    whole = np.empty(len(codes) + 2 * len(sizes), dtype=np.int64)
    inner = np.ones(len(whole), dtype=bool)
    inner[first] = inner[last] = False
    whole[inner], whole[first], whole[last] = codes, begin, end
    goes_on = np.ones(len(whole), dtype=bool)
    goes_on[last] = False
    return whole[goes_on], whole[1:][goes_on[:-1]]


def _place_of(token: str, distinct: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of a marker, which may be a token of the text, too."""
    at = np.flatnonzero(distinct == token)
    return (int(at[0]), distinct) if len(at) else (len(distinct), np.append(distinct, token))


def _merged(keys: np.ndarray, buckets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with one key and bucket added up; those that are left are sorted by key."""
    order = np.argsort(keys)
    keys, buckets = keys[order], buckets[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (buckets[1:] != buckets[:-1])
    if new.all():
        return keys, buckets, values[order]
    starts = np.flatnonzero(new)
    return keys[starts], buckets[starts], np.add.reduceat(values[order], starts, axis=0)


def _pack(tokenizer: str, kind: int, keys: np.ndarray, buckets: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """A row per bucket, from sums with a column per part and two of weights."""
    counts = values[:, :-2].astype(np.int64)
    several = counts.sum(axis=1) != 1
    parts = np.where(several, SEVERAL, counts.argmax(axis=1)).astype(np.uint8)
    return _pack_rows(tokenizer, kind, keys, buckets, parts, counts[several], values[:, -2], values[:, -1])


def _pack_rows(
    tokenizer: str, kind: int, keys: np.ndarray, buckets: np.ndarray, parts: np.ndarray, counts: np.ndarray, *weights: np.ndarray
) -> pa.RecordBatch:
    """A row per bucket. A key that was counted once needs no more than its part.

    ``counts`` has rows for the other keys only, those with ``SEVERAL`` as part. The two ``weights``, of validation and of
    other lines, go with keys that were counted there.
    """
    order = np.argsort(buckets.astype(np.uint16) if buckets.max() < 1 << 16 else buckets, kind="stable")
    several = parts == SEVERAL
    counted = [parts == 0, (parts != 0) & ~several]
    counted[0][several], counted[1][several] = counts[:, 0] > 0, (counts[:, 1:] > 0).any(axis=1)
    counts = counts[(np.cumsum(several) - 1)[order][several[order]]]
    keys, buckets, parts, several = keys[order], buckets[order], parts[order], several[order]
    edges = np.flatnonzero(np.diff(buckets, prepend=-1, append=-1))
    columns = [(keys, edges), (parts, edges), (counts, np.concatenate([[0], np.cumsum(several)])[edges])]
    for weight, has in zip(weights, counted):
        if weight.any():
            has = has[order]
            columns.append((weight[order][has], np.concatenate([[0], np.cumsum(has)])[edges]))
        else:
            columns.append((weight[:0], np.zeros_like(edges)))
    packed = [[column[start:stop].tobytes() for start, stop in zip(at[:-1], at[1:])] for column, at in columns]
    n = len(edges) - 1
    keyed = [pa.array([tokenizer] * n), pa.array([kind] * n, pa.int32()), pa.array(buckets[edges[:-1]], pa.int32())]
    return pa.RecordBatch.from_arrays(
        [*keyed, *[pa.array(c, pa.binary()) for c in packed]], names=["tokenizer", "kind", "bucket", *PACKED_COLUMNS]
    )


def _unpack(keys: bytes, parts: bytes, counts: bytes, weights: bytes, train_weights: bytes, shares: int) -> tuple[np.ndarray, np.ndarray]:
    keys, parts = np.frombuffer(keys, dtype=np.uint64), np.frombuffer(parts, dtype=np.uint8)
    values = np.zeros((len(keys), shares + 4))
    once = np.flatnonzero(parts != SEVERAL)
    values[once, parts[once]] = 1
    values[parts == SEVERAL, :-2] = np.frombuffer(counts, dtype=np.int64).reshape(-1, shares + 2)
    if weights:
        values[values[:, 0] > 0, -2] = np.frombuffer(weights)
    if train_weights:
        values[(values[:, 1:-2] > 0).any(axis=1), -1] = np.frombuffer(train_weights)
    return keys, values


class _Held:
    """Sums of a tokenizer and kind that a task holds, added up before they are handed on."""

    def __init__(self):
        self.rows, self.n = [], 0

    def add(self, keys: np.ndarray, buckets: np.ndarray, values: np.ndarray) -> tuple | None:
        """What is to be handed on, if anything."""
        self.rows.append((keys, buckets, values))
        self.n += len(keys)
        return self.take(HELD // 2) if self.n > HELD else None

    def take(self, least: int = 0) -> tuple | None:
        if not self.n:
            return None
        rows = _merged(*map(np.concatenate, zip(*self.rows)))
        if len(rows[0]) <= least:
            self.rows, self.n = [rows], len(rows[0])
            return None
        self.rows, self.n = [], 0
        return rows


class _Places:
    """Places of the pairs of a tokenizer that a task holds, counted before they are handed on."""

    def __init__(self):
        self.rows, self.n = [], 0

    def add(self, keys: np.ndarray, buckets: np.ndarray, parts: np.ndarray, weights: np.ndarray, n: int) -> tuple | None:
        self.rows.append((keys, buckets, parts, weights))
        self.n += len(keys)
        return self.take(n) if self.n > PLACES else None

    def take(self, n: int) -> tuple | None:
        """Keys, buckets, parts, counts and both weights as ``_pack_rows`` takes them, with ``n`` parts."""
        if not self.n:
            return None
        keys, buckets, parts, weights = map(np.concatenate, zip(*self.rows))
        self.rows, self.n = [], 0
        order = np.argsort(keys)
        keys, buckets, parts, weights = keys[order], buckets[order], parts[order], weights[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (buckets[1:] != buckets[:-1])
        starts = np.flatnonzero(new)
        several = np.diff(starts, append=len(keys)) > 1
        number = np.cumsum(new) - 1
        counted = several[number]
        place = (np.cumsum(several) - 1)[number[counted]]
        counts = np.bincount(place * n + parts[counted], minlength=int(several.sum()) * n).reshape(-1, n)
        both = [np.add.reduceat(w, starts) if w.any() else np.zeros(len(starts)) for w in _by_side(parts, weights)]
        return keys[starts], buckets[starts], np.where(several, SEVERAL, parts[starts]).astype(np.uint8), counts, *both


def _by_side(parts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights of validation and those of other lines, 0 elsewhere."""
    return np.where(parts == 0, weights, 0.0), np.where(parts == 0, 0.0, weights)


def _sums(numbers: np.ndarray, size: int, part: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers below ``size`` that occur, and their sums: a column per part and two of weights."""
    values = np.zeros((size, n + 2))
    values[:, :n] = np.bincount(numbers * n + part, minlength=size * n).reshape(-1, n)
    for column, side in enumerate(_by_side(part, weight), n):
        if side.any():
            values[:, column] = np.bincount(numbers, side, size)
    used = np.flatnonzero(values[:, :n].any(axis=1))
    return used, values[used]


class _Task:
    """What one task counts of one tokenizer; everything it gives is packed."""

    def __init__(self, name: str, shares: int, buckets: int):
        self.name, self.n, self.buckets = name, shares + 2, buckets
        self.held = {kind: _Held() for kind in (PAIRS, BEFORE, FOLLOWS)}
        self.places = _Places()

    def _bucket(self, high: np.ndarray) -> np.ndarray:
        return (high >> np.uint64(33)).astype(np.int64) % self.buckets

    def count(self, tokens: pa.Array | None, text: pa.Array | None, part: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Count the tokens of some lists, or the characters of some texts."""
        codes, sizes, distinct = _codes(tokens, text)
        begin, distinct = _place_of(BOS, distinct)
        end, distinct = _place_of(EOS, distinct)
        low, high = _hashes(distinct)
        before, after = _marked(codes, sizes, begin, end)
        size, lines = len(distinct), np.repeat(np.arange(len(sizes)), sizes + 1)
        part, weight = part[lines], weight[lines]
        for kind, token in ((BEFORE, before), (FOLLOWS, after)):
            used, values = _sums(token, size, part, weight, self.n)
            if (ready := self.held[kind].add(low[used], self._bucket(high[used]), values)) is not None:
                yield _pack(self.name, kind, *ready)
        if size * size <= len(before):
            pairs, values = _sums(before * size + after, size * size, part, weight, self.n)
            before, after = pairs // size, pairs % size
        keys = low[before] * ODD[0] + low[after] * ODD[1]
        buckets = self._bucket(high[before] * ODD[2] + high[after] * ODD[3])
        if size * size <= len(part):
            if (ready := self.held[PAIRS].add(keys, buckets, values)) is not None:
                yield _pack(self.name, PAIRS, *ready)
        elif (ready := self.places.add(keys, buckets, part.astype(np.uint8), weight, self.n)) is not None:
            yield _pack_rows(self.name, PAIRS, *ready)

    def rest(self) -> Iterator[pa.RecordBatch]:
        for kind, held in self.held.items():
            if (ready := held.take()) is not None:
                yield _pack(self.name, kind, *ready)
        if (ready := self.places.take(self.n)) is not None:
            yield _pack_rows(self.name, PAIRS, *ready)


def _packed(rows: DataFrame, shares: int, buckets: int) -> DataFrame:
    """``rows`` of ``losses`` counted in tasks, a row per tokenizer, kind and bucket whenever a task hands some on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tasks: dict[str, _Task] = {}
        words: dict[str, int] = {}
        for batch in batches:
            names = batch.column("tokenizer").dictionary_encode()
            for number, name in enumerate(names.dictionary.to_pylist()):
                lines = batch.filter(pc.equal(names.indices, number))
                in_text = lines.column("tokens").null_count == lines.num_rows
                lines = lines.filter(pc.is_valid(lines.column("text" if in_text else "tokens")))
                if not lines.num_rows:
                    continue
                part, weight = lines.column("part").to_numpy(), lines.column("weight").to_numpy()
                words[name] = words.get(name, 0) + int(lines.column("words").to_numpy()[part == 0].sum())
                lists = (None, lines.column("text")) if in_text else (lines.column("tokens"), None)
                if name not in tasks:
                    tasks[name] = _Task(name, shares, buckets)
                yield from tasks[name].count(*lists, part, weight)
        for task in tasks.values():
            yield from task.rest()
        for name, n in words.items():
            values = np.zeros((1, shares + 4))
            values[0, 0] = n
            yield _pack(name, LINES, np.zeros(1, np.uint64), np.zeros(1, np.int64), values)

    return rows.mapInArrow(run, PACKED)


def losses(rows: DataFrame, shares: int, alpha: float, scored: int) -> DataFrame:
    """Sums over distinct pairs and tokens of all lines, see ``experiments.pair_losses``; a small table.

    For pairs and for tokens that follow: the number of keys ``n``, the totals ``n1``, … of the first shares, ``m``
    of validation, ``weight`` and ``train_weight``, and ``train1``, ``val1``, ``weighted1``, ``train_weighted1``, …: counts times ``log(n{e} + alpha)``. For tokens
    that go before: the counts ``train{e}``, … of all tokens that have one ``total`` in the fit ``fit``.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fits = range(1, shares + 1)
    names = [f"{s}{e}" for e in fits for s in SUMS]
    counted, weights = ["n", *[f"n{e}" for e in fits], "m"], ["weight", "train_weight"]
    given = rows.select(
        "tokenizer", "tokens", "text", F.col("part").cast("int"), F.col("weight").cast("double"), F.col("words").cast("long")
    )
    packed = _packed(given, shares, BUCKETS * parts).repartition(parts, "bucket").sortWithinPartitions("bucket", "tokenizer", "kind")
    schema = ", ".join(
        ["tokenizer string, kind int, fit int, total long", *[f"{c} long" for c in counted], *[f"{c} double" for c in (*weights, *names)]]
    )

    def sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the first shares, and what is summed: training counts, validation counts, both weights."""
        grown = np.cumsum(values[:, 1 : shares + 1], axis=1)
        return grown, np.stack([grown[:, scored - 1], values[:, 0], values[:, -2], values[:, -1]], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[tuple[str, int], np.ndarray] = {}
        by_total: dict[tuple[str, int], pd.DataFrame] = {}

        def close(name: str, kind: int, packs: list[tuple[np.ndarray, np.ndarray]]) -> None:
            keys, values = map(np.concatenate, zip(*packs))
            _, _, values = _merged(keys, np.zeros(len(keys), np.int8), values)
            grown, summed = sums(values)
            if kind == BEFORE:
                for e in fits:
                    found = pd.DataFrame(summed).groupby(grown[:, e - 1].astype(np.int64)).sum()
                    earlier = by_total.get((name, e))
                    by_total[name, e] = found if earlier is None else earlier.add(found, fill_value=0.0)
                return
            row = np.concatenate([[len(values)], grown.sum(axis=0), summed[:, 1:].sum(axis=0), (np.log(grown + alpha).T @ summed).ravel()])
            whole[name, kind] = whole.get((name, kind), 0.0) + row

        now, packs = (0, "", 0), []
        for batch in batches:
            for bucket, name, kind, *packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tokenizer", "kind", *PACKED_COLUMNS))):
                if now != (bucket, name, kind) and packs:
                    close(*now[1:], packs)
                    packs = []
                now = bucket, name, kind
                packs.append(_unpack(*packed, shares))
        if packs:
            close(*now[1:], packs)
        found = []
        for (name, kind), row in whole.items():
            values = dict(zip([*counted, *weights, *names], row.tolist()))
            found.append({"tokenizer": name, "kind": kind} | values | {c: int(values[c]) for c in counted})
        for (name, e), table in by_total.items():
            for total, row in zip(table.index.tolist(), table.to_numpy().tolist()):
                found.append({"tokenizer": name, "kind": BEFORE, "fit": e, "total": total} | dict(zip([f"{s}{e}" for s in SUMS], row)))
        if found:
            yield from pa.Table.from_pylist(found, schema=arrow).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return packed.mapInArrow(run, schema)
