"""From token streams and token lists to training sequences and batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.functions.rows import list_rows
from corpuslab.functions.tokens import PAD
from corpuslab.operators.ordinal import hash_rank, place, running_offsets

IGNORED = -100  # label of positions that do not count
BLOCK = 32  # tokens kept per training line
DIGITS = 4_096  # an index is coded as two digits
FIRST_SIGN = 0x100000  # private code points, in no text, that stand for digits


def next_token_pairs(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Each token with the one after it in its list; nothing is shuffled."""
    others = [c for c in rows.columns if c != tokens]
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    x, y = F.slice(tokens, 1, n).alias("x"), F.slice(tokens, 2, n).alias("y")
    pairs = list_rows(rows, others, F.arrays_zip(x, y), "p")
    return pairs.select(*others, "pos", F.col("p.x").alias("prev"), F.col("p.y").alias("next"))


def code_characters(text: Column, vocab: DataFrame, unknown: int = 0) -> Column:
    """Encode the characters of a text in place, given a vocabulary of single characters.

    It comes to the driver and goes with the plan; it cannot be larger than Unicode, and what it
    holds beyond single characters, such as markers, is left out. Each character is replaced by
    one that stands for the low digit of its index, and once more for the high digit if any index has one.
    """
    coded = vocab.filter(F.length("token") == 1).select("token", "idx").collect()
    found = "".join(row.token for row in coded)

    def digits(of: Callable[[int], int]) -> Column:
        signs = "".join(chr(FIRST_SIGN + of(row.idx)) for row in coded)
        return F.split(F.translate(text, found, signs), "")

    def small(low: Column) -> Column:
        low = F.ascii(low).cast("long") - FIRST_SIGN
        return F.when(low >= 0, low).otherwise(unknown)

    def index(high: Column, low: Column) -> Column:
        high, low = (F.ascii(c).cast("long") - FIRST_SIGN for c in (high, low))
        return F.when(high >= 0, high * DIGITS + low).otherwise(unknown)

    if all(row.idx < DIGITS for row in coded):
        ids = F.transform(digits(lambda i: i), small)
    else:
        ids = F.zip_with(digits(lambda i: i // DIGITS), digits(lambda i: i % DIGITS), index)
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(ids)


class PackedCharacters:
    """Characters of texts as indexes of one, two or four bytes each, by a vocabulary of single characters.

    Texts are placed as they are, then packed: segments move as such bytes in place of lists of numbers, and are cut out without
    reading what comes before; ``unpack`` makes lists of them at the end. The vocabulary comes to the driver, see ``code_characters``.
    """

    #: Bytes per index: how many indexes there may be, the charset that reads them, and what is added to an index for it.
    WIDTHS = {1: (1 << 8, "ISO-8859-1", 0), 2: (0xD800, "UTF-16BE", 0), 4: (0x100000, "UTF-32", 0x10000)}

    def __init__(self, vocab: DataFrame, unknown: int = 0):
        coded = vocab.filter(F.length("token") == 1).select("token", "idx").collect()
        self.vocab = vocab
        self.indexes, self.unknown = {ord(row.token): row.idx for row in coded}, unknown
        top = max([unknown, *self.indexes.values()])
        self.width = next((w for w, (size, *_) in self.WIDTHS.items() if top < size), 4)
        _, self.charset, self.first = self.WIDTHS[self.width]

    def place(self, stream: DataFrame, key: str) -> tuple[DataFrame, int]:
        """``ordinal.place`` for a stream whose ``ids`` are texts, which are packed then.

        Rows of one key are in the order they have as lists of indexes, made for repeated keys only.
        """
        ids = code_characters(F.col("ids"), self.vocab, self.unknown)
        placed, total = place(stream, key, F.col("n"), F.xxhash64(*[ids if c == "ids" else c for c in stream.columns]))
        return self.pack(placed, "ids"), total

    def pack(self, rows: DataFrame, text: str) -> DataFrame:
        """``rows`` with the column ``text`` replaced by its packed indexes; a null text stays null."""
        table = np.full(max(self.indexes, default=0) + 2, self.unknown, dtype=np.int64)
        table[list(self.indexes)] = list(self.indexes.values())
        first, kind, place = self.first, f">u{self.width}", rows.columns.index(text)
        schema = T.StructType([T.StructField(text, T.BinaryType()) if f.name == text else f for f in rows.schema])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns, packed = list(batch.columns), []
                for found in columns[place]:
                    points = np.frombuffer((found.as_py() or "").encode("utf-32-le"), dtype=np.uint32)
                    codes = (table[np.minimum(points, len(table) - 1)] + first).astype(kind).tobytes()
                    packed.append(codes if found.is_valid else None)
                columns[place] = pa.array(packed, pa.binary())
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return rows.mapInArrow(run, schema)

    def unpack(self, ids: Column) -> Column:
        """Packed indexes as a list."""
        signs = F.split(F.decode(ids, self.charset), "")
        numbers = F.transform(signs, lambda c: F.ascii(c).cast("long") - self.first)
        return F.when(F.octet_length(ids) == 0, F.array().cast("array<bigint>")).otherwise(numbers)


def _cut(begin: Column, size: Column, packed: PackedCharacters | None) -> Column:
    """``size`` items of the list ``ids`` from place ``begin``, counted from 0, or of packed ones."""
    if packed is None:
        return F.slice("ids", (begin + 1).cast("int"), size.cast("int"))
    return F.substring("ids", (begin * packed.width + 1).cast("int"), (size * packed.width).cast("int"))


def _bounds(total: int, start: float, end: float | None, relative: bool) -> tuple[int, int]:
    """First and last position of a part; positions count like those of a list, shares are cut down to positions."""
    if relative:
        start, end = int(start * total), None if end is None else int(end * total)
    first, last, _ = slice(int(start), None if end is None else int(end)).indices(total)
    return first, max(first, last)


def _bounded(start: float = 0, end: float | None = None, relative: bool = False) -> bool:
    return start != 0 or end is not None


def place_part(
    stream: DataFrame, key: str, start: float = 0, end: float | None = None, relative: bool = False,
    packed: PackedCharacters | None = None,
) -> tuple[DataFrame, int]:
    """The part of a token stream between two bounds, each row with its ``start`` in the part; also the part's size.

    A stream has an integer ``key``, a list ``ids`` and its size ``n`` per row. Bounds are positions, or shares of
    the stream if ``relative``. A negative position counts from the end, the end is not included, and
    without one the part goes to the end of the stream. Rows are cut where they are, after the one join that
    places them; rows outside the part go, the others keep their columns. Empty parts have no rows.
    """
    placed, total = place(stream, key, F.col("n")) if packed is None else packed.place(stream, key)
    first, last = _bounds(total, start, end, relative)
    if (first, last) == (0, total):
        return placed, total
    low, high = F.col("start"), F.col("start") + F.col("n")
    begin, stop = F.greatest(low, F.lit(first)), F.least(high, F.lit(last))
    part = placed.filter(begin < stop).withColumns({
        "ids": _cut(begin - low, stop - begin, packed),
        "n": (stop - begin).cast("int"),
        "start": (begin - first).cast("long"),
    })
    return part, last - first


def bounded_stream(
    stream: DataFrame, key: str, start: float = 0, end: float | None = None, relative: bool = False
) -> DataFrame:
    """A part of a stream as a stream of its own, see ``place_part``.

    Its ``key`` is the place of a row in the part, counted from 0, so rows that shared a key keep their order.
    """
    part, _ = place_part(stream.select(key, "ids", "n"), key, start, end, relative)
    return part.filter("n > 0").select(F.col("start").alias(key), "ids", "n")


def slice_stream(
    stream: DataFrame, key: str, start: float, end: float, relative: bool, packed: PackedCharacters | None = None
) -> DataFrame:
    """The part of a token stream between two bounds, as one piece per row of ``stream``, which may have texts for ``packed``.

    Bounds are those of ``place_part``; ``from_pos`` and ``to_pos`` are places in the whole stream.
    """
    placed, total = place(stream, key, F.col("n")) if packed is None else packed.place(stream, key)
    first, last = _bounds(total, start, end, relative)
    low, high = F.col("start"), F.col("start") + F.col("n")
    begin, stop = F.greatest(low, F.lit(first)), F.least(high, F.lit(last))
    piece = _cut(begin - low, stop - begin, packed)
    return placed.filter(begin < stop).select(
        key,
        begin.cast("long").alias("from_pos"),
        stop.cast("long").alias("to_pos"),
        (piece if packed is None else packed.unpack(piece)).alias("ids"),
    )


def _segments(
    placed: DataFrame, keys: Sequence[str], first: Column, step: int, count: int,
    packed: PackedCharacters | None, bounded: bool,
) -> DataFrame:
    """Cut a placed stream into ``count`` segments of ``step + 1`` tokens per key.

    Segment ``k`` starts at ``first + k * step`` and shares its last token with
    the next one. Rows send whole pieces, not single tokens, to their segments.
    """
    width = step + 1
    low, high = F.col("start"), F.col("start") + F.col("n")
    since = F.greatest(F.ceil((low - first - step) / step), F.lit(0)).cast("long")
    until = F.least(F.floor((high - 1 - first) / step), F.lit(count - 1)).cast("long")
    hit = placed.filter((F.col("n") > 0) & (since <= until))
    hit = hit.select("*", F.explode(F.sequence(since, until)).alias("k"))
    begin = F.greatest(low, first + F.col("k") * step)
    stop = F.least(high, first + F.col("k") * step + width)
    hit = hit.select(*keys, "k", begin.alias("at"), _cut(begin - low, stop - begin, packed).alias("tokens"), (stop - begin).alias("size"))
    part = F.struct("at", F.col("tokens").alias("piece"))
    pieces = F.transform(F.array_sort(F.collect_list(part)), lambda p: p.piece)
    joined = F.flatten(pieces) if packed is None else F.aggregate(pieces, F.lit(b""), lambda one, more: F.concat(one, more))
    gather = lambda rows: rows.groupBy(*keys, "k").agg(joined.alias("tokens"))
    # In a part, a row without a list makes the segments null that it touches, so their pieces are brought together.
    if packed is None or bounded:
        return gather(hit)
    # Else most segments lie in one row of the stream and are whole as they are.
    return hit.where(F.col("size") == width).select(*keys, "k", "tokens").unionByName(gather(hit.where(F.col("size") < width)))


def _unpacked(segments: DataFrame, packed: PackedCharacters | None) -> DataFrame:
    return segments if packed is None else segments.withColumn("tokens", packed.unpack(F.col("tokens")))


def _shifted(steps: int) -> list[Column]:
    return [F.slice("tokens", 1, steps).alias("x"), F.slice("tokens", 2, steps).alias("y")]


def random_subsequences(
    stream: DataFrame, key: str, batch_size: int, num_steps: int, offset: int, seed: int, packed: PackedCharacters | None = None, **part
) -> DataFrame:
    """Batches of subsequences in a seeded hash order, with labels shifted by one.

    ``offset`` leading tokens are dropped; so are subsequences that do not fill a
    batch. ``part`` are bounds of ``place_part``. The result is ``(batch, row, x, y)``; texts of a stream, with
    ``packed``, are made lists of numbers when their segments have been dealt to batches.
    """
    placed, total = place_part(stream, key, **part, packed=packed)
    count = max((total - offset - 1) // num_steps, 0)
    wanted = count // batch_size * batch_size
    ranks = hash_rank(stream.sparkSession.range(count).withColumnRenamed("id", "k"), "k", seed)
    ranks = ranks.filter(F.col("rank") < wanted)
    segments = _segments(placed, [], F.lit(offset).cast("long"), num_steps, count, packed, _bounded(**part))
    return _unpacked(segments.join(ranks, "k"), packed).select(
        F.floor(F.col("rank") / batch_size).alias("batch"),
        (F.col("rank") % batch_size).alias("row"),
        *_shifted(num_steps),
    )


def sequential_batches(
    stream: DataFrame, key: str, batch_size: int, num_steps: int, offset: int, packed: PackedCharacters | None = None, **part
) -> DataFrame:
    """The stream, or a ``part`` of it, cut to ``batch_size`` long rows, walked in steps of ``num_steps``."""
    placed, total = place_part(stream, key, **part, packed=packed)
    length = max((total - offset - 1) // batch_size, 0)
    count = length // num_steps
    if count == 0:
        placed, length = placed.limit(0), 1
    high = F.col("start") + F.col("n")
    top = F.floor((F.col("start") - offset - num_steps) / length).cast("long")
    bottom = F.floor((high - 1 - offset) / length).cast("long")
    top, bottom = F.greatest(top, F.lit(0)), F.least(bottom, F.lit(batch_size - 1))
    rows = placed.filter(top <= bottom)
    rows = rows.select("*", F.explode(F.sequence(top, bottom)).alias("row"))
    first = F.lit(offset) + F.col("row") * length
    segments = _segments(rows, ["row"], first, num_steps, count, packed, _bounded(**part))
    return _unpacked(segments, packed).select(F.col("k").alias("batch"), "row", *_shifted(num_steps))


def batches(
    stream: DataFrame,
    key: str,
    batch_size: int,
    num_steps: int,
    mode: str,
    offset: int = 0,
    seed: int = 0,
    start_token: float = 0,
    max_tokens: float | None = None,
    relative_size: bool = False,
    packed: PackedCharacters | None = None,
) -> DataFrame:
    """Batches of a stream in one of the two modes, ``random`` or ``sequential``.

    Only the tokens from ``start_token`` up to ``max_tokens``, which is a position, not a number, are batched;
    with ``relative_size`` both are shares of the stream. The ``ids`` of a stream may be texts,
    with ``packed`` for their characters.
    """
    part = {"start": start_token, "end": max_tokens, "relative": relative_size, "packed": packed}
    if mode == "random":
        return random_subsequences(stream, key, batch_size, num_steps, offset, seed, **part)
    if mode == "sequential":
        return sequential_batches(stream, key, batch_size, num_steps, offset, **part)
    raise ValueError(f"unknown mode {mode!r}")


def length_batches(
    rows: DataFrame, batch_size: dict[str, int], tokens: str = "tokens", size: Column | None = None
) -> DataFrame:
    """Batch lists of similar length: sorted by size, then cut; per ``split``.

    ``size`` may give the sizes where rows come without their lists. Rows are read twice, so costly ones should be written already.

    Lists are counted per ``(split, size, document)``. Running sums over documents
    inside a size, and over sizes, give each document's first rank, so no task
    sorts a whole split or a whole size.
    """
    sized = rows.withColumn("n", (F.size(tokens) if size is None else size).cast("long"))
    counts = sized.groupBy("split", "n", "doc_id").agg(F.count("*").alias("m"))
    inside = running_offsets(counts, "doc_id", "m", ["split", "n"])
    classes = running_offsets(
        inside.groupBy("split", "n").agg(F.sum("m").alias("m")), "n", "m", ["split"]
    )
    starts = inside.join(classes.select("split", "n", F.col("offset").alias("below")), ["split", "n"])
    starts = starts.select(
        "split", "n", "doc_id", (F.col("offset") + F.col("below")).alias("first")
    )
    in_doc = Window.partitionBy("split", "n", "doc_id").orderBy("line_no")
    ranked = sized.join(starts, ["split", "n", "doc_id"]).withColumn(
        "rank", F.col("first") + F.row_number().over(in_doc) - 1
    )
    known = F.create_map(*[F.lit(v) for pair in batch_size.items() for v in pair])[F.col("split")]
    unknown = F.raise_error(F.concat(F.lit("no batch size for split "), F.col("split")))
    per_batch = F.coalesce(known, unknown.cast("int"))
    return ranked.select(
        *(c for c in rows.columns if c != "n"),
        "n",
        F.floor(F.col("rank") / per_batch).alias("batch"),
        (F.col("rank") % per_batch).cast("long").alias("row"),
    )


def pad_batches(batched: DataFrame, by: Sequence[str], tokens: str = "tokens", pad=PAD) -> DataFrame:
    """Fill every list up to the longest of its batch; the true size stays in ``n``."""
    longest = F.max(F.size(tokens)).over(Window.partitionBy(*by))
    padded = batched.withColumn("width", longest.cast("long"))
    fill = F.array_repeat(F.lit(pad), (F.col("width") - F.size(tokens)).cast("int"))
    return padded.withColumn(tokens, F.concat(tokens, fill))


def truncate(tokens: Column, block: int = BLOCK) -> Column:
    """The first ``block`` tokens of a training line."""
    return F.slice(tokens, 1, block)


def causal_labels(ids: Column, pad_id: int) -> Column:
    """Labels equal the inputs, except that padding does not count."""
    return F.transform(ids, lambda i: F.when(i == pad_id, IGNORED).otherwise(i).cast("long"))
