"""Phrase collocations by dynamic itemset counting.

The documents are dealt into shards that are scanned in turn, round and round. Every scan counts
phrases of all lengths at once: words from the first shard on, a longer phrase from the shard after the one
by which both its subphrases (without the last word, without the first) have been counted often enough. A
phrase is counted over as many shards as there are, one full cycle, wherever it began, so its count
is exact; a phrase whose subphrases are rare never is counted. Scans end when no cycle is left open.

What has been counted often enough is kept in a table of fixed size: one byte per hash slot, the
scan by which the phrases of the slot, taken together, reached the threshold. Phrases that share a slot begin
earlier than alone they would, but all tasks see the same table, so every phrase has one beginning and one
cycle. More phrases than slots cost work and change no count. A task adds up its counts by slot, up to the
threshold, in such a table too and gives it once, so that what scans move does not grow with the phrases.

Most phrases stand once or twice, so scans give their hashes and not their texts: sorted, in buckets, each as
often as it stands and up to the threshold, as differences. When all cycles are closed, hashes that were
given often enough set bits in a table whose size follows the text's, and one more pass over the texts counts
the phrases with a bit by their words. Hashes that meet let a rare phrase into that pass, and no further.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm.batches import field, scratch_folder, sliced, utf8
from corpuslab.operators.lookup import prepare_lookup
from corpuslab.session import cut_lineage

LONGEST = 3
LEAST = 10
SHARDS = 4
SLOT_BITS = 22
"""Slots of the tables of reached phrases, as a power of two: one byte each, on the driver and in tasks."""
SLOT_BLOCK = 1 << 16
"""Slots of a task's table of counts that go into one row."""
BUCKET_BYTES = 16 << 20
"""Text for one bucket of hashes, about: a task adds up one bucket at a time."""
TASK_BYTES = 128 << 20
"""Text whose frequent phrases one task adds up before they are shuffled, at least."""
BITMAP_BITS = 26, 30
"""Bits of the table of frequent phrases' hashes, as powers of two, at least and at most; it is broadcast."""
BIT_BYTES = 4
"""Text for one bit of that table, about, within these bounds: a fixed table would fill up and let all phrases in."""
REST_BITS = 24
"""Bits of a hash that are kept inside its bucket."""
PENDING = 1 << 21
"""Hashes that a task sorts and packs at a time: the more, the smaller their differences."""
SLICE_BYTES = 8 << 20
"""Text whose phrases a task counts at a time."""
COVERED = 50
"""A phrase goes if a longer candidate around it has this share of its occurrences, in percent."""
TOP = 2000
UNKNOWN = "und"

_U = np.uint64
_NEVER = 255
_SPACES = bytes(
    b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b
    for b in range(256)
)


class _Words(dict):
    """Numbers of the words of one language; 0 is the end of a piece."""

    def __init__(self, lang: bytes, known: list, langs: list, number: int):
        super().__init__({b"\n": 0})
        self.known, self.langs, self.number = known, langs, number

    def __missing__(self, word: bytes) -> int:
        made = self[word] = len(self.known)
        self.known.append(word)
        self.langs.append(self.number)
        return made


def numbered(langs: list[bytes], texts: list[bytes]):
    """All words of some texts as numbers, with a 0 after each piece; the words and their languages."""
    known, owners, names, tables = [b""], [0], [], {}
    parts = []
    for lang, text in zip(langs, texts, strict=True):
        table = tables.get(lang)
        if table is None:
            table = tables[lang] = _Words(lang, known, owners, len(names))
            names.append(lang)
        words = text.translate(_SPACES).replace(b"\n", b" \n ").split(b" ")
        parts.append(np.fromiter(map(table.__getitem__, filter(None, words)), np.int32))
        parts.append(np.zeros(1, np.int32))
    return np.concatenate(parts or [np.zeros(0, np.int32)]), known, owners, names


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return values ^ (values >> _U(29))


def phrases(
    ids: np.ndarray, hashes: np.ndarray, longest: int, active
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and hashes of the phrases for which ``active`` holds, by length.

    ``hashes`` holds one hash per word number. ``active(size, inside, shorter)`` gives a mask of the places where a
    phrase of that length begins, of those ``inside`` a piece; ``shorter`` are the hashes one word shorter.
    """
    word = hashes[ids]
    hashed, inside, shorter = word, ids > 0, None
    for size in range(1, longest + 1):
        if size > 1:
            if len(ids) < size:
                return
            shorter = hashed
            inside = inside[:-1] & (ids[size - 1 :] > 0)
            hashed = _mixed(hashed[:-1] * _U(0xD6E8FEB86659FD93) + word[size - 1 :])
        places = np.flatnonzero(active(size, inside, shorter))
        yield size, places, hashed[places]


def _slots(hashed: np.ndarray, bits: int) -> np.ndarray:
    return (hashed >> _U(64 - bits)).astype(np.int64)


def _split(hashed: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of a hash and the ``REST_BITS`` after it; ``buckets`` is a power of two."""
    bits = buckets.bit_length() - 1
    rest = (hashed >> _U(64 - REST_BITS - bits)) & _U((1 << REST_BITS) - 1)
    return _slots(hashed, bits) if bits else np.zeros(len(hashed), np.int64), rest.astype(np.uint32)


def _pack(rest: np.ndarray) -> bytes:
    """Sorted numbers of three bytes as differences, compressed byte by byte: first bytes, second, third."""
    steps = np.diff(rest, prepend=rest.dtype.type(0)).astype("<u4")
    return pa.compress(steps.view(np.uint8).reshape(-1, 4).T[:3].tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 3 * count, codec="zstd", asbytes=True), np.uint8).reshape(3, count)
    low, middle, high = planes.astype(np.uint32)
    return np.cumsum(low + (middle << 8) + (high << 16), dtype=np.uint32)


class Slice:
    """Numbered words of some rows, and the texts of phrases in them."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        import xxhash

        self.ids, known, owners, names = numbered(utf8(langs), utf8(texts))
        seeds = [xxhash.xxh64_intdigest(n) for n in names] or [0]
        digest = xxhash.xxh64_intdigest
        made = (digest(w, seeds[o]) for w, o in zip(known, owners, strict=True))
        self.hashes = np.fromiter(made, np.uint64, len(known))
        self.words, self.langs = pa.array(known, pa.binary()), pa.array(names, pa.binary())
        self.owners = np.array(owners, np.int32)

    def distinct(self, size: int, places: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The words of each different phrase at the places, and its number of places."""
        width = len(self.hashes)
        if width**size >= 1 << 62:
            stacked = np.stack([self.ids[places + i] for i in range(size)], axis=1)
            found, counts = np.unique(stacked, axis=0, return_counts=True)
            return list(found.T), counts
        code = np.zeros(len(places), np.int64)
        for i in range(size):
            code = code * width + self.ids[places + i]
        code, counts = np.unique(code, return_counts=True)
        words = []
        for _ in range(size):
            code, word = np.divmod(code, width)
            words.insert(0, word)
        return words, counts

    def texts(self, words: list[np.ndarray]) -> list[pa.Array]:
        """Languages and texts of phrases."""
        lists = [self.words.take(pa.array(w)) for w in words]
        joined = pc.binary_join_element_wise(*lists, b" ") if len(words) > 1 else lists[0]
        owner = pa.array(self.owners[words[0]])
        return [self.langs.take(owner).cast(pa.string()), joined.cast(pa.string())]


#: What a row of a scan is: the words of a language, counts of a block of slots, or hashes of phrases in a bucket.
TOTAL, SLOT, HASHES = range(3)
SCANNED = T.StructType(
    [
        T.StructField("kind", T.IntegerType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("slot", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("lang", T.StringType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("held", T.BinaryType()),
    ]
)
_ARROW = pa.schema(
    [("kind", pa.int32()), ("size", pa.int32()), ("slot", pa.int32()), ("n", pa.int64()), ("lang", pa.string())]
    + [("bucket", pa.int32()), ("held", pa.binary())]
)


def _rows(count: int, **columns) -> pa.RecordBatch:
    made = []
    for name, kind in zip(_ARROW.names, _ARROW.types, strict=True):
        value = columns.get(name)
        if value is None:
            made.append(pa.nulls(count, kind))
        elif isinstance(value, int):
            made.append(pa.array(np.full(count, value, kind.to_pandas_dtype())))
        else:
            made.append(value if isinstance(value, pa.Array) else pa.array(value.astype(kind.to_pandas_dtype())))
    return pa.RecordBatch.from_arrays(made, schema=_ARROW)


class _Seen:
    """Phrases of which a task has given ``least`` hashes, as far as a table of fixed size tells."""

    def __init__(self, bits: int = 18):
        self.table, self.bits = np.zeros(1 << bits, np.uint64), bits

    def fresh(self, hashed: np.ndarray, counts: np.ndarray, least: int) -> np.ndarray:
        slot = (hashed & _U((1 << self.bits) - 1)).astype(np.int64)
        new = self.table[slot] != hashed
        full = new & (counts >= least)
        self.table[slot[full]] = hashed[full]
        return new


def _add(held: np.ndarray, slots: np.ndarray, counts: np.ndarray, least: int) -> None:
    """Add the counts to their slots, which are sorted, each sum up to ``least``."""
    heads = np.flatnonzero(np.diff(slots, prepend=-1))
    if len(heads):
        slots, sums = slots[heads], np.add.reduceat(counts, heads)
        held[slots] = np.minimum(held[slots] + sums.astype(np.int64), least)


def _blocks(held: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Numbers and bytes of the blocks of a table that hold any count."""
    blocks = held.reshape(-1, min(len(held), SLOT_BLOCK))
    numbers = np.flatnonzero(blocks.any(axis=1))
    return numbers, pa.array([blocks[i].tobytes() for i in numbers], pa.binary())


def _slot_sums(scanned: DataFrame, least: int) -> pa.Table:
    """The tasks' counts of one scan added up, block by block, up to ``least``."""
    kind = np.min_scalar_type(least)

    def run(table: pa.Table) -> pa.Table:
        total = 0
        for held in table["held"]:
            total = np.minimum(np.frombuffer(held.as_py(), kind) + np.int64(total), least)
        summed = pa.array([total.astype(kind).tobytes()], pa.binary())
        return pa.table([table["size"][:1], table["slot"][:1], summed], names=["size", "slot", "held"])

    rows = scanned.where(F.col("kind") == SLOT).select("size", "slot", "held")
    return rows.groupBy("size", "slot").applyInArrow(run, "size int, slot int, held binary").toArrow()


def _hash_rows(sent: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Hashes bucket by bucket, sorted and packed, with their number."""
    bucket, rest = _split(np.sort(np.concatenate(sent)), buckets)
    heads = np.flatnonzero(np.diff(bucket, prepend=-1))
    parts = np.split(rest, heads[1:]) if len(heads) else []
    counts = np.array([len(p) for p in parts], np.int64)
    packed = pa.array([_pack(p) for p in parts], pa.binary())
    return _rows(len(heads), kind=HASHES, n=counts, bucket=bucket[heads], held=packed)


def _scan(shard: DataFrame, shared, scan: int, shards: int, longest: int, least: int, buckets: int) -> DataFrame:
    """What this scan counts: words by language, phrases by slots that are not reached and by hashes."""

    def run(batches):
        reached = [np.frombuffer(t, np.uint8) for t in shared.value]
        bits = len(reached[0]).bit_length() - 1 if reached else 1
        seen, sums, sent = _Seen(), {}, []

        def active(size, inside, shorter):
            if size == 1:
                return inside if scan < shards else np.zeros(len(inside), bool)
            since = reached[size - 2][_slots(shorter, bits)].astype(np.int16)
            since = np.maximum(since[:-1], since[1:]) + 1
            return inside & (since <= scan) & (scan < since + shards) & (since <= _NEVER)

        for batch in batches:
            for part in sliced(batch, SLICE_BYTES):
                held = Slice(*part.columns)
                for size, places, hashed in phrases(held.ids, held.hashes, longest, active):
                    if size == 1:
                        n = np.bincount(held.owners[held.ids[places]], minlength=len(held.langs))
                        yield _rows(len(n), kind=TOTAL, n=n, lang=held.langs.cast(pa.string()))
                    value, counts = np.unique(hashed, return_counts=True)
                    if size < longest:
                        slots = _slots(value, bits)
                        needed = reached[size - 1][slots] == _NEVER
                        if size not in sums:
                            sums[size] = np.zeros(1 << bits, np.min_scalar_type(least))
                        _add(sums[size], slots[needed], counts[needed], least)
                    new = seen.fresh(value, counts, least)
                    sent.append(np.repeat(value[new], np.minimum(counts[new], least)))
                if sum(map(len, sent)) >= PENDING:
                    yield _hash_rows(sent, buckets)
                    sent = []
        if sent:
            yield _hash_rows(sent, buckets)
        for size, held in sums.items():
            numbers, blocks = _blocks(held)
            yield _rows(len(numbers), kind=SLOT, size=size, slot=numbers, held=blocks)

    return shard.select("lang", "text").mapInArrow(run, SCANNED)


BITS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("bits", T.BinaryType())])


def _bitmap(scanned: DataFrame, buckets: int, least: int, bits: int) -> bytes:
    """One of about ``bits`` bits for the leading bits of each hash that was given ``least`` times, all buckets in a row."""
    size = max(8, min(bits, buckets << REST_BITS) // buckets)

    def run(table: pa.Table) -> pa.Table:
        packed = zip(table["held"].to_pylist(), table["n"].to_pylist(), strict=True)
        values = np.concatenate([_unpack(*p) for p in packed])
        values, counts = np.unique(values, return_counts=True)
        held = np.zeros(size, bool)
        held[_place(values[counts >= least], size)] = True
        return pa.table([table["bucket"][:1], pa.array([np.packbits(held).tobytes()])], names=BITS.names)

    hashed = scanned.where(F.col("kind") == HASHES).select("bucket", "n", "held")
    held = np.zeros((buckets, size // 8), np.uint8)
    for row in hashed.groupBy("bucket").applyInArrow(run, BITS).toLocalIterator():
        held[row.bucket] = np.frombuffer(row.bits, np.uint8)
    return held.tobytes()


def _place(rest: np.ndarray, size: int) -> np.ndarray:
    return (rest.astype(np.uint64) * _U(size) >> _U(REST_BITS)).astype(np.int64)


def _is_set(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).view(bool)


TEXTS = T.StructType(
    [SCANNED["lang"], T.StructField("phrase", T.StringType()), SCANNED["size"], SCANNED["n"]]
)


def _texts(rows: DataFrame, bitmap, buckets: int, longest: int) -> DataFrame:
    """Texts and counts, added up per slice, of the phrases whose bit is set."""

    def run(batches):
        packed = np.frombuffer(bitmap.value, np.uint8)
        size_of = 8 * len(packed) // buckets
        for batch in batches:
            for part in sliced(batch, SLICE_BYTES):
                held = Slice(*part.columns)
                for size, places, hashed in phrases(held.ids, held.hashes, longest, lambda s, inside, _: inside):
                    bucket, rest = _split(hashed, buckets)
                    places = places[_is_set(packed, bucket * size_of + _place(rest, size_of))]
                    words, counts = held.distinct(size, places)
                    columns = [pa.array(np.full(len(counts), size, np.int32)), pa.array(counts.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([*held.texts(words), *columns], names=TEXTS.names)

    return rows.select("lang", "text").mapInArrow(run, TEXTS)


def phrase_counts(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST,
    shards: int = SHARDS,
    slot_bits: int = SLOT_BITS,
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, a`` of all phrases of up to ``longest`` words with ``a >= least``; ``lang, n``.

    A text is lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and those into words at
    spaces and tabs; phrases lie within a piece, and overlapping occurrences count. Null and empty texts have no
    words; a null language is ``und``; repeated rows count as often as they stand. ``n`` counts all words of a
    language. Other columns, whatever their names, are not looked at. An empty table gives no row.
    """
    if not 1 <= shards <= (_NEVER - 1) // max(1, longest):
        raise ValueError("too many shards for the scans to be told apart")
    spark = docs.sparkSession
    folder = scratch_folder(spark, "collocations")
    dealt = docs.select(
        F.coalesce(field(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        field(text).alias("text"),
        F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"),
    ).where("text is not null and text <> ''")
    dealt.write.option("compression", "zstd").partitionBy("shard").parquet(f"{folder}/shards")
    rows = spark.read.schema("lang string, text string, shard int").parquet(f"{folder}/shards")
    written = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    buckets = 1 << max(6, (written // BUCKET_BYTES).bit_length())
    lowest, highest = BITMAP_BITS
    bits = 1 << min(highest, max(lowest, (written // BIT_BYTES).bit_length()))

    totals = [np.zeros(1 << slot_bits, np.min_scalar_type(least)) for _ in range(longest - 1)]
    reached = [np.full(1 << slot_bits, _NEVER, np.uint8) for _ in range(longest - 1)]
    scan, open_until = 0, shards
    while scan < open_until:
        shared = spark.sparkContext.broadcast([t.tobytes() for t in reached])
        shard = rows.where(F.col("shard") == scan % shards)
        path = f"{folder}/scan={scan}"
        found = _scan(shard, shared, scan, shards, longest, least, buckets)
        found.write.option("compression", "zstd").parquet(path)
        shared.destroy()
        for row in _slot_sums(spark.read.schema(SCANNED).parquet(path), least).to_pylist():
            added = np.frombuffer(row["held"], totals[0].dtype)
            block = slice(row["slot"] * len(added), (row["slot"] + 1) * len(added))
            held = totals[row["size"] - 1][block]
            before = held >= least
            held[:] = np.minimum(held.astype(np.int64) + added, least)
            fresh = ~before & (held >= least)
            if fresh.any():
                reached[row["size"] - 1][block][fresh] = scan
                open_until = max(open_until, scan + 1 + shards)
        scan += 1
    scanned = spark.read.schema(SCANNED).parquet(*[f"{folder}/scan={s}" for s in range(scan)])
    bitmap = spark.sparkContext.broadcast(_bitmap(scanned, buckets, least, bits))
    # Larger tasks: most phrases stand a few times each, and what a task adds up is not shuffled.
    joined = rows.coalesce(written // TASK_BYTES + 1)
    counts = _texts(joined, bitmap, buckets, longest).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("a"))
    sizes = scanned.where(F.col("kind") == TOTAL).groupBy("lang").agg(F.sum("n").alias("n"))
    return cut_lineage(counts.where(F.col("a") >= least)), sizes


def _cut(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(counts: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Phrases of two words or more with the cut of the lowest score: ``lang, phrase, size, a, l, r, score``.

    Scores are ``floor(1000000 * a * a / (l * r))`` in decimals of 38 digits, exact for counts below 10**16; the
    smallest first part wins ties. ``counts`` holds all parts; ``wanted``, rows of it, are scored, or all. Both should
    be written. Phrases are taken size by size, and a part is looked up among those of its own size: words are
    few, so a phrase of two words is not moved.
    """
    wanted = counts if wanted is None else wanted
    longest = max(2, counts.agg(F.max("size")).head()[0] or 0)
    parts = [
        prepare_lookup(
            counts.where(F.col("size") == size).select(
                "lang", F.col("phrase").alias("part"), F.col("a").alias("of_part"), F.col("a").alias("hot")
            ),
            ["lang", "part"], "hot",
        )
        for size in range(1, longest)
    ]
    words = F.split("phrase", " ")
    big = lambda c: F.col(c).cast("decimal(16,0)")
    found = []
    for size in range(2, longest + 1):
        rows, cuts = wanted.where(F.col("size") == size).select("lang", "phrase", "size", "a"), []
        for k in range(1, size):
            for name, start, length in ((f"l{k}", 1, k), (f"r{k}", k + 1, size - k)):
                rows = parts[length - 1](rows.withColumn("part", _cut(words, start, length)))
                rows = rows.drop("part").withColumnRenamed("of_part", name)
            rows = rows.withColumns(
                {f"top{k}": F.lit(1000000).cast("decimal(7,0)") * (big("a") * big("a")), f"below{k}": big(f"l{k}") * big(f"r{k}")}
            )
            score = F.expr(f"top{k} div below{k}").alias("score")
            cuts.append(F.struct(score, F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        best = rows.select("lang", "phrase", "size", "a", F.array_min(F.array(*cuts)).alias("best"))
        found.append(best.select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score"))
    return reduce(DataFrame.unionByName, found)


def uncovered(counts: DataFrame, covered: int = COVERED) -> DataFrame:
    """The phrases of two words or more that no longer one around them explains.

    A phrase goes if a longer one of ``counts``, itself gone or not, holds its words in a row and has
    at least ``covered`` percent of its occurrences.
    """
    phrases_ = counts.where("size > 1")
    words = F.split("phrase", " ")
    spans = phrases_.where("size > 2").select(
        "lang", "size", words.alias("w"), F.col("a").alias("longer"),
        F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("span"),
    )
    spans = spans.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("span") + 1)).alias("at"))
    inside = spans.select("lang", _cut(F.col("w"), F.col("at"), F.col("span")).alias("phrase"), "longer")
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    joined = phrases_.join(most, ["lang", "phrase"], "left")
    return joined.where(F.expr(f"longer is null or 100 * longer < {int(covered)} * a")).drop("longer")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, **options) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language, see ``phrase_counts``.

    Order is by score, then by ``a``, both descending, then by the phrase's bytes.
    """
    counts, sizes = phrase_counts(docs, text, lang, **options)
    left = scored(counts, cut_lineage(uncovered(counts)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
