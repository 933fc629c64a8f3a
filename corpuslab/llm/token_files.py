"""Token ids in files of length-delimited records, with an index for reads in any order.

A record is

    length of the payload    8 bytes, little-endian
    checksum of the length   4 bytes
    payload                  the document's number (8 bytes, signed; the byte before it says
                             whether it is null), bytes per id (1), the ids
    checksum of the payload  4 bytes
    end mark                 1 byte, a line feed

A checksum is the CRC-32 turned right by 15 bits, plus a constant, so that the checksum of
bytes that hold checksums is no fixed value. Ids take 2 bytes where the vocabulary allows, else 4.

Files are written by Spark's text writer, whose line end is the end mark: it takes bytes as they
are, works on any file system that Spark knows, and shows only files of tasks that ended well.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm.batches import field, list_array, texts, with_python
from corpuslab.llm.byte_pairs import LATIN, Memo, plain_pattern
from corpuslab.operators.ordinal import running_offsets

END_ID = 1
RECORDS_PER_FILE = 2048
RANGE_CHARS = 64
"""Rows of one key are dealt to ranges by so many characters of their text."""
_LENGTH, _SUM, _HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<?qB")
#: The number of a file among its task's files ends its name; the random letters before may look like one.
PIECE = r"-c(\d+)(?:\.[^-]*)?$"
FILES_PER_PART = 1 << 32
_FRAME = _LENGTH.size + 2 * _SUM.size + 1


def checksum(content: bytes) -> int:
    crc = zlib.crc32(content)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """The record of a payload, without its end mark."""
    length = _LENGTH.pack(len(payload))
    return b"".join(
        (length, _SUM.pack(checksum(length)), payload, _SUM.pack(checksum(payload)))
    )


def payload_of(doc: int | None, ids: np.ndarray, width: int) -> bytes:
    return _HEAD.pack(doc is None, doc or 0, width) + ids.astype(f"<u{width}").tobytes()


def record_at(content: bytes, offset: int) -> tuple[bytes, int]:
    """The payload of the record at ``offset`` and where the next one begins."""
    start = offset + _LENGTH.size + _SUM.size
    length = content[offset : offset + _LENGTH.size]
    if len(content) < start or _SUM.unpack_from(content, offset + _LENGTH.size)[0] != checksum(length):
        raise ValueError(f"damaged length at {offset}")
    stop = start + _LENGTH.unpack(length)[0]
    payload = content[start:stop]
    if len(content) <= stop + _SUM.size or _SUM.unpack_from(content, stop)[0] != checksum(payload):
        raise ValueError(f"damaged record at {offset}")
    return payload, stop + _SUM.size + 1


def ids_of(payload: bytes) -> tuple[int | None, np.ndarray]:
    null, doc, width = _HEAD.unpack_from(payload)
    return None if null else doc, np.frombuffer(payload, f"<u{width}", offset=_HEAD.size)


def records(content: bytes) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """Offset, document and ids of all records of a file."""
    offset = 0
    while offset < len(content):
        payload, after = record_at(content, offset)
        yield offset, *ids_of(payload)
        offset = after


class WordIds:
    """Ids of texts by the ``tokenizers`` library, which sees each word only now and then.

    A tokenizer that splits at white space gives for a text the ids of its words one after
    the other; words are cut at spaces and line ends, which every such tokenizer splits at. Where a
    tokenizer is of the kind ``_splits`` knows, texts in Latin letters are split here and only
    their pieces go to the library's model; words of other texts go through the whole tokenizer.
    """

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        self.splits = _splits(json.loads(content))
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.I)
        self.words, self.pieces = Memo(self._word), Memo(self._piece)

    def _piece(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array(self.kind, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _word(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return array(self.kind, ids).tobytes()

    def packed(self, text: str) -> bytes:
        """The ids of a text as unsigned integers of ``width`` bytes."""
        if self.splits and LATIN.fullmatch(text) and not self.added.search(text):
            return b"".join(map(self.pieces.__getitem__, self.splits.findall(text.lower())))
        words = text.replace("\n", " ").split(" ")
        return b"".join(map(self.words.__getitem__, words))


#: How byte-level tokenizers write bytes that are no visible letters.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {
    b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _VISIBLE)
}
def _splits(described: dict):
    """The pattern of a tokenizer that lowers texts and takes the pattern's matches as byte letters."""
    normal = (described.get("normalizer") or {}).get("normalizers", [])
    before = (described.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [n["type"] for n in normal] != ["NFC", "Replace", "Lowercase"] or len(before) != 2:
        return None
    split, letters = before
    plain = (
        normal[1]["pattern"] == {"Regex": "\\s+"}
        and split["type"] == "Split"
        and split["behavior"] == "Removed"
        and split["invert"]
        and "Regex" in split["pattern"]
        and letters["type"] == "ByteLevel"
        and not letters["add_prefix_space"]
        and not letters["use_regex"]
        and described["model"]["type"] == "BPE"
    )
    return plain_pattern(split["pattern"]["Regex"]) if plain else None


_WORKER: dict = {}


def _word_ids(content: bytes) -> WordIds:
    key = hash(content)
    if _WORKER.get("key") != key:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _WORKER.update(key=key, words=WordIds(content))
    return _WORKER["words"]


def write(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write ``folder/records`` in ascending order of ``key``, and ``folder/index``.

    Texts are sorted by ranges of keys first, so that each task encodes and writes its own
    range; files number as the ranges do. Null texts give the end id alone, a null key comes first,
    rows of one key are ordered by their text, and ranges may cut between them, so that a key that many
    rows share is no single task. Other columns are not written. An empty table gives no record.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    ordered = (
        docs.select(field(key).cast("long").alias("key"), field(text).alias("text"))
        .repartitionByRange("key", F.substring("text", 1, RANGE_CHARS))
        .sortWithinPartitions("key", "text")
    )

    def setup():
        words = _word_ids(shared.value)

        def make(keys, column):
            end = np.array([end_id], f"<u{words.width}").tobytes()
            packed = map(words.packed, texts(column))
            made = (
                frame(payload_of(k, np.frombuffer(p + end, f"<u{words.width}"), words.width))
                for k, p in zip(keys.to_pylist(), packed, strict=True)
            )
            return [pa.array(made, pa.binary())]

        return make

    record = T.StructType([T.StructField("record", T.BinaryType())])
    framed = with_python(ordered, [F.col("key"), F.col("text")], record, setup)
    framed.select(F.col("record").cast("string")).write.option("lineSep", "\n").option(
        "maxRecordsPerFile", records_per_file
    ).text(f"{folder}/records")
    read(spark, folder).select("file", "offset", "key", "n_ids").write.parquet(f"{folder}/index")


READ = T.StructType(
    [
        T.StructField("place", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("key", T.LongType()),
        T.StructField("before", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("ids", T.ArrayType(T.LongType())),
    ]
)


def _part(name) -> Column:
    return F.regexp_extract(name, r"^part-(\d+)", 1).cast("long")


def _piece(name) -> Column:
    return F.regexp_extract(name, PIECE, 1).cast("long")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The record files: ``file`` (name), ``part`` and ``piece`` (their order), ``content``."""
    name = F.element_at(F.split("path", "/"), -1)
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "part-*")
        .load(f"{folder}/records")
        .select(
            name.alias("file"),
            _part(name).alias("part"),
            _piece(name).alias("piece"),
            "content",
        )
    )


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """All records, checksums verified: ``file, part, piece, place`` (number in the file),
    ``offset, key, before`` (ids of the file before it), ``n_ids, ids_crc32`` (of the ids as 32-bit
    integers) and, if asked for, ``ids``."""
    schema = T.StructType(
        [
            T.StructField("file", T.StringType()),
            T.StructField("part", T.LongType()),
            T.StructField("piece", T.LongType()),
            *(READ.fields if with_ids else READ.fields[:-1]),
        ]
    )

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                file, part, piece = (batch.column(c)[i].as_py() for c in range(3))
                rows, lists, before = [], [], 0
                for place, (offset, key, ids) in enumerate(records(batch.column(3)[i].as_py())):
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    rows.append((place, offset, key, before, len(ids), crc))
                    before += len(ids)
                    if with_ids:
                        lists.append(ids.astype(np.int64))
                if not rows:
                    continue
                columns = [pa.array([x] * len(rows), t) for x, t in ((file, pa.string()), (part, pa.int64()), (piece, pa.int64()))]
                columns += [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                if with_ids:
                    columns.append(list_array(np.concatenate(lists), [len(x) for x in lists]))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return files(spark, folder).mapInArrow(run, schema)


def read_some(spark: SparkSession, folder: str, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` and ``ids`` of the wanted documents, found through the index.

    Only files that hold a wanted record are looked into, and in them only its bytes.
    """
    index = spark.read.parquet(f"{folder}/index")
    places = index.join(wanted.select(field(key).alias("key")).distinct(), "key", "left_semi")
    chosen = places.groupBy("file").agg(F.collect_list("offset").alias("offsets"))

    def run(batches):
        for batch in batches:
            for content, offsets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [ids_of(record_at(content, o)[0]) for o in sorted(offsets)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _ in found], pa.int64()),
                        list_array(
                            np.concatenate([i.astype(np.int64) for _, i in found]),
                            [len(i) for _, i in found],
                        ),
                    ],
                    names=[key, "ids"],
                )

    schema = T.StructType([T.StructField(key, T.LongType()), READ["ids"]])
    return files(spark, folder).join(chosen, "file").select("content", "offsets").mapInArrow(run, schema)


def positions(read_back: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Add ``start``: the number of ids in all records before this one.

    A record knows the ids before it in its file; the files' totals, from the written ``index`` if
    given, go through a running sum over the files' numbers. Only one row per file is shuffled.
    """
    totals = (read_back if index is None else index).select("file", "n_ids")
    totals = totals.groupBy("file").agg(F.sum("n_ids").alias("total"))
    number = _part("file") * F.lit(FILES_PER_PART) + _piece("file")
    starts = running_offsets(totals.withColumn("number", number), "number", "total")
    starts = starts.select("number", F.col("offset").alias("file_start"))
    numbered = read_back.withColumn("number", number)
    return (
        numbered.join(starts, "number")
        .withColumn("start", F.col("file_start") + F.col("before"))
        .drop("number", "file_start")
    )
