"""Near copies by SimHash: fingerprints, links of few differing bits, and components.

Fingerprints of 64 bits that differ in at most 2 bits share at least 6 of their 8 bytes at the same
positions. The inverted index has a posting for each four of the eight positions out of six
such fours (pairs of position pairs): two fingerprints with 6 shared bytes always meet in one of
them, whereas a single byte would be shared by every 256th pair of a corpus. Pairs that meet
are tallied, those with fewer than 6 shared bytes dropped, the rest verified bit by bit.

A posting with many fingerprints, as groups of near copies make them, isn't paired up: two
members differ in at most 2 bits exactly if changing at most one bit of each can make them
equal, so each member is filed under its 33 such variants within the posting and linked
with the smallest member under each. That is linear, and joins the same components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm.batches import field, utf8, with_python
from corpuslab.llm.components import connected
from corpuslab.session import cut_lineage

SHINGLE = 3
SEED = 42
MOST_BITS = 2
LEAST_BYTES = 8 - MOST_BITS
CROWD = 32
"""Postings with more fingerprints than this are linked through variants."""


def fingerprint_of(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """The bits that are set in more than half of the shingles' hashes."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], "<u8")
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        bits = hashes[start : start + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str, name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of the whole text (a long that holds the 64 bits).

    Words are runs without ASCII white space, A-Z made lower case. Null and empty texts have
    the fingerprint zero. An input column of that name is replaced.
    """

    def setup():
        def make(column):
            values = np.array([fingerprint_of(t) for t in utf8(column)], np.uint64)
            return [pa.array(values.view(np.int64))]

        return make

    return with_python(df, [field(text)], T.StructType([T.StructField(name, T.LongType())]), setup)


def _mask(*positions: int) -> int:
    value = sum(0xFF << (8 * p) for p in positions)
    return value - (1 << 64) if value >> 63 else value


#: Four byte positions each, out of the position pairs 01, 23, 45, 67.
FOURS = [(a, a + 1, b, b + 1) for a in range(0, 8, 2) for b in range(a + 2, 8, 2)]


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight bytes are the same at the same position."""
    different = a.bitwiseXOR(b)
    return sum(
        F.when(different.bitwiseAND(F.lit(_mask(p))) == 0, 1).otherwise(0) for p in range(8)
    )


def links(prints: DataFrame, name: str = "fingerprint") -> DataFrame:
    """Links ``a``, ``b`` (``a`` less than ``b``) that join fingerprints of few differing bits.

    ``prints`` holds each fingerprint once. Every link is a true one, and any two fingerprints with at
    most 2 differing bits are joined by links, in crowded postings by way of others.
    """
    fp = F.col("f")
    postings = prints.select(field(name).alias("f")).select(
        "f",
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(n).alias("n"), fp.bitwiseAND(F.lit(_mask(*four))).alias("bytes"))
                    for n, four in enumerate(FOURS)
                )
            )
        ).alias("k"),
    )
    postings = postings.select("f", F.col("k.n").alias("n"), F.col("k.bytes").alias("bytes"))
    sizes = postings.groupBy("n", "bytes").agg(F.count("*").alias("size")).where("size > 1")
    met = cut_lineage(postings.join(sizes, ["n", "bytes"]))
    few = met.where(F.col("size") <= CROWD)
    pairs = few.groupBy("n", "bytes").agg(F.array_sort(F.collect_list("f")).alias("all"))
    pairs = pairs.select("all", F.posexplode("all").alias("at", "a")).select(
        "a", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("b")
    )
    rest = [[p for p in range(8) if p not in four] for four in FOURS]
    one_bit = F.array(
        *(
            F.array(F.lit(0).cast("long"), *(F.lit(_bit(8 * p + i)) for p in free for i in range(8)))
            for free in rest
        )
    )
    variants = met.where(F.col("size") > CROWD).select(
        "f", "n", F.explode(F.element_at(one_bit, F.col("n") + 1)).alias("bit")
    )
    variants = variants.select("f", "n", F.col("f").bitwiseXOR(F.col("bit")).alias("variant"))
    smallest = variants.groupBy("n", "variant").agg(
        F.min("f").alias("a"), F.count("*").alias("members")
    )
    smallest = smallest.where("members > 1").drop("members")
    starred = variants.join(smallest, ["n", "variant"]).where("f != a")
    starred = starred.select("a", F.col("f").alias("b"))
    found = pairs.union(starred)
    tallied = found.where(shared_bytes(F.col("a"), F.col("b")) >= LEAST_BYTES)
    verified = tallied.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS)
    return verified.distinct()


def _bit(n: int) -> int:
    return (1 << n) - (1 << 64 if n == 63 else 0)


def near_copies(
    df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "fingerprint"
) -> DataFrame:
    """``key``, the fingerprint (long) and ``component_id``, the smallest key that links reach.

    Repeated rows stay repeated; null and empty texts all have fingerprint zero and so
    are linked. A null key belongs to its text's component, but never names one unless the
    component has no other.
    """
    made = fingerprints(df.select(field(key).alias("key"), field(text).alias("text")), "text", "f")
    prints = cut_lineage(made.select("key", "f"))
    classes = cut_lineage(prints.groupBy("f").agg(F.min("key").alias("least")))
    joined = connected(links(classes.select("f"), "f"))
    named = classes.join(joined.withColumnRenamed("node", "f"), "f", "left")
    named = named.select("f", "least", F.coalesce("component", "f").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("f", "root").join(roots, "root").select("f", "component_id")
    return prints.join(named, "f").select(
        F.col("key").alias(key), F.col("f").alias(name), "component_id"
    )
