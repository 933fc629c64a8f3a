"""Nearest original text of each generated text, by edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.functions import distance
from corpuslab.operators.lookup import fits_broadcast
from corpuslab.session import cut_lineage

BLOCK = 1_024  # originals compared at a time
CELLS = 1 << 20  # characters of a block, so long texts make small blocks
TOGETHER = 4_096  # texts, of any blocks, that a generated text is compared with at a time
LONGEST = 1_024  # characters of a generated text compared with blocks
MAX_GENERATED, MAX_GENERATED_BYTES = 50_000, 16 << 20  # sent to every task
BAND = 16  # characters per length band
SALTS = 64  # parts of a length band
NEAR = 24  # difference in length of the originals that give a first bound
FIRST = 4  # parts of a length band, of all SALTS, that give a first bound
TASKS = 4  # tasks per core: comparing costs far more than the bytes suggest
LETTERS = 31  # characters counted one by one; all others are counted together


def _distinct(texts: DataFrame, key: list[str]) -> DataFrame:
    """One row per text, with the smallest key it occurs under."""
    return texts.groupBy("text").agg(F.min(F.struct(*key)).alias("key"))


def _spread(texts: DataFrame) -> DataFrame:
    """Comparing costs far more than the bytes suggest, so use all cores at least."""
    spark = texts.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return texts.repartition(max(wanted, spark.sparkContext.defaultParallelism), "text")


class _Best:
    """The nearest original so far of each generated text, within one task."""

    def __init__(self, generated: list[str], keys: list[str]):
        letters = sorted({c for g in generated for c in g}) or [" "]
        self.alphabet = np.unique(distance.code_points("".join(letters)))
        self.patterns = [distance.make_pattern(g, self.alphabet) for g in generated]
        self.generated, self.keys = generated, keys
        self.best: list[tuple | None] = [None] * len(generated)

    def add(self, batch: pd.DataFrame) -> None:
        batch = batch.sort_values(self.keys, ignore_index=True)
        texts = batch["text"].to_list()
        order = np.argsort([-len(t) for t in texts], kind="stable")
        blocks = []
        while len(order):
            rows = max(1, min(BLOCK, CELLS // (len(texts[order[0]]) + 1)))
            blocks.append(distance.make_block(texts, order[:rows], self.alphabet))
            order = order[rows:]
        for number, pattern in enumerate(self.patterns):
            self._compare(number, pattern, blocks, batch)

    def _compare(self, number: int, pattern, blocks: list, batch: pd.DataFrame) -> None:
        """Blocks of about the text's length come first, so the bound tightens early.

        What the lower bounds leave of several blocks is compared together: of one block it is too little
        for steps over arrays to be worth while.
        """
        gaps = [
            max(b.sizes[-1] - pattern.size, pattern.size - b.sizes[0], 0) for b in blocks
        ]
        # no two texts are further apart than the longer one is long
        bound = max(pattern.size, blocks[-1].sizes[-1])
        held, found = self.best[number], None
        if held:
            bound = min(bound, held[0])
        parts, waiting = [], 0
        order = np.argsort(gaps, kind="stable")
        for turn, i in enumerate(order):
            if gaps[i] <= bound:
                keep = np.flatnonzero(distance.lower_bounds(pattern, blocks[i]) <= bound)
                if len(keep):
                    parts.append((blocks[i], keep))
                    waiting += len(keep)
            last = turn + 1 == len(order) or gaps[order[turn + 1]] > bound
            if waiting and (last or waiting >= TOGETHER or (found is None and held is None)):
                block = distance.joined(parts)
                scores = distance.distances(pattern, block)
                nearest = scores.min()
                candidate = (nearest, block.rows[scores == nearest].min())
                found = min(found, candidate) if found else candidate
                bound = min(bound, nearest)
                parts, waiting = [], 0
            if last:
                break  # all blocks after it are further off in length
        if found:
            row = batch.iloc[found[1]]
            mine = (int(found[0]), tuple(row[k] for k in self.keys), row["text"])
            if held is None or mine < held:
                self.best[number] = mine

    def frame(self) -> pd.DataFrame:
        rows = [
            (g, b[0], b[2], *b[1]) for g, b in zip(self.generated, self.best) if b is not None
        ]
        return pd.DataFrame(rows, columns=["gen", "distance", "text", *self.keys])


def _scan(asked: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Best originals by one scan of them, with the generated texts in every task.

    Each task gives one row per generated text, so little is shuffled.
    """
    generated = [r.gen for r in asked.collect()]
    sent = known.sparkSession.sparkContext.broadcast(generated)
    flat = known.select("text", *[F.col(f"key.{k}").alias(k) for k in key])
    schema = T.StructType(
        [
            T.StructField("gen", T.StringType()),
            T.StructField("distance", T.IntegerType()),
            T.StructField("text", T.StringType()),
            *[flat.schema[k] for k in key],
        ]
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(sent.value, key)
        for batch in batches:
            if len(batch):
                best.add(batch)
        yield best.frame()

    found = flat.mapInPandas(compare, schema)
    best = F.min(F.struct("distance", F.struct(*key).alias("key"), "text")).alias("best")
    return found.groupBy("gen").agg(best)


def _letters(asked: DataFrame) -> list[str]:
    """The most common characters of the generated texts, ``LETTERS`` at most."""
    letter = F.explode(F.split("gen", "")).alias("letter")
    counts = asked.select(letter).where("letter <> ''").groupBy("letter").count()
    return [r.letter for r in counts.orderBy(F.desc("count"), "letter").limit(LETTERS).collect()]


def _profile(text: str, letters: list[str], prefix: str) -> list[Column]:
    """How often a text has each letter and how often any other, one column each."""
    size = F.length(text)
    counts = [size - F.length(F.replace(F.col(text), F.lit(c), F.lit(""))) for c in letters]
    others = reduce(Column.__sub__, counts, size)
    return [c.alias(f"{prefix}{i}") for i, c in enumerate([*counts, others])]


def _unmatched(width: int) -> Column:
    """Characters of the longer text, or of the shorter one, without a partner in the other.

    Each needs an edit, so no edit distance is smaller.
    """
    missing = [F.greatest(F.col(f"g{i}") - F.col(f"o{i}"), F.lit(0)) for i in range(width)]
    left = reduce(Column.__add__, missing)
    return F.greatest(left, left + F.length("text") - F.length("gen"))


def _bands(low: Column, high: Column) -> Column:
    first = F.floor(F.greatest(low, F.lit(0)) / BAND)
    return F.sequence(first, F.greatest(F.floor(high / BAND), first))


def _spread_bands(rows: DataFrame) -> DataFrame:
    """Length bands over a set number of tasks, which both sides of the join share."""
    spark = rows.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(wanted, TASKS * spark.sparkContext.defaultParallelism), "band", "salt")


def _within(asked: DataFrame, known: DataFrame, reach: Column, salts: int, width: int) -> DataFrame:
    """Pairs of a generated text and an original no further apart than its ``bound``, with their ``distance``.

    Lengths differ by ``reach`` at most. Bands are cut into parts by a hash of the original, of which
    the first ``salts`` are compared; so a common length is not in one task. Lengths and
    letters bound the distance from below before it is worked out.
    """
    size = F.length("gen")
    asked = asked.withColumn("band", F.explode(_bands(size - reach, size + reach)))
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = _spread_bands(known.where(F.col("salt") < salts)).join(_spread_bands(asked), ["band", "salt"])
    joined = joined.where(F.abs(F.length("gen") - F.length("text")) <= F.col("bound"))
    joined = joined.where(_unmatched(width) <= F.col("bound"))
    found = F.call_function("levenshtein", F.col("gen"), F.col("text"), F.col("bound"))
    return joined.withColumn("distance", found).where("distance >= 0")


def _join(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Best originals by joins on length bands, for any number of generated texts, as ``(gen, best)``.

    A fixed share of the originals of about a text's length gives an upper bound, or the shortest
    original does where there are none. All originals within that bound are then compared: they
    differ in length by no more than it.
    """
    shortest = known.agg(F.min(F.length("text"))).first()[0]
    letters = _letters(asked)
    width = len(letters) + 1
    known = cut_lineage(
        known.select(
            "text", "key", F.floor(F.length("text") / BAND).alias("band"),
            F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int").alias("salt"),
            *_profile("text", letters, "o"),
        )
    )
    far = F.greatest(F.length("gen"), F.lit(shortest)).alias("bound")
    asked = cut_lineage(asked.select("gen", far, *_profile("gen", letters, "g")))
    near = _within(asked, known, F.lit(NEAR), FIRST, width)
    near = near.groupBy("gen").agg(F.min("distance").alias("near"))
    bounded = asked.join(near, "gen", "left").withColumn("bound", F.least("bound", "near")).drop("near")
    pairs = _within(cut_lineage(bounded), known, F.col("bound"), SALTS, width)
    return pairs.groupBy("gen").agg(F.min(F.struct("distance", "key", "text")).alias("best"))


def nearest_original(
    generated: DataFrame,
    originals: DataFrame,
    key: list[str],
    append_newline: bool = False,
    scan: bool | None = None,
) -> DataFrame:
    """For each distinct generated text, its nearest original, ``(gen, distance, key, text)``.

    Ties go to the original with the smallest key. The result is exact. Texts that
    also are originals are settled by an equality join. The others are compared by
    one scan of the originals if they are few and short enough to be in every task,
    and by joins on length bands if not; ``scan`` overrides the choice. Null texts on either side
    take no part; without originals there are no rows.

    With ``append_newline`` originals are compared with a line end after them, as
    lines of a file are if nothing strips them.
    """
    if append_newline:
        originals = originals.withColumn("text", F.concat("text", F.lit("\n")))
    known = cut_lineage(_spread(_distinct(originals.where("text is not null"), key)))
    asked = generated.select(F.col("text").alias("gen")).where("gen is not null").distinct()
    same = cut_lineage(
        asked.join(known.withColumnRenamed("text", "gen"), "gen", "left").select("gen", "key")
    )
    settled = same.filter("key is not null").select(
        "gen", F.struct(F.lit(0).alias("distance"), "key", F.col("gen").alias("text")).alias("best")
    )
    rest = same.filter("key is null").select("gen")
    short = rest.filter(F.length("gen") <= LONGEST)
    if scan is None:
        scan = fits_broadcast(short, MAX_GENERATED, MAX_GENERATED_BYTES)
    if not known.isEmpty():
        if scan:
            settled = settled.unionByName(_scan(short, known, key))
            rest = rest.filter(F.length("gen") > LONGEST)
        if not rest.isEmpty():
            settled = settled.unionByName(_join(rest, known))
    text = F.col("best.text")
    return settled.select(
        "gen",
        F.col("best.distance").cast("long").alias("distance"),
        F.col("best.key").alias("key"),
        (F.regexp_replace(text, r"\n\z", "") if append_newline else text).alias("text"),
    )


def similarity_by_run(generated: DataFrame, nearest: DataFrame, run: str) -> DataFrame:
    """Mean distance to the nearest original, per run, over all generated rows."""
    counted = generated.groupBy(run, F.col("text").alias("gen")).agg(F.count("*").alias("m"))
    scored = counted.join(nearest.select("gen", "distance"), "gen")
    return scored.groupBy(run).agg(
        F.sum("m").alias("n_texts"),
        F.round(F.sum(F.col("distance") * F.col("m")) / F.sum("m"), 6).alias("mean_distance"),
    )
