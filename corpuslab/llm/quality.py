"""A quality classifier: ordinal regression of graded ratings on hashed text.

Cumulative links: the chance that a text's grade is ``g`` or more is the logistic function of its score
less the threshold of ``g``. All grades share the weights of the hashed words; the thresholds
are in order. A text gets its expected grade and the tail probability of the grade asked for.

Trained on the driver from at most ``MOST_RATED`` rated texts, those with the smallest hashes of
their keys, of which only hashed features leave the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm.batches import field, list_array, utf8, with_python
from corpuslab.llm.decontaminate import words_of

BITS = 18
MOST_RATED = 12_000
LEAST_TEXTS = 20
"""Features of fewer rated texts than this have no weight."""
PREFIXES = (4,)
"""Beginnings of words, in bytes, that are features as well: they also know words not seen before."""
GRADES = 3
KEEP = 0.7
_SPACES = b" \t\n\r\x0b\x0c"
_LOWER = bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_PLAIN = _LOWER + _UPPER + bytes(range(48, 58)) + bytes(range(128, 256)) + _SPACES


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 1 << 17:
            self.clear()
        made = self[word] = xxhash.xxh64_intdigest(word, BITS) >> (64 - BITS)
        return made


_HASHES = _Hashes()


def features(text: bytes) -> np.ndarray:
    """Hashes of the words and their beginnings, each once, and of a few shares of the text."""
    words = words_of(text)
    found = set(words)
    size = max(1, len(text))
    shares = (
        (b"symbols", len(text.translate(None, _PLAIN)) / size),
        (b"capitals", (size - len(text.translate(None, _UPPER))) / size),
        (b"different", len(found) / max(1, len(words))),
        (b"repeats", sum(map(bytes.__eq__, words, words[1:])) / max(1, len(words))),
        (b"bars", text.count(b" | ") / max(1, len(words))),
    )
    found |= {w[:n] + b"-" for n in PREFIXES for w in found if len(w) > n}
    found.update(b"%b=%d" % (name, min(9, int(20 * share))) for name, share in shares)
    found.add(b"length=%d" % len(words).bit_length())
    return np.unique(np.fromiter(map(_HASHES.__getitem__, found), np.int32, len(found)))


class Model:
    """Weights shared by all grades and one threshold for each grade above the lowest; ``rated`` texts were used."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, rated: int = 0):
        self.weights, self.thresholds, self.rated = weights, thresholds, rated

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """The chances of each grade above the lowest, or more; one row per score."""
        return _logistic(np.asarray(scores)[:, None] - self.thresholds)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(
    owner: np.ndarray, feature: np.ndarray, grades: np.ndarray, n_grades: int = GRADES,
    steps: int = 120, ridge: float = 1e-3,
) -> Model:
    """Weights and thresholds that make the grades likely, by Adam steps on all rows.

    ``owner`` and ``feature`` list the features of the rated rows. Thresholds are the first one and
    gaps that stay positive. Without rows every grade above the lowest is as likely as not.
    """
    rows, size = len(grades), 1 << BITS
    often = np.bincount(feature, minlength=size) >= LEAST_TEXTS
    owner, feature = owner[often[feature]], feature[often[feature]]
    used = np.unique(feature)
    feature = np.searchsorted(used, feature).astype(np.int32)
    values = np.zeros(len(used) + n_grades - 1)
    tails = np.array([(grades >= g).mean() if rows else 0.5 for g in range(1, n_grades)])
    tails = np.clip(tails, 0.01, 0.99)
    first = -np.log(tails / (1 - tails))
    gaps = np.maximum(np.diff(first), 1e-2)
    values[len(used) :] = np.concatenate((first[:1], np.log(gaps)))
    mean, square = np.zeros_like(values), np.zeros_like(values)

    def cuts(v):
        return np.cumsum(np.concatenate((v[:1], np.exp(v[1:]))))

    for step in range(1, steps + 1 if rows else 1):
        weights, bend = values[: len(used)], values[len(used) :]
        score = np.bincount(owner, weights[feature], rows)
        edges = np.concatenate(([-np.inf], cuts(bend), [np.inf]))
        low, high = edges[grades] - score, edges[grades + 1] - score
        at_low, at_high = _logistic(low), _logistic(high)
        slope_low, slope_high = at_low * (1 - at_low), at_high * (1 - at_high)
        slope_low[grades == 0] = 0
        slope_high[grades == n_grades - 1] = 0
        chance = np.maximum(
            np.where(grades == n_grades - 1, 1, at_high) - np.where(grades == 0, 0, at_low), 1e-12
        )
        d_score = (slope_high - slope_low) / chance / rows
        d_cut = np.zeros(n_grades - 1)
        np.add.at(d_cut, np.minimum(grades, n_grades - 2), -slope_high / chance / rows)
        np.add.at(d_cut, np.maximum(grades - 1, 0), slope_low / chance / rows)
        d_bend = np.cumsum(d_cut[::-1])[::-1]
        d_bend[1:] *= np.exp(bend[1:])
        slope = np.concatenate(
            (np.bincount(feature, d_score[owner], len(used)) + ridge * weights, d_bend)
        )
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        values = values - 0.05 * (mean / (1 - 0.9**step)) / (
            np.sqrt(square / (1 - 0.99**step)) + 1e-8
        )
    whole = np.zeros(size)
    whole[used] = values[: len(used)]
    return Model(whole, cuts(values[len(used) :]), rows)


def train(
    docs: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text",
    grade: str = "grade", most: int = MOST_RATED, n_grades: int = GRADES,
) -> Model:
    """Fit on the texts of ``docs`` that ``ratings`` (``key``, ``grade``) has a grade for.

    The ratings with the ``most`` smallest hashes are taken; ratings without a text, null grades and grades
    outside ``0`` to ``n_grades - 1`` are left out, and of several for one key the lowest counts.
    """
    rated = ratings.select(field(key).alias("key"), field(grade).cast("int").alias("grade"))
    rated = rated.where(F.col("grade").between(0, n_grades - 1)).groupBy("key").agg(
        F.min("grade").alias("grade")
    )
    texts = docs.select(field(key).alias("key"), field(text).alias("text")).where("text is not null")
    rated = rated.orderBy(F.xxhash64("key"), "key").limit(most)
    size = rated.count()
    chosen = texts.join(F.broadcast(rated) if size <= MOST_RATED else rated, "key")

    def setup():
        def make(column):
            found = [features(t) for t in utf8(column)]
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            return [list_array(flat, [len(f) for f in found])]

        return make

    added = T.StructType([T.StructField("features", T.ArrayType(T.IntegerType()))])
    made = with_python(chosen, [F.col("text")], added, setup).select("key", "grade", "features")
    table = made.toArrow().sort_by("key").combine_chunks()
    lists = table["features"].combine_chunks()
    counts = np.asarray(pa.compute.list_value_length(lists)).astype(np.int64)
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    flat = np.asarray(lists.flatten())
    return fit(owner, flat, np.asarray(table["grade"]).astype(np.int64), n_grades)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``expected_grade`` and ``tails`` (chances of grades 1, 2, ... or more).

    The whole text counts; null is an empty text. Input columns of these names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(
        (model.weights.astype(np.float32), model.thresholds)
    )

    def setup():
        weights, thresholds = shared.value
        own = Model(weights, thresholds)

        def make(column):
            scores = [float(weights[features(t)].sum(dtype=np.float64)) for t in utf8(column)]
            tails = own.tails(np.array(scores))
            return [
                pa.array(tails.sum(axis=1)),
                list_array(tails.reshape(-1), [tails.shape[1]] * len(scores)),
            ]

        return make

    added = T.StructType(
        [
            T.StructField("expected_grade", T.DoubleType()),
            T.StructField("tails", T.ArrayType(T.DoubleType())),
        ]
    )
    return with_python(df, [field(text)], added, setup)


def grades_of(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``grade``: good quality and lack of toxicity give a point each."""
    return labels.select(
        "doc_id", (F.col("quality").cast("int") + 1 - F.col("toxic").cast("int")).alias("grade")
    )


def accepted(scored: DataFrame, grade: int = GRADES - 1, least: float = KEEP) -> DataFrame:
    """Add ``accepted``: whether ``grade`` or more is as likely as ``least``."""
    return scored.withColumn("accepted", F.element_at("tails", grade) >= least)
