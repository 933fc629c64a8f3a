"""URL filters: rules for hosts and paths, and for the rest a model of their letters.

The model is a logistic regression on hashed character n-grams of host and path. It is trained from
a small labelled URL table, by full-batch gradient steps on the driver: at most
``MOST_LABELLED`` rows, those with the smallest hashes, so that the same table gives the same model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm.batches import field, smallest_by_hash, with_python

BITS = 16
GRAMS = (3, 4, 5)
MOST_LABELLED = 20_000

#: Fixed rules: verdict, host (with all subdomains) and the beginning of the path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and where there is no ``://``."""
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    whole = F.coalesce(F.when(F.instr(url, "://") > 0, after), F.lit(""))
    host = F.regexp_extract(whole, r"(?s)^([^/?#]*)", 1)
    rest = F.substring(whole, F.length(host) + 1, F.length(whole))
    path = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, domain, begin in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(begin)
        rule = F.when(fits, F.lit(domain + begin)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str, bits: int = BITS) -> np.ndarray:
    """Hashes of the n-grams of host and path, each once; the two have grams of their own."""
    found = []
    for salt, text in ((1, f"^{host}$"), (2, f"^{path}$")):
        codes = np.frombuffer(text.encode(), np.uint8).astype(np.uint64) + np.uint64(salt)
        for n in GRAMS:
            if len(codes) >= n:
                value = np.full(len(codes) - n + 1, n, np.uint64)
                for i in range(n):
                    value = (value ^ codes[i : len(codes) - n + 1 + i]) * np.uint64(0x100000001B3)
                    value ^= value >> np.uint64(29)
                value *= np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * salt)
                found.append(value >> np.uint64(64 - bits))
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)


class Model:
    """Weights of hashed grams and an intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def probability(self, host: str, path: str) -> float:
        """How likely the URL is one to block."""
        grams = features(host, path, int(np.log2(len(self.weights))))
        score = self.intercept + self.weights[grams].sum() / max(1.0, np.sqrt(len(grams)))
        return float(1 / (1 + np.exp(-np.clip(score, -500, 500))))


def fit(rows: list[tuple[str, str, bool]], bits: int = BITS, steps: int = 200, ridge: float = 1e-4):
    """A model from host, path and whether to block. Without both labels it says what there is."""
    grams = [features(h, p, bits) for h, p, _ in rows]
    wanted = np.array([b for _, _, b in rows], float)
    weights, intercept = np.zeros(1 << bits), 0.0
    if not rows or wanted.min() == wanted.max():
        return Model(weights, (8.0 if wanted.max(initial=0) else -8.0))
    owner = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
    flat = np.concatenate(grams)
    scale = 1 / np.sqrt(np.maximum(1, [len(g) for g in grams]))
    square, square_0 = np.full(1 << bits, 1e-8), 1e-8
    for _ in range(steps):
        score = intercept + scale * np.bincount(owner, weights[flat], len(rows))
        error = (1 / (1 + np.exp(-np.clip(score, -500, 500))) - wanted) / len(rows)
        slope = np.bincount(flat, (error * scale)[owner], 1 << bits) + ridge * weights
        square += slope**2
        weights -= 0.5 * slope / np.sqrt(square)
        square_0 += error.sum() ** 2
        intercept -= 0.5 * error.sum() / np.sqrt(square_0)
    return Model(weights, intercept)


def train(labelled: DataFrame, most: int = MOST_LABELLED, bits: int = BITS) -> Model:
    """Fit on ``host, path, block`` of ``labelled``, at most ``most`` rows by smallest hash.

    Equal URLs count once for each label that they have; rows with nulls are left out.
    """
    rows = labelled.select("host", "path", "block").dropna()
    return fit([tuple(r) for r in smallest_by_hash(rows, ["host", "path"], most).collect()], bits)


def judge(
    pages: DataFrame, model: Model | None = None, url: str = "url", rules=RULES
) -> DataFrame:
    """Add ``host, path, rule, verdict`` and ``p_block`` (double) to each page.

    A rule decides where one fits, else the model. Without a model, one is trained from the
    URLs that rules decide: they are the labelled table. Null URLs have empty host and path and
    are judged by the model. Input columns of these names are replaced.
    """
    host, path = split_url(field(url))
    parts = pages.withColumns({"host": host, "path": path})
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": rule, "verdict": verdict})
    if model is None:
        model = train(parts.where("rule is not null").select("host", "path", (F.col("verdict") == "block").alias("block")))
    shared = pages.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.intercept))

    def setup():
        own = Model(*shared.value)
        known: dict[tuple, float] = {}

        def make(hosts, paths):
            out = []
            for key in zip(hosts.to_pylist(), paths.to_pylist(), strict=True):
                if key not in known:
                    if len(known) >= 100_000:
                        known.clear()
                    known[key] = own.probability(*key)
                out.append(known[key])
            return [pa.array(out, pa.float64())]

        return make

    added = T.StructType([T.StructField("p_block", T.DoubleType())])
    scored = with_python(parts, [F.col("host"), F.col("path")], added, setup)
    by_model = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("verdict", by_model))
