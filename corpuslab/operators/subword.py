"""Subword tokenizers: train byte-pair merges, and split words with a vocabulary.

Everything here works on distinct words with counts. The occurrences are scanned
once to count the words, and once to put the results back.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions.bytelevel import byte_pieces, byte_symbols, byte_values, printable_bytes
from corpuslab.functions.rows import item_rows
from corpuslab.functions.tokens import CONTINUED
from corpuslab.operators.dictionary import code_lists, cut_lists
from corpuslab.operators.lookup import fits_broadcast, lookup
from corpuslab.operators.merge_round import MergeRound, RunMerges  # noqa: F401
from corpuslab.session import cut_lineage

# Special token and unknown-word token.
END_OF_TEXT = "<|endoftext|>"
UNKNOWN_WORD = "[UNK]"

# White space as ``byte_pieces`` takes it, which is not that of Python, with what follows it.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PARTS = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
FIRST_SIGN = 0x10000  # code point that stands for symbol 0 in training
MAX_VOCAB = 0x110000 - FIRST_SIGN  # one code point per symbol
CANDIDATES = 20_000  # best pairs looked at per round
PLACES = 200_000  # places of these pairs that are wanted on the driver per round, equal parts of words once
RUNS = 100_000  # parts of words that may come to the driver per round
WIDER = 4  # how much further the next round may look
MAX_ENTRIES, MAX_ENTRY_BYTES = 8_000_000, 256 << 20  # of a vocabulary sent to every task


def piece_counts(lines: DataFrame) -> DataFrame:
    """Distinct byte-level pieces of the lines' ``text``, with counts.

    No piece has white space behind something else, so a text may be cut before each run of it. Tasks count these
    parts of some lines at a time, and only distinct ones are cut into pieces.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter()
            for text in pc.drop_null(batch.column(0)):
                counts.update(PARTS.findall(text.as_py()))
            columns = [pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "freq"])

    parts = lines.select("text").mapInArrow(run, "part string, freq long")
    parts = parts.groupBy("part").agg(F.sum("freq").alias("freq"))
    pieces = item_rows(parts, ["freq"], byte_pieces(F.col("part")), "piece")
    return pieces.groupBy("piece").agg(F.sum("freq").alias("freq"))


def _pairs(words: DataFrame) -> DataFrame:
    """Pairs of neighbouring symbols with their ``count`` and their ``places`` in distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, places = Counter(), Counter()
            for word, freq in zip(batch["word"].to_pylist(), batch["freq"].to_pylist()):
                for i in range(len(word) - 1):
                    counts[word[i : i + 2]] += freq
                    places[word[i : i + 2]] += 1
            columns = [pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64()), pa.array(places.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["pair", "count", "places"])

    found = words.mapInArrow(run, "pair string, count long, places long")
    return found.groupBy("pair").agg(F.sum("count").alias("count"), F.sum("places").alias("places"))


def _runs(words: DataFrame, pairs: list[str]) -> DataFrame:
    """The longest parts of the words in which all neighbours are among ``pairs``, as ``run`` and ``freq``."""
    sent = words.sparkSession.sparkContext.broadcast(set(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leading = sent.value
        for batch in batches:
            found = Counter()
            for word, freq in zip(batch["word"].to_pylist(), batch["freq"].to_pylist()):
                start = 0
                for end in range(1, len(word) + 1):
                    if end == len(word) or word[end - 1 : end + 1] not in leading:
                        if end - start > 1:
                            found[word[start:end]] += freq
                        start = end
            columns = [pa.array(found, pa.string()), pa.array(found.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["run", "freq"])

    return words.mapInArrow(run, "run string, freq long").groupBy("run").agg(F.sum("freq").alias("freq"))


def _leading(ranked: list[Row], places: int) -> list[Row]:
    """The first of the ranked pairs, one at least, that have ``places`` places in distinct words or fewer."""
    sums = list(accumulate(row.places for row in ranked))
    return ranked[: max(1, bisect_right(sums, places))]


def _leading_runs(words: DataFrame, ranked: list[Row], places: int) -> tuple[list[Row], dict[str, int], int]:
    """The leading pairs and their runs, ``RUNS`` at most, and the places to look for in the next round.

    Common pairs have many places in words but few different runs, so the number of places follows what came.
    """
    while True:
        leading = _leading(ranked, places)
        runs = _runs(words, [row.pair for row in leading])
        if len(leading) == 1:  # one symbol with another, or repeated: a run per number of repeats
            rows = runs.collect()
            break
        rows = runs.limit(RUNS + 1).collect()
        if len(rows) <= RUNS:
            break
        places = min(places, sum(row.places for row in leading)) // 2
    came = sum(len(row.run) - 1 for row in rows)
    return leading, {row.run: row.freq for row in rows}, max(1, min(places * WIDER, places * PLACES // came))


def _sign(index: int) -> str:
    return chr(FIRST_SIGN + index)


def _text(sign: str, texts: list[str]) -> str:
    return texts[ord(sign) - FIRST_SIGN]


def train_bpe(
    pieces: DataFrame,
    vocab_size: int = 10_000,
    min_frequency: int = 2,
    specials: Sequence[str] = (END_OF_TEXT,),
) -> tuple[DataFrame, DataFrame]:
    """Learn merges from piece counts: ``(rank, left, right)`` and ``(token, idx)``.

    Pairs are taken by frequency, ties by the ids of their symbols. A word is kept
    as a string with one character per symbol, whose code point is the symbol's id,
    so that the order of strings is the order of ids. A round counts all pairs, brings
    a bounded number of leading ones to the driver with the parts of the words that consist of them
    (equal parts once), takes all merges that follow from these (see ``RunMerges``), and rewrites the words.
    """
    spark = pieces.sparkSession
    texts = [*specials, *sorted(printable_bytes())]
    ids = {t: i for i, t in enumerate(texts)}
    if vocab_size > MAX_VOCAB:
        raise ValueError(f"a subword vocabulary may have {MAX_VOCAB} entries at most")
    signs = F.array(*[F.lit(_sign(ids[c])) for c in printable_bytes()])
    word = F.array_join(byte_values(F.col("piece"), signs), "")
    words = cut_lineage(pieces.select(word.alias("word"), "freq").filter(F.length("word") > 1))
    merges: list[tuple[int, str, str]] = []
    places = PLACES
    while len(texts) < vocab_size:
        ranked = (
            _pairs(words)
            .filter(F.col("count") >= min_frequency)
            .orderBy(F.desc("count"), "pair")
            .limit(CANDIDATES)
            .collect()
        )
        if not ranked:
            break
        leading, runs, places = _leading_runs(words, ranked, places)
        worst = (-leading[-1]["count"], leading[-1].pair)
        whole = len(leading) == len(ranked) < CANDIDATES
        taken = RunMerges(runs)
        done: dict[str, tuple[int, str, str]] = {}
        while len(texts) < vocab_size and (best := taken.best()) is not None:
            pair, count = best
            if count < min_frequency or not whole and (-count, pair) > worst:
                break
            left, right = (_text(sign, texts) for sign in pair)
            fresh = left + right not in ids
            if fresh:
                ids[left + right] = len(texts)
                texts.append(left + right)
            merges.append((len(merges), left, right))
            sign = _sign(ids[left + right])
            done[pair] = (len(done), pair, sign)
            # A string made before has places beyond the runs.
            if not fresh:
                break
            taken.merge(pair, sign)
        words = cut_lineage(_merged(words, done).filter(F.length("word") > 1))
    return (
        spark.createDataFrame(merges, "rank long, left string, right string"),
        spark.createDataFrame(list(enumerate(texts)), "idx long, token string"),
    )


def _merged(words: DataFrame, done: dict[str, tuple[int, str, str]]) -> DataFrame:
    sent = words.sparkSession.sparkContext.broadcast(done)

    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda word: _merge_in_order(word, sent.value))

    return words.withColumn("word", apply("word"))


def _merge_in_order(word: str, merges: dict[str, tuple[int, str, str]]) -> str:
    """Each merge once, in its order; ``merges`` gives rank, pair and result."""
    last = -1
    while True:
        pairs = {word[i : i + 2] for i in range(len(word) - 1)}
        found = [m for p in pairs if (m := merges.get(p)) and m[0] > last]
        if not found:
            return word
        last, pair, sign = min(found)
        word = word.replace(pair, sign)


def _merge_word(
    symbols: Sequence[str], merges: dict[tuple[str, str], tuple[int, str]]
) -> list[str]:
    """Merge pairs by rank, from the left; ``merges`` gives rank and result.

    The ranks of neighbours are kept in a list, of which a merge changes those beside it only.
    """
    symbols, none = list(symbols), (MAX_VOCAB, "")
    ranks = [merges.get(pair, none)[0] for pair in zip(symbols, symbols[1:])]
    while ranks and (best := min(ranks)) < MAX_VOCAB:
        at = ranks.index(best)
        merged = merges[symbols[at], symbols[at + 1]][1]
        while True:
            symbols[at : at + 2] = [merged]
            del ranks[at]
            if at:
                ranks[at - 1] = merges.get((symbols[at - 1], merged), none)[0]
            if at < len(ranks):
                ranks[at] = merges.get((merged, symbols[at + 1]), none)[0]
            # All places of a pair are merged before the next one.
            if best not in ranks:
                break
            at = ranks.index(best)
    return symbols


def _merge_table(merges: DataFrame) -> dict[tuple[str, str], tuple[int, str]]:
    rows = merges.limit(MAX_VOCAB + 1).collect()
    if len(rows) > MAX_VOCAB:
        raise ValueError(f"there may be {MAX_VOCAB} merges at most")
    return {(m.left, m.right): (m.rank, m.left + m.right) for m in rows}


def encode_pieces(pieces: DataFrame, merges: DataFrame) -> DataFrame:
    """Add ``parts``, the subwords of each distinct piece.

    The merges go to every task; a trained vocabulary has ``MAX_VOCAB`` entries at most.
    """
    table = _merge_table(merges)

    @F.pandas_udf("array<string>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_merge_word(s, table) for s in batch])

    return pieces.withColumn("parts", apply(byte_symbols(F.col("piece"))))


def encode_bpe(lines: DataFrame, keys: Sequence[str], merges: DataFrame) -> DataFrame:
    """The byte-level subwords of each line, as ``tokens``."""
    rows = lines.select(*keys, F.array("text").alias("lines"))
    return encode_bpe_lines(rows, keys, merges).select(*keys, F.col("lines")[0].alias("tokens"))


def encode_bpe_lines(docs: DataFrame, keys: Sequence[str], merges: DataFrame) -> DataFrame:
    """Documents with the texts in their array ``lines`` replaced by lists of byte-level subwords."""
    sent = docs.sparkSession.sparkContext.broadcast(_merge_table(merges))
    signs = printable_bytes()

    def make_cut():
        table = sent.value
        return lambda piece: _merge_word([signs[b] for b in piece.encode("utf-8", "replace")], table)

    return cut_lists(docs.withColumn("lines", F.transform("lines", byte_pieces)), "lines", make_cut)


def _joined_parts(docs: DataFrame) -> DataFrame:
    return docs.withColumn("lines", F.transform("lines", F.flatten))


def _known_cuts(types: DataFrame, vocab: DataFrame, max_chars: int) -> DataFrame:
    """Where the longest entry ends from each place of a word: ``(word, start, stop)``, from 1.

    The substrings of distinct words are counted, those in the vocabulary are kept, and the
    counts tell hot substrings in the join back. No vocabulary is too large for it.
    """
    entries = vocab.select(F.col("token").alias("part")).distinct()
    longest = entries.agg(F.max(F.length("part"))).first()[0] or 0
    size = F.length("word")
    short = types.filter((size > 0) & (size <= max_chars))
    places = short.select("word", F.explode(F.sequence(F.lit(1), size)).alias("start"))
    last = F.least(size, F.col("start") + longest - 1)
    cuts = places.filter(F.lit(longest > 0)).select(
        "word", "start", F.explode(F.sequence("start", last)).alias("stop")
    )
    part = F.substr("word", "start", F.col("stop") - F.col("start") + 1)
    lead = F.when(F.col("start") > 1, F.lit(CONTINUED)).otherwise("")
    cuts = cuts.select("word", "start", "stop", F.concat(lead, part).alias("part"))
    seen = cuts.groupBy("part").agg(F.count("*").alias("n")).join(entries, "part", "left_semi")
    table = cut_lineage(seen.withColumn("known", F.lit(True)))
    found = lookup(cuts, table, ["part"], "n").filter("known")
    return found.groupBy("word", "start").agg(F.max("stop").alias("stop"))


def encode_longest_match(
    rows: DataFrame, keys: Sequence[str], vocab: DataFrame, max_chars: int = 100
) -> DataFrame:
    """Split the words in ``tokens`` by the longest match in a supplied vocabulary.

    ``vocab`` has a ``token`` column; entries that continue a word start with
    ``##``. A word that cannot be split, or is too long, becomes one unknown token.
    """
    docs = rows.select(*keys, F.array("tokens").alias("lines"))
    coded = encode_longest_match_lines(docs, keys, vocab, max_chars)
    return coded.select(*keys, F.col("lines")[0].alias("tokens"))


def encode_longest_match_lines(
    docs: DataFrame, keys: Sequence[str], vocab: DataFrame, max_chars: int = 100
) -> DataFrame:
    """Documents with the word lists in their array ``lines`` replaced by lists of their parts.

    A vocabulary that has been measured and is not too large goes to every task, which cuts the words of its
    documents where they are. A larger one is joined to the substrings of distinct words.
    """
    entries = cut_lineage(vocab.select(F.col("token").alias("part")).where("part is not null").distinct())
    if fits_broadcast(entries, MAX_ENTRIES, MAX_ENTRY_BYTES):
        sent = docs.sparkSession.sparkContext.broadcast(_flagged(entries))
        return cut_lists(docs, "lines", lambda: _matcher(sent.value, max_chars))
    words = item_rows(docs, [], F.flatten("lines"), "word")
    types = cut_lineage(words.groupBy("word").agg(F.count("*").alias("freq")))
    table = cut_lineage(match_words(types, vocab, max_chars)).select("word", "parts", "freq")
    return _joined_parts(code_lists(docs, keys, "lines", table, "freq"))


def _flagged(entries: DataFrame) -> dict[str, int]:
    """Entries without their sign of continuing: 1 if one begins a word, 2 if it goes on, 3 if both."""
    goes_on = F.startswith("part", F.lit(CONTINUED))
    bare = F.when(goes_on, F.substr("part", F.lit(len(CONTINUED) + 1))).otherwise(F.col("part"))
    rows = entries.select(bare.alias("bare"), F.when(goes_on, 2).otherwise(1).alias("flag"))
    both = rows.groupBy("bare").agg(F.sum("flag").cast("int").alias("flag")).toArrow()
    return dict(zip(both["bare"].to_pylist(), both["flag"].to_pylist()))


def _matcher(entries: dict[str, int], max_chars: int) -> Callable[[str], list[str]]:
    """Cuts a word by the longest match, from the left, in entries of ``_flagged``."""
    longest = max(map(len, entries), default=0) + len(CONTINUED)

    def begins(part: str) -> bool:
        return entries.get(part, 0) & 1 or (
            part.startswith(CONTINUED) and entries.get(part[len(CONTINUED):], 0) & 2
        )

    def cut(word: str) -> list[str]:
        if not word:
            return []
        if len(word) > max_chars:
            return [UNKNOWN_WORD]
        parts, start = [], 0
        while start < len(word):
            for stop in range(min(len(word), start + longest), start, -1):
                part = word[start:stop]
                if start and entries.get(part, 0) & 2:
                    parts.append(CONTINUED + part)
                    break
                if not start and begins(part):
                    parts.append(part)
                    break
            else:
                return [UNKNOWN_WORD]
            start = stop
        return parts

    return cut


def match_words(types: DataFrame, vocab: DataFrame, max_chars: int = 100) -> DataFrame:
    """Add ``parts`` to distinct words (``word``, ``freq``), by the longest match."""
    cuts = _known_cuts(types, vocab, max_chars)
    stops = cuts.groupBy("word").agg(
        F.map_from_entries(F.collect_list(F.struct("start", "stop"))).alias("stops")
    )

    def step(state, place):
        stop = F.try_element_at("stops", place)
        lead = F.when(place > 1, F.lit(CONTINUED)).otherwise("")
        part = F.concat(lead, F.substr("word", place, stop - place + 1))
        moved = F.struct((stop + 1).alias("next"), F.array_append(state["parts"], part).alias("parts"))
        return F.when((state["next"] == place) & stop.isNotNull(), moved).otherwise(state)

    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("parts"))
    walk = F.aggregate(F.sequence(F.lit(1), F.length("word")), start, step)
    walked = stops.select("word", walk.alias("walk"), (F.length("word") + 1).alias("end"))
    whole = walked.filter(F.col("walk.next") == F.col("end")).select("word", "walk.parts")
    return types.join(whole, "word", "left").select(
        "word", "freq",
        F.when(F.col("word") == "", F.array())
        .otherwise(F.coalesce("parts", F.array(F.lit(UNKNOWN_WORD)))).alias("parts"),
    )

def save_tokenizer(merges: DataFrame, vocab: DataFrame, folder: str) -> None:
    """Write a trained tokenizer as two tables."""
    merges.coalesce(1).write.mode("overwrite").parquet(f"{folder}/merges")
    vocab.coalesce(1).write.mode("overwrite").parquet(f"{folder}/vocab")


def load_tokenizer(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Read the two tables of a saved tokenizer, ``(merges, vocab)``."""
    return spark.read.parquet(f"{folder}/merges"), spark.read.parquet(f"{folder}/vocab")
