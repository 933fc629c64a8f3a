"""Next-token tables: fit, score, and generate text from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.tokens import EOS
from corpuslab.operators.lookup import fits_broadcast, lookup
from corpuslab.operators.ordinal import running_offsets
from corpuslab.operators.vocab import encode
from corpuslab.session import cut_lineage, write_laid_out

STEPS_PER_WRITE = 6
FRONTIER_STEPS = 4  # tokens that the search for reachable tokens goes further per write


def count_bigrams(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """How often each token follows each other one, as ``n``."""
    return pairs.groupBy(*by, "prev", "next").agg(F.count("*").alias("n"))


def with_totals(bigrams: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``total``, the occurrences of ``prev`` as a predecessor.

    ``bigrams`` should be written already. A frequent ``prev`` has many rows, so
    totals come back by a lookup weighted with the number of rows.
    """
    totals = cut_lineage(
        bigrams.groupBy(*by, "prev").agg(F.sum("n").alias("total"), F.count("*").alias("rows_"))
    )
    return lookup(bigrams, totals, [*by, "prev"], "rows_")


def top_successors(bigrams: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` most frequent successors of each token; ties by token."""
    order = Window.partitionBy("prev").orderBy(F.desc("n"), F.asc("next"))
    ranked = bigrams.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.filter(F.col("rank") <= k)


def score_table(pairs: DataFrame, fit: Column, alpha: float = 1.0) -> DataFrame:
    """Every pair in ``pairs`` with its smoothed negative log probability.

    Counts are taken over the rows where ``fit`` holds; the vocabulary is that of
    all rows. ``weight`` is the number of rows a pair has altogether.
    """
    counted = cut_lineage(
        pairs.groupBy("prev", "next").agg(F.count_if(fit).alias("n"), F.count("*").alias("weight"))
    )
    size = counted.select("next").distinct().count()
    known = with_totals(counted)
    p = (F.col("n") + alpha) / (F.col("total") + alpha * size)
    return cut_lineage(known.select("prev", "next", (-F.log(p)).alias("nll"), "weight"))


def score(pairs: DataFrame, table: DataFrame, **limits: int) -> DataFrame:
    """Add the negative log probability ``nll`` to each pair occurrence."""
    return lookup(pairs, table, ["prev", "next"], "weight", **limits)


def best_successor(bigrams: DataFrame, policy: str) -> DataFrame:
    """The token greedy generation goes to from each token.

    ``stop_at_eos`` takes the most frequent successor, whatever it is;
    ``suppress_eos`` never takes the end marker but the next best instead.
    """
    if policy not in ("stop_at_eos", "suppress_eos"):
        raise ValueError(f"unknown policy {policy!r}")
    if policy == "suppress_eos":
        bigrams = bigrams.filter(F.col("next") != EOS)
    best = bigrams.groupBy("prev").agg(F.min(F.struct(-F.col("n"), "next")).alias("best"))
    return best.select("prev", F.col("best.next").alias("next"))


def _append(walks: DataFrame, hops: DataFrame, small: bool) -> DataFrame:
    """Continue each walk ``(…, path, end)`` with the hop that starts at its end.

    Walks tend to end at few tokens, so hops are weighted by how many arrive there.
    """
    onward = hops.select(
        F.col("token").alias("end"), F.col("path").alias("onward"), F.col("end").alias("then")
    )
    if small:
        walked = walks.join(F.broadcast(onward), "end", "left")
    else:
        ends = walks.filter("end is not null").groupBy("end").agg(F.count("*").alias("arrivals"))
        walked = lookup(walks, cut_lineage(onward.join(ends, "end")), ["end"], "arrivals")
    path = F.concat("path", F.coalesce("onward", F.array().cast("array<string>")))
    kept = [c for c in walks.columns if c not in ("path", "end")]
    return walked.select(*kept, path.alias("path"), F.col("then").alias("end"))


def reachable(successors: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """The rows of ``successors`` that walks of ``steps`` tokens from ``starts`` come to, written.

    Breadth first: each round takes the tokens seen for the first time one token further, and
    the rounds end when none is new. A round has one row per new token, so no key is hot in its join,
    and ``FRONTIER_STEPS`` rounds are written together.
    """
    table = F.broadcast(successors) if fits_broadcast(successors) else successors
    new, found = starts.select(F.col("start").alias("prev")).distinct(), None
    for first in range(0, steps, FRONTIER_STEPS):
        edges = None
        for _ in range(first, min(steps, first + FRONTIER_STEPS)):
            taken = new.join(table, "prev")
            edges = taken if edges is None else edges.unionByName(taken)
            new = taken.select(F.col("next").alias("prev")).distinct()
            if found is not None:
                new = new.join(found.select("prev"), "prev", "left_anti")
        edges = cut_lineage(edges.distinct())
        if edges.isEmpty():
            break
        found = edges if found is None else found.unionByName(edges)
        ends = edges.select(F.col("next").alias("prev")).distinct()
        new = cut_lineage(ends.join(found.select("prev"), "prev", "left_anti"))
        if new.isEmpty():
            break
    return successors.limit(0) if found is None else found


def walks(successors: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """Follow ``successors`` for ``steps`` tokens from each distinct start token.

    The next token depends on the last one only, so hops of 1, 2, 4, … tokens are
    built by joining the hop table to itself, and added up to the wanted number:
    a dozen joins rather than one per token. Only tokens that the walks can come to have hops. A walk
    ends early at a token that has no successor, such as the end marker.
    """
    successors = reachable(cut_lineage(successors.select("prev", "next")), starts, steps)
    hops = cut_lineage(
        successors.select(
            F.col("prev").alias("token"), F.array("next").alias("path"), F.col("next").alias("end")
        )
    )
    walked = starts.select("start", F.array().cast("array<string>").alias("path"),
                           F.col("start").alias("end"))
    while steps:
        small = fits_broadcast(hops)
        if steps & 1:
            walked = cut_lineage(_append(walked, hops, small))
        steps >>= 1
        if steps:
            hops = cut_lineage(_append(hops, hops, small))
    return walked.select("start", "path")


def generate_greedy(
    prompts: DataFrame, bigrams: DataFrame, steps: int = 50, policy: str = "suppress_eos"
) -> DataFrame:
    """Add ``generated``, the tokens greedy generation puts after ``tokens``.

    Prompts with the same last token go on in the same way, so each last token is
    walked once and joined back.
    """
    asked = prompts.withColumn("start", F.element_at("tokens", -1))
    starts = asked.groupBy("start").agg(F.count("*").alias("asked"))
    found = cut_lineage(
        walks(best_successor(bigrams, policy), starts, steps).join(starts, "start")
    )
    return lookup(asked, found, ["start"], "asked").select(
        *prompts.columns, F.col("path").alias("generated")
    )


def draw(seed: int, *parts: Column) -> Column:
    """A fixed pseudo-random integer below 2**60 for these values."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sampling_table(bigrams: DataFrame, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables for drawing a successor in proportion to its count.

    The successors of a token split ``[0, total)`` among them, in vocabulary
    order. Each token's range is cut into bins as wide as its mean count, and an
    interval is listed in each bin it touches: at most twice as many rows as there
    are successors. A draw then joins on one bin rather than on all successors.
    """
    coded = encode(bigrams.withColumnRenamed("next", "token"), vocab, -1)
    starts = running_offsets(
        coded.select("prev", "token", F.col("idx").alias("next_idx"), "n"),
        "next_idx", "n", ["prev"], carry=["token"],
    )
    totals = cut_lineage(
        bigrams.groupBy("prev")
        .agg(F.sum("n").alias("total"), F.count("*").alias("successors"))
        .withColumn("width", F.ceil(F.col("total") / F.col("successors")))
    )
    spans = lookup(
        starts, totals.select("prev", "width", "successors"), ["prev"], "successors"
    ).select(
        "prev",
        F.col("token").alias("next"),
        F.col("offset").alias("low"),
        (F.col("offset") + F.col("n")).alias("high"),
        "width",
    )
    bins = F.sequence(
        F.floor(F.col("low") / F.col("width")), F.floor((F.col("high") - 1) / F.col("width"))
    )
    binned = spans.select("prev", F.explode(bins).alias("bin"), "low", "high", "next")
    onward = totals.select(
        F.col("prev").alias("next"), F.col("total").alias("next_total"),
        F.col("width").alias("next_width"), F.col("total").alias("hot"),
    )
    return totals.select("prev", "total", "width"), cut_lineage(
        lookup(binned, onward, ["next"], "hot")
    )


def generate_sampled(
    prompts: DataFrame,
    bigrams: DataFrame,
    vocab: DataFrame,
    samples: int = 2,
    max_tokens: int = 30,
    seed: int = 0,
) -> DataFrame:
    """Several sampled outputs per prompt, each of at most ``max_tokens`` tokens.

    The draw is a hash of prompt, sample and length, so outputs do not change when
    a task is run again. A step is one join on the last token and the drawn bin;
    finished outputs take bins that do not exist. State is written every few steps. A table too large to
    be broadcast is written once in the layout of that join, and only the state moves.
    """
    totals, binned = sampling_table(bigrams, vocab)
    table = F.broadcast(binned) if fits_broadcast(binned) else write_laid_out(binned, "prev", "bin")
    table = table.alias("b")
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long")))
    state = prompts.select(
        "prompt", "tokens", numbers.alias("sample_no"), F.element_at("tokens", -1).alias("prev")
    )
    state = lookup(state, totals.withColumn("hot", F.col("total")), ["prev"], "hot")
    for step in range(1, max_tokens):
        going = F.col("total").isNotNull() & (F.size("tokens") < max_tokens)
        drawn = F.pmod(draw(seed, F.col("prompt"), F.col("sample_no"), F.size("tokens")), "total")
        nowhere = -1 - F.pmod(F.xxhash64("prompt", "sample_no"), F.lit(1 << 20))
        state = state.withColumn("drawn", drawn).withColumn(
            "bin", F.when(going, F.floor(F.col("drawn") / F.col("width"))).otherwise(nowhere)
        )
        hit = (
            (F.col("s.prev") == F.col("b.prev"))
            & (F.col("s.bin") == F.col("b.bin"))
            & (F.col("s.drawn") >= F.col("b.low"))
            & (F.col("s.drawn") < F.col("b.high"))
        )
        moved = F.coalesce(F.col("b.next") != EOS, F.lit(False))
        state = state.alias("s").join(table, hit, "left").select(
            "prompt",
            F.when(moved, F.array_append("tokens", F.col("b.next")))
            .otherwise(F.col("tokens"))
            .alias("tokens"),
            "sample_no",
            F.when(moved, F.col("b.next")).otherwise(F.col("s.prev")).alias("prev"),
            F.when(moved, F.col("b.next_total")).alias("total"),
            F.when(moved, F.col("b.next_width")).alias("width"),
        )
        if step % STEPS_PER_WRITE == 0:
            state = cut_lineage(state)
            if state.filter(F.col("total").isNotNull()).isEmpty():
                break
    return state.select("prompt", "sample_no", "tokens")
