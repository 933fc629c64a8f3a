"""Edit distances of one text to blocks of texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WORD = 64  # bits per machine word

_ONE = np.uint64(1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


@dataclass
class Block:
    """Texts of similar length, as columns of symbol numbers in an alphabet."""

    rows: np.ndarray  # where the texts were, longest text first
    sizes: np.ndarray
    cells: np.ndarray
    counts: np.ndarray  # per text, how often it has each symbol


def make_block(texts: list[str], rows: np.ndarray, alphabet: np.ndarray) -> Block:
    """``rows`` picks the texts, longest first; characters not in the alphabet are alike."""
    sizes = np.array([len(texts[r]) for r in rows])
    codes = code_points("".join(texts[r] for r in rows))
    columns = np.repeat(np.arange(len(rows)), sizes)
    places = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.searchsorted(alphabet, codes).clip(max=len(alphabet) - 1)
    symbols = np.where(alphabet[at] == codes, at, len(alphabet))
    cells = np.full((sizes[0], len(rows)), len(alphabet), dtype=np.int32)
    cells[places, columns] = symbols
    width = len(alphabet) + 1
    counts = np.bincount(columns * width + symbols, minlength=len(rows) * width)
    return Block(rows, sizes, cells, counts.reshape(len(rows), width).astype(np.int32))


@dataclass
class Pattern:
    """A text prepared for comparing: where it has which symbol, as bits."""

    size: int
    masks: np.ndarray
    counts: np.ndarray


def make_pattern(text: str, alphabet: np.ndarray) -> Pattern:
    symbols = np.searchsorted(alphabet, code_points(text))
    places = np.arange(len(symbols))
    masks = np.zeros((max(1, -(-len(symbols) // WORD)), len(alphabet) + 1), dtype=np.uint64)
    # every place has a bit of its own, so adding is setting
    np.add.at(masks, (places // WORD, symbols), _ONE << (places % WORD).astype(np.uint64))
    counts = np.bincount(symbols, minlength=len(alphabet) + 1).astype(np.int32)
    return Pattern(len(symbols), masks, counts)


def lower_bounds(pattern: Pattern, block: Block) -> np.ndarray:
    """Per text of the block, the characters of either text that have no partner."""
    extra = pattern.counts - block.counts
    missing = extra.clip(min=0).sum(axis=1)
    return np.maximum(missing, block.sizes - pattern.size + missing)


def joined(parts: list[tuple[Block, np.ndarray]]) -> Block:
    """The texts of some blocks at the places picked in each, as one block, longest text first."""
    sizes = np.concatenate([b.sizes[keep] for b, keep in parts])
    order = np.argsort(-sizes, kind="stable")
    column = np.empty(len(order), dtype=np.int64)
    column[order] = np.arange(len(order))
    cells = np.zeros((sizes.max(initial=0), len(order)), dtype=np.intp)
    start = 0
    for b, keep in parts:
        height = b.sizes[keep].max(initial=0)
        cells[:height, column[start : start + len(keep)]] = b.cells[:height, keep]
        start += len(keep)
    rows = np.concatenate([b.rows[keep] for b, keep in parts])
    counts = np.concatenate([b.counts[keep] for b, keep in parts])
    return Block(rows[order], sizes[order], cells, counts[order])


def distances(pattern: Pattern, block: Block, keep: np.ndarray | None = None) -> np.ndarray:
    """Edit distances, in characters, to the texts of a block, or to those at the places ``keep``.

    One character of all texts is handled per step, a column of the distance matrix
    being kept as bits of vertical differences (Myers 1999, Hyyrö 2003). Texts come
    longest first, so finished ones drop off the end; the differences that a text ends with add up to
    its distance. All steps write to the same arrays, as making new ones costs more than the steps.
    """
    sizes = block.sizes if keep is None else block.sizes[keep]
    if pattern.size == 0 or not len(sizes):
        return sizes
    cells = block.cells if keep is None else block.cells[:, keep]
    cells = cells.astype(np.intp, copy=False)
    words, width = len(pattern.masks), len(sizes)
    plus = np.full((words, width), ~np.uint64(0))
    minus = np.zeros((words, width), dtype=np.uint64)
    scratch = np.empty((5, width), dtype=np.uint64)
    carried = np.empty((4, width), dtype=np.uint64)
    top = np.uint64(WORD - 1)
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right").tolist()
    for step, n in enumerate(active):
        at = cells[step, :n]
        equal, vertical, horizontal, up, down = scratch[:, :n]
        above, below, next_above, next_below = carried[:, :n]
        for w in range(words):
            p, m = plus[w, :n], minus[w, :n]
            np.take(pattern.masks[w], at, out=equal, mode="clip")
            np.bitwise_or(equal, m, out=vertical)
            if w:
                np.bitwise_or(equal, below, out=equal)
            np.bitwise_and(equal, p, out=horizontal)
            np.add(horizontal, p, out=horizontal)
            np.bitwise_xor(horizontal, p, out=horizontal)
            np.bitwise_or(horizontal, equal, out=horizontal)
            np.bitwise_or(horizontal, p, out=up)
            np.invert(up, out=up)
            np.bitwise_or(up, m, out=up)
            np.bitwise_and(p, horizontal, out=down)
            if w < words - 1:  # the top bits go on to the next word
                np.right_shift(up, top, out=next_above)
                np.right_shift(down, top, out=next_below)
            np.left_shift(up, _ONE, out=up)
            np.bitwise_or(up, above if w else _ONE, out=up)
            np.left_shift(down, _ONE, out=down)
            if w:
                np.bitwise_or(down, below, out=down)
            np.bitwise_and(up, vertical, out=m)
            np.bitwise_or(up, vertical, out=up)
            np.invert(up, out=up)
            np.bitwise_or(up, down, out=p)
            above, next_above = next_above, above
            below, next_below = next_below, below
    score = sizes.astype(np.int64)
    for w in range(words):
        rest = pattern.size - w * WORD
        valid = ~np.uint64(0) if rest >= WORD else (_ONE << np.uint64(rest)) - _ONE
        score += np.bitwise_count(plus[w] & valid)
        score -= np.bitwise_count(minus[w] & valid)
    return score
