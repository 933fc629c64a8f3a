"""Byte-level BPE by prefix tables, and the way back.

The encoding of every prefix of a byte string ends in one token only, and a token is that
last token exactly if it cannot merge, in the order of ranks, with the last token of what
stands before it. So one table with the last token of each prefix holds the encodings
of all prefixes: an append fills further entries, and an edit needs new entries only until
as many as the longest token has bytes are the same as before.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm.batches import field, list_array, texts, with_python

LATIN = re.compile("[\t-\r -~\xa1-\u017f]*")
"""Texts for which Python's own patterns mean the same as those with Unicode properties."""
MEMO = 1 << 17
"""Pieces whose ids a worker remembers before it starts anew; not a limit on the input."""


def read_ranks(content: bytes) -> dict[bytes, int]:
    """The rank file's lines, a token in base64 and its rank, as a dict."""
    pairs = (line.split() for line in content.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Ranks:
    """Ranked byte tokens, with what may stand beside what."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self.known: dict[int, bool] = {}
        # Every beginning of a token; the steps of the matcher are added as they are needed.
        self.beginnings = {t[:i] for t in ranks for i in range(len(t) + 1)}
        self.states: dict[bytes, tuple[bytes, tuple[tuple[int, int], ...]]] = {}
        self.steps: dict[bytes, tuple[bytes, tuple[tuple[int, int], ...]]] = {}

    def step(self, read: bytes) -> tuple[bytes, tuple[tuple[int, int], ...]]:
        """The matcher's state after ``read``, which is a state and one byte more.

        A state is the longest end of what was read with which a token begins. With it come
        the tokens that end here, as length and token, the longest first.
        """
        state = read
        while state not in self.beginnings:
            state = state[1:]
        if state not in self.states:
            ends = ((len(state) - i, self.ranks.get(state[i:])) for i in range(len(state)))
            self.states[state] = (
                state,
                tuple((n, t) for n, t in ends if t is not None and self.usable(t)),
            )
        if len(self.steps) >= 2 * MEMO:
            self.steps.clear()
        self.steps[read] = self.states[state]
        return self.states[state]

    def _born(self, token: int) -> int:
        """When merging makes this token; single bytes are there from the start."""
        return token if len(self.tokens[token]) > 1 else -1

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None if no merge ever does."""
        if token not in self._halves:
            whole = self.tokens[token]
            found = None
            for cut in range(1, len(whole)):
                left, right = self.ranks.get(whole[:cut]), self.ranks.get(whole[cut:])
                if (
                    left is not None
                    and right is not None
                    and max(self._born(left), self._born(right)) < token
                    and self.usable(left)
                    and self.usable(right)
                    and self.beside(left, right, token)
                ):
                    found = left, right
                    break
            self._halves[token] = found
        return self._halves[token]

    def usable(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self.halves(token) is not None

    def beside(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether the two tokens side by side stay as they are, merges below ``before`` only.

        Goes back through the merges that made both, the latest first. Wherever the two
        pieces at the border could have merged earlier than what really happened next,
        the tokens would not have come about. Of equal ranks the left one merges first.
        """
        key = left << 32 | right
        if before is None and key in self.known:
            return self.known[key]
        limit = float("inf") if before is None else before
        while True:
            rank = self.ranks.get(self.tokens[left] + self.tokens[right])
            if rank is not None and rank < limit:
                fine = False
                break
            made_left, made_right = self._born(left), self._born(right)
            if made_left < 0 and made_right < 0:
                fine = True
                break
            if made_left > made_right:
                limit, left = left, self.halves(left)[1]
            else:
                limit, right = right + 1, self.halves(right)[0]
        if before is None:
            if len(self.known) >= 2 * MEMO:
                self.known.clear()
            self.known[key] = fine
        return fine


class PrefixTable:
    """A byte string with the last token of each of its prefixes."""

    def __init__(self, ranks: Ranks, content: bytes = b""):
        self.ranks = ranks
        self.content = b""
        self.last: list[int] = []
        self.append(content)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; nothing of the table before them changes."""
        start = len(self.content)
        self.content += more
        for _ in self._filled(start):
            pass

    def _filled(self, filled: int) -> Iterator[int]:
        """Fill the entries after ``filled``, giving the end of each prefix that has one."""
        content, last, ranks = self.content, self.last, self.ranks
        known, push, steps = ranks.known, last.append, ranks.steps
        state = b""
        for end in range(max(0, filled - ranks.longest), len(content)):
            read = state + content[end : end + 1]
            state, ending = steps.get(read) or ranks.step(read)
            if end < filled:
                continue
            for length, token in ending:
                start = end + 1 - length
                if not start:
                    break
                before = last[start - 1]
                fine = known.get(before << 32 | token)
                if fine is None:
                    fine = ranks.beside(before, token)
                if fine:
                    break
            else:
                raise ValueError(f"no token for byte {content[end]}")
            push(token)
            yield end + 1

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace bytes ``start:stop``; gives how many entries had to be computed."""
        old = self.last[stop:]
        self.content = self.content[:start] + new + self.content[stop:]
        del self.last[start:]
        computed, alike, after = 0, 0, start + len(new)
        for end in self._filled(start):
            computed += 1
            if end > after:
                alike = alike + 1 if self.last[-1] == old[end - after - 1] else 0
                if alike >= self.ranks.longest:
                    self.last.extend(old[end - after :])
                    break
        return computed

    def ids(self) -> list[int]:
        """The encoding, read from the end."""
        found, end = [], len(self.last)
        while end:
            found.append(self.last[end - 1])
            end -= len(self.ranks.tokens[found[-1]])
        return found[::-1]


def of_category(kind: str) -> str:
    """The characters up to Latin letters whose category begins with ``kind``."""
    return "".join(c for c in map(chr, range(0x30, 0x250)) if unicodedata.category(c)[0] == kind)


def plain_pattern(pattern: str) -> re.Pattern | None:
    """The pattern with ``\\p{L}`` and ``\\p{N}`` spelled out for Latin texts; None if it has others.

    Python's own matcher is several times as fast as the one that knows Unicode properties.
    """
    out, inside = [], False
    for part in re.findall(r"\\p\{[LN]\}|\\.|.", pattern, re.S):
        if part in (r"\p{L}", r"\p{N}"):
            letters = of_category(part[3])
            part = letters if inside else f"[{letters}]"
        elif part in (r"\p", r"\P", r"\X"):
            return None
        elif part in "[]":
            inside = part == "["
        out.append(part)
    return re.compile("".join(out))


class Encoder:
    """Texts to ids: each match of ``pattern`` by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = Ranks(ranks)
        self.pattern = regex.compile(pattern)
        self.plain = plain_pattern(pattern)
        self.pieces = Memo(self._piece)

    def piece(self, piece: bytes) -> list[int]:
        known = self.ranks.ranks.get(piece)
        return [known] if known is not None else PrefixTable(self.ranks, piece).ids()

    def _piece(self, piece: str) -> bytes:
        return array("i", self.piece(piece.encode())).tobytes()

    def packed(self, text: str) -> bytes:
        """The ids as 32-bit integers."""
        pattern = self.plain if self.plain and LATIN.fullmatch(text) else self.pattern
        return b"".join(map(self.pieces.__getitem__, pattern.findall(text)))

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()


class Memo(dict):
    """Remembers what ``make`` gave for short keys; when full, only those used of late."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        made = self.older.get(key)
        if made is None:
            made = self.make(key)
        if len(key) <= 64:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[key] = made
        return made


class EncodedText:
    """A text with its pieces and ids, kept right under appends and edits.

    ``reach`` says how many characters beyond its end a match of the pattern may look at.
    """

    def __init__(self, encoder: Encoder, text: str = "", reach: int = 2):
        self.encoder, self.reach = encoder, reach
        self.text = ""
        self.ends: list[int] = []
        self.pieces: list[list[int]] = []
        self.edit(0, 0, text)

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, stop: int, new: str) -> int:
        """Replace characters ``start:stop``; gives how many pieces were encoded anew."""
        first = next((i for i, e in enumerate(self.ends) if e + self.reach > start), len(self.ends))
        begin = self.ends[first - 1] if first else 0
        old = list(zip(self.ends[first:], self.pieces[first:], strict=True))
        self.text = self.text[:start] + new + self.text[stop:]
        shift, after = len(new) - (stop - start), start + len(new)
        old_at = {end + shift: i for i, (end, _) in enumerate(old)}
        del self.ends[first:], self.pieces[first:]
        encoded = 0
        for match in self.encoder.pattern.finditer(self.text, begin):
            self.ends.append(match.end())
            self.pieces.append(self.encoder.piece(match.group().encode()))
            encoded += 1
            if match.end() >= after and match.end() in old_at:
                for end, piece in islice(old, old_at[match.end()] + 1, None):
                    self.ends.append(end + shift)
                    self.pieces.append(piece)
                break
        return encoded

    def ids(self) -> list[int]:
        return [i for piece in self.pieces for i in piece]


_WORKER: dict = {}


def _encoder(ranks: bytes, pattern: str) -> Encoder:
    """One encoder per worker process, with what it has remembered."""
    key = hash(ranks), pattern
    if _WORKER.get("key") != key:
        _WORKER.update(key=key, encoder=Encoder(read_ranks(ranks), pattern))
    return _WORKER["encoder"]


def encode(df: DataFrame, text: str, ranks: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Add the column ``ids`` (array of int) with the tokens of the whole text.

    ``ranks`` is the path of a rank file, read here and sent to the tasks (its size does
    not depend on the data). Null and empty texts have no ids; an input column named like
    ``ids`` is replaced; repeated rows stay repeated.
    """
    with open(ranks, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())

    def setup():
        encoder = _encoder(shared.value, pattern)

        def make(column):
            packed = [encoder.packed(t) for t in texts(column)]
            flat = np.frombuffer(b"".join(packed), "<i4")
            return [list_array(flat, [len(p) // 4 for p in packed])]

        return make

    added = T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return with_python(df, [field(text)], added, setup)


def decode(df: DataFrame, ids: str, ranks: str, content: str = "content") -> DataFrame:
    """Add the column ``content`` (binary) with the bytes that the ids stand for.

    Null and empty lists give no bytes; null entries are skipped; an id without a token is
    an error, as there is no byte string for it.
    """
    with open(ranks, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())

    def setup():
        table = read_ranks(shared.value)
        lengths = np.full(max(table.values(), default=0) + 1, -1, np.int64)
        for token, rank in table.items():
            lengths[rank] = len(token)
        starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
        ordered = sorted(table.items(), key=lambda pair: pair[1])
        letters = np.frombuffer(b"".join(token for token, _ in ordered), np.uint8)

        def make(column):
            flat = column.flatten()
            counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
            values = np.asarray(pa.compute.fill_null(flat, -1))
            owner = np.repeat(np.arange(len(counts)), counts)
            known = values >= 0
            values, owner = values[known], owner[known]
            if len(values) and (values.max() >= len(lengths) or lengths[values].min() < 0):
                raise ValueError("an id has no token")
            sizes = lengths[values]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            at = np.repeat(starts[values] - (ends - sizes), sizes) + np.arange(total)
            per_row = np.bincount(owner, sizes, len(counts)).astype(np.int64)
            offsets = np.zeros(len(counts) + 1, np.int64)
            np.cumsum(per_row, out=offsets[1:])
            made = pa.Array.from_buffers(
                pa.binary(),
                len(counts),
                [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(letters[at])],
            )
            return [made]

        return make

    added = T.StructType([T.StructField(content, T.BinaryType())])
    return with_python(df, [field(ids)], added, setup)
