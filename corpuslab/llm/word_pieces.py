"""Numbers of word pieces by greedy longest match, in one pass over each word.

The vocabulary is a trie, one root for pieces that begin a word and one for those that go on.
When a state cannot go on with a letter, its failure link names the state for what is left
after the longest pieces are taken off, and how many were taken was counted beforehand. So
each letter is read once, and no piece is ever built.
"""

from __future__ import annotations

import pickle
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm.batches import field, utf8, with_python

MEMO = 1 << 17
"""Words whose counts a worker remembers before it starts anew; not a limit on the input."""


class Automaton:
    """Counts pieces of words over an alphabet of bytes.

    An empty piece among the first ones stands for what is only put before a word.
    """

    def __init__(self, first: list[bytes], further: list[bytes]):
        # States: 0 begins a word, 1 goes on with it.
        self.next: list[dict[int, int]] = [{}, {}]
        ends = set()
        for root, pieces in ((0, first), (1, further)):
            for piece in pieces:
                state = root
                for byte in piece:
                    if byte not in self.next[state]:
                        self.next[state][byte] = len(self.next)
                        self.next.append({})
                    state = self.next[state][byte]
                if piece:
                    ends.add(state)
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        if b"" in first:
            # Where no longer piece begins a word, the empty one does, and all letters go on with it.
            self.fail[0], self.popped[0] = 1, 1
        queue = deque([0, 1])
        while queue:
            state = queue.popleft()
            for byte, child in self.next[state].items():
                if child in ends:
                    self.fail[child], self.popped[child] = 1, 1
                else:
                    back, taken = self.fail[state], self.popped[state]
                    while back >= 0 and byte not in self.next[back]:
                        taken += self.popped[back]
                        back = self.fail[back]
                    if back >= 0:
                        self.fail[child], self.popped[child] = self.next[back][byte], taken
                queue.append(child)

    def count(self, word: bytes) -> int:
        """The number of pieces; 0 for an empty word, -1 if the word cannot be cut."""
        state = pieces = 0
        for byte in word:
            while byte not in self.next[state]:
                pieces += self.popped[state]
                state = self.fail[state]
                if state < 0:
                    return -1
            state = self.next[state][byte]
        if not word:
            return 0
        while state != 1:
            pieces += self.popped[state]
            state = self.fail[state]
            if state < 0:
                return -1
        return pieces


def vocabulary(tokens) -> tuple[list[bytes], list[bytes]]:
    """Pieces from byte-level tokens: those with a space in front begin a word, those without
    any white space go on with it. Tokens that hold white space elsewhere are no pieces. The lone space
    is the empty first piece: words that no other piece begins, as in scripts it lacks, are cut after it."""
    first = [t[1:] for t in tokens if t == b" " or t[:1] == b" " and t[1:].split() == [t[1:]]]
    further = [t for t in tokens if t.split() == [t]]
    return first, further


_WORKER: dict = {}


def count_pieces(
    df: DataFrame, text: str, first: list[bytes], further: list[bytes], unknown: int = 1
) -> DataFrame:
    """Add ``n_words`` and ``n_pieces`` (long) of the whole text.

    Words are runs without ASCII white space. A word that cannot be cut into pieces counts as
    ``unknown`` pieces. Null and empty texts have no words. Input columns of these names
    are replaced. The vocabulary does not grow with the data and is sent to every task.
    """
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps((first, further)))

    def setup():
        key = hash(shared.value)
        if _WORKER.get("key") != key:
            _WORKER.update(key=key, memo=_Counts(Automaton(*pickle.loads(shared.value)), unknown))
        memo = _WORKER["memo"]

        def make(column):
            split = [t.split() for t in utf8(column)]
            return [
                pa.array([len(words) for words in split], pa.int64()),
                pa.array([sum(map(memo.__getitem__, words)) for words in split], pa.int64()),
            ]

        return make

    long = T.LongType()
    added = T.StructType([T.StructField("n_words", long), T.StructField("n_pieces", long)])
    return with_python(df, [field(text)], added, setup)


class _Counts(dict):
    def __init__(self, automaton: Automaton, unknown: int):
        super().__init__()
        self.automaton, self.unknown, self.older = automaton, unknown, {}

    def __missing__(self, word: bytes) -> int:
        count = self.older.get(word)
        if count is None:
            count = self.automaton.count(word)
            count = self.unknown if count < 0 else count
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[word] = count
        return count
