"""Which byte-pair merges follow from one look at the counts, exactly."""

from __future__ import annotations

import heapq
from collections import defaultdict


class MergeRound:
    """Takes leading merges until a count that decides is no longer known.

    ``counts`` holds the leading pairs, by count and then by order of the pair; all other pairs
    come after them. ``triples`` holds how often a leading pair is followed by a symbol with which
    its last symbol makes a leading pair, too; what is not in it does not occur. A pair and a
    triple are strings of one character per symbol, and a new symbol's character is the greatest.

    Merging ``AB`` takes ``xAB`` from the count of ``xA`` and gives it to the pair of ``x`` and the
    new symbol; ``ABy`` likewise. That is exact as long as no earlier merge of the round ends in
    ``x`` or begins with ``B``. Else both counts are only bounded from above, and
    the round ends when a bounded pair comes first. A pair that is not among the leading ones gives
    new pairs no more frequent than itself, which come after it, too.
    """

    def __init__(self, counts: dict[str, int], triples: dict[str, int]):
        self.most = dict(counts)
        self.triples = triples
        self.bounded: set[str] = set()
        self.begins, self.ends = defaultdict(set), defaultdict(set)
        for pair in counts:
            self.begins[pair[0]].add(pair)
            self.ends[pair[1]].add(pair)
        self.heap = [(-count, pair) for pair, count in counts.items()]
        heapq.heapify(self.heap)
        self.firsts: set[str] = set()
        self.lasts: set[str] = set()
        self.new: set[str] = set()

    def best(self) -> tuple[str, int] | None:
        """The next merge and its count, or None if it cannot be told."""
        while self.heap:
            count, pair = self.heap[0]
            if self.most.get(pair) == -count:
                return None if pair in self.bounded else (pair, -count)
            heapq.heappop(self.heap)
        return None

    def merge(self, pair: str, sign: str) -> None:
        """Replace ``pair``, of two different symbols, by the new symbol ``sign``."""
        first, last = pair
        count = self._drop(pair)
        for other in list(self.ends[first]):
            left = other[0]
            known = left not in self.lasts and last not in self.firsts and left != last
            self._move(other, left + pair, left + sign, known, count)
        for other in list(self.begins[last]):
            right = other[1]
            known = first not in self.lasts and right not in self.firsts and right != first
            self._move(other, pair + right, sign + right, known, count)
        if last + first in self.most:
            self._set(sign + sign, min(self.most[last + first], count), False)
        self.firsts.add(first)
        self.lasts.add(last)
        self.new.add(sign)

    def _move(self, old: str, triple: str, made: str, known: bool, count: int) -> None:
        most = min(self.most[old], count)
        if self.new & set(triple):
            known = False
        else:
            most = min(most, self.triples.get(triple, 0))
        if most == 0:
            return
        if known and most <= self.most[old]:
            exact = old not in self.bounded
            self._set(old, self.most[old] - most, exact)
        else:
            self._set(old, self.most[old], False)
        self._set(made, most, known)

    def _set(self, pair: str, most: int, exact: bool) -> None:
        if not exact:
            self.bounded.add(pair)
        if self.most.get(pair) != most:
            self.most[pair] = most
            self.begins[pair[0]].add(pair)
            self.ends[pair[1]].add(pair)
            heapq.heappush(self.heap, (-most, pair))

    def _drop(self, pair: str) -> int:
        self.begins[pair[0]].discard(pair)
        self.ends[pair[1]].discard(pair)
        return self.most.pop(pair)


class RunMerges:
    """Takes leading merges from the parts of words that hold all places of the leading pairs.

    ``runs`` holds, with their counts, the longest parts in which all neighbours are leading pairs. A pair that
    is not among these, by count and then by order of the pair, occurs only where a run ends; what merges make of
    it is no more frequent and has a greater character, so it comes after the last leading pair, too. All
    counts up to that one are therefore exact, however many merges are taken, as long as no merge
    makes a string that there was before.
    """

    def __init__(self, runs: dict[str, int]):
        self.runs, self.freqs = list(runs), list(runs.values())
        self.counts: dict[str, int] = defaultdict(int)
        self.places: dict[str, set[int]] = defaultdict(set)
        for number, (run, freq) in enumerate(runs.items()):
            for pair in map(str.__add__, run, run[1:]):
                self.counts[pair] += freq
                self.places[pair].add(number)
        self.heap = [(-count, pair) for pair, count in self.counts.items()]
        heapq.heapify(self.heap)

    def best(self) -> tuple[str, int] | None:
        """The most frequent pair that is left, the first one of equals, and its count."""
        while self.heap:
            count, pair = self.heap[0]
            if count and self.counts.get(pair) == -count:
                return pair, -count
            heapq.heappop(self.heap)
        return None

    def merge(self, pair: str, sign: str) -> None:
        """Replace ``pair`` by the new symbol ``sign``, from the left of each run."""
        changed: dict[str, int] = defaultdict(int)
        for number in self.places.pop(pair):
            run, freq = self.runs[number], self.freqs[number]
            if pair not in run:
                continue
            merged = self.runs[number] = run.replace(pair, sign)
            for old in map(str.__add__, run, run[1:]):
                changed[old] -= freq
            for new in map(str.__add__, merged, merged[1:]):
                changed[new] += freq
                self.places[new].add(number)
        for other, change in changed.items():
            if change:
                self.counts[other] += change
                heapq.heappush(self.heap, (-self.counts[other], other))
        self.counts.pop(pair, None)
