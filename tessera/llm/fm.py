"""FM-index over integer symbols: wavelet-matrix ranks, backward search, location by sampled suffix positions.

All steps are numpy array operations over many patterns or rows at once; an
index lives in one task and covers one training shard.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative symbols by prefix doubling; an ended suffix sorts first."""
    n = len(text)
    rank, step = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1, 1
    while True:
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        ranks = np.cumsum(new)
        if not n or ranks[-1] == n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = ranks
        step *= 2


class WaveletMatrix:
    """Rank and access over integers below ``2 ** bits``; level k holds bit ``bits - 1 - k`` and counts of ones before each place."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        cur = symbols.astype(np.int64)
        for level in range(bits - 1, -1, -1):
            bit = (cur >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            cur = np.concatenate((cur[bit == 0], cur[bit == 1]))

    def walk(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where ``place`` gets to if it follows ``symbol`` through the levels."""
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            up = ones[place].astype(np.int64)
            place = np.where((symbol >> (self.bits - 1 - level)) & 1, zeros + up, place - up)
        return place

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at place, where it gets to)."""
        symbol = np.zeros(len(place), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            up = ones[place].astype(np.int64)
            bit = ones[place + 1] - up
            symbol = symbol * 2 + bit
            place = np.where(bit == 1, zeros + up, place - up)
        return symbol, place


class FMIndex:
    """Index of a text of symbols 0 to ``alphabet - 1``; every ``sample``-th suffix position is stored."""

    def __init__(self, text: np.ndarray, alphabet: int, sample: int = 8):
        text = np.concatenate((text.astype(np.int64) + 1, [0]))         # 0 ends the text
        self.n = len(text)
        order = suffix_order(text)
        self.tree = WaveletMatrix(text[order - 1], max(1, int(alphabet).bit_length()))
        counts = np.bincount(text, minlength=alphabet + 1)
        self.before = np.concatenate(([0], np.cumsum(counts)))[:alphabet + 1]
        symbols = np.arange(alphabet + 1)
        self.base = self.tree.walk(symbols, np.zeros(alphabet + 1, np.int64))
        marked = order % sample == 0
        self.marks = np.concatenate(([0], np.cumsum(marked))).astype(np.int32)
        self.stored = order[marked]

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before each place."""
        return self.tree.walk(symbol, place) - self.base[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of patterns (one a row, the first ``lengths`` symbols of each), by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > step) & (high > low))
            if not len(live):
                break
            c = patterns[live, lengths[live] - 1 - step].astype(np.int64) + 1
            low[live] = self.before[c] + self.rank(c, low[live])
            high[live] = self.before[c] + self.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: each steps back through the transform until a stored position."""
        out, steps, todo, at = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.astype(np.int64)
        while len(todo):
            here = self.marks[at + 1] > self.marks[at]
            out[todo[here]] = self.stored[self.marks[at[here]]] + steps
            todo, at = todo[~here], at[~here]
            symbol, place = self.tree.access(at)
            at = self.before[symbol] + place - self.base[symbol]
            steps += 1
        return out
