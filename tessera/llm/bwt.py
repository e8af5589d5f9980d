"""Common prefixes of a text by breadth-first backward extension on its Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

#: Suffixes are ordered by this many symbols; intervals of strings up to one shorter are then exact.
ORDERED = 64


def order_suffixes(text: np.ndarray, depth: int = ORDERED) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols (0 to 255), ties in any order: packing eight, then doubling."""
    n = len(text)
    padded = np.concatenate((text.astype(np.uint64), np.zeros(8, np.uint64)))
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key |= padded[j:j + n] << np.uint64(56 - 8 * j)
    step = 8
    while True:
        order = np.argsort(key)
        if step >= depth:
            return order
        new = np.ones(n, np.uint64)
        ranked = key[order]
        new[1:] = ranked[1:] != ranked[:-1]
        ranks = np.cumsum(new)
        if n and ranks[-1] == n:
            return order
        rank = np.zeros(n + step, np.uint64)
        rank[order] = ranks
        key = rank[:n] << np.uint64(32) | rank[step:]
        step *= 2


def prefix_classes(text: np.ndarray, length: int) -> np.ndarray:
    """For each position a class: two that start ``length`` symbols without a 0 share it exactly if these are equal.

    ``text`` holds symbols below 256; 0 separates strings and ends the text. A right boundary of an interval of
    suffixes is the end of those that begin with one string. Starting from single symbols, every interval is
    extended backwards by each symbol before its rows; a child whose right boundary is new has found the common
    prefix there, one shorter than the child's string, and is extended in turn. Levels rise by one, so prefixes
    are derived by increasing value; the search stops at ``length``, and what has no boundary then agrees so far.
    """
    if not 0 < length < ORDERED:
        raise ValueError(f"length must be between 1 and {ORDERED - 1}")
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    order = order_suffixes(text)
    before = text[order - 1].astype(np.uint8)                           # the transform
    by_symbol = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)                                        # a row's place once its symbol is put in front
    step[by_symbol] = np.arange(n)
    counts = np.bincount(before, minlength=256)
    ends = np.cumsum(counts)
    inside = np.ones(n, bool)
    inside[ends[:-1][ends[:-1] < n]] = False
    inside[0] = False
    same = by_symbol[1:][inside[1:]], by_symbol[:-1][inside[1:]]
    last_same, next_same = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    last_same[same[0]], next_same[same[1]] = same[1], same[0]
    del by_symbol, same
    cut = np.zeros(n + 1, bool)
    cut[[0, n]] = True
    present = np.flatnonzero(counts)
    low, high = (ends - counts)[present], ends[present]
    new = ~cut[high]
    low, high = low[new], high[new]
    cut[high] = True
    for _ in range(length - 1):
        if not len(low):
            break
        size = high - low
        rows = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
        live = before[rows] > 0                                         # strings do not begin with a separator
        rows, lows, highs = rows[live], np.repeat(low, size)[live], np.repeat(high, size)[live]
        # children of one level are disjoint, so sorted starts and sorted ends belong together
        low = np.sort(step[rows[last_same[rows] < lows]])
        high = np.sort(step[rows[next_same[rows] >= highs]]) + 1
        new = ~cut[high]
        low, high = low[new], high[new]
        cut[high] = True
    classes = np.empty(n, np.int64)
    classes[order] = np.cumsum(cut[:n]) - 1
    return classes
