"""Rolling hashes and window minima over numpy arrays, all modulo 2**64."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def rolling(values: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of every run of ``k`` values: a polynomial in an odd ``base``, built by doubling."""
    out, length, power = None, 0, np.array(base, _U)
    run, n = values, 1
    with np.errstate(over="ignore"):
        while True:
            if k & n:
                if out is None:
                    out, length = run, n
                else:
                    m = len(values) - (length + n) + 1
                    out, length = out[:max(0, m)] * power + run[length:length + max(0, m)], length + n
            if n * 2 > k:
                break
            m = len(values) - 2 * n + 1
            run = run[:max(0, m)] * power + run[n:n + max(0, m)]
            power, n = power * power, n * 2
    return out[:max(0, len(values) - k + 1)]


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Least of every ``w`` neighbouring values."""
    cur, n = values, 1
    while n * 2 <= w:
        cur, n = np.minimum(cur[:len(cur) - n], cur[n:]), n * 2
    return np.minimum(cur[:len(cur) - (w - n)], cur[w - n:]) if n < w and len(cur) > w - n else cur[:max(0, len(values) - w + 1)]


def table(seed: int) -> np.ndarray:
    """256 fixed random 64-bit values, one a byte."""
    return np.random.default_rng(seed).integers(1, 2**64, 256, dtype=np.uint64)


#: Windows hashed at a time, so that all steps stay in the processor's cache.
_BLOCK = 1 << 15


def key_runs(codes: np.ndarray, bounds: np.ndarray, window: int, k: int, lookup: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``window`` codes that lie in one document (``bounds``: where each begins, and the end of the last), as
    runs of neighbours with one key: (start, count, key, document).

    A window's key is the least hash of its ``k``-shingles. Equal windows have equal keys, and a text has far fewer
    runs than windows. ``lookup`` maps codes to 64-bit values.
    """
    n = len(codes) - window + 1
    stop = np.maximum(bounds[:-1], bounds[1:] - window + 1)             # after the last window of each document
    begins = bounds[:-1][stop > bounds[:-1]]
    if n <= 0 or not len(begins):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, _U), none
    new, inside = np.zeros(n, bool), np.zeros(n + 1, np.int8)
    new[begins] = True
    inside[begins] += 1
    inside[stop[stop > bounds[:-1]]] -= 1
    inside = np.cumsum(inside[:n], dtype=np.int8).astype(bool)
    starts, keys = [], []
    for a in range(0, n, _BLOCK):
        part = codes[a:min(n, a + _BLOCK) + window - 1]
        key = window_min(mix(rolling(part if lookup is None else lookup[part], k, 0x9E3779B97F4A7C15)), window - k + 1)
        first = new[a:a + len(key)]
        first[0] = True
        first[1:] |= key[1:] != key[:-1]
        at = np.flatnonzero(first & inside[a:a + len(key)])
        starts.append(at + a)
        keys.append(key[at])
    start, key = np.concatenate(starts), np.concatenate(keys)
    edges = np.searchsorted(start, bounds)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(edges))
    fresh = np.ones(len(start), bool)                                   # a block's first window may go on with the last run
    fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    start, key, owner = start[fresh], key[fresh], owner[fresh]
    count = np.minimum(np.append(start[1:], n), stop[owner]) - start
    return start, count, mix(key + _U(1)) & ~_U(1), owner


def spread(counts: np.ndarray) -> np.ndarray:
    """0 to count - 1 for each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values if len(table) else np.zeros(len(values), bool)


def cut_points(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` shards, equal ranges of 64 bits, begins in sorted keys."""
    edges = np.array([(i << 64) // n for i in range(n)], dtype=np.uint64)
    return np.concatenate((np.searchsorted(sorted_keys, edges), [len(sorted_keys)]))
