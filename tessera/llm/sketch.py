"""Which window keys recur between documents: count-min sketches of the chunks, merged cell by cell.

Each chunk counts the documents of its keys in a count-min sketch of ``DEPTH`` rows. A sketch is as wide as the corpus
needs and mostly zero, so a chunk sends only the cells that it has counted in. Shards, each a range of cells, add the sketches of all chunks up and
answer every chunk with a bit for each of its cells: two documents or more. A key is estimated repeated if its cells of all
rows are. An estimate is never below the true count, so no repeated window is lost; what is estimated repeated by
chance is sorted out by the exact pass that follows. Counters stop at two, which is all that the estimate asks.

A counter may also tell what its keys weigh in the chunk, in levels rounded up. Shards add these too and answer with a second bit
a cell, set where the sum is over a limit; so all chunks agree on the keys that would be too much for one shard, and none that is over the limit is missed.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.common import planes, unplanes
from tessera.llm.hashes import among, cut_points, mix

_U = np.uint64
#: Rows of a sketch, and cells of a row for each byte of text (a key stands for some twenty windows, so for far more than a byte).
DEPTH, CELLS_PER_BYTE = 2, 1
#: The lowest bit of a counter tells one document from several, the next five are the level of its weight, the one above its row; its
#: cell stands in the highest.
_LEVEL, _ROW = 1, 6
_LOW = _U((1 << _ROW) - 1)
#: Weight that a level stands for, at most: half powers of two, so sums are less than half too large. The last one also stands for more.
LEVELS = np.ceil(128 * 2 ** (np.arange(32) / 2)).astype(np.int32)


def cell_bits(n_bytes: int) -> int:
    """Bits of a cell's number in sketches for ``n_bytes`` of text; a wrong guess costs time in the exact pass, never a window."""
    return min(48, max(10, int(CELLS_PER_BYTE * max(n_bytes, 1) - 1).bit_length()))


def _cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(keys + _U(row * 0x9E3779B9)) >> _U(64 - bits) << _U(64 - bits)) | _U(row << _ROW)


def _added(cells: np.ndarray, *amounts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct cells and the sums of their amounts."""
    order = np.argsort(cells)
    cells = cells[order]
    at = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])[:len(cells)])
    return cells[at], *(np.add.reduceat(a[order], at, dtype=np.int64) if len(at) else a[:0] for a in amounts)


def sketch(owner: np.ndarray, keys: np.ndarray, bits: int, weight: np.ndarray | None = None) -> np.ndarray:
    """A chunk's sketch: its counters that are not zero, in order of their cells; the lowest bit tells one document from several, the next
    ones give the level of the sum of ``weight``, where there is one."""
    if not len(keys):
        return keys
    order = np.argsort(keys)
    keys, owner = keys[order], owner[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    several = np.maximum.reduceat(owner, at) != np.minimum.reduceat(owner, at)
    keys, amounts = keys[at], [1 + several]
    if weight is not None:
        amounts.append(np.add.reduceat(weight[order], at))
    cells, counts, *sums = _added(np.concatenate([_cells(keys, row, bits) for row in range(DEPTH)]), *(np.tile(a, DEPTH) for a in amounts))
    for x in sums:
        cells = cells | np.minimum(np.searchsorted(LEVELS, x), len(LEVELS) - 1).astype(_U) << _U(_LEVEL)
    return cells | (counts > 1).astype(_U)


def send(counters: np.ndarray, n: int):
    """(shard, blob) of a chunk's counters."""
    cuts = cut_points(counters, n)
    for s in range(n):
        if cuts[s + 1] > cuts[s]:
            yield s, planes(counters[cuts[s]:cuts[s + 1]])


def merge(blobs: list[bytes], limit: int | None = None) -> list[bytes]:
    """A shard's answer: for each chunk a bit a counter it sent, set if the sum over all chunks is two documents or more. With a
    ``limit`` as many bits follow, set if the sum of weights is over it; if no cell's is, none do."""
    sent = [unplanes(b) for b in blobs]
    every = np.concatenate(sent)
    counts = 1 + (every & _U(1)).astype(np.uint8)
    if limit is None:
        cells, counts = _added(every & ~_LOW, counts)
        found = [cells[counts > 1]]
    else:
        cells, counts, weights = _added(every & ~_LOW, counts, LEVELS[((every & _LOW) >> _U(_LEVEL)).astype(np.uint8)])
        found = [cells[counts > 1], cells[weights > limit]]
    found = found[:1] + [x for x in found[1:] if len(x)]
    return [b"".join(np.packbits(among(c & ~_LOW, x)).tobytes() for x in found) for c in sent]


def _told(keys: np.ndarray, counters: np.ndarray, bits: int, n: int, answers: dict[int, bytes], part: int) -> np.ndarray:
    """For which of the chunk's keys the answers' bits of one part are set in the cells of all rows."""
    cuts, told = cut_points(counters, n), []
    for s in range(n):
        own = counters[cuts[s]:cuts[s + 1]]
        size = -(-len(own) // 8)
        got = np.frombuffer(answers[s], np.uint8)[part * size:(part + 1) * size] if size else ()
        if len(got):
            told.append(own[np.unpackbits(got, count=len(own)).astype(bool)])
    cells = np.concatenate(told) & ~_LOW if told else counters[:0]
    return np.logical_and.reduce([among(_cells(keys, row, bits), cells) for row in range(DEPTH)])


def repeated(keys: np.ndarray, counters: np.ndarray, bits: int, n: int, answers: dict[int, bytes]) -> np.ndarray:
    """Which of the chunk's keys are estimated repeated, by the answers to its counters."""
    return _told(keys, counters, bits, n, answers, 0)


def heavy(keys: np.ndarray, counters: np.ndarray, bits: int, n: int, answers: dict[int, bytes]) -> np.ndarray:
    """Which of the chunk's keys are estimated to weigh more than the limit in all chunks together."""
    return _told(keys, counters, bits, n, answers, 1)
