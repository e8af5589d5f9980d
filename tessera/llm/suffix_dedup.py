"""Removal of repeated 50-byte strings by suffix order.

A window is ``length`` bytes of one document. Windows are dealt to shards by
their key (see ``hashes.key_runs``), so equal windows meet. Keys that the merged sketch (see ``sketch``)
shows in one document only need no comparison. Neighbouring windows of one key
travel together as one fragment, each distinct fragment once a chunk. Where all chunks
together hold more than ``HEAVY_BYTES`` of a key, as the sketch also shows, its windows travel
alone and are dealt by a hash of the whole window, so no common phrase fills one shard. A shard takes its
fragments some keys at a time, groups the windows of those that share a key but differ by ``bwt.prefix_classes``,
and answers with the least document of every window.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import sketch
from tessera.llm.bwt import prefix_classes
from tessera.llm.common import CHUNK_BYTES, chunks, exchange, materialize, n_shards, planes, require, ship_package, texts, unpack, unplanes
from tessera.llm.hashes import cut_points, key_runs, mix, rolling, spread, table

_LAST = np.iinfo(np.int64).max
#: Bytes in the grams whose least hash is a window's key.
KEY_BYTES = 16
#: Windows in one fragment, and symbols in one transform, at most (but for a single fragment).
FRAGMENT_WINDOWS, TRANSFORM_SYMBOLS = 4096, 1_000_000
#: Bytes of fragments, as counted in all chunks, from which on a key's windows are dealt one by one; bytes of fragments that a shard
#: takes at a time, or those of one key. The first is below the last of ``sketch.LEVELS``.
HEAVY_BYTES, ANSWER_BYTES = 4_000_000, 4_000_000
#: Strings numbered at a time, as Python's numbers take four times an array's room.
_NUMBERED = 1 << 16


def _numbers(raw: bytes, begins: np.ndarray, ends: np.ndarray, seen: dict[bytes, int]) -> np.ndarray:
    """Place of each string among the distinct ones, which ``seen`` takes up."""
    out = np.empty(len(begins), np.int64)
    for a in range(0, len(begins), _NUMBERED):
        some = slice(a, a + _NUMBERED)
        out[some] = [seen.setdefault(raw[s:e], len(seen)) for s, e in zip(begins[some].tolist(), ends[some].tolist())]
    return out


def _window_keys(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of each of the windows that begin at ``at``."""
    lookup, key = table(22), np.zeros(len(at), np.uint64)
    for j in range(length):
        key = key * np.uint64(0x9FB21C651E98DF25) + lookup[data[at + j]]
    return mix(key)


class Strings:
    """Windows of a chunk as runs of neighbours with one key: start, number of windows, key, document."""

    def __init__(self, batch: pa.RecordBatch, length: int):
        self.batch, self.length = batch, length
        self.data, self.offsets = texts(batch.column(batch.num_columns - 1))
        self.start, self.count, self.key, self.owner = key_runs(self.data, self.offsets, length, min(KEY_BYTES, length), table(21))

    def sketch(self, bits: int) -> np.ndarray:
        return sketch.sketch(self.owner, self.key, bits, self.count + self.length - 1)

    def ids(self) -> np.ndarray:
        """Document ids; a null id counts as larger than any other."""
        return self.batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)

    def keep(self, some: np.ndarray, heavy: np.ndarray | None = None) -> None:
        """Only the runs marked in ``some``, in pieces of bounded size; those in ``heavy`` in single windows with keys of their own."""
        heavy = np.zeros(len(some), bool) if heavy is None else heavy
        most = np.where(heavy, 1, FRAGMENT_WINDOWS)
        pieces = -(-self.count[some] // most[some])
        which = np.repeat(np.flatnonzero(some), pieces)
        piece, alone = spread(pieces) * most[which], heavy[which]
        self.start, self.key, self.owner = self.start[which] + piece, self.key[which], self.owner[which]
        self.count = np.minimum(self.count[which] - piece, most[which])
        self.key[alone] = _window_keys(self.data, self.start[alone], self.length)

    def fragments(self) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """(key, bytes, least document) of the distinct fragments in order of their keys, and the fragment of each run."""
        seen: dict[bytes, int] = {}
        number = _numbers(self.data.tobytes(), self.start, self.start + self.count + self.length - 1, seen)
        doc, key = np.full(len(seen), _LAST, np.int64), np.zeros(len(seen), np.uint64)
        np.minimum.at(doc, number, self.ids()[self.owner])
        key[number] = self.key
        order = np.argsort(key, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        parts = list(seen)
        return key[order], [parts[i] for i in order.tolist()], doc[order], place[number]


def _pack(key: np.ndarray, parts: list[bytes], doc: np.ndarray) -> bytes:
    head = np.array([len(parts)], np.int64).tobytes()
    lens = np.fromiter(map(len, parts), np.uint32, len(parts))
    return head + planes(key) + planes(lens) + planes(doc.view(np.uint64)) + zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _parse(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob[:8], np.int64)[0])
    at = np.cumsum([8, 8 * n, 4 * n, 8 * n])
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[at[3]:]), np.uint8)
    return unplanes(blob[8:at[1]]), unplanes(blob[at[1]:at[2]], np.uint32).astype(np.int64), unplanes(blob[at[2]:at[3]]).view(np.int64), data


def least_by_window(parts: list[bytes], docs: np.ndarray, length: int) -> np.ndarray:
    """Least document of each window of the fragments, one after the other, through one transform."""
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    raw = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    starts = np.cumsum(lens + 1) - lens - 1
    code = np.zeros(256, np.uint8)                                      # dense symbols from 1; UTF-8 has fewer than 255 byte values
    used = np.unique(raw)
    code[used] = np.arange(1, len(used) + 1)
    text = code[raw]
    text[starts + lens] = 0
    classes = prefix_classes(text, length)
    windows = lens - length + 1
    own = classes[np.repeat(starts, windows) + spread(windows)]
    least = np.full(int(classes.max()) + 1, _LAST, np.int64)
    np.minimum.at(least, own, np.repeat(docs, windows))
    return least[own]


def _grouped(parts: list[bytes], docs: np.ndarray, length: int, depth: int = 0) -> np.ndarray:
    """``least_by_window`` of the distinct fragments of one key.

    Where they are too many for one transform, their windows are dealt out anew by keys of other hashes, which seldom
    choose the same gram again, and equal pieces are joined; what is still too many is dealt by a hash of each window.
    """
    size = sum(map(len, parts)) + len(parts)
    if size <= TRANSFORM_SYMBOLS or len(parts) == 1:
        return least_by_window(parts, docs, length)
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    windows, bounds = lens - length + 1, np.concatenate(([0], np.cumsum(lens)))
    raw = b"".join(parts)
    data = np.frombuffer(raw, np.uint8)
    out, first = np.empty(int(windows.sum()), np.int64), np.cumsum(windows) - windows
    if depth < 3:
        start, count, key, owner = key_runs(data, bounds, length, min(KEY_BYTES, length), table(31 + depth))
        seen: dict[bytes, int] = {}
        number = np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in zip(start.tolist(), (start + count + length - 1).tolist())), np.int64, len(start))
        least, keys = np.full(len(seen), _LAST, np.int64), np.zeros(len(seen), np.uint64)
        np.minimum.at(least, number, docs[owner])
        keys[number] = key
        found, base = _by_key(list(seen), keys, least, length, depth + 1)
        inner = spread(count)
        out[np.repeat(first[owner] + start - bounds[owner], count) + inner] = found[np.repeat(base[number], count) + inner]
        return out
    at = np.repeat(bounds[:-1], windows) + spread(windows)
    turns = -(-len(at) * (length + 1) // TRANSFORM_SYMBOLS)
    turn = (mix(rolling(table(22)[data], length, 0x9FB21C651E98DF25))[at] % np.uint64(turns)).astype(np.int64)
    owner = np.repeat(docs, windows)
    for k in range(turns):
        own = np.flatnonzero(turn == k)
        if len(own):
            out[own] = least_by_window([raw[i:i + length] for i in at[own].tolist()], owner[own], length)
    return out


def _by_key(parts: list[bytes], key: np.ndarray, least: np.ndarray, length: int, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Least document of every window of distinct fragments, and where each fragment's windows begin. Fragments that
    share a key go through one transform, as many keys together as it holds; one alone with its key needs none."""
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    windows = lens - length + 1
    base = np.cumsum(windows) - windows
    found = np.repeat(least, windows)
    order = np.argsort(key, kind="stable")
    edges = np.append(np.flatnonzero(np.append(True, key[order[1:]] != key[order[:-1]])), len(order))

    def settle(groups: list[np.ndarray]) -> None:
        group = np.concatenate(groups)
        own = [parts[i] for i in group.tolist()]
        got = _grouped(own, least[group], length, depth) if len(groups) == 1 else least_by_window(own, least[group], length)
        found[np.repeat(base[group], windows[group]) + spread(windows[group])] = got

    held, size = [], 0
    sizes = np.add.reduceat(lens[order], edges[:-1]) + np.diff(edges) if len(order) else lens
    shared = np.flatnonzero(np.diff(edges) > 1)
    for b, e, n in zip(edges[shared].tolist(), edges[shared + 1].tolist(), sizes[shared].tolist()):
        if held and size + n > TRANSFORM_SYMBOLS:
            settle(held)
            held, size = [], 0
        held.append(order[b:e])
        size += n
    if held:
        settle(held)
    return found, base


def answer(blobs: list[bytes], length: int) -> list[bytes]:
    """A shard's answer: for each fragment sent, runs of windows with one least document."""
    key, lens, doc, data = (list(x) for x in zip(*map(_parse, blobs)))
    ends = np.cumsum([0, *map(len, key)])                               # of each chunk's fragments
    key, lens, doc, raw = np.concatenate(key), np.concatenate(lens), np.concatenate(doc), b"".join(data)
    del data
    begins, windows = np.cumsum(lens) - lens, lens - length + 1
    order = np.argsort(key, kind="stable")
    fresh = np.flatnonzero(np.append(True, key[order[1:]] != key[order[:-1]]))
    before = (np.cumsum(lens[order]) - lens[order])[fresh]              # bytes of smaller keys
    turns = np.append(fresh[np.append(True, np.diff(before // ANSWER_BYTES) > 0)], len(order))
    pieces = []
    for own in (order[a:b] for a, b in zip(turns[:-1], turns[1:])):
        seen: dict[bytes, int] = {}
        number = _numbers(raw, begins[own], begins[own] + lens[own], seen)
        keys, least = np.zeros(len(seen), np.uint64), np.full(len(seen), _LAST, np.int64)
        keys[number] = key[own]
        np.minimum.at(least, number, doc[own])
        found, base = _by_key(list(seen), keys, least, length)
        value, first = found[np.repeat(base[number], windows[own]) + spread(windows[own])], np.cumsum(windows[own]) - windows[own]
        new = np.zeros(len(value), bool)
        new[first] = True
        new[1:] |= value[1:] != value[:-1]
        runs = np.flatnonzero(new)
        pieces.append((np.add.reduceat(new, first, dtype=np.int64), np.diff(np.append(runs, len(value))).astype(np.uint16), value[runs]))
    many, size, value = (np.concatenate(x) for x in zip(*pieces))
    runs = np.empty(len(order), np.int64)
    runs[order] = np.cumsum(many) - many                                # where a fragment's runs begin, and how many they are
    many[order] = many.copy()
    upto, at = np.concatenate(([0], np.cumsum(many)))[ends], np.repeat(runs, many) + spread(many)
    size, value = size[at], value[at]
    return [planes(size[a:b]) + planes(value[a:b].view(np.uint64)) for a, b in zip(upto[:-1], upto[1:])]


def _runs(blob: bytes) -> np.ndarray:
    k = len(blob) // 10
    return np.repeat(unplanes(blob[2 * k:]).view(np.int64), unplanes(blob[:2 * k], np.uint16).astype(np.int64))


def _answers(pdf, kind: int) -> dict[int, bytes]:
    own = pdf[pdf["kind"] == kind]
    return dict(zip(own["shard"].tolist(), own["blob"].tolist()))


def _send_sketches(batches, length: int, bits: int, n: int):
    for batch in batches:
        for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = list(sketch.send(Strings(unpack(blob), length).sketch(bits), n))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()),
                                              pa.array([b for _, b in rows], pa.binary())], ["shard", "chunk", "blob"])


def _recalled(blob: bytes, replies, length: int, bits: int, n: int):
    """A chunk's repeated runs, its fragments and where each shard's begin."""
    s = Strings(unpack(blob), length)
    counters, got = s.sketch(bits), _answers(replies, 1)
    s.keep(sketch.repeated(s.key, counters, bits, n, got), sketch.heavy(s.key, counters, bits, n, got))
    key, parts, doc, which = s.fragments()
    return s, key, parts, doc, which, cut_points(key, n)


def _send_fragments(own, replies, length: int, bits: int, n: int):
    import pandas as pd
    out = []
    for chunk, blob in zip(own["chunk"], own["blob"]):
        _, key, parts, doc, _, cuts = _recalled(blob, replies, length, bits, n)
        out.extend((k, chunk, _pack(key[a:b], parts[a:b], doc[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a)
    return pd.DataFrame(out, columns=["shard", "chunk", "blob"])


def _remove(own, replies, length: int, bits: int, n: int, id_col: str):
    import pandas as pd
    frames = []
    for blob in own["blob"]:
        s, _, parts, _, which, cuts = _recalled(blob, replies, length, bits, n)
        got, docs = _answers(replies, 2), s.batch.num_rows
        least = np.concatenate([_runs(got[k]) for k in range(n) if cuts[k + 1] > cuts[k]] or [np.zeros(0, np.int64)])
        windows = np.fromiter(map(len, parts), np.int64, len(parts)) - length + 1
        base = np.cumsum(windows) - windows
        inner = spread(s.count)
        seen = (np.repeat(s.start, s.count) + inner)[least[np.repeat(base[which], s.count) + inner] < np.repeat(s.ids()[s.owner], s.count)]
        size = len(s.data)
        change = np.bincount(seen, minlength=size + 1).astype(np.int64) - np.bincount(seen + length, minlength=size + 1)
        gone = np.cumsum(change[:size]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = s.offsets[1:-1]
        inner = inner[inner < size]
        begins[inner] = gone[inner]                                     # runs do not cross documents
        upto = lambda mark: np.concatenate(([0], np.cumsum(mark)))[s.offsets]
        kept, raw = upto(~gone), s.data[~gone].tobytes()
        spans_at = np.flatnonzero(begins)
        ends_mark = gone.copy()
        ends_mark[:-1] &= ~gone[1:]
        ends_mark[inner[inner > 0] - 1] = gone[inner[inner > 0] - 1]
        first, last, home = upto(begins), np.flatnonzero(ends_mark) + 1, s.offsets
        frames.append(pd.DataFrame({
            id_col: pd.array(s.batch.column(0).to_pylist(), "Int64"), "n_bytes": np.diff(s.offsets), "n_removed": np.diff(upto(gone)),
            "spans": pd.Series([np.column_stack((spans_at[first[d]:first[d + 1]], last[first[d]:first[d + 1]])).ravel() - home[d] for d in range(docs)], dtype=object),
            "kept": pd.Series([raw[kept[d]:kept[d + 1]] for d in range(docs)], dtype=object)}))
    return pd.concat(frames) if frames else pd.DataFrame(columns=[id_col, "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, *, length: int = 50, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id long, n_bytes long, n_removed long, spans array<long>, kept binary) of every row.

    A byte of a text's UTF-8 goes if a string of ``length`` bytes covers it that also starts in a document with a
    smaller id; all is judged on the input and no string crosses documents. ``spans`` lists start and end of each
    maximal removed run in turn, ``kept`` the other bytes. Ids are integers; a null id counts as larger than all
    others, and rows that share an id do not remove each other's bytes. A null text is empty; one shorter than
    ``length`` loses nothing. An empty table gives an empty result; other columns are not read. However many
    documents repeat a fragment, it reaches its shard once a chunk; a phrase that many documents hold between different
    neighbours is spread over all shards.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    ship_package(spark)
    n = n_shards(spark)
    packed = materialize(chunks(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text=text_col, limit=chunk_bytes), spark, "chunks")
    bits = sketch.cell_bits(packed.count() * chunk_bytes)
    schema = "shard int, chunk long, blob binary"
    flags = materialize(exchange(packed.mapInArrow(partial(_send_sketches, length=length, bits=bits, n=n), schema), partial(sketch.merge, limit=HEAVY_BYTES), n), spark, "flags")
    flags = flags.withColumn("kind", F.lit(1))

    def send(own, replies):
        return _send_fragments(own, replies, length, bits, n)

    def remove(own, replies):
        return _remove(own, replies, length, bits, n, id_col)

    sent = packed.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInPandas(send, schema)
    least = exchange(sent, partial(answer, length=length), n).withColumn("kind", F.lit(2))
    return packed.groupBy("chunk").cogroup(flags.unionByName(least).groupBy("chunk")).applyInPandas(
        remove, f"`{id_col}` long, n_bytes long, n_removed long, spans array<long>, kept binary")
