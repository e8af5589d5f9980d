"""Removal of repeated 50-word passages: a count-min prefilter, then exact groups of the windows it leaves.

Every chunk counts the documents of its window keys (see ``hashes.key_runs``) in a count-min sketch, and shards merge the
sketches cell by cell (see ``sketch``). A window is never more frequent than its key, so
the merged sketch never underestimates a window's count. Windows of keys estimated repeated are then grouped by 128
hash bits, each chunk sending a window once with its least document.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import sketch
from tessera.llm.common import CHUNK_BYTES, chunks, exchange, materialize, n_shards, planes, require, ship_package, texts, unpack, unplanes
from tessera.llm.hashes import cut_points, key_runs, mix, rolling, spread, table

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Words in the shingles whose least hash is a window's key.
KEY_WORDS = 10
#: Two independent word hashes: (seed of the byte values, odd base).
_HASHES = ((11, 0x9FB21C651E98DF25), (12, 0xC2B2AE3D27D4EB4F))
_LAST = np.iinfo(np.int64).max


#: Bytes hashed at a time, and the longest run of powers that is kept for the next.
_BLOCK, _KEPT = 1 << 18, 1 << 20
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 1 to ``n``."""
    if len(_POWERS.get(base, ())) >= n:
        return _POWERS[base][:n]
    with np.errstate(over="ignore"):
        out = np.cumprod(np.full(n, base, np.uint64))
    if n <= _KEPT:
        _POWERS[base] = out
    return out


class Words:
    """Words of a chunk: byte places, owning document and hashes."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        self.data, self.offsets = texts(batch.column(batch.num_columns - 1))
        space = _SPACE[self.data]
        start = ~space
        start[1:] &= space[:-1]
        inner = self.offsets[1:-1]
        inner = inner[inner < len(space)]
        start[inner] = ~space[inner]                                    # a text begins anew
        end = ~space
        end[:-1] &= space[1:]
        inner = inner[inner > 0] - 1
        end[inner] = ~space[inner]                                      # and ended before
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.owner = np.repeat(np.arange(batch.num_rows), np.diff(np.searchsorted(self.starts, self.offsets)))
        self.per_doc = np.bincount(self.owner, minlength=batch.num_rows)

    def hashes(self, which: int) -> np.ndarray:
        """64-bit hash of each word, from prefix sums of byte values times powers of an odd base."""
        seed, base = _HASHES[which]
        values, out = table(seed), np.empty(len(self.starts), np.uint64)
        edges = np.unique(np.searchsorted(self.starts, np.append(np.arange(0, len(self.data), _BLOCK), len(self.data))))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            a, b = int(self.starts[i]), int(self.ends[j - 1])
            powers, back = _powers(base, b - a + 1), _powers(pow(base, -1, 1 << 64), b - a + 1)
            starts, ends = self.starts[i:j] - a, self.ends[i:j] - a
            with np.errstate(over="ignore"):
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[self.data[a:b]] * powers[:-1], dtype=np.uint64)))
                out[i:j] = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
        return out

    def ids(self) -> np.ndarray:
        """Document ids; a null id counts as larger than any other."""
        return self.batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _runs(w: Words, first: np.ndarray, words: int, bits: int):
    """Runs of windows of one key, and the chunk's sketch."""
    bounds = np.concatenate(([0], np.cumsum(w.per_doc)))
    start, count, key, owner = key_runs(first, bounds, words, min(KEY_WORDS, words))
    return start, count, key, sketch.sketch(owner, key, bits)


def _flagged(w: Words, words: int, bits: int, n: int, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, h1, h2) of the windows whose key is estimated repeated."""
    first = w.hashes(0)
    start, count, key, counters = _runs(w, first, words, bits)
    some = sketch.repeated(key, counters, bits, n, answers)
    starts = np.repeat(start[some], count[some]) + spread(count[some])
    if not len(starts):
        return starts, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return starts, mix(rolling(first, words, _HASHES[0][1])[starts]), mix(rolling(w.hashes(1), words, _HASHES[1][1])[starts])


def _distinct(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): sorting by (h1, h2, doc) and the marks of distinct windows in it."""
    order = np.lexsort((doc, h2, h1))
    first = np.ones(len(order), bool)
    a, b = h1[order], h2[order]
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, first


def _pack(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> bytes:
    return planes(h1) + planes(h2) + planes(doc.view(np.uint64))


def _parse(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = len(blob) // 3
    return unplanes(blob[:k]), unplanes(blob[k:2 * k]), unplanes(blob[2 * k:]).view(np.int64)


def least_documents(blobs: list[bytes]) -> list[bytes]:
    """A shard's answer: for each window sent, the least document over all chunks."""
    sent = [_parse(b) for b in blobs]
    h1, h2, doc = (np.concatenate([s[i] for s in sent]) for i in range(3))
    order, first = _distinct(h1, h2, doc)
    least = np.empty(len(doc), np.int64)
    least[order] = doc[order][np.flatnonzero(first)][np.cumsum(first) - 1]
    cuts = np.cumsum([len(s[0]) for s in sent])[:-1]
    return [planes(x.view(np.uint64)) for x in np.split(least, cuts)]


def _windows(w: Words, words: int, bits: int, n: int, answers: dict[int, bytes]):
    """Flagged windows and, for each of ``n`` shards, what the chunk sends of them."""
    starts, h1, h2 = _flagged(w, words, bits, n, answers)
    doc = w.ids()[w.owner[starts]]
    order, first = _distinct(h1, h2, doc)
    once = order[first]
    return starts, h1, h2, doc, order, first, once, cut_points(h1[once], n)


def _answers(pdf, kind: int) -> dict[int, bytes]:
    own = pdf[pdf["kind"] == kind]
    return dict(zip(own["shard"].tolist(), own["blob"].tolist()))


def _send_sketches(batches, words: int, bits: int, n: int):
    for batch in batches:
        for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = Words(unpack(blob))
            rows = list(sketch.send(_runs(w, w.hashes(0), words, bits)[3], n))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()),
                                              pa.array([b for _, b in rows], pa.binary())], ["shard", "chunk", "blob"])


def _send_windows(own, replies, words: int, bits: int, n: int):
    import pandas as pd
    out = []
    for chunk, blob in zip(own["chunk"], own["blob"]):
        _, h1, h2, doc, _, _, once, cuts = _windows(Words(unpack(blob)), words, bits, n, _answers(replies, 1))
        out.extend((s, chunk, _pack(*(x[once[cuts[s]:cuts[s + 1]]] for x in (h1, h2, doc)))) for s in range(n) if cuts[s + 1] > cuts[s])
    return pd.DataFrame(out, columns=["shard", "chunk", "blob"])


def kept_words(w: Words, gone: np.ndarray) -> pa.Array:
    """Texts of the words not marked in ``gone``, joined by one space."""
    kept = np.flatnonzero(~gone)
    owner = w.owner[kept]
    data = w.data.copy()
    mark = np.zeros(len(data) + 1, np.int8)
    mark[w.starts[kept]] += 1
    mark[w.ends[kept]] -= 1
    take = np.cumsum(mark[:-1]).astype(bool)
    joined = w.ends[kept[:-1][owner[1:] == owner[:-1]]]                 # a space after each word that another follows
    take[joined] = True
    data[joined] = 32
    before = np.concatenate(([0], np.cumsum(take)))
    offsets = before[w.offsets].astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[take].tobytes())])


def _remove(own, replies, words: int, bits: int, n: int, id_col: str):
    import pandas as pd
    frames = []
    for blob in own["blob"]:
        w = Words(unpack(blob))
        starts, h1, h2, doc, order, first, once, cuts = _windows(w, words, bits, n, _answers(replies, 1))
        got = _answers(replies, 2)
        least = np.concatenate([unplanes(got[s]).view(np.int64) for s in range(n) if cuts[s + 1] > cuts[s]] or [np.zeros(0, np.int64)])
        over = np.empty(len(starts), np.int64)
        over[order] = least[np.cumsum(first) - 1] if len(order) else least
        mark = np.zeros(len(w.starts) + 1, np.int64)
        seen = starts[over < doc]
        np.add.at(mark, seen, 1)
        np.add.at(mark, seen + words, -1)
        gone = np.cumsum(mark[:-1]) > 0
        frames.append(pd.DataFrame({
            id_col: pd.array(w.batch.column(0).to_pylist(), "Int64"), "n_words": w.per_doc,
            "n_removed": np.bincount(w.owner[gone], minlength=w.batch.num_rows),
            "kept_text": pd.Series([x.decode() for x in kept_words(w, gone).to_pylist()], dtype=object)}))
    return pd.concat(frames) if frames else pd.DataFrame(columns=[id_col, "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, *, words: int = 50, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id long, n_words long, n_removed long, kept_text) of every row.

    A word goes if a window of ``words`` words covers it whose word sequence also starts in a document with a smaller
    id; all is judged on the input. ``kept_text`` joins the other words by one space. Ids are integers; a null id
    counts as larger than all others, and rows that share an id do not remove each other's words. A null or empty
    text, or one shorter than a window, loses nothing. An empty table gives an empty result; other columns are not
    read. A window's group is met shard by shard as one entry a chunk, however many documents repeat it.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    ship_package(spark)
    n = n_shards(spark)
    packed = materialize(chunks(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text=text_col, limit=chunk_bytes), spark, "chunks")
    bits = sketch.cell_bits(packed.count() * chunk_bytes)
    schema = "shard int, chunk long, blob binary"
    flags = materialize(exchange(packed.mapInArrow(partial(_send_sketches, words=words, bits=bits, n=n), schema), sketch.merge, n), spark, "flags")
    flags = flags.withColumn("kind", F.lit(1))

    def send(own, replies):
        return _send_windows(own, replies, words, bits, n)

    def remove(own, replies):
        return _remove(own, replies, words, bits, n, id_col)

    sent = packed.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInPandas(send, schema)
    least = exchange(sent, least_documents, n).withColumn("kind", F.lit(2))
    return packed.groupBy("chunk").cogroup(flags.unionByName(least).groupBy("chunk")).applyInPandas(
        remove, f"`{id_col}` long, n_words long, n_removed long, kept_text string")
