"""Texts as seekable compressed frames: independent zstandard frames with cumulative unit counts.

A unit is a code point. A text is cut at code-point boundaries into frames of about ``FRAME_BYTES`` UTF-8 bytes, each
compressed by itself; ``ends`` holds the units up to the end of each frame. A place is found by bisection in ``ends``
and only its frame is decompressed; frames in order are also one zstandard stream of the whole text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import require, ship_package

#: UTF-8 bytes of a full frame: what is decompressed to cut at one place.
FRAME_BYTES = 65_536
LEVEL = 3

#: Columns that hold a framed text.
FIELDS = (T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("frames", T.ArrayType(T.BinaryType())))


def units(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


class Codec:
    """One compressor and decompressor, used frame by frame."""

    def __init__(self) -> None:
        import zstandard
        self._out = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self._in = zstandard.ZstdDecompressor()
        self.size = zstandard.frame_content_size

    def pack(self, data: bytes) -> bytes:
        return self._out.compress(data)

    def unpack(self, frame: bytes) -> bytes:
        return self._in.decompress(frame) if self.size(frame) else b""

    def split(self, data: bytes, frame_bytes: int = FRAME_BYTES) -> tuple[list[int], list[bytes]]:
        """(ends, frames) of UTF-8 bytes; none of an empty text."""
        ends, frames, at, total = [], [], 0, 0
        while at < len(data):
            to = min(len(data), at + frame_bytes)
            while to < len(data) and data[to] & 0xC0 == 0x80:           # not inside a code point
                to += 1
            piece = data[at:to]
            total += units(piece)
            ends.append(total)
            frames.append(self.pack(piece))
            at = to
        return ends, frames

    def pieces(self, ends: list[int], frames: list[bytes], first: int, last: int) -> Iterator[tuple[int, bytes]]:
        """(units, frame) of the units from ``first`` up to ``last``: whole frames as they are, cut ones packed anew."""
        k = bisect_left(ends, first + 1)
        while first < last:
            begin, stop = (ends[k - 1] if k else 0), min(last, ends[k])
            if first == begin and stop == ends[k]:
                yield stop - first, frames[k]
            else:
                data = self.unpack(frames[k])
                lead = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                to = int(lead[stop - begin]) if stop < ends[k] else len(data)
                yield stop - first, self.pack(data[int(lead[first - begin]):to])
            first, k = stop, k + 1

    def stream(self, frames: Iterable[bytes]) -> Iterator[bytes]:
        """The bytes of frames in order, one frame at a time."""
        for frame in frames:
            yield self.unpack(frame)

    def span(self, frames: list[bytes], first: int, last: int) -> Iterator[bytes]:
        """The bytes from ``first`` up to ``last``; frames outside are not decompressed."""
        at = 0
        for frame in frames:
            size = self.size(frame)
            if at < last and at + size > first:
                yield self.unpack(frame)[max(0, first - at):last - at]
            at += size

    def find(self, frames: list[bytes], words: tuple[bytes, ...]) -> dict[bytes, int]:
        """Where each of ``words`` first begins, in bytes, also across frames; words that do not occur are left out."""
        found: dict[bytes, int] = {}
        carry, at, keep = b"", 0, max(map(len, words)) - 1
        for data in self.stream(frames):
            window = carry + data
            for w in words:
                if w not in found and (place := window.find(w)) >= 0:
                    found[w] = at - len(carry) + place
            if len(found) == len(words):
                break
            carry = window[-keep:] if keep else b""
            at += len(data)
        return found


def framed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """(id, n long, ends array<long>, frames array<binary>) of every row: its text as frames, and its code points.

    One row in, one row out, so null ids and repeated rows stay. A null or empty text has no frame and ``n`` 0. A long
    text has many frames. Other columns are not read; an empty table gives an empty result. The result is a plain
    table that can be written and read again.
    """
    require(docs, id_col, text_col)
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for b in batches:
            split = [codec.split(t or b"", frame_bytes) for t in pc.cast(b.column(1), pa.binary()).to_pylist()]
            ends = pa.array([e for e, _ in split], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e[-1] if e else 0 for e, _ in split], pa.int64()), ends,
                                              pa.array([f for _, f in split], pa.list_(pa.binary()))], [id_col, "n", "ends", "frames"])

    return rows.mapInArrow(cut, T.StructType([rows.schema[0], T.StructField("n", T.LongType()), *FIELDS]))


def unframed(framed: DataFrame, name: str = "text") -> DataFrame:
    """The other columns and the text of framed rows."""
    ship_package(framed.sparkSession)
    carry = [c for c in framed.columns if c not in ("ends", "frames")]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for b in batches:
            whole = [b"".join(codec.stream(f)).decode() for f in b.column(len(carry)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(carry)], pa.array(whole, pa.string())], [*carry, name])

    rows = framed.select(*carry, "frames")
    return rows.mapInArrow(join, T.StructType([*rows.schema.fields[:-1], T.StructField(name, T.StringType())]))
