"""Fill-in-the-middle over framed texts: prefix, middle and suffix change places without the text being unpacked whole.

Only the frames that hold a cut are decompressed and packed anew; all others move as they are. Digests stream the
frames in their new order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import require, ship_package
from tessera.llm.frames import FIELDS, Codec

#: Marks before the prefix, the suffix and the middle (fixed values).
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred texts, how many keep their order, and how many of the others begin with the suffix (fixed values).
PLAIN_FROM, SPM_BELOW = 90, 20
SEED = 1


def draws(key: object, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a seed and an id; a null id is the empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digest[8 * i:8 * i + 8], 16) for i in range(4))


def form_of(marked: bool, n: int, h3: int, h4: int) -> str:
    """plain where there is no text or a mark stands in it, else by lot plain, spm or psm."""
    if not n or marked or h3 % 100 >= PLAIN_FROM:
        return "plain"
    return "spm" if h4 % 100 < SPM_BELOW else "psm"


def rearranged(codec: Codec, ends: list[int], frames: list[bytes], form: str, low: int, high: int) -> tuple[list[int], list[bytes]]:
    """(ends, frames) of the output of a form with cuts after ``low`` and ``high`` units."""
    if form == "plain":
        return ends, frames
    n = ends[-1]
    parts = {PREFIX: (0, low), SUFFIX: (high, n), MIDDLE: (low, high)}
    total, out_ends, out = 0, [], []
    for mark in (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE):
        for size, frame in ((len(mark), codec.pack(mark)), *codec.pieces(ends, frames, *parts[mark])):
            total += size
            out_ends.append(total)
            out.append(frame)
    return out_ends, out


def restored(codec: Codec, frames: list[bytes], form: str) -> Iterator[bytes]:
    """The original text of an output, piece by piece: marks are found in the stream, then parts are read in their order."""
    if form == "plain":
        yield from codec.stream(frames)
        return
    total = sum(map(codec.size, frames))
    at = codec.find(frames, (PREFIX, SUFFIX, MIDDLE))
    order = sorted(at, key=at.get)
    stop = {mark: at[after] for mark, after in zip(order, order[1:])} | {order[-1]: total}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from codec.span(frames, at[mark] + len(mark), stop[mark])


def fill_in_middle(framed: DataFrame, *, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """(id, n long, form string, prefix_chars long, middle_chars long, ends, frames) of every framed row (id, n, ends, frames).

    Two cuts and the form come from SHA-256 of seed and id, so they depend on nothing else. ``prefix_chars`` and
    ``middle_chars`` are code points, null in the form plain; ``frames`` is the output text. Empty texts and texts
    that hold one of the marks stay plain. Rows that share an id get the same draws; a null id counts as an empty
    string. One row in, one row out; an empty table gives an empty result, other columns are not read.
    """
    require(framed, id_col, "n", "ends", "frames")
    ship_package(framed.sparkSession)
    rows = framed.select(id_col, "n", "ends", "frames")
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "ends", "frames"]

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for b in batches:
            forms, lows, mids, out_ends, out = [], [], [], [], []
            for key, n, ends, frames in zip(*(c.to_pylist() for c in b.columns)):
                h1, h2, h3, h4 = draws(key, seed)
                form = form_of(bool(n) and bool(codec.find(frames, (PREFIX, SUFFIX, MIDDLE))), n, h3, h4)
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                new_ends, new = rearranged(codec, ends, frames, form, low, high)
                forms.append(form)
                lows.append(None if form == "plain" else low)
                mids.append(None if form == "plain" else high - low)
                out_ends.append(new_ends)
                out.append(new)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(forms, pa.string()), pa.array(lows, pa.int64()), pa.array(mids, pa.int64()),
                                              pa.array(out_ends, pa.list_(pa.int64())), pa.array(out, pa.list_(pa.binary()))], names)

    long = [T.StructField(c, T.LongType()) for c in ("prefix_chars", "middle_chars")]
    return rows.mapInArrow(move, T.StructType([rows.schema[0], rows.schema[1], T.StructField("form", T.StringType()), *long, *FIELDS]))


def digests(moved: DataFrame) -> DataFrame:
    """The columns of ``fill_in_middle`` with, in place of the frames, output_sha256 and restored_sha256: lowercase hex of the
    output and of the text rebuilt from output and form, each streamed frame by frame."""
    require(moved, "form", "frames")
    ship_package(moved.sparkSession)
    carry = [c for c in moved.columns if c not in ("ends", "frames")]
    form_at = carry.index("form")

    def digest(pieces: Iterator[bytes]) -> str:
        h = hashlib.sha256()
        for p in pieces:
            h.update(p)
        return h.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for b in batches:
            rows = list(zip(b.column(form_at).to_pylist(), b.column(len(carry)).to_pylist()))
            out = [digest(codec.stream(frames)) for _, frames in rows]
            back = [digest(restored(codec, frames, form)) for form, frames in rows]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(carry)], pa.array(out, pa.string()), pa.array(back, pa.string())],
                                             [*carry, "output_sha256", "restored_sha256"])

    rows = moved.select(*carry, "frames")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *(T.StructField(c, T.StringType()) for c in ("output_sha256", "restored_sha256"))]))
