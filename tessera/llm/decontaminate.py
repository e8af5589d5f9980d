"""Benchmark decontamination: an FM-index for each training shard, searched for all benchmark windows.

Each task cuts its documents into shards of bounded size. Words are numbered by
the benchmark's vocabulary. A window can only occur where every pair of
neighbouring words is a pair of the benchmark, so the index covers just those
chains (nothing that could match is left out). Windows are found by backward
search, located by sampled suffix positions, and merged into removal spans.
Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize, require, ship_package, sliced, with_fields
from tessera.llm.fm import FMIndex

_WORD = [c for c in range(256) if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128]
#: Lower-cases A-Z and turns every byte that is in no word into a space.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c in _WORD or 65 <= c <= 90 else 32 for c in range(256))
#: Text bytes of a shard; a longer document is a shard of its own.
SHARD_BYTES = 8_000_000
#: Text bytes of benchmark items that one broadcast holds; a larger benchmark takes several passes.
BLOCK_BYTES = 16_000_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Phrases:
    """Windows of benchmark items over a numbered vocabulary (0: any other word)."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], int] = {}
        self.ids: list[object] = []
        number: dict[object, int] = {}
        owners: set[tuple[int, int]] = set()
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if not ids:
                continue
            if item not in number:
                number[item] = len(self.ids)
                self.ids.append(item)
            for i in range(max(1, len(ids) - window + 1)):
                owners.add((seen.setdefault(tuple(ids[i:i + window]), len(seen)), number[item]))
        self.lengths = np.array([len(w) for w in seen], np.int64)
        self.windows = np.zeros((len(seen), window), np.int64)
        for w, k in seen.items():
            self.windows[k, :len(w)] = w
        pairs = np.array(sorted(owners), np.int64).reshape(-1, 2)
        self.owner_start = np.searchsorted(pairs[:, 0], np.arange(len(seen) + 1))
        self.owner = pairs[:, 1]
        self.size = len(self.vocabulary) + 1
        chain = [w[i] * self.size + w[i + 1] for w in seen for i in range(len(w) - 1)]
        self.pairs = np.unique(np.array(chain, np.int64))
        self.shortest = int(self.lengths[self.lengths > 1].min(initial=window))
        self.singles = np.array(sorted(w[0] for w in seen if len(w) == 1), np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _kept(tokens: np.ndarray, ph: Phrases) -> np.ndarray:
    """Positions of words in chains that are long enough for a window, or that are one-word windows."""
    keep = _among(tokens, ph.singles)
    both = np.flatnonzero((tokens[:-1] > 0) & (tokens[1:] > 0))
    linked = both[_among(tokens[both] * ph.size + tokens[both + 1], ph.pairs)]
    if len(linked):
        new = np.flatnonzero(np.diff(linked) != 1)
        first, last = linked[np.concatenate(([0], new + 1))], linked[np.concatenate((new, [len(linked) - 1]))] + 1
        long = last - first + 1 >= ph.shortest
        mark = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(mark, first[long], 1)
        np.add.at(mark, last[long] + 1, -1)
        keep |= np.cumsum(mark)[:-1] > 0
    return np.flatnonzero(keep)


def search_shard(documents: list[list[bytes]], ph: Phrases) -> list[tuple[list[tuple[int, int]], list[int]]]:
    """For each document its merged spans of hit words [first, end) and the numbers of items with windows in it."""
    lens = np.fromiter(map(len, documents), np.int64, len(documents))
    starts = np.concatenate(([0], np.cumsum(lens + 1)))                  # a 0 after each document
    tokens = np.zeros(int(starts[-1]), np.int64)
    for d, words in enumerate(documents):
        tokens[starts[d]:starts[d] + len(words)] = ph.numbers(words)
    at = _kept(tokens, ph) if len(tokens) > 1 and len(ph.lengths) else np.zeros(0, np.int64)
    found: list[tuple[list[tuple[int, int]], list[int]]] = [([], []) for _ in documents]
    if not len(at):
        return found
    gap = np.concatenate(([0], np.cumsum(np.diff(at) != 1)))             # a separator between chains
    place = np.arange(len(at)) + gap
    text, source = np.zeros(int(place[-1]) + 1, np.int64), np.zeros(int(place[-1]) + 1, np.int64)
    text[place], source[place] = tokens[at], at
    index = FMIndex(text, ph.size)
    low, high = index.search(ph.windows, ph.lengths)
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    if not len(which):
        return found
    rows = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]
    first = source[index.locate(rows)]
    cover = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + ph.lengths[which], -1)
    hit = np.concatenate(([0], (np.cumsum(cover)[:-1] > 0).astype(np.int8), [0]))
    edge = np.diff(hit)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    for d, b, e in zip((np.searchsorted(starts, begins, side="right") - 1).tolist(), begins.tolist(), ends.tolist()):
        found[d][0].append((b - int(starts[d]), e - int(starts[d])))
    doc = np.searchsorted(starts, first, side="right") - 1
    seen = np.unique(doc * len(ph.lengths) + which)
    for d, w in zip((seen // len(ph.lengths)).tolist(), (seen % len(ph.lengths)).tolist()):
        found[d][1].extend(ph.owner[ph.owner_start[w]:ph.owner_start[w + 1]].tolist())
    return [(spans, sorted(set(items))) for spans, items in found]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Phrases]:
    """The benchmark in blocks of about ``block_bytes``, each collected alone: a broadcast never grows with it."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(id_col, text_col)
    size = items.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // block_bytes))
    block = F.pmod(F.xxhash64(id_col, text_col), F.lit(n))
    for k in range(n):
        rows = items.where(block == k).collect()
        yield Phrases(sorted(((r[0], r[1].encode()) for r in rows), key=lambda x: (x[0] is None, str(x[0]), x[1])), window)


_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
                       T.StructField("items", T.ArrayType(T.StringType()))])


def _scan(docs: DataFrame, carry: tuple[str, ...], text_col: str, ph) -> DataFrame:
    """``carry`` columns, n_words, spans and items of every row, for one broadcast block."""
    n = len(carry)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in sliced(batches, "__text", SHARD_BYTES):
            block = ph.value
            documents = [words_of(t or b"") for t in pc.cast(piece.column(n), pa.binary()).to_pylist()]
            found = search_shard(documents, block)
            names = [[str(block.ids[i]) for i in items if block.ids[i] is not None] for _, items in found]
            yield pa.RecordBatch.from_arrays(
                [*piece.columns[:n], pa.array([len(w) for w in documents], pa.int64()),
                 pa.array([[list(s) for s in spans] for spans, _ in found], pa.list_(pa.list_(pa.int64()))),
                 pa.array(names, pa.list_(pa.string()))], [*carry, "n_words", "spans", "items"])

    rows = docs.select(*carry, F.col(text_col).alias("__text"))
    return rows.mapInArrow(search, T.StructType([*rows.schema.fields[:-1], *_FOUND.fields]))


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(map(tuple, spans)):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``carry`` columns, n_words, spans (merged [first, end) word spans covered by windows) and items (sorted ids as
    strings) of every row of ``docs``.

    A window is ``window`` consecutive words of an item, or the whole of a shorter item. Null and empty texts have no
    words; items without words have no windows; an item without an id hits words but is not listed; repeated items
    count once and repeated rows of ``docs`` each get a result; an empty benchmark hits nothing. A benchmark beyond
    ``block_bytes`` is searched block by block and the results of a row are merged.
    """
    require(docs, *carry, text_col)
    require(benchmark, item_col, item_text_col)
    spark = docs.sparkSession
    ship_package(spark)
    blocks = [spark.sparkContext.broadcast(p) for p in _blocks(benchmark, item_col, item_text_col, window, block_bytes)]
    if len(blocks) == 1:
        out = _scan(docs, carry, text_col, blocks[0])
    else:
        rows = materialize(docs.select(*carry, F.col(text_col).alias("__t")).withColumn("__row", F.monotonically_increasing_id()), spark, "rows")
        parts = None
        for b in blocks:
            one = _scan(rows, (*carry, "__row"), "__t", b)
            parts = one if parts is None else parts.unionByName(one)
        out = parts.groupBy("__row").agg(*[F.first(c).alias(c) for c in carry], F.first("n_words").alias("n_words"),
                                         F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        spans = F.array_sort(F.col("spans"))
        none = F.array().cast("array<array<bigint>>")
        out = out.withColumn("spans", F.aggregate(spans, none, lambda a, s: F.when(
            (F.size(a) > 0) & (F.get(F.get(a, F.size(a) - 1), F.lit(1)) >= F.get(s, F.lit(0))),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.array(F.get(F.get(a, F.size(a) - 1), F.lit(0)),
                                                                   F.greatest(F.get(F.get(a, F.size(a) - 1), F.lit(1)), F.get(s, F.lit(1)))))))
            .otherwise(F.concat(a, F.array(s))))).drop("__row")
    return out.withColumn("items", F.array_sort(F.array_distinct("items")))


def cut(text: bytes, spans: list) -> bytes:
    """``text`` without the words of the spans and what stands between them."""
    import re
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_FOLD))]
    out, at = [], 0
    for b, e in spans:
        out.append(text[at:places[b][0]])
        at = places[e - 1][1]
    return b"".join((*out, text[at:]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text_col: str = "text", chars_col: str | None = "n_chars",
                  item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with benchmark windows cut out of the texts; a document that had words and has none left goes.

    Columns stay as they are, but for ``chars_col``, where there is one, of texts that were cut. Nulls, repeats and
    empty tables as in ``contamination``. All blocks of a large benchmark are searched on the texts as they come in; the
    pass of the last one cuts what any of them covers, so the size of blocks does not change the result.
    """
    require(docs, text_col)
    spark = docs.sparkSession
    ship_package(spark)
    names, out = docs.columns, docs
    at, chars = names.index(text_col), names.index(chars_col) if chars_col in names else None

    spans_col = "__spans"
    while spans_col in names:
        spans_col += "_"

    def search(ph, first: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in sliced(batches, text_col, SHARD_BYTES):
                columns, schema = piece.columns[:len(names)], pa.schema(list(piece.schema)[:len(names)])
                texts = pc.cast(columns[at], pa.binary()).to_pylist()
                documents = [words_of(t or b"") for t in texts]
                found = [spans for spans, _ in search_shard(documents, ph.value)]
                if not first:
                    found = [merged([*old, *new]) for old, new in zip(piece.columns[-1].to_pylist(), found)]
                if not last:
                    spans = pa.array([[list(x) for x in own] for own in found], pa.list_(pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays([*columns, spans], [*names, spans_col])
                    continue
                piece = pa.RecordBatch.from_arrays(columns, schema=schema)
                hit = [i for i, spans in enumerate(found) if spans]
                if hit:
                    gone = [sum(e - b for b, e in found[i]) == len(documents[i]) for i in hit]
                    for i in hit:
                        texts[i] = cut(texts[i], found[i])
                    columns[at] = pa.array(texts, pa.binary()).cast(pa.string()).cast(columns[at].type)
                    if chars is not None:
                        counts, changed = columns[chars].to_pylist(), set(hit)
                        columns[chars] = pa.array([len(texts[i].decode()) if i in changed else c for i, c in enumerate(counts)], columns[chars].type)
                    stay = np.ones(len(texts), bool)
                    stay[[i for i, g in zip(hit, gone) if g]] = False
                    piece = pa.RecordBatch.from_arrays(columns, schema=schema).filter(pa.array(stay))
                yield piece
        return run

    blocks = [spark.sparkContext.broadcast(p) for p in _blocks(benchmark, item_col, item_text_col, window, block_bytes)]
    spans_type = T.ArrayType(T.ArrayType(T.LongType()))
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        out = out.mapInArrow(search(block, k == 0, last), with_fields(docs.schema) if last else with_fields(docs.schema, (spans_col, spans_type)))
    return out


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from the result of ``contamination``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + F.get(s, F.lit(1)) - F.get(s, F.lit(0)))
    return found.select(id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
