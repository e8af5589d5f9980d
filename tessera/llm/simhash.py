"""Near duplicates by SimHash: fingerprints, pigeonhole blocks, verified bit distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import components, free_name, materialize, require, ship_package, unwrapped, whole_row

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles hashed at a time, so that a very long text needs no more memory than its words.
_AT_ONCE = 65_536
#: Fingerprints that share a block in pairs; larger blocks are linked through midpoints, just as exactly.
PAIRS_UP_TO = 64


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a UTF-8 text; 0 if it has no words."""
    from xxhash import xxh64_intdigest
    words = text.translate(_LOWER).split()          # ASCII white space only, for bytes
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, _AT_ONCE):
        to = min(n, at + _AT_ONCE)
        h = [xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts[at:to].tolist(), ends[at + k - 1:to + k - 1].tolist())]
        total += np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The columns ``carry`` and ``fp long`` of every row; fp is the signed form of the 64 bits. One row in, one row
    out: repeated rows and null ids stay, a null text has no words and fingerprint 0, other columns are not read."""
    require(docs, *carry, text_col)
    ship_package(docs.sparkSession)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.cast(b.column(len(carry)), pa.binary()).to_pylist()
            fp = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(carry)], pa.array(fp)], [*carry, "fp"])

    rows = docs.select(*carry, F.col(text_col).alias("__text"))
    return rows.mapInArrow(hashes, T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())]))


def _masks(max_bits: int) -> list[int]:
    """Masks of ``max_bits``-subsets left out of ``max_bits + 3`` blocks: fingerprints within ``max_bits`` agree on one."""
    blocks = max_bits + 3
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    out = []
    for kept in combinations(range(blocks), blocks - max_bits):
        m = sum(block[i] for i in kept)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def links(fps: DataFrame, max_bits: int = 2, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """(a long, b long): links between distinct fingerprints (fp long) that differ in at most ``max_bits`` bits.

    Blocks of at most ``pairs_up_to`` fingerprints give all their pairs, verified by bit count. A larger block
    would give a square of pairs, so its fingerprints are linked through midpoints: two differ in at most two
    bits exactly if both are within one bit of a common value, so each sends itself and its 64 one-bit
    neighbours, and the at most 65 that meet at a value link to the least of them. Every such link is true,
    and connectivity is that of all pairs. Supports ``max_bits`` 0, 1 and 2.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits must be 0, 1 or 2")
    none = fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    if max_bits == 0:
        return none
    keys = F.array(*(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks(max_bits))))
    blocks = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.part", "k.key")
    sizes = blocks.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(blocks.join(sizes, ["part", "key"]), name="blocks")
    small = shared.where(F.col("n") <= pairs_up_to)
    a, b = small.select("part", "key", F.col("fp").alias("a")), small.select("part", "key", F.col("fp").alias("b"))
    pairs = a.join(b, ["part", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")
    hot = shared.where(F.col("n") > pairs_up_to).select("fp").distinct()
    flips = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    if max_bits == 2:
        near = [F.struct(F.lit(0).alias("bit"), F.col("fp").alias("mid")),
                *(F.struct(F.lit(0).alias("bit"), F.col("fp").bitwiseXOR(F.lit(m)).alias("mid")) for m in flips)]
    else:                                                   # one bit: equal once that bit is cleared
        near = [F.struct(F.lit(i).alias("bit"), F.col("fp").bitwiseAND(F.lit(~m)).alias("mid")) for i, m in enumerate(flips)]
    mids = hot.select("fp", F.explode(F.array(*near)).alias("k")).select("fp", "k.bit", "k.mid")
    met = mids.groupBy("bit", "mid").agg(F.collect_list("fp").alias("all")).where("size(all) > 1")      # 65 at most
    stars = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def _labelled(prints: DataFrame, id_col: str, max_bits: int) -> DataFrame:
    """``prints`` (id, fp, ...) with label long and component_id."""
    spark = prints.sparkSession
    fps = prints.groupBy("fp").agg(F.min(id_col).alias("__least"))
    labels = components(links(fps.select("fp"), max_bits))
    marked = materialize(fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
                         .select("fp", "__least", F.coalesce("label", "fp").alias("label")), spark, "marked")
    named = marked.join(marked.groupBy("label").agg(F.min("__least").alias("component_id")), "label").select("fp", "label", "component_id")
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(id, fp long, label long, component_id) of every row.

    Two fingerprints link if they differ in at most ``max_bits`` bits; a component is what links reach. ``label``
    names it (its least fingerprint) and ``component_id`` is its least non-null id; it is null only if all ids of
    the component are. Copies meet at their fingerprint before any pair is formed. Null and empty texts have
    fingerprint 0, which links like any other. Repeated rows stay, each with the same component; an empty table
    gives an empty result.
    """
    prints = materialize(fingerprints(docs, carry=(id_col,), text_col=text_col, shingle=shingle), docs.sparkSession, "fingerprints")
    return _labelled(prints, id_col, max_bits).select(id_col, "fp", "label", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each component, of the least id, nulls last.

    Rows are told apart by 96 hash bits of id and text, so of repeated rows one stays, and rows that share an id but
    not the text are judged each by its text. Null and empty texts have fingerprint 0 and are one group; an empty table
    gives an empty result. A row travels as one value, so its columns may have any names, those of this function's own included.
    """
    row = free_name(docs, "__row")
    keyed = docs.select(whole_row(docs).alias(row), F.col(id_col), F.col(text_col), F.xxhash64(id_col, text_col).alias("__k"), F.hash(id_col, text_col).alias("__m"))
    prints = materialize(fingerprints(keyed, carry=(id_col, "__k", "__m"), text_col=text_col, shingle=shingle), docs.sparkSession, "fingerprints")
    tagged = _labelled(prints, id_col, max_bits).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    stay = tagged.groupBy("label").agg(F.min(F.struct("__k", "__m")).alias("s")).select("s.__k", "s.__m")
    # one exchange serves the join and the removal of repeated rows
    return keyed.join(stay, ["__k", "__m"]).dropDuplicates(["__k", "__m"]).select(*unwrapped(row, docs.columns))
