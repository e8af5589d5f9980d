"""Exact Jaccard join of word n-grams, by prefix lists in position blocks and by answers of similar sets.

Texts become sets of hashed shingles. Chunks send the shingles they hold to shards, which answer how common each is;
a set of which too few shingles are shared with any other text cannot link and is done. The others are indexed under
their rarest shingles (the prefix filter), with their places.

Equal sets are one class. Instead of all pairs of a list, a round compares its entries with few *pivots*. The blocks of a list are
skipped by size and position before their entries are read. What lies in one component needs no further comparison,
and the overlaps of two sets with a pivot bound their own from both sides, which often answers for them. Lists whose
entries still lie in several components go into the next round, with what lies outside the largest as pivots, or with more
pivots. No link is lost: each pair of a list is joined already, excluded by a bound, or intersected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CHUNK_BYTES, chunks, components, empty, exchange, in_buckets, materialize, n_shards, planes, require, ship_package, unpack, unplanes
from tessera.llm.hashes import cut_points, mix, rolling
from tessera.llm.window_dedup import Words

_U = np.uint64
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_BASE, _SHORT, _KEY = 0x9FB21C651E98DF25, _U(0xA24BAED4963EE407), _U(0x9FB21C651E98DF25)
#: Bits of a shingle's hash by which it is counted: fewer only make a shingle look more common.
_COUNTED = _U(16)
#: Lists of so many entries are compared in full at once; after the first turn, lists with up to ``SHORT`` entries outside their
#: largest component. Other lists get a power of ``_PIVOTS`` as many pivots as turns went by.
_FEW, SHORT, _PIVOTS = 8, 64, 4
#: Places in one block of a list.
BLOCK = 8


class Sets:
    """Distinct shingles of a chunk's texts, sorted text by text, and 128-bit keys of the sets."""

    def __init__(self, batch: pa.RecordBatch, n: int):
        w = Words(batch)
        w.data = _LOWER[w.data]
        own = w.hashes(0)
        first = np.concatenate(([0], np.cumsum(w.per_doc)))
        codes, owner = mix(rolling(own, n, _BASE) + _U(n)), w.owner[:max(0, len(own) - n + 1)]
        whole = w.owner[n - 1:] == owner if len(owner) else np.zeros(0, bool)
        codes, owner = codes[whole], owner[whole]
        for k in range(1, n):                                           # a text of fewer words is one shingle
            short = np.flatnonzero(w.per_doc == k)
            if len(short):
                codes = np.concatenate((codes, mix(rolling(own, k, _BASE)[first[short]] + _U(k) + _SHORT)))
                owner = np.concatenate((owner, short))
        order = np.lexsort((codes, owner))
        codes, owner = codes[order], owner[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
        self.codes, self.owner = codes[new], owner[new]
        self.size = np.bincount(self.owner, minlength=batch.num_rows)
        self.ids = batch.column(0)
        bounds = np.concatenate(([0], np.cumsum(self.size)))
        with np.errstate(over="ignore"):
            sums = [np.concatenate((np.zeros(1, _U), np.cumsum(x, dtype=_U))) for x in (mix(self.codes ^ _KEY), mix(self.codes * _KEY + _U(1)))]
            self.keys = [s[bounds[1:]] - s[bounds[:-1]] for s in sums]
        rank = np.lexsort((np.arange(batch.num_rows), self.keys[1], self.keys[0]))
        a, b = (k[rank] for k in self.keys)
        self.once = np.ones(batch.num_rows, bool)                       # the first text of each set
        self.once[rank[1:]] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct counted hashes of the first texts, the place of each of their shingles among them, and in how many texts they are."""
        return np.unique(self.codes[self.once[self.owner]] >> _COUNTED, return_inverse=True, return_counts=True)


def _cuts(keys: np.ndarray, n: int) -> np.ndarray:
    return cut_points(keys << _COUNTED, n)


def _send(batches, words: int, n: int):
    for batch in batches:
        for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys, _, count = Sets(unpack(blob), words).counted()
            cuts, many = _cuts(keys, n), np.minimum(count, 2).astype(np.uint8)
            rows = [(s, planes(keys[cuts[s]:cuts[s + 1]]) + many[cuts[s]:cuts[s + 1]].tobytes()) for s in range(n) if cuts[s + 1] > cuts[s]]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()),
                                              pa.array([b for _, b in rows], pa.binary())], ["shard", "chunk", "blob"])


def how_common(blobs: list[bytes]) -> list[bytes]:
    """A shard's answer: for each shingle sent, eight times the binary logarithm of the texts that hold it; zero for one."""
    keys = [unplanes(b[:8 * (len(b) // 9)]) for b in blobs]
    count = np.concatenate([np.frombuffer(b[8 * (len(b) // 9):], np.uint8) for b in blobs])
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, count)
    level = np.minimum(255, np.floor(8 * np.log2(np.maximum(total, 1)))).astype(np.uint8)[place]
    return [x.tobytes() for x in np.split(level, np.cumsum([len(k) for k in keys])[:-1])]


def _rows(own, replies, words: int, n: int, percent: int):
    """A row for each text; the shared shingles, rarest first, of the first text of a set that may link."""
    import pandas as pd
    frames, got = [], dict(zip(zip(replies["chunk"], replies["shard"]), replies["blob"]))
    for chunk, blob in zip(own["chunk"], own["blob"]):
        s = Sets(unpack(blob), words)
        keys, place, _ = s.counted()
        cuts = _cuts(keys, n)
        level = np.concatenate([np.frombuffer(got[chunk, i], np.uint8) for i in range(n) if cuts[i + 1] > cuts[i]] or [np.zeros(0, np.uint8)])[place]
        sent = s.once[s.owner]
        codes, owner = s.codes[sent], s.owner[sent]
        codes, owner, level = codes[level > 0], owner[level > 0], level[level > 0]
        shared = np.bincount(owner, minlength=len(s.size))
        may = (100 * shared >= percent * s.size) & (shared > 0)
        order = np.lexsort((codes, level, owner))
        order = order[may[owner[order]]]
        codes, owner = codes[order].view(np.int64), owner[order]
        edges = np.searchsorted(owner, np.arange(len(s.size) + 1))
        frames.append(pd.DataFrame({
            "row": (chunk << 22) + np.arange(len(s.size)), "id": pd.array(s.ids.to_pylist(), "Int64"), "size": s.size,
            "k1": s.keys[0].view(np.int64), "k2": s.keys[1].view(np.int64),
            "toks": pd.Series([codes[edges[i]:edges[i + 1]] if m else None for i, m in enumerate(may)], dtype=object)}))
    return pd.concat(frames) if frames else pd.DataFrame(columns=["row", "id", "size", "k1", "k2", "toks"])


def sets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(row, id, size, k1, k2, toks) of every row of ``docs``, written once: the size of its set, the set's key and, for one
    text at least of every set that may link with another, the shingles that other texts hold too, rarest first."""
    spark = docs.sparkSession
    n = n_shards(spark)
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def send(batches):
        return _send(batches, words, n)

    def rows(own, replies):
        return _rows(own, replies, words, n, percent)

    with in_buckets(chunks(ids, "id", limit=chunk_bytes), "chunk", n, "chunks") as packed:
        replies = exchange(packed.mapInArrow(send, "shard int, chunk long, blob binary"), how_common, n)
        found = packed.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(rows, "row long, id long, size long, k1 long, k2 long, toks array<long>")
        return materialize(found, spark, "sets")


def needed(a: Column, b: Column, percent: int) -> Column:
    """The least overlap of sets of two sizes that link."""
    return F.floor(((a + b) * percent + (99 + percent)) / (100 + percent)).cast("long")


def _postings(classes: DataFrame, percent: int) -> DataFrame:
    """(token, c, pos, size, band, block): the prefix of each class; a place counts the unshared shingles, which come first."""
    length = F.col("size") - F.floor((F.col("size") * percent + 99) / 100).cast("long") + 1
    alone = F.col("size") - F.size("toks")
    some = classes.where(length > alone).select("c", "size", alone.alias("alone"), F.slice("toks", F.lit(1), (length - alone).cast("int")).alias("p"))
    each = some.select("c", "size", "alone", F.posexplode("p").alias("i", "token")).withColumn("pos", F.col("alone") + F.col("i"))
    band = F.floor(F.log(F.col("size").cast("double")) / math.log(100 / percent)) if percent < 100 else F.col("size")
    return each.select("token", "c", "pos", "size", band.cast("long").alias("band"), F.floor(F.col("pos") / BLOCK).alias("block"))


def _marked(live: DataFrame, turn: int, short: int) -> DataFrame:
    """The entries of lists that hold more than one label, which stands for what is known to be connected, and which are pivots.

    In the first turn these are all entries of a list of ``_FEW``, and of others the least, which is the same in all
    lists of a family and names it then. Later they are all that lie outside the list's largest component, where these are ``short`` at most:
    that settles the list. In other lists they are drawn by hash, four times as many a turn.
    """
    sizes = live.groupBy("token", "label").agg(F.count("*").alias("k"), F.min("c").alias("least")).groupBy("token").agg(
        F.sum("k").alias("n"), F.max(F.struct("k", "label")).alias("top"), F.min("least").alias("least")).where("n > top.k")
    if turn:
        lot = F.when(F.col("n") - F.col("top.k") <= short, F.col("label") != F.col("top.label")).otherwise(F.pmod(F.xxhash64("c"), F.col("n")) < _PIVOTS ** turn)
        pivot = lot | ((F.col("c") == F.col("least")) & (F.col("n") - F.col("top.k") > short))
    else:
        pivot = (F.col("n") <= _FEW) | (F.col("c") == F.col("least"))
    return live.join(sizes, "token").withColumn("pivot", pivot).drop("n", "top", "least")


def _pairs(live: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """(a, b, sa, sb): entries and pivots of a list in different components that its blocks and their places admit."""
    blocks = live.groupBy("token", "band", "block").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.min("pos").alias("from"))
    p = pivots.select("token", F.col("c").alias("v"), F.col("size").alias("vs"), F.col("pos").alias("vp"), F.col("label").alias("vl"))
    near = p.join(blocks, "token").where((F.col("least") * percent <= F.col("vs") * 100) & (F.col("most") * 100 >= F.col("vs") * percent)
                                         & (F.least(F.col("vs") - F.col("vp"), F.col("most") - F.col("from")) >= needed(F.col("vs"), F.col("least"), percent)))
    met = near.select("token", "band", "block", "v", "vs", "vp", "vl").join(live, ["token", "band", "block"])
    met = met.where((F.col("c") != F.col("v")) & (F.col("label") != F.col("vl"))
                    & (F.least(F.col("vs") - F.col("vp"), F.col("size") - F.col("pos")) >= needed(F.col("vs"), F.col("size"), percent)))
    first = F.col("c") < F.col("v")
    return met.select(F.least("c", "v").alias("a"), F.greatest("c", "v").alias("b"), F.when(first, F.col("size")).otherwise(F.col("vs")).alias("sa"),
                      F.when(first, F.col("vs")).otherwise(F.col("size")).alias("sb")).distinct()


def _derived(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """``pairs`` with the bounds (low, high) of their overlap that overlaps with common pivots give; pairs compared before are left out.

    Of a and b, oa and ob elements lie in the pivot of size sv: they share oa + ob - sv at least, and at most the lesser
    of oa and ob inside it and the lesser rest outside.
    """
    new = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
    both = known.select(F.col("a").alias("x"), F.col("b").alias("v"), F.col("sb").alias("sv"), "o").unionByName(
        known.select(F.col("b").alias("x"), F.col("a").alias("v"), F.col("sa").alias("sv"), "o"))
    side = new.join(both.select(F.col("x").alias("a"), "v", "sv", F.col("o").alias("oa")), "a") \
        .join(both.select(F.col("x").alias("b"), "v", F.col("o").alias("ob")), ["b", "v"])
    low = F.col("oa") + F.col("ob") - F.col("sv")
    high = F.least("oa", "ob") + F.least(F.col("sa") - F.col("oa"), F.col("sb") - F.col("ob"))
    bounds = side.groupBy("a", "b").agg(F.max(low).alias("low"), F.min(high).alias("high"))
    return new.join(bounds, ["a", "b"], "left")


def _overlaps(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, sa, sb, o): the exact overlap of each pair; shingles that no other text holds cannot be in it."""
    left = classes.select(F.col("c").alias("a"), F.col("toks").alias("ta"))
    right = classes.select(F.col("c").alias("b"), F.col("toks").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb", F.size(F.array_intersect("ta", "tb")).cast("long").alias("o"))


def links(classes: DataFrame, percent: int = 90, short: int = SHORT) -> tuple[DataFrame, DataFrame]:
    """(edges (a, b), labels (node, label)) of classes (c, size, toks): every edge is a true link, and edges connect exactly
    what all links connect."""
    spark = classes.sparkSession
    live = materialize(_postings(classes, percent).withColumn("label", F.col("c")), spark, "postings")
    known = spark.createDataFrame([], "a long, b long, sa long, sb long, o long")
    edges = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "node long, label long")
    turn = 0
    while True:
        live = materialize(_marked(live, turn, short), spark, "live")
        if empty(live):
            return edges, materialize(components(edges), spark, "components")
        pairs = _pairs(live, live.where("pivot"), percent)
        need = needed(F.col("sa"), F.col("sb"), percent)
        if turn:
            pairs = _derived(pairs, known).where(F.col("high").isNull() | (F.col("high") >= need))
            sure, unsure = F.col("low") >= need, F.col("low").isNull() | (F.col("low") < need)
        else:
            sure, unsure = F.lit(False), F.lit(True)
        pairs = materialize(pairs, spark, "pairs")
        seen = materialize(_overlaps(pairs.where(unsure).select("a", "b", "sa", "sb"), classes), spark, "overlaps")
        known = known.unionByName(seen)
        new = materialize(pairs.where(sure).select("a", "b").unionByName(seen.where(F.col("o") >= need).select("a", "b")), spark, "edges")
        if not empty(new):
            edges = edges.unionByName(new)
            labels = materialize(_hooked(labels, new), spark, "labels")
        rest = live.where("not pivot").drop("pivot", "label")
        live = rest.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
        turn += 1


def _hooked(labels: DataFrame, new: DataFrame) -> DataFrame:
    """``labels`` (node, label) after further edges: every label gives way to the least one beside it. Nodes of one label are
    connected, those of two may be; one step is enough to see the families, as they surround their pivots."""
    a, b = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    at = new.join(a, "a", "left").join(b, "b", "left").select(F.inline(F.array(
        F.struct(F.col("a").alias("node"), F.coalesce("la", "a").alias("label"), F.coalesce("lb", "b").alias("to")),
        F.struct(F.col("b").alias("node"), F.coalesce("lb", "b").alias("label"), F.coalesce("la", "a").alias("to")))))
    to = at.groupBy("label").agg(F.min("to").alias("to"))
    nodes = labels.unionByName(at.select("node", "label")).distinct()
    return nodes.join(to, "label", "left").select("node", F.least("to", "label").alias("label"))


def near_sets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id long, n_shingles long, component_id long) of every row: the size of its set of word shingles and the least id that
    links reach.

    A-Z are lower-cased, words stand between ASCII white space; a text of fewer words than a shingle is one shingle. Sets link
    when 100 times their overlap is at least ``percent`` times their union. A text without words, or a null one, is linked with
    nothing: its component is its own id. ``component_id`` is the least non-null id, so null only where all ids are. Repeated
    rows stay, each with the same component; an empty table gives an empty result; other columns are not read. Shingles are
    compared by 64-bit hashes, sets by 128-bit ones.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    ship_package(spark)
    rows = sets(docs, id_col=id_col, text_col=text_col, words=words, percent=percent, chunk_bytes=chunk_bytes)
    some = rows.where("size > 0").groupBy("k1", "k2").agg(F.min("id").alias("least"), F.min(F.when(F.col("toks").isNotNull(), F.col("row"))).alias("c"))
    some = materialize(some, spark, "classes")
    chosen = rows.select("row", "size", "toks").join(some.select(F.col("c").alias("row")), "row").select(F.col("row").alias("c"), "size", "toks")
    n = n_shards(spark)
    with in_buckets(chosen.repartition(n, "c"), "c", n, "classes") as classes:
        _, labels = links(classes, percent)
    named = some.join(labels.withColumnRenamed("node", "c"), "c")
    least = named.groupBy("label").agg(F.min("least").alias("reach"))
    reached = named.join(least, "label").select("k1", "k2", "reach")
    components_ = materialize(some.join(reached, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("reach", "least").alias("component_id")), spark, "reached")
    out = rows.select("id", "size", "k1", "k2").join(components_, ["k1", "k2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
                      F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
