"""Longest-processing-time sharding: equal texts stay together, large groups first, each to the least loaded shard."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, require, ship_package

#: Parts into which a size class or a shard is cut before rows are numbered in it.
PARTS = 1024
#: Bytes that a row costs besides its text.
ROW_BYTES = 16


def assign_classes(classes, shards: int):
    """Greedy runs for (size, count) classes in falling order of size: yields (size, first, end, shard).

    The heap holds (load, shard). Items of one class are alike, so a class of many items is dealt in whole
    rounds: every shard whose load stays under the highest level that the class fills takes items at once, and the
    heap deals only the last few; loads are those of dealing all one by one.
    """
    heap = [(0, s) for s in range(shards)]
    heapq.heapify(heap)
    for size, count in classes:
        size, count, first = int(size), int(count), 0
        if count > 4 * shards:
            # largest level that uses at most count items, when each shard is filled while its load is below it
            low, high = heap[0][0], max(heap)[0] + size * (count // shards + 2)
            need = lambda level: sum(max(0, -(-(level - load) // size)) for load, _ in heap)
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if need(mid) <= count else (low, mid - 1)
            filled = []
            for load, s in sorted(heap, key=lambda x: x[1]):
                k = max(0, -(-(low - load) // size))
                if k:
                    yield size, first, first + k, s
                    first += k
                filled.append((load + k * size, s))
            heap = filled
            heapq.heapify(heap)
        runs: dict[int, int] = {}
        for _ in range(count - first):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            runs[s] = runs.get(s, 0) + 1
        for s in sorted(runs):
            yield size, first, first + runs[s], s
            first += runs[s]


def _numbered(df: DataFrame, group: str, order: list[str], name: str, part) -> DataFrame:
    """``df`` with a gapless ``name`` from 0 within each ``group``, in order of (part, order).

    Rows are numbered within (group, part); the parts' counts, at most ``PARTS`` a group, give each part its start. No
    task sorts a whole group.
    """
    parted = df.withColumn("__part", part)
    counts = parted.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "__part", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__start"))
    inner = parted.withColumn("__r", F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order)))
    return inner.join(starts, [group, "__part"]).withColumn(name, (F.col("__start") + F.col("__r") - 1).cast("long")).drop("__part", "__r", "__start")


def shard(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size long, text_crc32 long, law, shard int, slot long, grown_shard int) of every row.

    Law ``bytes``: rows of one text form a group that stays together; groups go in falling order of their bytes, ties
    by a digest of the text, each to the least loaded shard. The plan needs only how many groups have each size:
    distinct sizes are at most the root of twice the bytes, and one task walks that table with the heap. Rows keep to
    slim columns (no text is shuffled) and a hot text costs no more than its rows. ``grown_shard`` is null, as
    adding a shard under this law deals anew.

    A null text has no bytes and CRC 0 and is a group apart from the empty text. Null ids and repeated rows each
    get a slot of their own; an empty table gives an empty result; other columns are not read.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    ship_package(spark)
    text = F.col(text_col)
    slim = materialize(docs.select(
        F.col(id_col), (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.md5(text), F.lit("null")).alias("__text")), spark, "slim")
    groups = slim.groupBy("__text").agg(F.sum("size").alias("__bytes"))

    def plan(pdf):
        import pandas as pd
        pdf = pdf.sort_values("__bytes", ascending=False)
        return pd.DataFrame(list(assign_classes(zip(pdf["__bytes"], pdf["__n"]), shards)), columns=["__bytes", "__first", "__end", "shard"])

    classes = groups.groupBy("__bytes").agg(F.count("*").alias("__n"))
    runs = materialize(classes.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(plan, "__bytes long, __first long, __end long, shard int"), spark, "runs")
    part = F.pmod(F.xxhash64("__text"), F.lit(PARTS))
    ranked = _numbered(groups, "__bytes", ["__text"], "__rank", part)
    r, g = runs.alias("r"), ranked.alias("g")
    placed = g.join(r, (F.col("g.__bytes") == F.col("r.__bytes")) & (F.col("g.__rank") >= F.col("r.__first")) & (F.col("g.__rank") < F.col("r.__end"))
                    ).select("g.__text", "r.shard")
    rows = slim.join(placed, "__text")
    out = _numbered(rows, "shard", [id_col, "__text"], "slot", F.pmod(F.xxhash64(id_col, "__text"), F.lit(PARTS)))
    return out.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
