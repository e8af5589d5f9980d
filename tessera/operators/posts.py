"""Post preparation: ids, seeded sampling, pairing, projections, filters
(operators P1-P7, F1-F8)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_prefix, md5_key


# P1 ------------------------------------------------------------------------
def with_post_id(df: DataFrame, key: str, label: str = "label", out: str = "id") -> DataFrame:
    """``'ID' || key || '_' || label`` from a natural key (never a generated
    row number, which is not stable across plans or retries)."""
    return df.withColumn(out, F.concat(F.lit("ID"), F.col(key).cast("string"), F.lit("_"), F.col(label)))


# P2 ------------------------------------------------------------------------
def sample_n(df: DataFrame, n: int, key: str = "id", seed: str = "1") -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement: the rows with the
    smallest ``md5(key || '|' || seed)`` (ties on key).

    A global sort of every row would funnel all partitions' top-n lists into
    one task. Instead a cheap count fixes a hash-prefix cut that keeps about
    ``n + 6 sqrt(n)`` rows; the ordered limit then runs on those only. If the
    cut ever keeps fewer than ``n`` rows the full input is used, so the result
    is always exact. Reads only the key column for the two counts.
    """
    order = md5_key(key, seed)
    total = df.select(key).count()
    if total <= n:
        return df
    margin = n + 6.0 * math.sqrt(n) + 64.0
    cut = min(1 << 32, int(math.ceil(margin / total * (1 << 32))) + 1)
    cand = df.where(hash_prefix(key, seed, 8) < F.lit(cut))
    if cand.select(key).count() < n:
        cand = df
    return cand.orderBy(order, F.col(key)).limit(n)


# P3 ------------------------------------------------------------------------
def draw_pairs(df: DataFrame, m: int, key: str = "id", seed: str = "pairs") -> DataFrame:
    """Draw ``2m`` distinct rows (P2 order) and pair draw ``i`` with draw
    ``i + m``; with fewer than ``2m`` rows, ``m`` shrinks to half the draws.
    Returns (pair_id, id1, id2). All window work is over the <= 2m draws."""
    draws = (sample_n(df.select(key), 2 * m, key, seed)
             .withColumn("rn", F.row_number().over(Window.orderBy(md5_key(key, seed), F.col(key))))
             .withColumn("half", F.floor(F.count(F.lit(1)).over(Window.partitionBy()) / 2)))
    a = draws.select(F.col("rn").alias("pair_id"), F.col(key).alias("id1"), "half")
    b = draws.select(F.col("rn").alias("rn2"), F.col(key).alias("id2"))
    return (a.where(F.col("pair_id") <= F.col("half"))
            .join(b, F.col("rn2") == F.col("pair_id") + F.col("half"))
            .select("pair_id", "id1", "id2"))


# P4 ------------------------------------------------------------------------
def fetch_pair_texts(pairs: DataFrame, posts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Attach both texts of each pair whose posts are there. The 2m ids of the pairs (m is the caller's bound) are
    broadcast to one scan of the posts; only the texts found are then brought together by pair."""
    side = lambda k: F.struct(F.lit(k).alias("side"), F.col(f"id{k}").alias("__id"))
    sides = pairs.select("pair_id", "id1", "id2", F.explode(F.array(side(1), side(2))).alias("s")).select("pair_id", "id1", "id2", "s.side", "s.__id")
    found = posts.select(F.col(key).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(sides), "__id")
    own = lambda k: F.max(F.when(F.col("side") == k, F.col("__text"))).alias(f"text{k}")
    return (found.groupBy("pair_id", "id1", "id2").agg(own(1), own(2), F.count_distinct("side").alias("__n"))
            .where("__n = 2").drop("__n"))


# P5 ------------------------------------------------------------------------
def add_typed_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add empty typed result columns (name -> type)."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns.items()])


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


# P6 ------------------------------------------------------------------------
def one_per_group(df: DataFrame, group: str, key: str, seed: str = "1") -> DataFrame:
    """One seeded random row per group: the row with the smallest
    ``md5(key || '|' || seed)``. A ``min`` over a struct is partially
    aggregated map-side, so a hot group never lands in one task whole."""
    cols = [c for c in df.columns]
    best = F.min(F.struct(md5_key(key, seed).alias("_h"), F.col(key).alias("_k"),
                          *[F.col(c) for c in cols if c != group]))
    return (df.groupBy(group).agg(best.alias("_b"))
            .select(group, *[F.col("_b")[c].alias(c) for c in cols if c != group]))


# P7 ------------------------------------------------------------------------
def select_prefix(df: DataFrame, prefix: str, keep: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns plus every column starting with ``prefix``, minus ``drop``."""
    cols = [c for c in df.columns if c.startswith(prefix) and c not in drop]
    return df.select(*keep, *cols)


# F1-F8 ----------------------------------------------------------------------
def flagged(df: DataFrame, flag: str = "any_flag") -> DataFrame:
    return df.where(F.col(flag) == 1)


def yes_no_only(df: DataFrame, col: str = "value") -> DataFrame:
    return df.where(F.col(col).isin("Yes", "No"))


def in_range(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    return df.where(F.col(col).between(lo, hi))


def equals(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


def significant(df: DataFrame, p: str = "p", threshold: str = "bonferroni_threshold") -> DataFrame:
    return df.where(F.col(p) < F.col(threshold))


def positive(df: DataFrame, col: str = "log2fc") -> DataFrame:
    return df.where(F.col(col) > 0)

