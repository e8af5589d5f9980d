"""Aggregations, rankings, reshapes and joins (operators G, W, H, K).

Every aggregate is a single ``groupBy`` with map-side partial aggregation.
Rankings run on already-aggregated (bounded) tables, never over raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import row_sum, yes_no_code


def _yes_count(c: str) -> Column:
    return F.sum(F.when(F.col(c) == "Yes", 1).otherwise(0)).cast("long")


# G1 -------------------------------------------------------------------------
def label_summary(q: DataFrame, answers: Sequence[str], label: str = "label", freq: str = "freq_num",
                  flag: str = "any_flag") -> DataFrame:
    """Per label: n, "Yes" count per answer, frequency mean/min/max ignoring
    missing, flagged count and percent - one aggregation pass."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [_yes_count(a).alias(f"yes_{a}") for a in answers]
    aggs += [F.avg(freq).alias("freq_mean"), F.min(freq).alias("freq_min"), F.max(freq).alias("freq_max"),
             F.sum(flag).cast("long").alias("any_count")]
    return (q.groupBy(label).agg(*aggs)
            .withColumn("any_perc", F.lit(100.0) * F.col("any_count") / F.col("n")))


# G2 -------------------------------------------------------------------------
def contingency(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    """Counts of ``row`` x ``col`` for the given column values, zeros filled."""
    aggs = [F.sum(F.when(F.col(col) == F.lit(v), 1).otherwise(0)).cast("long").alias(f"n_{v}") for v in values]
    return df.groupBy(row).agg(*aggs)


# G3 -------------------------------------------------------------------------
def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name))


# G4 -------------------------------------------------------------------------
def median_group_size(df: DataFrame, group: str) -> DataFrame:
    """Exact median (even counts averaged) of the group sizes. Groups are counted by size first: the distinct sizes,
    at most the root of twice the rows, are all that one task sees."""
    from tessera.operators.stats import feature_medians
    sizes = value_counts(df, group).select(F.lit(0).alias("all"), "n")
    return feature_medians(sizes, "all", "n").select(F.col("median").alias("median_n"))


# G5 -------------------------------------------------------------------------
def answer_counts(q: DataFrame, answers: Sequence[str], by: str = "label") -> DataFrame:
    """(question, value, by, n) over Yes/No answers only (H1 + F2 + count)."""
    long = unpivot(q.select(by, *answers), [by], answers, "question", "value")
    return (long.where(F.col("value").isin("Yes", "No"))
            .groupBy("question", "value", by).agg(F.count(F.lit(1)).alias("n")))


# G6 -------------------------------------------------------------------------
def frequency_counts(q: DataFrame, freq: str = "freq_num", by: str = "label", lo: float = 0, hi: float = 5):
    return (q.where(F.col(freq).between(lo, hi))
            .groupBy(by, F.col(freq).alias("freq")).agg(F.count(F.lit(1)).alias("n")))


# G7 -------------------------------------------------------------------------
def cluster_means(scored: DataFrame, key: str = "id", cluster: str = "cluster", score: str = "score") -> DataFrame:
    """Mean score per (post, cluster), rounded half-even to 2 places."""
    return (scored.groupBy(key, cluster)
            .agg(F.bround(F.avg(score), 2).alias("mean_score")))


# G8 -------------------------------------------------------------------------
def collapse_to_map(df: DataFrame, key: str, map_key: str, value: str, order: str | None = None,
                    name: str = "m") -> DataFrame:
    """One map per ``key``. A repeated map key keeps the entry with the largest
    ``order`` (last wins); the map is bounded by the keys of one row group."""
    dedup = df.groupBy(key, map_key).agg(
        (F.max_by(value, order) if order else F.last(value)).alias(value))
    entries = F.array_sort(F.collect_list(F.struct(F.col(map_key).alias("k"), F.col(value).alias("v"))))
    return dedup.groupBy(key).agg(F.map_from_entries(entries).alias(name))


# G9 -------------------------------------------------------------------------
def composition(df: DataFrame, group: str, part: str) -> DataFrame:
    """Share of each ``part`` inside each ``group``."""
    counts = df.groupBy(group, part).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("prop", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


# G10 ------------------------------------------------------------------------
def answer_proportions(df: DataFrame, answers: Sequence[str], group: str) -> DataFrame:
    """Share of each answer value per (question, group); unknown answers are
    kept as their own value ("NA")."""
    long = unpivot(df.select(group, *answers), [group], answers, "question", "value")
    long = long.withColumn("value", F.coalesce(F.col("value").cast("string"), F.lit("NA")))
    counts = long.groupBy("question", group, "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("prop", F.col("n") / F.sum("n").over(Window.partitionBy("question", group)))


# G11 ------------------------------------------------------------------------
def score_distribution(df: DataFrame, group: str, score: str) -> DataFrame:
    """Per group: n, mean, standard error, median of the score."""
    return (df.where(F.col(score).isNotNull()).groupBy(group)
            .agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"),
                 (F.stddev_samp(score) / F.sqrt(F.count(F.lit(1)))).alias("se"),
                 F.median(score).alias("median")))


def score_histogram(df: DataFrame, group: str, score: str) -> DataFrame:
    """Integer-score histogram per group (density data)."""
    counts = df.where(F.col(score).isNotNull()).groupBy(group, F.col(score).alias("score")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def score_density(df: DataFrame, group: str, score: str, points: int = 512) -> DataFrame:
    """(group, x, density): Gaussian kernel density of the score from its least to its largest value, on ``points`` places,
    or the one place where these are equal.

    The bandwidth is R's default, 0.9 min(sd, IQR / 1.34) n^-0.2; where the smaller is 0 it is the sd, else the least value's size,
    else 1. A group of one value has no sd and takes the latter two. Sums run over the distinct values with their counts.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(group, F.col(score).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    by = counts.groupBy(group).agg(
        F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), (F.sum(F.col("c") * F.col("v")) / F.sum("c")).alias("m"),
        (F.expr("percentile(v, 0.75, c)") - F.expr("percentile(v, 0.25, c)")).alias("iqr"))
    sd = counts.join(by.select(group, "m", "n"), group).groupBy(group).agg(
        F.sqrt(F.try_divide(F.sum(F.col("c") * (F.col("v") - F.col("m")) * (F.col("v") - F.col("m"))), F.max("n") - 1)).alias("sd"))
    some = lambda c: F.when(c > 0, c)
    width = F.coalesce(some(F.least(F.coalesce("sd", F.lit(0.0)), F.col("iqr") / 1.34)), some(F.col("sd")), some(F.abs("lo")), F.lit(1.0))
    grid = by.join(sd, group).withColumn("h", 0.9 * width * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    grid = grid.select(group, "n", "h", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points - 1)))).alias("x"))
    z = (F.col("x") - F.col("v")) / F.col("h")
    return grid.join(counts, group).groupBy(group, "x").agg(
        (F.sum(F.col("c") * F.exp(-z * z / 2)) / F.max(F.col("n") * F.col("h") * F.sqrt(2 * F.pi()))).alias("density"))


# G12 ------------------------------------------------------------------------
def missing_counts(long: DataFrame, posts: DataFrame, key: str = "id", feature: str = "feature_id",
                   value: str = "rating") -> DataFrame:
    """Posts lacking a (numeric) value, per feature: posts - non-null values.
    The post count is a one-row aggregate; no posts x features grid is built."""
    n_posts = posts.agg(F.count(key)).scalar()       # scalar subquery, no join; ids are unique
    per = long.groupBy(feature).agg(F.count(value).alias("n_rated"))
    return per.select(feature, n_posts.alias("n_posts"), "n_rated", (n_posts - F.col("n_rated")).alias("n_missing"))


# G14 ------------------------------------------------------------------------
def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


# W1 -------------------------------------------------------------------------
def top_k_with_ties(counts: DataFrame, k: int, by: str = "n", desc: bool = True,
                    partition: str | None = None) -> DataFrame:
    """Rows whose rank (``rank()``, ties share a rank) is within ``k``.

    Without a partition column the k-th value is found with a bounded
    ordered limit (per-partition top-k, no global sort) and everything at
    least as good is kept; the rank is then computed over the kept rows only.
    """
    order = F.col(by).desc() if desc else F.col(by).asc()
    if partition is not None:
        w = Window.partitionBy(partition).orderBy(order)
        return counts.withColumn("rank", F.rank().over(w)).where(F.col("rank") <= k)
    kth = counts.select(by).orderBy(order).limit(k).agg(F.min(by) if desc else F.max(by)).scalar()
    kept = counts.where((F.col(by) >= kth) if desc else (F.col(by) <= kth))
    # ties can make the kept rows many, but they hold at most k distinct values: rank those
    # (1 + rows strictly better) on a <= k-row table and broadcast it back
    levels = kept.groupBy(by).agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy().orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = levels.select(by, (F.sum("_cnt").over(w) - F.col("_cnt") + 1).cast("int").alias("rank"))
    return kept.join(F.broadcast(levels), by)


# W3 / W4 / W5 ----------------------------------------------------------------
def order_within(df: DataFrame, partition: str, by: str, name: str = "order") -> DataFrame:
    """Display position (1..n) of each row within its partition, by ``by``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(partition).orderBy(F.col(by), *[
        F.col(c) for c in df.columns if c not in (partition, by)])))


def with_explicit_order(df: DataFrame, col: str, levels: Sequence[str], name: str = "level_pos") -> DataFrame:
    """Attach the position of ``col`` in an explicit level list (1-based, 0 if absent)."""
    return df.withColumn(name, F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(col)))


def reorder_first(df: DataFrame, first: str) -> DataFrame:
    return df.select(first, *[c for c in df.columns if c != first])


# H1 / H2 ------------------------------------------------------------------------
def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "name",
            value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def pivot_known(df: DataFrame, key: Sequence[str] | str, pivot: str, values: Sequence, value: str,
                agg: str = "first") -> DataFrame:
    """Long -> wide with the value list given (no extra job to discover it)."""
    fn = {"first": F.first, "max": F.max, "avg": F.avg, "sum": F.sum}[agg]
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).pivot(pivot, list(values)).agg(fn(value))


# H4 -------------------------------------------------------------------------
def pivot_discovered(long: DataFrame, key: str, col: str, value: str) -> DataFrame:
    """Long -> wide with a column for every id that occurs, whether defined or not, by name; null where unrated.

    A post's values are one object, and the schema of all objects is aggregated as a variant's in one pass with partial
    aggregates, so nothing but the names of the columns reaches the driver. Of repeated ids in a post the largest value counts; an
    empty table has the key alone."""
    from pyspark.sql.types import StructType
    from tessera.session import materialize
    own = long.where(F.col(col).isNotNull()).groupBy(key, col).agg(F.max(value).alias("v")).groupBy(key) \
        .agg(F.map_from_entries(F.collect_list(F.struct(col, "v"))).alias("m"))                     # a post's ids: bounded by the features
    own = materialize(own, name="rating-objects")
    seen = own.agg(F.schema_of_variant_agg(F.to_variant_object("m"))).first()[0]
    names = StructType.fromDDL(f"o {seen.replace('OBJECT<', 'STRUCT<', 1)}")["o"].dataType.names if seen and seen.startswith("OBJECT<") else []
    return own.select(key, *[F.try_element_at("m", F.lit(n)).alias(n) for n in names])


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# K1 / K2 / K4 -------------------------------------------------------------------
def semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_semi")


def lookup_join(df: DataFrame, lookup: DataFrame, on: str) -> DataFrame:
    """Inner join against a lookup table; duplicate lookup keys fan out.
    Spark broadcasts the lookup where its bytes are below the threshold."""
    return df.join(lookup, on, "inner")


def yes_no_recode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[yes_no_code(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def sum_score(df: DataFrame, cols: Sequence[str], name: str = "sum_score") -> DataFrame:
    return df.withColumn(name, row_sum(cols))
