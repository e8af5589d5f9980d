"""Statistics and models over the long rating table (operators T1-T13).

Data stay long, ``(id, feature_id, value)``, until a model needs vectors.
Aggregates are single ``groupBy`` passes with map-side combine; all-pairs
work (T10) is pre-aggregated into value cells before any window runs; only
per-feature scalars (bounded by the number of features p) reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import log2_ratio, sig_round
from tessera.functions.tails import chisq_pvalue, f_pvalue


# T1 -------------------------------------------------------------------------
def chisq_independence(df: DataFrame, row: str, col: str) -> DataFrame:
    """Pearson chi-squared test of ``row`` x ``col`` (statistic, df, yates).

    Uses only the observed (non-empty) cells: without correction
    X2 = sum((o - e)^2 / e) + N - sum(e), as an empty cell gives its e. Rows
    without a label on either side are left out. For a 2x2 table R applies Yates' correction with
    y = min(0.5, |o - e|); all four |o - e| are equal there, so one observed
    cell gives it and X2 = (d - y)^2 N (1/r1 + 1/r2)(1/c1 + 1/c2).
    No zero-filled grid (cross join) is ever built.
    """
    known = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())        # a missing label is in no table
    cells = known.groupBy(F.col(row).alias("r"), F.col(col).alias("c")).agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy("r").agg(F.sum("o").alias("nr"))
    cols = cells.groupBy("c").agg(F.sum("o").alias("nc"))
    # table totals as scalar subqueries (no join); Spark picks the joins with the margins by their size
    n_all = rows.agg(F.sum("nr")).scalar()
    x = (cells.join(rows, "r").join(cols, "c")
         .withColumn("N", n_all).withColumn("levels_r", rows.agg(F.count(F.lit(1))).scalar())
         .withColumn("inv_r", rows.agg(F.sum(1.0 / F.col("nr"))).scalar())
         .withColumn("levels_c", cols.agg(F.count(F.lit(1))).scalar())
         .withColumn("inv_c", cols.agg(F.sum(1.0 / F.col("nc"))).scalar())
         .withColumn("e", F.col("nr").cast("double") * F.col("nc") / F.col("N")))
    agg = x.groupBy("N", "levels_r", "levels_c", "inv_r", "inv_c").agg(
        F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("e")).alias("s_seen"),
        F.sum("e").alias("e_seen"),                                           # empty cells give their e: N less these
        F.max(F.abs(F.col("o") - F.col("e"))).alias("d"))
    yates = (F.col("levels_r") == 2) & (F.col("levels_c") == 2)
    y = F.least(F.lit(0.5), F.col("d"))
    stat = F.when(yates, (F.col("d") - y) * (F.col("d") - y) * F.col("N") * F.col("inv_r") * F.col("inv_c")) \
        .otherwise(F.col("s_seen") + F.col("N") - F.col("e_seen"))
    return agg.select(stat.alias("statistic"), ((F.col("levels_r") - 1) * (F.col("levels_c") - 1)).alias("df"),
                      yates.alias("yates"), F.col("N").alias("n"))


def with_chisq_p(test: DataFrame) -> DataFrame:
    return test.withColumn("p", chisq_pvalue("statistic", "df"))


# F5 / G12 -------------------------------------------------------------------
def kept_features(long: DataFrame, posts: DataFrame, max_missing_frac: float = 0.5, key: str = "id",
                  feature: str = "feature_id", value: str = "value") -> DataFrame:
    """Features with fewer than ``max_missing_frac * posts`` missing values
    (the reference's absolute rule is 500 of 1,000 posts). Missing = posts -
    non-null values; unknown feature ids are judged like any other."""
    n_posts = posts.agg(F.count(key)).scalar()       # scalar subquery, no join; ids are unique
    per = long.groupBy(feature).agg(F.count(value).alias("n_rated"))
    return per.where((n_posts - F.col("n_rated")) < F.lit(max_missing_frac) * n_posts).select(feature)


def _collect_names(df: DataFrame, col: str) -> list[str]:
    """Driver copy of a bounded name list (features: p values)."""
    return sorted(r[0] for r in df.select(col).distinct().collect())


# T2 -------------------------------------------------------------------------
def feature_medians(long: DataFrame, feature: str = "feature_id", value: str = "value") -> DataFrame:
    """(feature, median): exact, even counts averaged as R's ``median``. Values are counted first, so the window
    runs over a feature's distinct values, not over its rows."""
    cells = (long.where(F.col(value).isNotNull()).groupBy(F.col(feature).alias("f"), F.col(value).alias("v"))
             .agg(F.count(F.lit(1)).alias("c")))
    of = Window.partitionBy("f")
    upto = F.sum("c").over(of.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = cells.withColumn("twice", 2 * upto).withColumn("n", F.sum("c").over(of))
    lower = F.min(F.when(F.col("twice") >= F.col("n"), F.col("v")))
    upper = F.min(F.when(F.col("twice") > F.col("n"), F.col("v")))
    return x.groupBy(F.col("f").alias(feature)).agg(((lower + upper) / 2).alias("median"))


def median_impute(long: DataFrame, posts: DataFrame, features: Sequence[str], key: str = "id",
                  feature: str = "feature_id", value: str = "value") -> DataFrame:
    """Dense post x feature values, missing ones replaced by the feature's exact median.

    Long -> wide by one ``groupBy(id).pivot`` with the known feature list;
    posts without any value still get a row (left join from ``posts``, whose
    keys are unique); the p medians are literals. Returns the wide table
    (id, one column per feature)."""
    feats = list(features)
    lv = long.where(F.col(feature).isin(feats))
    meds = {r[0]: r[1] for r in feature_medians(lv, feature, value).collect()}       # p numbers
    wide = lv.groupBy(key).pivot(feature, feats).agg(F.first(value, ignorenulls=True))
    full = posts.select(key).join(wide, key, "left")
    return full.select(key, *[F.coalesce(F.col(f"`{f}`"), F.lit(meds.get(f)).cast("double")).alias(f) for f in feats])


def to_long(wide: DataFrame, key: str = "id", feature: str = "feature_id", value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """One row per key and feature; ``keep`` names further columns that stay."""
    cols = [c for c in wide.columns if c != key and c not in keep]
    return wide.unpivot([key, *keep], cols, feature, value)


def clustered_long(wide: DataFrame, clusters: DataFrame, key: str = "id", cluster: str = "cluster") -> DataFrame:
    """Values with their post's cluster: joined while a post is one row, then unpivoted."""
    return to_long(wide.join(clusters.select(key, cluster), key), key, keep=(cluster,))


# T3 -------------------------------------------------------------------------
def zscore(wide: DataFrame, key: str = "id") -> tuple[DataFrame, list[str]]:
    """Column z-scores with the sample sd (n - 1). Constant columns (sd 0 or
    undefined) cannot be scaled; they are dropped and returned by name."""
    cols = [c for c in wide.columns if c != key]
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(f"`{c}`").alias(f"m{i}"), F.stddev_samp(f"`{c}`").alias(f"s{i}")]
    stats = wide.agg(*aggs).first()
    keep, dropped = [], []
    for i, c in enumerate(cols):
        sd = stats[f"s{i}"]
        (keep if sd is not None and sd > 0 else dropped).append((i, c))
    out = wide.select(key, *[((F.col(f"`{c}`") - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"])).alias(c)
                             for i, c in keep])
    return out, [c for _, c in dropped]


# T5 / T6 / G13 ----------------------------------------------------------------
def one_vs_rest_anova(values: DataFrame, clusters: DataFrame | None = None, key: str = "id", feature: str = "feature_id",
                      value: str = "value", cluster: str = "cluster") -> DataFrame:
    """Every one-vs-rest one-way ANOVA (feature x cluster) from ONE aggregate.

    Per (feature, cluster): n, mean and central sum of squares (var_pop * n,
    numerically stable). Per feature, the total sum of squares is combined
    from the cluster moments (Chan et al.), and the "rest" group is total
    minus cluster. SSB = n_in n_out / N (mean_in - mean_out)^2, SSW = T - SSB,
    F = SSB / (SSW / (N - 2)), ges = SSB / T. The windows run on the small
    (features x clusters) table. ``f_raw`` is the full F; F and ges are rounded to 3 decimals as the
    reference's test table is.
    """
    v = values if clusters is None else values.join(clusters.select(key, cluster), key)
    g = (v.groupBy(feature, cluster)
         .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("vp")))
    w = Window.partitionBy(feature)
    g = (g.withColumn("n_all", F.sum("n").over(w))
         .withColumn("s_all", F.sum(F.col("n") * F.col("mean")).over(w))
         .withColumn("gm", F.col("s_all") / F.col("n_all")))
    g = g.withColumn("t_ss", F.sum(F.col("vp") * F.col("n") + F.col("n") * (F.col("mean") - F.col("gm")) ** 2).over(w))
    n_out = F.col("n_all") - F.col("n")
    g = g.withColumn("mean_out", F.when(n_out > 0, (F.col("s_all") - F.col("n") * F.col("mean")) / n_out))
    g = g.withColumn("ssb", F.col("n") * n_out / F.col("n_all") * (F.col("mean") - F.col("mean_out")) ** 2)
    ssw = F.col("t_ss") - F.col("ssb")
    fstat = F.when((ssw > 0) & (F.col("n_all") > 2), F.col("ssb") / (ssw / (F.col("n_all") - 2)))
    ges = F.when(F.col("t_ss") > 0, F.col("ssb") / F.col("t_ss"))
    return g.select(F.col(feature).alias("feature"), F.col(cluster).alias("cluster"),
                    F.col("mean").alias("mean_in_cluster"), F.col("mean_out").alias("mean_out_cluster"),
                    F.lit(1).alias("dfn"), (F.col("n_all") - 2).cast("long").alias("dfd"), fstat.alias("f_raw"),
                    F.round(fstat, 3).alias("f"), F.round(ges, 3).alias("ges"))


def bonferroni(tests: DataFrame, alpha: float = 0.05, by: str = "cluster") -> DataFrame:
    """Alpha / number of tests in the same one-vs-rest family."""
    return tests.withColumn("bonferroni_threshold", F.lit(alpha) / F.count(F.lit(1)).over(Window.partitionBy(by)))


def with_p(tests: DataFrame) -> DataFrame:
    """P of the unrounded F(dfn, dfd), rounded to 3 significant digits as published."""
    return tests.withColumn("p", sig_round(f_pvalue("f_raw", "dfn", "dfd"), 3))


# X10 + F6 + F7 + W2 + X2/X4/X5: T13 ----------------------------------------------
def marker_table(tests: DataFrame, top: int = 15) -> DataFrame:
    """Significant (rounded p < threshold), positive fold change, top ``top``
    per cluster by largest unrounded F (the order of p, also where p underflows),
    ties kept, plus display columns."""
    t = with_p(bonferroni(tests))
    t = (t.withColumn("p_adj_sig", F.col("p") < F.col("bonferroni_threshold")).where("p_adj_sig")
         .withColumn("log2fc", log2_ratio("mean_in_cluster", "mean_out_cluster"))
         .where(F.col("log2fc") > 0))
    ranked = t.withColumn("rank", F.rank().over(Window.partitionBy("cluster").orderBy(F.col("f_raw").desc())))
    return (ranked.where(F.col("rank") <= top)
            .withColumn("group", F.substring_index("feature", "_", 1))
            .withColumn("cluster_name", F.concat(F.lit("Cluster "), F.col("cluster").cast("string")))
            .withColumn("feature_name", F.replace(F.col("feature"), F.lit("_"), F.lit(" "))))


def top_by_f(tests: DataFrame, top: int = 15) -> DataFrame:
    """W2 without p: rank by F descending (same order as p for equal df,
    immune to p underflow), ties kept."""
    return (tests.withColumn("rank", F.rank().over(Window.partitionBy("cluster").orderBy(F.col("f_raw").desc())))
            .where(F.col("rank") <= top))


# T12 ------------------------------------------------------------------------
def fold_change_table(tests: DataFrame, clusters: Sequence[int], clamp_cluster: bool = True) -> DataFrame:
    """One row per feature, one log2FC column per cluster (``fc_<k>``), plus
    ``fcp_<k>`` with -Inf clamped to 0 for plotting (every cluster)."""
    t = tests.withColumn("log2fc", log2_ratio("mean_in_cluster", "mean_out_cluster"))
    wide = t.groupBy("feature").pivot("cluster", list(clusters)).agg(F.first("log2fc"))
    out = wide.select("feature", *[F.col(f"`{k}`").alias(f"fc_{k}") for k in clusters])
    if clamp_cluster:
        out = out.select("*", *[F.when(F.col(f"fc_{k}") == float("-inf"), 0.0).otherwise(F.col(f"fc_{k}"))
                                .alias(f"fcp_{k}") for k in clusters])
    return out


# T10 ------------------------------------------------------------------------
#: Distinct values that one window of the ranks covers, about; a feature has as many ranges as its values need.
VALUES_A_RANGE = 50_000


def _range_of(v: str, cuts: str, ranges: int) -> Column:
    """How many of a feature's sorted ``ranges`` - 1 cuts lie below a value: coarse steps first, then the cuts of one step."""
    step = max(1, math.isqrt(ranges))
    below = lambda some: F.size(F.filter(some, lambda t: t < F.col(v)))
    if ranges <= step:
        return F.lit(0)
    coarse = F.transform(F.sequence(F.lit(step), F.lit(max(step, (ranges - 1) // step * step)), F.lit(step)), lambda i: F.element_at(cuts, i))
    g = below(coarse) * step
    return g + below(F.slice(cuts, g + 1, F.lit(step)))


def _mid_ranks(counted: DataFrame, per: DataFrame, keys: Sequence[str], f: str, v: str, ranges: int) -> DataFrame:
    """(keys, v, d): exact mid-rank of each value in its group, less (n + 1) / 2, from value counts (keys, v, k).

    A value is one row, however many posts have it. Cuts of the feature ``f`` (``per``: f, cuts) split its values into ranges; a
    window numbers one range, and the totals of the ranges before it are added. The cuts only divide the work."""
    x = counted.withColumn("b", F.lit(0)) if ranges < 2 else \
        counted.join(per.select(F.col("f").alias(f), "cuts"), f).withColumn("b", _range_of(v, "cuts", ranges)).drop("cuts")
    one = Window.partitionBy(*keys, "b").orderBy(v).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("upto", F.sum("k").over(one))
    group = Window.partitionBy(*keys)
    before = group.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    tot = (x.groupBy(*keys, "b").agg(F.sum("k").alias("t"))
           .select(*keys, "b", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("off"), F.sum("t").over(group).alias("n")))
    d = F.col("off") + F.col("upto") - (F.col("k") - 1) / 2.0 - (F.col("n") + 1) / 2.0
    return x.join(tot, [*keys, "b"]).select(*keys, v, d.alias("d"))


def _cut_points(v: DataFrame, most: int) -> tuple[DataFrame, int]:
    """((f, n, lo, hi, cuts) of long (f, v), ranges) where a feature has up to ``most`` distinct values."""
    from tessera.session import materialize
    ranges = 1 + most // VALUES_A_RANGE
    cuts = F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 10_000) if ranges > 1 else F.array().cast("array<double>")
    return materialize(v.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), cuts.alias("cuts")),
                       name="spearman-features"), ranges


def spearman_pairwise(long: DataFrame, key: str = "id", feature: str = "feature_id", value: str = "value",
                      full: bool = True, features: Sequence[str] | None = None) -> DataFrame:
    """Spearman correlation of every feature pair on that pair's complete
    posts, ties as mid-ranks (R ``cor(..., "pairwise.complete.obs", "spearman")``).

    Plan: self-join on id (f1 < f2), then count (f1, f2, v1, v2) cells - the
    map-side partial aggregate shrinks posts x p^2/2 rows to at most
    p^2/2 x (distinct values)^2 cells. Mid-ranks come from the marginal counts
    (f1, f2, value) alone, range by range (``_mid_ranks``), centred at (n+1)/2
    before the weighted sums, so no large-number cancellation. A constant side
    gives NULL. The plan is the same for few and for many values.
    """
    if features is not None:
        # known (bounded) feature list: one groupBy(id) pivot shuffle, then row-local pairs.
        # Halves the raw-row shuffle of the self-join, but at small scale the p^2/2-struct
        # projection costs more than it saves (sf0.1: ~17 s vs ~3 s), so it is opt-in.
        feats = sorted(features)
        wide = (long.where(F.col(feature).isin(feats) & F.col(value).isNotNull())
                .groupBy(key).pivot(feature, feats).agg(F.first(value)))
        return spearman_pairwise_wide(wide, feats, full)
    v = long.where(F.col(value).isNotNull()).select(key, F.col(feature).alias("f"), F.col(value).cast("double").alias("v"))
    return _spearman_from_cells(pair_cells(v, key), v.select("f", "v"), full)


def pair_cells(v: DataFrame, key: str = "id") -> DataFrame:
    """(f1, f2, v1, v2, c) of long (key, f, v): how many keys hold each pair of values."""
    a = v.select(key, F.col("f").alias("f1"), F.col("v").alias("v1"))
    b = v.select(key, F.col("f").alias("f2"), F.col("v").alias("v2"))
    return (a.join(b, key).where(F.col("f1") < F.col("f2"))
            .groupBy("f1", "f2", "v1", "v2").agg(F.count(F.lit(1)).alias("c")))


def spearman_pairwise_wide(wide: DataFrame, features: Sequence[str], full: bool = True) -> DataFrame:
    """T10 on a wide table (one row per post, one column per feature, NULL
    where missing) - the shape R's ``cor(mat)`` takes.

    Two features that are missing in the same posts have the same complete posts as each alone, so all such pairs share one
    ranking a feature: values are ranked once, joined to the rows, and one pass sums the products of all pairs row by row. Only pairs with
    different gaps are ranked anew on their own posts, from cells that are counted inside the rows."""
    from tessera.session import materialize
    feats = sorted(features)
    pairs = [(a, b) for i, a in enumerate(feats) for b in feats[i + 1:]]
    at = {f: i for i, f in enumerate(feats)}
    x = materialize(wide.select(*[F.col(f"`{f}`").cast("double").alias(f"v{at[f]}") for f in feats]), name="spearman-wide")
    there = {f: F.col(f"v{at[f]}").isNotNull() for f in feats}
    seen = x.agg(*[F.count_if(there[f]).alias(f"n{at[f]}") for f in feats], *[F.min(f"v{at[f]}").alias(f"lo{at[f]}") for f in feats],
                 *[F.max(f"v{at[f]}").alias(f"hi{at[f]}") for f in feats], *[F.approx_count_distinct(f"v{at[f]}").alias(f"u{at[f]}") for f in feats],
                 *[F.count_if(there[a] & there[b]).alias(f"n{at[a]}_{at[b]}") for a, b in pairs]).first()      # p^2 / 2 numbers
    alike = [(a, b) for a, b in pairs if seen[f"n{at[a]}_{at[b]}"] == seen[f"n{at[a]}"] == seen[f"n{at[b]}"]]
    own = [p for p in pairs if p not in set(alike) and seen[f"n{at[p[0]]}_{at[p[1]]}"]]
    long = x.select(F.inline(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"v{at[f]}").alias("v")) for f in feats]))).where(F.col("v").isNotNull())
    upper = x.sparkSession.createDataFrame([], "f1 string, f2 string, rho double, n_complete long")
    if alike:
        ranked = sorted({f for p in alike for f in p})
        counted = materialize(long.where(F.col("f").isin(ranked)).groupBy("f", "v").agg(F.count(F.lit(1)).alias("k")), name="spearman-values")
        per, ranges = _cut_points(counted, max(seen[f"u{at[f]}"] for f in ranked))
        ranks = materialize(_mid_ranks(counted, per, ("f",), "f", "v", ranges), name="spearman-ranks")
        rows = x
        for f in ranked:
            side = ranks.where(F.col("f") == f).select(F.col("v").alias(f"v{at[f]}"), F.col("d").alias(f"d{at[f]}"))
            few = seen[f"u{at[f]}"] <= VALUES_A_RANGE                        # two numbers a value, so under a megabyte or so
            rows = rows.join(F.broadcast(side) if few else side, f"v{at[f]}", "left")
        d = {f: F.col(f"d{at[f]}") for f in ranked}
        sums = rows.agg(*[F.sum(d[f] * d[f]).alias(f"s{at[f]}") for f in ranked], *[F.sum(d[a] * d[b]).alias(f"s{at[a]}_{at[b]}") for a, b in alike])
        rho = {p: F.when((F.col(f"s{at[p[0]]}") > 0) & (F.col(f"s{at[p[1]]}") > 0), F.col(f"s{at[p[0]]}_{at[p[1]]}")
                         / F.sqrt(F.col(f"s{at[p[0]]}") * F.col(f"s{at[p[1]]}"))) for p in alike}
        found = [F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), rho[a, b].alias("rho"), F.lit(seen[f"n{at[a]}_{at[b]}"]).cast("long").alias("n_complete"))
                 for a, b in alike]
        upper = materialize(sums.select(F.inline(F.array(*found))).where("n_complete > 0"), name="spearman-pairs")
    if own:
        each = F.array(*[F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"v{at[a]}").alias("v1"), F.col(f"v{at[b]}").alias("v2")) for a, b in own])
        cells = x.select(F.inline(each)).where(F.col("v1").isNotNull() & F.col("v2").isNotNull()).groupBy("f1", "f2", "v1", "v2").agg(F.count(F.lit(1)).alias("c"))
        per, ranges = _cut_points(long.where(F.col("f").isin(sorted({f for p in own for f in p}))), max(seen[f"u{at[f]}"] for p in own for f in p))
        upper = upper.unionByName(_from_cells(cells, per, ranges))
    if not full:
        return upper
    alone = [(f, 1.0 if seen[f"lo{at[f]}"] < seen[f"hi{at[f]}"] else None, seen[f"n{at[f]}"]) for f in feats if seen[f"n{at[f]}"]]
    return _both_halves(upper).unionByName(x.sparkSession.createDataFrame([(f, f, r, n) for f, r, n in alone], "f1 string, f2 string, rho double, n_complete long"))


def _spearman_from_cells(cells: DataFrame, v: DataFrame, full: bool) -> DataFrame:
    """Correlations from (f1, f2, v1, v2, c) cells; ``v`` is the long (f, v) table. The p rows about features are written
    once: they are read several times."""
    most = v.groupBy("f").agg(F.approx_count_distinct("v").alias("u")).agg(F.max("u")).first()[0]
    per, ranges = _cut_points(v, most or 0)
    upper = _from_cells(cells, per, ranges)
    if not full:
        return upper
    diag = per.select(F.col("f").alias("f1"), F.col("f").alias("f2"), F.when(F.col("lo") < F.col("hi"), F.lit(1.0)).alias("rho"),
                      F.col("n").alias("n_complete"))
    return _both_halves(upper).unionByName(diag)


def _from_cells(cells: DataFrame, per: DataFrame, ranges: int) -> DataFrame:
    """(f1, f2, rho, n_complete) of each pair's own ranks. Cells are written once: each is read several times."""
    from tessera.session import materialize
    cells = materialize(cells, name="spearman-cells")
    x = cells
    for side in ("1", "2"):
        counted = cells.groupBy("f1", "f2", "v" + side).agg(F.sum("c").alias("k"))
        ranks = _mid_ranks(counted, per, ("f1", "f2"), "f" + side, "v" + side, ranges).withColumnRenamed("d", "d" + side)
        x = x.join(ranks, ["f1", "f2", "v" + side])
    agg = (x.groupBy("f1", "f2").agg(F.sum(F.col("c") * F.col("d1") * F.col("d2")).alias("sxy"),
                                     F.sum(F.col("c") * F.col("d1") * F.col("d1")).alias("sxx"),
                                     F.sum(F.col("c") * F.col("d2") * F.col("d2")).alias("syy"),
                                     F.sum("c").alias("n_complete")))
    rho = F.when((F.col("sxx") > 0) & (F.col("syy") > 0), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")))
    return agg.select("f1", "f2", rho.alias("rho"), "n_complete")


def _both_halves(upper: DataFrame) -> DataFrame:
    both = upper.select(F.inline(F.array(
        F.struct(F.col("f1").alias("a"), F.col("f2").alias("b"), "rho", "n_complete"),
        F.struct(F.col("f2").alias("a"), F.col("f1").alias("b"), "rho", "n_complete"))))
    return both.select(F.col("a").alias("f1"), F.col("b").alias("f2"), "rho", "n_complete")


# MLlib -----------------------------------------------------
def assemble(wide: DataFrame, key: str = "id", out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    cols = [c for c in wide.columns if c != key]
    safe = wide.select(key, *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    return VectorAssembler(inputCols=[f"c{i}" for i in range(len(cols))], outputCol=out).transform(safe) \
        .select(key, out)


def pca_scores(vectors: DataFrame, k: int | None = None, key: str = "id", col: str = "features"):
    """T4: principal-component scores of (already centred) vectors. Signs are
    fixed so each component's largest |loading| is positive. Returns
    (scores DataFrame (id, pcs array<double>), explained variance list)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array
    import numpy as np
    one = vectors.select(col).first()
    if one is None:                                # no rows: no scores, no components
        return vectors.select(key, F.array().cast("array<double>").alias("pcs")), []
    dim = len(one[0])
    k = k or dim
    model = PCA(k=k, inputCol=col, outputCol="pcv").fit(vectors)
    pc = model.pc.toArray()                       # dim x k, bounded by p^2
    signs = [1.0 if pc[np.argmax(np.abs(pc[:, j])), j] >= 0 else -1.0 for j in range(k)]
    arr = vector_to_array(F.col("pcv"))
    scores = model.transform(vectors).select(
        key, F.array(*[arr[j] * F.lit(signs[j]) for j in range(k)]).alias("pcs"))
    return scores, list(model.explainedVariance.toArray())


def _sq_dist(x: str, centre: Sequence[float]) -> Column:
    """Squared distance of an array column from a fixed point."""
    gaps = F.zip_with(F.col(x), F.array(*[F.lit(float(c)) for c in centre]), lambda a, b: (a - b) * (a - b))
    return F.aggregate(gaps, F.lit(0.0), lambda s, d: s + d)


def _distances(x, centres):
    """Squared distances (rows by centres) of points from centres, added up dimension by dimension as ``_sq_dist`` does."""
    import numpy as np
    out = np.zeros((len(x), len(centres)))
    for j in range(centres.shape[1]):
        gap = x[:, j, None] - centres[None, :, j]
        out += gap * gap
    return out


def _matrix(batch, name: str = "x"):
    """An Arrow column of equally long lists as rows of a matrix."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _with_least_distance(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """``points`` with ``d``, the squared distance from the nearest of ``centres``."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        of = np.array(centres)
        for b in batches:
            if b.num_rows:
                least = np.fmin.reduce(_distances(_matrix(b), of), axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least)], names=[*b.schema.names, "d"])

    return points.mapInArrow(run, points.select("*", F.lit(0.0).alias("d")).schema)


def _starts(points: DataFrame, k: int, seed: int, key: str) -> list[list[float]]:
    """k-means++ starts drawn by hash: of all points the one with the least -ln(u) / D^2, where u in (0, 1) comes
    from md5(id, seed, round). That is a draw with weight D^2, and it doesn't depend on partitions. Fewer than
    ``k`` come back where there are fewer distinct points."""
    centres: list[list[float]] = []
    points = points.select(F.col(key).alias("k"), "x")
    for i in range(k):
        digits = F.substring(F.md5(F.concat_ws("|", F.col("k").cast("string"), F.lit(str(seed)), F.lit(str(i)))), 1, 12)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16 ** 12)
        near = _with_least_distance(points, centres) if centres else points.withColumn("d", F.lit(1.0))
        best = near.select("x", "d", F.struct((-F.log(u) / F.col("d")).alias("w"), F.col("k")).alias("o")) \
            .where("d > 0").agg(F.min_by("x", "o")).first()[0]
        if best is None:
            break
        centres.append(list(best))
    return centres


def _sums_by_centre(points: DataFrame, models: dict[int, list[list[float]]]) -> DataFrame:
    """(m, c, n, ss, s): by model and nearest centre (from 1, the first of equally near ones) the number of points, the sum of
    their squared distances and their sum by dimension. A task gives one row a centre, the shuffle adds them up."""
    names = sorted(models)
    dim = len(models[names[0]][0])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        of = {m: np.array(models[m]) for m in names}
        acc = {m: np.zeros((len(of[m]), dim + 2)) for m in names}                # sums, squared distance, number of points
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b)
            for m in names:
                ds = _distances(x, of[m])
                c = np.argmin(np.where(np.isnan(ds), np.inf, ds), axis=1)
                own = ds[np.arange(len(x)), c]
                for j, w in enumerate([*x.T, own, None]):
                    acc[m][:, j] += np.bincount(c, weights=w, minlength=len(of[m]))
        rows = [(m, i + 1, int(a[-1]), float(a[-2]), a[:-2].tolist()) for m in names for i, a in enumerate(acc[m]) if a[-1]]
        if rows:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows), kinds)], names=["m", "c", "n", "ss", "s"])

    parts = points.select("x").mapInArrow(run, "m int, c long, n long, ss double, s array<double>")
    return parts.groupBy("m", "c").agg(F.sum("n").alias("n"), F.sum("ss").alias("ss"), *[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(dim)])


def _lloyd(points: DataFrame, models: dict[int, list[list[float]]], max_iter: int) -> dict[int, dict]:
    """Lloyd steps of several models at once, one scan a step. A centre is a mean rounded to 9 places, so that the
    order of a sum doesn't show. Returns, by model, its centres, sizes and within-cluster sum of squares, in which
    sizes and sum belong to these centres unless ``max_iter`` ended the steps."""
    dim = len(next(iter(models.values()))[0])
    fits = {m: {"centres": c, "sizes": [0] * len(c), "wss": 0.0} for m, c in models.items()}
    live = set(fits)
    for _ in range(max_iter):
        rows = _sums_by_centre(points, {m: fits[m]["centres"] for m in live}).collect()        # a row a centre
        for m in sorted(live):
            own = {r["c"]: r for r in rows if r["m"] == m}
            old = fits[m]["centres"]
            new = [[round(own[i + 1][f"s{j}"] / own[i + 1]["n"], 9) for j in range(dim)] if i + 1 in own else c for i, c in enumerate(old)]
            fits[m] = {"centres": new, "sizes": [own[i + 1]["n"] if i + 1 in own else 0 for i in range(len(old))],
                       "wss": float(sum(r["ss"] for r in own.values()))}
            if new == old:
                live.discard(m)
        if not live:
            break
    return fits


def _points(vectors: DataFrame, key: str, col: str) -> DataFrame:
    """(key, x array) written once, dealt anew by key so that all cores read it: every step does."""
    from pyspark.ml.functions import vector_to_array
    from tessera.session import materialize
    return materialize(vectors.select(key, vector_to_array(col).alias("x")).repartition(key), name="points")


def kmeans_clusters(vectors: DataFrame, k: int = 4, seed: int = 1, key: str = "id", col: str = "features",
                    max_iter: int = 50) -> tuple[DataFrame, float]:
    """K-means; clusters renumbered 1..k by size (desc), then by centroid
    norm. Starts come from hashes of the ids, so a seed gives the same clusters
    however the rows are partitioned. Returns ((id, cluster), cost)."""
    points = _points(vectors, key, col)
    starts = _starts(points, k, seed, key)
    if not starts:
        return points.select(key, F.lit(1).alias("cluster")), 0.0       # no points
    fit = _lloyd(points, {k: starts}, max_iter)[k]
    centres = fit["centres"]
    order = sorted(range(len(centres)), key=lambda i: (-fit["sizes"][i], sum(x * x for x in centres[i])))
    number = {old: new + 1 for new, old in enumerate(order)}
    near = points.select(key, F.array(*[_sq_dist("x", c) for c in centres]).alias("ds"))
    place = F.array_position("ds", F.array_min("ds")).cast("int")
    return near.select(key, F.element_at(F.array(*[F.lit(number[i]) for i in range(len(centres))]), place).alias("cluster")), fit["wss"]


def total_ss(vectors_long: DataFrame, feature: str = "feature_id", value: str = "value") -> DataFrame:
    """Within-cluster SS for k = 1: total sum of squares about column means."""
    return (vectors_long.groupBy(feature).agg((F.var_pop(value) * F.count(value)).alias("ss"))
            .agg(F.sum("ss").alias("wss")))


def elbow(vectors: DataFrame, ks: Sequence[int] = range(1, 11), seed: int = 1, key: str = "id", col: str = "features",
          max_iter: int = 50) -> DataFrame:
    """Total within-cluster SS per k. All k are fitted together, a scan a step; the starts
    of k are the first k of one draw."""
    points = _points(vectors, key, col)
    starts = _starts(points, max(ks), seed, key)
    if not starts:
        return points.sparkSession.createDataFrame([(k, 0.0) for k in ks], "k int, wss double")
    fits = _lloyd(points, {k: starts[:k] for k in ks}, max_iter)
    return points.sparkSession.createDataFrame([(k, fits[k]["wss"]) for k in ks], "k int, wss double")


def feature_blocks(corr: DataFrame, k: int = 4, seed: int = 1) -> DataFrame:
    """Features in ``k`` blocks by their correlation rows with bisecting k-means: for more features than a
    complete-linkage tree (T11, ``linkage``) has room for. No rows give no blocks."""
    from pyspark.ml.clustering import BisectingKMeans
    from tessera.session import materialize
    corr = materialize(corr, name="corr")                                  # read for its names and for its rows
    feats = sorted(r[0] for r in corr.select("f1").distinct().collect())   # p names
    if not feats:
        return corr.select(F.col("f1").alias("feature"), F.lit(1).alias("block"))
    filled = corr.withColumn("rho", F.coalesce("rho", F.lit(0.0)))
    wide = filled.groupBy("f1").pivot("f2", feats).agg(F.first("rho"))
    # p rows of p values: written once so the iterative fit never re-runs the correlation plan
    vec = materialize(assemble(wide.fillna(0.0), key="f1"), name="corr_rows")
    model = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="block").fit(vec)
    return model.transform(vec).select(F.col("f1").alias("feature"), (F.col("block") + 1).alias("block"))
