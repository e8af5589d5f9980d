"""Complete-linkage trees of features (operator T11): merges, blocks and display order.

Distances stay a table (a, b, d). A round merges all pairs that are each other's nearest at once, which for complete
linkage gives the tree of one merge after another; new distances are maxima by one aggregation. Ties go to the pair of
least names, so a tree does not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

MERGES = "height double, left string, right string"


def row_distances(corr: DataFrame, places: int = 9) -> DataFrame:
    """(a, b, d) for a < b: Euclidean distance of two features' rows in a correlation table (f1, f2, rho), a missing
    correlation being 0; rounded, so that equal distances are equal on every engine."""
    corr = materialize(corr, name="corr")                                   # read for its names and for its rows
    names = sorted(r[0] for r in corr.select("f1").distinct().collect())    # p names
    have = corr.where(F.col("rho").isNotNull()).groupBy("f1").agg(F.map_from_entries(F.collect_list(F.struct("f2", "rho"))).alias("m"))
    rows = corr.select("f1").distinct().join(have, "f1", "left").select("f1", F.array(*[F.coalesce(F.col("m")[n], F.lit(0.0)) for n in names] or [F.lit(0.0)]).alias("r"))
    rows = materialize(rows, name="corr-rows")                              # p rows of p numbers
    a, b = rows.select(F.col("f1").alias("a"), F.col("r").alias("ra")), rows.select(F.col("f1").alias("b"), F.col("r").alias("rb"))
    square = F.aggregate(F.zip_with("ra", "rb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(F.sqrt(square), places).alias("d"))


def row_means(corr: DataFrame, places: int = 9) -> DataFrame:
    """(feature, mean) over all features of the table, a missing correlation being 0."""
    p = corr.select("f1").distinct().agg(F.count(F.lit(1))).scalar()
    return corr.groupBy(F.col("f1").alias("feature")).agg(F.sum(F.coalesce("rho", F.lit(0.0))).alias("s")) \
        .select("feature", F.round(F.col("s") / p, places).alias("mean"))


def complete_linkage(dist: DataFrame) -> DataFrame:
    """(height, left, right) of all p - 1 merges of distances (a, b, d), a < b. A cluster goes by its least feature, and a merge
    joins ``right`` to ``left``. No distance gives no merge."""
    spark = dist.sparkSession
    live = materialize(dist.select(F.inline(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y"), "d"),
                                                    F.struct(F.col("b").alias("x"), F.col("a").alias("y"), "d")))), spark, "linkage")
    done: list[tuple] = []                                              # p - 1 rows at last
    while True:
        nearest = live.groupBy("x").agg(F.min(F.struct("d", F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"))).alias("m"))
        both = nearest.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        merged = [tuple(r) for r in both.select("m.d", "m.left", "m.right").collect()]
        if not merged:
            return spark.createDataFrame(done, MERGES)
        done += merged
        to = F.broadcast(spark.createDataFrame([(right, left) for _, left, right in merged], "right string, left string"))      # a row a merge
        moved = live.join(to.select(F.col("right").alias("x"), F.col("left").alias("nx")), "x", "left") \
            .join(to.select(F.col("right").alias("y"), F.col("left").alias("ny")), "y", "left") \
            .select(F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y"), "d").where("x <> y")
        live = materialize(moved.groupBy("x", "y").agg(F.max("d").alias("d")), spark, "linkage")


def _ordered(merges: DataFrame) -> list:
    return [tuple(r) for r in merges.orderBy("height", "left", "right").select("height", "left", "right").collect()]      # p - 1 rows


def cut(merges: DataFrame, features: DataFrame, k: int = 4) -> DataFrame:
    """(feature, block): the tree of ``features`` (feature) cut into ``k`` blocks, numbered by their least features. Fewer features
    give a block each."""
    names = sorted(r[0] for r in features.select("feature").distinct().collect())
    of = {n: n for n in names}
    for _, left, right in _ordered(merges)[:max(0, len(names) - k)]:
        of = {n: left if c == right else c for n, c in of.items()}
    number = {c: i + 1 for i, c in enumerate(sorted(set(of.values())))}
    return merges.sparkSession.createDataFrame([(n, number[of[n]]) for n in names], "feature string, block int")


def leaf_order(merges: DataFrame, means: DataFrame) -> DataFrame:
    """(feature, position): the leaves of the tree from 1 on. Of two branches the one of the larger mean comes first, where a
    branch's mean is that of its two own branches; equal ones stand by name."""
    branch = {r["feature"]: (-r["mean"], [r["feature"]]) for r in means.collect()}      # p rows
    for _, left, right in _ordered(merges):
        a, b = branch[left], branch.pop(right)
        first, second = (a, b) if a[0] <= b[0] else (b, a)
        branch[left] = ((a[0] + b[0]) / 2, first[1] + second[1])
    leaves: Sequence[str] = [f for _, (_, fs) in sorted(branch.items()) for f in fs]
    return merges.sparkSession.createDataFrame([(f, i + 1) for i, f in enumerate(leaves)], "feature string, position int")
