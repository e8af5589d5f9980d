"""k-means by optimal transfers (operator T7): no single move of a point lowers the within-cluster sum of squares.

A point may leave cluster i for j if n_i / (n_i - 1) d_i^2 exceeds n_j / (n_j + 1) d_j^2, which counts how both centres
follow it. Lloyd's steps give the first clusters; then a round moves many points together, as many of the best
moves as lower the sum most, measured in one scan for several cuts of the list of moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.stats import _lloyd, _points, _sq_dist, _starts
from tessera.session import materialize

#: Cuts of the list of moves that a round measures, as quantiles of their gains; the best move alone is one more.
CUTS = (0.0, 0.5, 0.75, 0.875, 0.9375)
#: A gain below this part of the sum of squares is rounding.
LEAST_GAIN = 1e-12


def _state(points: DataFrame, dim: int, *by: str) -> DataFrame:
    """Size, centre and sum of squares of every cluster (c, x)."""
    return points.groupBy(*by, "c").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("x")[j]).alias(f"m{j}") for j in range(dim)],
                                        F.sum(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)).alias("sq"))


def _sum_of_squares(rows, dim: int) -> float:
    return float(sum(r["sq"] - r["n"] * sum(r[f"m{j}"] ** 2 for j in range(dim)) for r in rows))


def moves(points: DataFrame, rows, dim: int, floor: float = 0.0) -> DataFrame:
    """(key columns, x, c, to, gain) of every point that a single move would lower the sum for, by more than ``floor``."""
    order = sorted(rows, key=lambda r: r["c"])
    centres = [[r[f"m{j}"] for j in range(dim)] for r in order]
    leave = F.array(*[F.lit(float(r["n"]) / (r["n"] - 1) if r["n"] > 1 else 0.0) for r in order])
    join = F.array(*[F.lit(float(r["n"]) / (r["n"] + 1)) for r in order])
    at = F.array_position(F.array(*[F.lit(r["c"]) for r in order]), F.col("c")).cast("int")
    x = points.withColumn("ds", F.array(*[_sq_dist("x", c) for c in centres])).withColumn("at", at)
    costs = F.transform(F.zip_with("ds", join, lambda d, w: d * w), lambda v, i: F.when(i + 1 == F.col("at"), F.lit(float("inf"))).otherwise(v))
    x = x.withColumn("costs", costs).withColumn("gain", F.element_at("ds", F.col("at")) * F.element_at(leave, F.col("at")) - F.array_min("costs"))
    names = F.array(*[F.lit(r["c"]) for r in order])
    to = F.element_at(names, F.array_position("costs", F.array_min("costs")).cast("int"))
    return x.withColumn("to", to).where(F.col("gain") > floor).drop("ds", "at", "costs")


def transfer_clusters(vectors: DataFrame, k: int = 4, seed: int = 1, key: str = "id", col: str = "features", max_rounds: int = 100) -> tuple[DataFrame, float]:
    """((key, cluster int), within-cluster sum of squares) by optimal transfers from Lloyd's clusters.

    Clusters are numbered by size, then by the norm of the centre. The result is the same for any partitioning. Fewer distinct points
    than ``k`` give fewer clusters; no point gives an empty table.
    """
    points = _points(vectors, key, col)
    starts = _starts(points, k, seed, key)
    if not starts:
        return points.select(key, F.lit(1).alias("cluster")), 0.0
    dim = len(starts[0])
    centres = _lloyd(points, {k: starts}, 50)[k]["centres"]
    ds = F.array(*[_sq_dist("x", c) for c in centres])
    own = materialize(points.select(key, "x", F.array_position(ds, F.array_min(ds)).cast("int").alias("c")), name="clusters")
    rows = _state(own, dim).collect()                                   # a row a cluster
    best = _sum_of_squares(rows, dim)
    for _ in range(max_rounds):
        if len(rows) < 2:
            break
        able = materialize(moves(own, rows, dim, LEAST_GAIN * max(best, 1.0)), name="moves")
        top = able.agg(F.max(F.struct("gain", key)).alias("t"), F.percentile_approx("gain", list(CUTS), 1000).alias("cuts")).first()
        if top["t"] is None:
            break
        lone = F.col(key) == top["t"][key]
        steps = [F.col("gain") >= c for c in [0.0, *top["cuts"][1:]]] + [lone]
        marked = own.join(able.select(key, "to", F.array(*steps).alias("go")), key, "left")
        tried = marked.select("x", "c", "to", F.posexplode(F.coalesce("go", F.array(*[F.lit(False)] * len(steps)))).alias("cut", "goes")) \
            .select("x", "cut", F.when(F.col("goes"), F.col("to")).otherwise(F.col("c")).alias("c"))
        found: dict[int, list] = {}
        for r in _state(tried, dim, "cut").collect():                   # a row a cut and cluster
            found.setdefault(r["cut"], []).append(r)
        cut, rows_then = min(found.items(), key=lambda kv: (_sum_of_squares(kv[1], dim), kv[0]))
        if _sum_of_squares(rows_then, dim) >= best:
            break                                                       # the gain is below what the sum resolves
        rows, best = rows_then, _sum_of_squares(rows_then, dim)
        own = materialize(marked.select(key, "x", F.when(F.coalesce(F.col("go")[cut], F.lit(False)), F.col("to")).otherwise(F.col("c")).alias("c")), name="clusters")
    order = sorted(rows, key=lambda r: (-r["n"], sum(r[f"m{j}"] ** 2 for j in range(dim))))
    number = {r["c"]: i + 1 for i, r in enumerate(order)}
    names = F.create_map(*[F.lit(v) for kv in number.items() for v in kv])
    return own.select(key, names[F.col("c")].alias("cluster")), best


def certificate(vectors: DataFrame, clusters: DataFrame, key: str = "id", col: str = "features") -> DataFrame:
    """(n, clusters, improving): points, clusters, and single moves that would lower the sum of squares by more than a
    billionth of it, all counted anew from the points and their clusters."""
    from pyspark.ml.functions import vector_to_array
    own = materialize(vectors.select(key, vector_to_array(col).alias("x")).join(clusters.select(key, F.col("cluster").alias("c")), key), name="certificate")
    first = own.select(F.size("x")).first()
    spark = own.sparkSession
    if first is None:
        return spark.createDataFrame([(0, 0, 0)], "n long, clusters long, improving long")
    rows = _state(own, first[0]).collect()
    more = moves(own, rows, first[0], 1e-9 * _sum_of_squares(rows, first[0])) if len(rows) > 1 else own.where(F.lit(False))
    return own.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c").alias("clusters")).select(
        "n", "clusters", F.lit(more.count()).cast("long").alias("improving"))
