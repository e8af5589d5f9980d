"""Invariants for MLlib-backed operators (T4, T7, T8, T11) and sampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import posts as P
from tessera.operators import stats as T


def _emb(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    cols = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(8)]
    wide = e.select(F.col("vec_id").cast("string").alias("id"), *cols)
    z, _ = T.zscore(wide)
    return T.assemble(z)


def test_pca_invariants(spark):
    vec = _emb(spark)
    scores, var = T.pca_scores(vec)
    s = np.array([r["pcs"] for r in scores.collect()])
    cov = np.cov(s, rowvar=False)
    assert np.allclose(cov - np.diag(np.diag(cov)), 0, atol=1e-8)   # components uncorrelated
    assert abs(np.trace(cov) - 8) < 1e-8                              # total variance = p for z-scores
    assert np.all(np.diff(np.diag(cov)) <= 1e-9)                      # ordered by variance


def test_kmeans_repeatable_and_partition_independent(spark):
    vec = _emb(spark)
    of = lambda v: {r["id"]: r["cluster"] for r in T.kmeans_clusters(v, 4, seed=1)[0].collect()}
    a = of(vec)
    assert set(a.values()) == {1, 2, 3, 4} and len(a) == vec.count()
    for n in (1, 2, 8):
        assert of(vec.repartition(n)) == a


def test_kmeans_finds_planted_groups_and_few_points(spark):
    rows = [(f"i{i}", float(10 * (i % 4)) + i / 1e4, float(i % 2)) for i in range(200)]
    vec = T.assemble(spark.createDataFrame(rows, "id string, a double, b double"))
    got = {r["id"]: r["cluster"] for r in T.kmeans_clusters(vec, 4, seed=3)[0].collect()}
    assert len({(i % 4, got[f"i{i}"]) for i in range(200)}) == 4
    few = T.assemble(spark.createDataFrame([("x", 1.0), ("y", 1.0)], "id string, a double"))
    assert {r["cluster"] for r in T.kmeans_clusters(few, 4)[0].collect()} == {1}
    none, cost = T.kmeans_clusters(vec.where("id = '-'"), 4)
    assert none.count() == 0 and cost == 0.0


def test_elbow_near_monotone(spark):
    e = T.elbow(_emb(spark), range(1, 6), seed=1).orderBy("k").collect()
    w = [r["wss"] for r in e]
    assert w[0] >= max(w[1:]) and w[-1] <= w[1]


def test_sample_n_exact_and_pairs(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("id"))
    got = [r["id"] for r in P.sample_n(df, 100, "id", "s").collect()]
    want = [r["id"] for r in df.orderBy(F.md5(F.concat_ws("|", "id", F.lit("s"))), "id").limit(100).collect()]
    assert sorted(got) == sorted(want)
    pairs = P.draw_pairs(df, 20, "id", "s").collect()
    ids = [r["id1"] for r in pairs] + [r["id2"] for r in pairs]
    assert len(pairs) == 20 and len(set(ids)) == 40
    small = P.draw_pairs(df.limit(7), 20, "id", "s").collect()
    assert len(small) == 3


def test_one_per_group(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").cast("string").alias("k"))
    out = P.one_per_group(df, "g", "k", "1").collect()
    assert len(out) == 7 and all(int(r["k"]) % 7 == r["g"] for r in out)


def test_elbow_steps_are_bounded_plans_and_equal_plain_lloyd(spark):
    """The plan of a step held an expression for every centre and dimension, so it grew with both and took longer than its scan."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(c, 1.0, (80, 6)) for c in (-4, 0, 5)])
    points = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "id string, x array<double>").repartition(5)
    models = {k: x[:k].round(3).tolist() for k in (1, 2, 4)}
    plan = lambda ms: len(T._sums_by_centre(points, ms)._jdf.queryExecution().analyzed().toString())
    assert abs(plan(models) - plan({1: models[1]})) < 100
    fits = T._lloyd(points, models, 50)
    for k, start in models.items():
        c = np.array(start)
        for _ in range(50):
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            near = d.argmin(1)
            new = np.array([x[near == i].mean(0).round(9) if (near == i).any() else c[i] for i in range(k)])
            done, c = (new == c).all(), new
            if done:
                break
        assert fits[k]["wss"] == pytest.approx(d.min(1).sum(), rel=1e-9)
        assert fits[k]["sizes"] == np.bincount(near, minlength=k).tolist()
    near = {r["id"]: r["d"] for r in T._with_least_distance(points, models[4]).collect()}
    assert near == {r["id"]: r["d"] for r in points.select("id", F.array_min(F.array(*[T._sq_dist("x", c) for c in models[4]])).alias("d")).collect()}
