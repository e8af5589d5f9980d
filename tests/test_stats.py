"""Statistics against direct computation and published golden values."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from tessera.functions.tails import chisq_sf, f_sf
from tessera.operators import stats as T

# Published marker rows (FIXTURES.md section 2): F, DFn, DFd, p
GOLDEN_FP = [(51.036, 1, 998, 1.75e-12), (12.823, 1, 998, 0.000359), (393.416, 1, 998, 4.54e-74),
             (1230.462, 1, 998, 2.77e-176), (125.327, 1, 998, 1.73e-27), (13.394, 1, 998, 0.000266)]
# Published means with their log2 fold changes
GOLDEN_FC = [(2.93939393939394, 2.59510869565217, 0.179723755962576),
             (0.917073170731707, 0.0628930817610062, 3.86606361256919),
             (1.64044943820225, 1.20856201975851, 0.440799618151301)]


def test_f_tail_matches_published_p():
    for f, d1, d2, p in GOLDEN_FP:
        assert abs(f_sf(f, d1, d2) - p) / p < 0.005


def test_chisq_tail():
    assert abs(chisq_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(chisq_sf(7.814727903251178, 3) - 0.05) < 1e-9


def test_log2fc_golden(spark):
    from tessera.functions.scalars import log2_ratio
    df = spark.createDataFrame([(a, b) for a, b, _ in GOLDEN_FC], "a double, b double")
    got = [r[0] for r in df.select(log2_ratio("a", "b")).collect()]
    for g, (_, _, want) in zip(got, GOLDEN_FC):
        assert abs(g - want) < 1e-12


def _anova_direct(x, in_mask):
    a, b = x[in_mask], x[~in_mask]
    n, m = len(x), x.mean()
    ssb = len(a) * (a.mean() - m) ** 2 + len(b) * (b.mean() - m) ** 2
    ssw = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
    return a.mean(), b.mean(), ssb / (ssw / (n - 2)), ssb / (ssb + ssw)


def test_one_vs_rest_anova_matches_two_group_computation(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        c = int(rng.integers(1, 5))
        for f in ("f1", "f2"):
            rows.append((f"p{i}", f, float(rng.integers(0, 4) + (c == 2) * (f == "f1")), c))
    pdf = pd.DataFrame(rows, columns=["id", "feature_id", "value", "cluster"])
    got = T.one_vs_rest_anova(spark.createDataFrame(pdf)).toPandas()
    for _, r in got.iterrows():
        sub = pdf[pdf.feature_id == r.feature]
        mi, mo, f, ges = _anova_direct(sub.value.to_numpy(), (sub.cluster == r.cluster).to_numpy())
        assert abs(r.mean_in_cluster - mi) < 1e-12 and abs(r.mean_out_cluster - mo) < 1e-12
        assert abs(r.f - round(f, 3)) < 1e-9 and abs(r.ges - round(ges, 3)) < 1e-9
        assert r.dfd == len(sub) - 2


def test_spearman_matches_pairwise_complete_ranks(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        for f in ("a", "b", "c"):
            if rng.random() > 0.15:
                rows.append((f"p{i}", f, float(rng.randint(0, 3))))
    pdf = pd.DataFrame(rows, columns=["id", "feature_id", "value"])
    got = T.spearman_pairwise(spark.createDataFrame(pdf)).toPandas()
    wide = pdf.pivot(index="id", columns="feature_id", values="value")
    for _, r in got.iterrows():
        if r.f1 == r.f2:
            assert r.rho == 1.0
            continue
        both = wide[[r.f1, r.f2]].dropna()
        want = both[r.f1].rank().corr(both[r.f2].rank())
        assert abs(r.rho - want) < 1e-12 and r.n_complete == len(both)


def test_chisq_with_and_without_yates(spark):
    # 2x2: R chisq.test(matrix(c(12, 5, 7, 9), 2)) -> X-squared = 1.2606 (Yates)
    rows = [("a", "x")] * 12 + [("b", "x")] * 5 + [("a", "y")] * 7 + [("b", "y")] * 9
    r = T.chisq_independence(spark.createDataFrame(rows, "r string, c string"), "r", "c").first()
    o = np.array([[12, 7], [5, 9]], float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    want = (((np.abs(o - e) - np.minimum(0.5, np.abs(o - e))) ** 2) / e).sum()
    assert r["yates"] and r["df"] == 1 and abs(r["statistic"] - want) < 1e-9
    # 3x2 with an empty cell, no correction
    rows = [("a", "x")] * 10 + [("b", "x")] * 4 + [("c", "y")] * 6 + [("a", "y")] * 3
    r = T.chisq_independence(spark.createDataFrame(rows, "r string, c string"), "r", "c").first()
    o = np.array([[10, 3], [4, 0], [0, 6]], float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    assert not r["yates"] and r["df"] == 2 and abs(r["statistic"] - (((o - e) ** 2) / e).sum()) < 1e-9


def test_median_impute_even_count_and_zscore_drops_constant(spark):
    long = spark.createDataFrame([("p1", "f", 1.0), ("p2", "f", 2.0), ("p3", "f", 3.0), ("p4", "f", 4.0),
                                  ("p1", "k", 2.0), ("p2", "k", 2.0)], "id string, feature_id string, value double")
    posts = spark.createDataFrame([(f"p{i}",) for i in range(1, 6)], "id string")
    wide = T.median_impute(long, posts, ["f", "k"])
    got = {r["id"]: (r["f"], r["k"]) for r in wide.collect()}
    assert got["p5"] == (2.5, 2.0)             # R median: even counts averaged
    z, dropped = T.zscore(wide)
    assert dropped == ["k"] and z.columns == ["id", "f"]
    vals = [r["f"] for r in z.collect()]
    assert abs(sum(vals)) < 1e-12 and abs(np.std(vals, ddof=1) - 1.0) < 1e-12


def test_kept_features_absolute_rule(spark):
    posts = spark.createDataFrame([(f"p{i}",) for i in range(10)], "id string")
    rows = [(f"p{i}", "five", 1.0) for i in range(5)] + [(f"p{i}", "six", 1.0) for i in range(6)]
    long = spark.createDataFrame(rows, "id string, feature_id string, value double")
    kept = [r[0] for r in T.kept_features(long, posts, 0.5).collect()]
    assert kept == ["six"]                      # 5 missing of 10 is dropped, 4 is kept


def test_long_wide_roundtrip(spark):
    from tessera.operators import summaries as G
    rng = np.random.default_rng(9)
    rows = [(f"p{i}", f"f{j}", float(rng.integers(0, 4))) for i in range(50) for j in range(5) if rng.random() > 0.2]
    long = spark.createDataFrame(rows, "id string, feature_id string, value double")
    wide = G.pivot_known(long, "id", "feature_id", [f"f{j}" for j in range(5)], "value")
    back = T.to_long(wide).where("value IS NOT NULL")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_spearman_of_many_values_equals_pandas(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(1500):
        for f in ("a", "b", "c"):
            if rng.random() > 0.1:
                rows.append((f"p{i}", f, float(np.round(rng.normal(), 2))))   # many distinct values, some ties
    long = spark.createDataFrame(pd.DataFrame(rows, columns=["id", "feature_id", "value"]))
    got = {(r.f1, r.f2): r.rho for r in T.spearman_pairwise(long).collect()}
    pdf = pd.DataFrame(rows, columns=["id", "feature_id", "value"]).pivot(index="id", columns="feature_id", values="value")
    for f, g in (("a", "b"), ("a", "c"), ("b", "c")):
        both = pdf[[f, g]].dropna()
        want = both[f].rank().corr(both[g].rank())
        assert abs(got[(f, g)] - want) < 1e-12 and got[(g, f)] == got[(f, g)]
    assert got[("a", "a")] == 1.0


def test_spearman_wide_equals_long(spark):
    rng = np.random.default_rng(21)
    rows = [(f"p{i}", *[None if rng.random() < 0.15 else float(rng.integers(0, 4)) for _ in range(4)])
            for i in range(300)]
    wide = spark.createDataFrame(rows, "id string, a double, b double, c double, d double")
    long = T.to_long(wide).where("value IS NOT NULL")
    w = {(r.f1, r.f2): (r.rho, r.n_complete) for r in T.spearman_pairwise_wide(wide, ["a", "b", "c", "d"]).collect()}
    lg = {(r.f1, r.f2): (r.rho, r.n_complete) for r in T.spearman_pairwise(long).collect()}
    assert w.keys() == lg.keys()
    for k in w:
        assert w[k][1] == lg[k][1] and abs(w[k][0] - lg[k][0]) < 1e-12


def test_spearman_known_features_path_equals_self_join(spark):
    rng = np.random.default_rng(22)
    rows = [(f"p{i}", f, float(rng.integers(0, 4))) for i in range(200) for f in ("x-1", "y z", "w")
            if rng.random() > 0.2]
    long = spark.createDataFrame(rows, "id string, feature_id string, value double")
    a = {(r.f1, r.f2): (r.rho, r.n_complete) for r in T.spearman_pairwise(long).collect()}
    b = {(r.f1, r.f2): (r.rho, r.n_complete) for r in T.spearman_pairwise(long, features=["x-1", "y z", "w"]).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][1] == b[k][1] and abs(a[k][0] - b[k][0]) < 1e-12
