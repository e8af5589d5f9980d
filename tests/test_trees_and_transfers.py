"""Complete linkage, optimal transfers, density, numbered rows and list texts against plain versions."""

import json
import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from tessera.operators import annotate as A
from tessera.operators import linkage as L
from tessera.operators import posts as P
from tessera.operators import stats as S
from tessera.operators import summaries as G
from tessera.operators import transfers
from tessera.sources.tables import POSTS_SCHEMA, read_numbered_jsonl


def plain_merges(dist):
    """One merge after another, the least pair first."""
    live, out = {frozenset((a, b)): d for a, b, d in dist}, []
    while live:
        d, a, b = min((d, *sorted(p)) for p, d in live.items())
        out.append((d, a, b))
        new = {}
        for p, e in live.items():
            q = frozenset(a if x == b else x for x in p)
            if len(q) == 2:
                new[q] = max(e, new.get(q, e))
        live = new
    return out


@pytest.mark.parametrize("places", [6, 0])
def test_complete_linkage_is_that_of_single_merges(spark, places):
    r = random.Random(places)
    at = {f"f{i:02d}": [r.random() * 5 for _ in range(3)] for i in range(24)}      # rounded to 0 places, most distances tie
    dist = [(a, b, round(math.dist(at[a], at[b]), places)) for a, b in combinations(sorted(at), 2)]
    got = L.complete_linkage(spark.createDataFrame(dist, "a string, b string, d double").repartition(3)).collect()
    want = plain_merges(dist)
    assert sorted(round(m.height, 6) for m in got) == sorted(round(d, 6) for d, *_ in want)
    if places:
        assert sorted((m.height, m.left, m.right) for m in got) == sorted(want)


def test_blocks_and_leaf_order(spark):
    merges = spark.createDataFrame([(1.0, "a", "b"), (2.0, "c", "d"), (5.0, "a", "c"), (9.0, "a", "e")], L.MERGES)
    names = spark.createDataFrame([(f,) for f in "abcde"], "feature string")
    blocks = {k: {r.feature: r.block for r in L.cut(merges, names, k).collect()} for k in (1, 2, 3, 9)}
    assert set(blocks[1].values()) == {1} and blocks[2] == {**dict.fromkeys("abcd", 1), "e": 2}
    assert blocks[3] == {"a": 1, "b": 1, "c": 2, "d": 2, "e": 3} and len(set(blocks[9].values())) == 5
    means = spark.createDataFrame([("a", 0.1), ("b", 0.4), ("c", 0.5), ("d", 0.6), ("e", 0.2)], "feature string, mean double")
    got = [r.feature for r in L.leaf_order(merges, means).orderBy("position").collect()]
    assert got == ["d", "c", "b", "a", "e"]


def test_empty_correlation(spark):
    none = spark.createDataFrame([], "f1 string, f2 string, rho double")
    merges = L.complete_linkage(L.row_distances(none))
    assert merges.collect() == [] and L.cut(merges, none.selectExpr("f1 as feature")).collect() == []
    assert L.leaf_order(merges, L.row_means(none)).collect() == []
    assert S.feature_blocks(none).collect() == []
    vectors = spark.createDataFrame([("a", Vectors.dense([1.0]))], ["id", "features"]).where("id = '-'")
    assert S.pca_scores(vectors)[0].collect() == [] and transfers.transfer_clusters(vectors)[0].collect() == []
    assert [tuple(r) for r in transfers.certificate(vectors, spark.createDataFrame([], "id string, cluster int")).collect()] == [(0, 0, 0)]


def within(points, of):
    return sum(((points[of == c] - points[of == c].mean(axis=0)) ** 2).sum() for c in set(of))


def test_no_single_move_is_better(spark):
    r = np.random.default_rng(5)
    points = np.round(r.normal(size=(90, 3)) + 1.2 * r.integers(0, 3, size=(90, 1)), 3)
    rows = [(f"p{i:03d}", Vectors.dense(p)) for i, p in enumerate(points)]
    frames = [spark.createDataFrame(rows, ["id", "features"]).repartition(k) for k in (1, 5)]
    results = [transfers.transfer_clusters(f, 4, seed=2) for f in frames]
    maps = [{x.id: x.cluster for x in c.collect()} for c, _ in results]
    assert maps[0] == maps[1]
    of = np.array([maps[0][i] for i, _ in rows])
    best = within(points, of)
    assert abs(best - results[0][1]) < 1e-9 * best
    for i in range(len(of)):
        for c in range(1, 5):
            if c != of[i] and (of == of[i]).sum() > 1:
                other = of.copy()
                other[i] = c
                assert within(points, other) >= best - 1e-9
    assert [tuple(x) for x in transfers.certificate(frames[0], results[0][0]).collect()] == [(90, 4, 0)]
    lloyd, cost = S.kmeans_clusters(frames[0], 4, seed=2)
    assert best <= cost + 1e-9
    wrong = lloyd.selectExpr("id", "cast(1 + pmod(hash(id), 4) as int) as cluster")
    assert transfers.certificate(frames[0], wrong).first()["improving"] > 0


def test_few_distinct_points(spark):
    few = spark.createDataFrame([(str(i), Vectors.dense([float(i % 2)])) for i in range(6)], ["id", "features"])
    clusters, cost = transfers.transfer_clusters(few, 4)
    assert {r.cluster for r in clusters.collect()} == {1, 2} and cost == 0


def test_density(spark):
    r = random.Random(3)
    groups = {1: [r.choice([0, 1, 2, 2, 3, 5]) for _ in range(50)], 2: [4] * 9, 3: [0], 4: [1, 1, 1, 1, 1, 1, 9]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [(1, None)], "g int, v int")
    got = G.score_density(df, "g", "v", points=16).collect()
    for g, vs in groups.items():
        iqr = np.quantile(vs, 0.75) - np.quantile(vs, 0.25)
        sd = np.std(vs, ddof=1) if len(vs) > 1 else 0
        h = 0.9 * (min(sd, iqr / 1.34) or sd or abs(vs[0]) or 1) * len(vs) ** -0.2
        want = {round(x, 9): sum(math.exp(-((x - v) / h) ** 2 / 2) for v in vs) / (len(vs) * h * math.sqrt(2 * math.pi))
                for x in np.linspace(min(vs), max(vs), 16)}
        own = {round(x.x, 9): x.density for x in got if x.g == g}
        assert own.keys() == want.keys() and all(abs(own[x] - want[x]) < 1e-9 for x in want)


def test_rows_of_files_without_a_key_are_numbered_alike(spark, tmp_path):
    rows, number = [], 0
    for f in ("b", "a", "c"):
        lines = [json.dumps({"text": f"{f} {i} " + "x" * (i % 90), "label": f"l_{i % 3}"}) for i in range({"a": 700, "b": 0, "c": 333}[f])]
        (tmp_path / f"{f}.json").write_text("\n".join(lines) + "\n\n")
    for f in "abc":
        for line in (tmp_path / f"{f}.json").read_text().split("\n"):
            if line:
                rows.append((number, json.loads(line)["text"]))
                number += 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "20k", "3k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = read_numbered_jsonl(spark, str(tmp_path), POSTS_SCHEMA)
            assert sorted((r.row_index, r.text) for r in got.collect()) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    ids = P.with_post_id(got, "row_index").select("id").collect()
    assert len(set(ids)) == number and (f"ID{number - 1}_l_2",) in {tuple(r) for r in ids}


def test_list_text_is_pythons(spark):
    values = ["plain", "chef's", 'a "quoted" dish', "both ' and \"", "back\\slash", "tab\tand\nline", "chef's \\"]
    rows = [(v,) for i, v in enumerate(values) for _ in range(len(values) - i)] + [(None,)] * 20
    got = A.ranked_list_text(spark.createDataFrame(rows, "category string")).first()
    assert got["terms"] == str(values) and got["n_terms"] == len(values)
