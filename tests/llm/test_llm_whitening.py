"""Whitening against numpy's eigenvectors of the plain covariance."""

import math
import random

import numpy as np
import pytest
from tessera.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n string, component string, x string"


def brute(rows, count=4):
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in good})
    n, d = len(distinct), len(distinct[0])
    sums = [sum(x[j] for x in distinct) for j in range(d)]
    centred = np.array([[n * x[j] - sums[j] for j in range(d)] for x in distinct], float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return good, n, sums, values[::-1], vectors[:, ::-1][:, :count], values.sum()


def check(spark, rows, count=4, expect=None):
    df = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA).repartition(3)
    got = whitening.whiten(df, count=count).collect()
    good, n, sums, values, vectors, trace = brute(rows, count)
    m = min(count, int((values > 1e-9 * values[0]).sum())) if values[0] > 0 else 0
    assert m == (expect if expect is not None else m)
    assert len(got) == m * len(good)
    want = {}
    for i, x in good:
        y = [n * a - s for a, s in zip(x, sums)]
        want.setdefault((i, sum(a * a for a in y)), []).append(np.array(y, float) / n @ vectors)
    for r in got:
        assert r.n == n and (i := r.vec_id, r.deviation) in want
        assert r.identity_error < 1e-9 and r.identity_error == got[0].identity_error
        assert abs(r.explained - values[r.component - 1] / trace) < 1e-10
    return got, want, values


def signs_fixed(got, want, values, m):
    for c in range(1, m + 1):
        pairs = []
        for r in got:
            if r.component == c:
                options = [w[c - 1] / math.sqrt(values[c - 1]) for w in want[r.vec_id, r.deviation]]
                pairs.append((r.whitened, options))
        one = max(pairs, key=lambda p: abs(p[0]))
        sign = min((1, -1), key=lambda s: min(abs(one[0] - s * o) for o in one[1]))
        assert all(min(abs(a - sign * o) for o in opts) < 1e-8 for a, opts in pairs)


def test_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got, want, values = check(spark, rows, expect=4)
    signs_fixed(got, want, values, 4)


def test_odd_rows_and_copies(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1 + j) for j in range(6)]) for i in range(80)]
    rows += [(200 + i, rows[3][1]) for i in range(50)] + [(None, rows[5][1]), (7, rows[7][1]), (7, rows[8][1])]
    rows += [(300, None), (301, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (302, [math.nan] * 6), (303, [math.inf] + [0.0] * 5), (304, []), (305, [-0.0] * 6)]
    got, want, values = check(spark, [x for x in rows], expect=4)
    signs_fixed(got, want, values, 4)


def test_other_lengths_have_no_place(spark):
    rows = [(i, [float(i % 7), float(i % 5), float(i % 3)]) for i in range(30)]
    odd = spark.createDataFrame(rows + [(99, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in whitening.whiten(odd).collect()} == set(range(30))


@pytest.mark.parametrize("scale", [1e3, 1e16])
def test_large_values_stay_exact(spark, scale):
    r = random.Random(9)
    rows = [(i, [round(r.gauss(0, 1), 3) * scale for _ in range(3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good, n, sums, *_ = brute(rows)
    want = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in good}
    for row in whitening.whiten(df).collect():
        assert row.deviation == (want[row.vec_id] if want[row.vec_id] < 1 << 63 else None)


def test_few_directions_and_none(spark):
    def line(k):
        return [(i, [i / 4.0, i / 2.0, -i / 4.0]) for i in range(k)]
    check(spark, line(20), expect=1)
    for rows in (line(1), [(i, [0.5, 0.5]) for i in range(4)], []):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert whitening.whiten(df).collect() == []


def test_equal_deviations_are_all_found(spark):
    rows = [(2 * j + s, [(1 - 2 * s) * (4.0 if k == j else 0.0) for k in range(6)]) for j in range(6) for s in (0, 1)]
    rows += [(50 + s, [(1 - 2 * s) * (8.0 if k == 0 else 0.0) for k in range(6)]) for s in (0, 1)]
    got, *_ = check(spark, rows, expect=4)
    assert len({(r.component, round(r.explained, 9)) for r in got}) == 4


def test_bidiagonal(spark):
    r = random.Random(2)
    rows = spark.createDataFrame([([r.randrange(-500, 500) for _ in range(9)],) for _ in range(60)], "x array<long>")
    fit = whitening.Fit(rows)
    basis, small = whitening.bidiagonalise(fit)
    x = np.array([q.x for q in fit.rows.collect()], float)
    x -= x.mean(axis=0)
    assert np.abs(basis.T @ basis - np.eye(9)).max() < 1e-13
    assert np.abs(np.triu(np.tril(small, 1)) - small).max() == 0
    assert np.abs(basis.T @ x.T @ x @ basis - small.T @ small).max() < 1e-8 * np.abs(x.T @ x).max()
    short, _ = whitening.components(fit, 1, steps=7)
    full, _ = whitening.components(fit, 1)
    assert abs(short[:, 0] @ full[:, 0]) > 0.9
