"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

X has a row for each distinct vector, centred. A step takes one scan: every task multiplies its rows by one
direction (Xy, the next left vector) and those products into the rows again (X'u), and tasks' sums are added by Spark.
A left vector is as long as the table and never stored: it is X times a short vector, so a task makes its part of any
of them from its rows. Right vectors, no longer than an embedding, are kept and reorthogonalised on the driver. The
SVD of the small bidiagonal matrix gives components and deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize, require, ship_package

#: Steps of the quantised values: x = floor(SCALE * c).
SCALE = 256
#: Below this part of the largest singular value a direction counts as having no spread.
NOTHING = 1e-11
_LONG = 1 << 63


def quantised(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, x array<long>) of the rows whose vector has only finite entries: x = floor(scale * c), as long.

    Rows with a null vector, or a null or non-finite entry, go; so do vectors of another length than the commonest
    (of equally common ones the longest), and empty ones, which lie in no space. Null ids and repeated rows stay.
    What exceeds a long is the nearest long. Other columns are not read.
    """
    require(vectors, id_col, vector_col)
    rows = vectors.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("__c"))
    finite = F.forall("__c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = rows.where(F.col("__c").isNotNull() & (F.size("__c") > 0)).where(finite)
    length = rows.groupBy(F.size("__c").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1)
    rows = rows.where(F.size("__c") == F.coalesce(length.select("d").scalar(), F.lit(0)))
    top = float(_LONG)                                                  # a double; floor() itself holds at the ends of long
    x = F.transform("__c", lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-top)), F.lit(top))).cast("long"))
    return rows.select(id_col, x.alias("x"))


class Fit:
    """The list that is fitted: distinct vectors x, how many they are, and their sums (exact integers)."""

    def __init__(self, rows: DataFrame):
        self.rows = materialize(rows.select("x").distinct(), name="distinct-vectors")
        entry = self.rows.select(F.posexplode("x").alias("i", "v"))
        sums = entry.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.max(F.abs(F.col("v").cast("decimal(38,0)"))).alias("m"),
                                      F.count("*").alias("n")).orderBy("i").collect()      # a row a dimension
        self.sums = [int(r["s"]) for r in sums]
        self.n = int(sums[0]["n"]) if sums else 0
        most = max((int(r["m"]) for r in sums), default=0)
        self.wide = 2 * self.n * most >= _LONG                          # n * x - S might not fit a long


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _spread(x: np.ndarray, n: int, sums: list[int], wide: bool) -> np.ndarray:
    """n * x - S, exact: longs, or Python's integers where these may not fit."""
    return x.astype(object) * n - np.array(sums, object) if wide else x * n - np.array(sums, np.int64)


def _centred(x: np.ndarray, n: int, sums: list[int], wide: bool) -> np.ndarray:
    """x - S / n: the difference is exact before it is divided."""
    return _spread(x, n, sums, wide).astype(np.float64) / n


def _totals(fit: Fit, make) -> np.ndarray:
    """The sum over all centred rows of the vector that ``make`` gives for a batch of them: tasks add their own, Spark the tasks'."""
    n, sums, wide = fit.n, fit.sums, fit.wide

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                own = make(_centred(_matrix(b.column(0)), n, sums, wide))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    parts = fit.rows.mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    return np.array([r["v"] for r in parts.orderBy("i").collect()])      # as long as an embedding or two


def _fresh(basis: np.ndarray, rng: np.random.Generator) -> np.ndarray | None:
    """A random unit vector at right angles to the columns of ``basis``; none if they fill the space."""
    d, k = basis.shape
    if k >= d:
        return None
    v = rng.standard_normal(d)
    for _ in range(3):
        v -= basis @ (basis.T @ v)
        v /= np.linalg.norm(v)
    return v


def bidiagonalise(fit: Fit, steps: int | None = None, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(V, B): X V = U B with V'V = U'U = I and B upper bidiagonal.

    A step is one scan. Without ``steps`` there are as many as dimensions; then V spans the space and the result is
    exact also where deviations coincide, which a shorter run from one start cannot tell apart. Where the run ends in
    an invariant subspace it begins again with a random vector at right angles to all before.
    """
    d = len(fit.sums)
    rng = np.random.default_rng(seed)
    right = _fresh(np.zeros((d, 0)), rng)[:, None]
    left = np.zeros((d, 0))                                             # u = X y: the y of each left vector,
    back = np.zeros((d, 0))                                             # and X'u
    small, scale = np.zeros((d, d)), 0.0
    for k in range(min(d, steps or d)):
        v = right[:, k]
        y = v - left @ (back.T @ v)                                     # U'(Xv) is (X'U)'v
        weights = np.column_stack((left, y))

        def products(x, weights=weights):
            u = x @ weights
            return np.concatenate((u[:, -1] @ u, u[:, -1] @ x))         # with all left vectors, itself, and the rows

        got = _totals(fit, products)
        inner, norm, z = got[:k], got[k], got[k + 1:]
        y, z = y - left @ inner, z - back @ inner                       # once more, by measured products
        alpha = float(np.sqrt(max(0.0, norm - inner @ inner)))
        scale = max(scale, alpha)
        if alpha <= NOTHING * scale or alpha == 0:                      # Xv lies among the left vectors before
            y, z, alpha = np.zeros(d), np.zeros(d), 0.0
        else:
            y, z = y / alpha, z / alpha
        left, back = np.column_stack((left, y)), np.column_stack((back, z))
        small[k, k] = alpha
        w = z.copy()
        for _ in range(2):                                              # full reorthogonalisation, twice
            w -= right @ (right.T @ w)
        beta = float(np.linalg.norm(w))
        if right.shape[1] == d:
            break
        if beta <= NOTHING * scale or beta == 0:
            beta, w = 0.0, _fresh(right, rng)
        else:
            w /= beta
        small[k, k + 1] = beta
        right = np.column_stack((right, w))
    k = min(d, steps or d)
    return right[:, :k], small[:k, :k]


def components(fit: Fit, count: int = 4, steps: int | None = None, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(unit eigenvectors of the covariance as columns, their eigenvalues), by falling value, at most ``count``.

    Fewer where the vectors spread in fewer directions. Signs: the largest entry is positive.
    """
    if fit.n < 2:
        return np.zeros((len(fit.sums), 0)), np.zeros(0)
    basis, small = bidiagonalise(fit, steps, seed)
    _, deviations, turns = np.linalg.svd(small)
    keep = deviations[:count] > 1e3 * NOTHING * deviations[0] if deviations[0] > 0 else np.zeros(0, bool)
    found = basis @ turns[:len(keep)][keep].T
    found /= np.linalg.norm(found, axis=0)
    found *= np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    return found, deviations[:len(keep)][keep] ** 2 / fit.n


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", count: int = 4, scale: int = SCALE,
           steps: int | None = None, seed: int = 1) -> DataFrame:
    """(id, component int, n long, deviation long, whitened double, explained double, identity_error double): a row for each row of
    ``quantised`` and component.

    Fitted to the distinct vectors, so copies weigh nothing. ``deviation`` is the exact sum over dimensions of
    (n x - S)^2, null if it exceeds a long. ``whitened`` is the centred vector on the component over the root of its
    eigenvalue; ``explained`` the eigenvalue's part of the trace; ``identity_error`` the largest absolute entry of
    whitened's covariance over the fitted list less the identity, measured in a scan of its own. There are at most
    ``count`` components, fewer where there are fewer directions of spread, so fewer than two distinct vectors, or an
    empty table, give an empty result. Null ids and repeated rows stay.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = materialize(quantised(vectors, id_col=id_col, vector_col=vector_col, scale=scale), spark, "quantised")
    fit = Fit(rows)
    found, values = components(fit, count, steps, seed)
    schema = T.StructType([rows.schema[0], *(T.StructField(c, t) for c, t in (
        ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()),
        ("explained", T.DoubleType()), ("identity_error", T.DoubleType())))])
    m = len(values)
    if not m:
        return spark.createDataFrame([], schema)
    to = found / np.sqrt(values)

    def moments(x):
        w = x @ to
        return np.concatenate(((w.T @ w).ravel(), w.sum(axis=0), [(x * x).sum()]))

    got = _totals(fit, moments) / fit.n
    mean = got[m * m:m * m + m]
    error = float(np.abs(got[:m * m].reshape(m, m) - np.outer(mean, mean) - np.eye(m)).max())
    explained = values / got[-1]
    n, sums, wide = fit.n, fit.sums, fit.wide

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            far = _spread(_matrix(b.column(1)), n, sums, wide)
            w = (far.astype(np.float64) / n) @ to
            exact = far if wide or (far.astype(np.float64) ** 2).sum(axis=1).max() < _LONG / 2 else far.astype(object)
            total = [t if t < _LONG else None for t in (exact * exact).sum(axis=1).tolist()]
            k = len(total)
            each = pa.array(np.repeat(np.arange(k), m))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)), pa.array(np.full(k * m, n, np.int64)),
                 pa.array(total, pa.int64()).take(each), pa.array(w.ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * m, error))],
                schema.names)

    return rows.mapInArrow(project, schema)
