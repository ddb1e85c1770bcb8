"""LASSO importance at a fixed alpha or with K-fold CV over an alpha path (M7, M8).

Features are standardised (population std; a constant column is all 0) and
the objective is ``(1/2n)||y - b - Xw||^2 + alpha ||w||_1``.  Only moments
are needed: with G = cov(X) / var-scaling and c = cov(X, y) the problem is
coordinate descent on p x p numbers.  CV folds are contiguous blocks of the
row order (dense positions from ``ordered_index``); one grouped moment job
gives every fold's statistics and the training statistics of fold k are the
exact combination of the other folds, so the 100-alpha x K-fold path costs a
single pass over the rows.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.functions.ordering import ordered_index
from sifter.operators.moments import Moments, combine, moment_table


def coordinate_descent(G: np.ndarray, c: np.ndarray, alpha: float, w0: np.ndarray | None = None,
                       tol: float = 1e-12, max_iter: int = 100_000) -> np.ndarray:
    """argmin_w 1/2 w'Gw - c'w + alpha |w|_1 (G = X'X/n, c = X'y/n, centred)."""
    p = len(c)
    w = np.zeros(p) if w0 is None else w0.copy()
    diag = np.diag(G).copy()
    for _ in range(max_iter):
        delta = 0.0
        for j in range(p):
            if diag[j] <= 0:
                if w[j] != 0:
                    delta = max(delta, abs(w[j]))
                w[j] = 0.0
                continue
            rho = c[j] - G[j] @ w + diag[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / diag[j]
            delta = max(delta, abs(new - w[j]))
            w[j] = new
        if delta < tol:
            break
    return w


def _standardised_problem(m: Moments, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """G, c of the standardised features from raw moments (last column = y)."""
    cov = m.M / m.n
    p = len(scale)
    inv = np.where(scale > 0, 1.0 / np.where(scale > 0, scale, 1.0), 0.0)
    G = cov[:p, :p] * np.outer(inv, inv)
    c = cov[:p, p] * inv
    return G, c


def alpha_grid(G_full_c: np.ndarray, n_alphas: int = 100, eps: float = 1e-3) -> np.ndarray:
    """Log-spaced alphas from alpha_max = max|X'y|/n down to eps * alpha_max."""
    a_max = float(np.max(np.abs(G_full_c)))
    if a_max <= 0:
        return np.full(n_alphas, 1e-12)
    return np.geomspace(a_max, a_max * eps, num=n_alphas)


def cross_validated_alpha(folds: Sequence[Moments], total: Moments, scale: np.ndarray, n_alphas: int = 100,
                          eps: float = 1e-3) -> float:
    """The alpha of the path with the smallest mean test error over the folds, from their moments alone."""
    p = len(scale)
    alphas = alpha_grid(_standardised_problem(total, scale)[1], n_alphas, eps)
    inv = np.where(scale > 0, 1.0 / np.where(scale > 0, scale, 1.0), 0.0)
    units = np.r_[inv, 1.0]
    mse = np.zeros((len(alphas), len(folds)))
    for fi, test in enumerate(folds):
        train = combine([f for j, f in enumerate(folds) if j != fi])
        G, c = _standardised_problem(train, scale)
        # test statistics in standardised units (rows share the global scaling)
        Mt = test.M * np.outer(units, units)
        mu_tr, mu_te = train.mean * units, test.mean * units
        w = np.zeros(p)
        for ai, a in enumerate(alphas):
            w = coordinate_descent(G, c, a, w, tol=1e-10)
            b = mu_tr[p] - mu_tr[:p] @ w
            d = mu_te[p] - b - mu_te[:p] @ w
            sse = Mt[p, p] - 2 * w @ Mt[:p, p] + w @ Mt[:p, :p] @ w + test.n * d * d
            mse[ai, fi] = sse / test.n
    return float(alphas[int(np.argmin(mse.mean(axis=1)))])


def _result(spark, feature_cols, w, alpha, target) -> DataFrame:
    rows = [(target, f, float(v), float(abs(v)), float(alpha)) for f, v in zip(feature_cols, w)]
    df = spark.createDataFrame(rows, "target string, feature string, coefficient double, "
                                     "abs_coefficient double, alpha double")
    from pyspark.sql import Window
    w_ = Window.partitionBy("target").orderBy(F.col("abs_coefficient").desc())
    return df.withColumn("rank", F.rank().over(w_).cast("long")).select(
        "target", "feature", "coefficient", "abs_coefficient", "rank", "alpha")


def run_lasso(df: DataFrame, feature_cols: Sequence[str], target: str, alpha: float | None = None,
              cv: int = 5, row_order: Sequence[str] = ("row_id",), n_alphas: int = 100,
              eps: float = 1e-3) -> DataFrame:
    """M7/M8: coefficients of the standardised LASSO, ranked by |coefficient|.

    ``alpha=None`` picks alpha by K = min(cv, n) contiguous folds in
    ``row_order`` (minimum mean test MSE over folds, first on ties), then
    refits on all rows.  Columns: target, feature, coefficient,
    abs_coefficient, rank, alpha.
    """
    if alpha is not None and alpha <= 0:
        raise ValueError(f"alpha must be a positive number; got {alpha}.")
    cols = list(feature_cols) + [target]
    spark = df.sparkSession
    if alpha is not None:
        m = moment_table(df, cols)[()]
        if m.n == 0:
            raise ValueError("X must contain at least one row.")
        scale = np.sqrt(np.clip(np.diag(m.M)[:-1] / m.n, 0, None))
        G, c = _standardised_problem(m, scale)
        w = coordinate_descent(G, c, float(alpha))
        return _result(spark, feature_cols, w, alpha, target)

    complete = F.lit(True)
    for c_ in cols:
        complete = complete & F.col(c_).isNotNull()
    rows = df.where(complete)
    indexed = ordered_index(rows.select(*cols, *row_order), list(row_order), name="_pos")
    n = indexed.count()
    if n == 0:
        raise ValueError("X must contain at least one row.")
    k = max(2, min(cv, n))
    q_, r_ = divmod(n, k)
    big = r_ * (q_ + 1)
    fold = F.when(F.col("_pos") < big, F.floor(F.col("_pos") / (q_ + 1))) \
        .otherwise(r_ + F.floor((F.col("_pos") - big) / max(q_, 1))).cast("int")
    parts = moment_table(indexed.withColumn("_fold", fold), cols, ["_fold"])
    folds = [parts[(i,)] for i in range(k) if (i,) in parts]
    total = combine(folds)
    scale = np.sqrt(np.clip(np.diag(total.M)[:-1] / total.n, 0, None))
    best = cross_validated_alpha(folds, total, scale, n_alphas, eps)
    w = coordinate_descent(*_standardised_problem(total, scale), best)
    return _result(spark, feature_cols, w, best, target)
