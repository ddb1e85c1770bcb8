"""PCA of standardised features.

The correlation matrix comes from one moment aggregation; its eigenvectors
(p x p, on the driver) give loadings and explained-variance ratios.  Scores
are a projection evaluated by Spark on every row (a select of dot products,
inside whole-stage codegen).  Signs are fixed so that the largest absolute
loading of every component is positive.
"""

from __future__ import annotations

from typing import NamedTuple, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sifter.operators.moments import correlation_from, moment_table


class PCAResult(NamedTuple):
    variance: DataFrame      # pc, explained_variance_ratio, cumulative_variance
    loadings: DataFrame      # feature, pc, loading
    scores: DataFrame        # input columns kept + PC1..PCk
    feature_rank: DataFrame  # feature, max_loading, rank
    n_components: int


def fit_pca(corr: np.ndarray, n: int, variance_threshold: float = 0.90,
            max_components: int = 5) -> tuple[np.ndarray, np.ndarray, int]:
    """(explained variance ratios of fitted comps, loadings p x n_fit, n_selected)."""
    p = corr.shape[0]
    vals, vecs = np.linalg.eigh(corr)
    order = np.argsort(vals)[::-1]
    vals = np.clip(vals[order], 0, None)
    vecs = vecs[:, order]
    total = vals.sum()
    n_fit = min(max_components, min(n - 1, p))
    if n_fit < 1:
        raise ValueError("PCA needs at least two rows.")
    evr = vals[:n_fit] / total if total > 0 else np.zeros(n_fit)
    comps = vecs[:, :n_fit]
    for k in range(n_fit):
        j = int(np.argmax(np.abs(comps[:, k])))
        if comps[j, k] < 0:
            comps[:, k] = -comps[:, k]
    cum = np.cumsum(evr)
    idx = int(np.searchsorted(cum, variance_threshold))
    return evr, comps, min(idx + 1, n_fit)


def run_pca(df: DataFrame, feature_cols: Sequence[str], variance_threshold: float = 0.90,
            max_components: int = 5, keep_cols: Sequence[str] = ("row_id",)) -> PCAResult:
    if not (0 < variance_threshold <= 1.0):
        raise ValueError(f"variance_threshold must be in (0, 1]; got {variance_threshold}.")
    if max_components < 1:
        raise ValueError(f"max_components must be at least 1; got {max_components}.")
    feats = list(feature_cols)
    m = moment_table(df, feats)[()]
    if m.n == 0:
        raise ValueError("X must contain at least one row.")
    R = correlation_from(m)
    evr, comps, k = fit_pca(R, int(m.n), variance_threshold, max_components)
    spark = df.sparkSession
    cum = np.cumsum(evr)
    variance = spark.createDataFrame(
        [(i + 1, float(evr[i]), float(cum[i])) for i in range(k)],
        "pc int, explained_variance_ratio double, cumulative_variance double")
    loadings = spark.createDataFrame(
        [(f, i + 1, float(comps[j, i])) for j, f in enumerate(feats) for i in range(k)],
        "feature string, pc int, loading double")
    sd = np.sqrt(np.clip(np.diag(m.M) / m.n, 0, None))
    z = [((F.col(f).cast("double") - float(m.mean[j])) / float(sd[j])) if sd[j] > 0 else F.lit(0.0)
         for j, f in enumerate(feats)]
    pcs = []
    for i in range(k):
        expr = F.lit(0.0)
        for j in range(len(feats)):
            expr = expr + z[j] * float(comps[j, i])
        pcs.append(expr.alias(f"PC{i + 1}"))
    keep = [c for c in keep_cols if c in df.columns]
    scores = df.select(*keep, *pcs)
    w = Window.orderBy(F.col("max_loading").desc())
    feature_rank = (loadings.groupBy("feature").agg(F.max(F.abs("loading")).alias("max_loading"))
                    .withColumn("rank", F.rank().over(w).cast("long")))
    return PCAResult(variance, loadings, scores, feature_rank, k)
