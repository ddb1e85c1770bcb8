"""Moment tables (H1): counts, means and centred cross-products per group.

One aggregation job returns, for every group (e.g. CV fold, bootstrap
replicate, target), ``n``, the mean vector and the centred cross-product
matrix ``M = sum (z - mean)(z - mean)^T`` of the requested columns, using
Spark's numerically stable ``covar_pop``.  Everything linear (LASSO, its CV
path, PCA, Pearson) is finished from these p x p numbers on the driver.
Groups combine exactly with the parallel-axis rule (``combine``), so a
training set "all folds but k" never needs a second pass over the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.functions.broadcasting import broadcast_if_small


@dataclass
class Moments:
    n: float
    mean: np.ndarray      # (q,)
    M: np.ndarray         # (q, q) centred cross-products

    @property
    def cov(self) -> np.ndarray:
        return self.M / self.n if self.n else np.full_like(self.M, np.nan)


def combine(parts: Sequence[Moments]) -> Moments:
    """Merge group moments (parallel-axis theorem)."""
    n = sum(p.n for p in parts)
    mean = sum(p.n * p.mean for p in parts) / n
    M = sum(p.M + p.n * np.outer(p.mean - mean, p.mean - mean) for p in parts)
    return Moments(n, mean, M)


# Above this many columns the pairwise covar_pop expressions (q(q+1)/2 of
# them) are replaced by per-partition numpy cross-products summed by Spark.
WIDE_COLS = 40


def _wide_moments(data: DataFrame, q: int, group_cols: Sequence[str], weighted: bool) -> dict[tuple, Moments]:
    """Two passes: group means, then centred cross-products per partition
    (numpy, one long row per (group, i, j)) reduced by a grouped sum."""
    import pandas as pd

    w = F.col("_w") if weighted else F.lit(1.0)
    means = data.groupBy(*group_cols).agg(
        F.sum(w).alias("_n"), *[(F.sum(w * F.col(f"_z{i}")) / F.sum(w)).alias(f"_m{i}") for i in range(q)])
    mrows = {tuple(r[g] for g in group_cols): r for r in means.collect()}   # one row per group
    mean_vec = {k: np.array([r[f"_m{i}"] for i in range(q)], dtype=float) for k, r in mrows.items()}
    zcols = [f"_z{i}" for i in range(q)]
    iu, ju = np.triu_indices(q)

    def partial(batches):
        acc: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            keys = list(zip(*[pdf[g] for g in group_cols])) if group_cols else [()] * len(pdf)
            pdf = pdf.assign(_key=keys)
            for key, part in pdf.groupby("_key", sort=False):
                Z = part[zcols].to_numpy(dtype=float) - mean_vec[key]
                wt = part["_w"].to_numpy(dtype=float) if weighted else np.ones(len(part))
                M = (Z * wt[:, None]).T @ Z
                acc[key] = acc.get(key, 0) + M
        rows = []
        for key, M in acc.items():
            for a, b in zip(iu, ju):
                rows.append((*key, int(a), int(b), float(M[a, b])))
        yield pd.DataFrame(rows, columns=[*group_cols, "_i", "_j", "_v"])

    gschema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.schema.fields
                        if f.name in group_cols)
    schema = (gschema + ", " if gschema else "") + "_i int, _j int, _v double"
    sums = data.mapInPandas(partial, schema).groupBy(*group_cols, "_i", "_j").agg(F.sum("_v").alias("_v"))
    out = {k: Moments(float(r["_n"]), mean_vec[k], np.zeros((q, q))) for k, r in mrows.items()}
    for r in sums.collect():                                            # q(q+1)/2 rows per group
        k = tuple(r[g] for g in group_cols)
        out[k].M[r["_i"], r["_j"]] = out[k].M[r["_j"], r["_i"]] = r["_v"]
    return out


def moment_table(df: DataFrame, cols: Sequence[str], group_cols: Sequence[str] = (),
                 weight: str | None = None) -> dict[tuple, Moments]:
    """``{group key: Moments}`` from one aggregation over complete rows.

    With ``weight`` (a non-negative row weight such as a bootstrap count)
    rows are counted that many times; weighted moments use sums of
    weighted, group-mean-centred values in a second pass.
    """
    cols = list(cols)
    q = len(cols)
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    data = df.where(complete).select(*group_cols, *[F.col(c).cast("double").alias(f"_z{i}")
                                                    for i, c in enumerate(cols)],
                                     *([F.col(weight).cast("double").alias("_w")] if weight else []))
    if q > WIDE_COLS:
        return _wide_moments(data, q, list(group_cols), weight is not None)
    if weight is None:
        aggs = [F.count(F.lit(1)).alias("_n")]
        aggs += [F.avg(f"_z{i}").alias(f"_m{i}") for i in range(q)]
        aggs += [F.covar_pop(f"_z{i}", f"_z{j}").alias(f"_c{i}_{j}") for i in range(q) for j in range(i, q)]
        rows = data.groupBy(*group_cols).agg(*aggs).collect()
        out = {}
        for r in rows:
            n = float(r["_n"])
            mean = np.array([r[f"_m{i}"] for i in range(q)], dtype=float)
            M = np.zeros((q, q))
            for i in range(q):
                for j in range(i, q):
                    M[i, j] = M[j, i] = (r[f"_c{i}_{j}"] or 0.0) * n
            out[tuple(r[g] for g in group_cols)] = Moments(n, mean, M)
        return out
    # weighted: means first, then centred weighted cross-products
    w = F.col("_w")
    means = data.groupBy(*group_cols).agg(
        F.sum(w).alias("_n"), *[(F.sum(w * F.col(f"_z{i}")) / F.sum(w)).alias(f"_m{i}") for i in range(q)])
    joined = data.join(broadcast_if_small(means), list(group_cols)) if group_cols else \
        data.withColumn("_k", F.lit(1)).join(F.broadcast(means.withColumn("_k", F.lit(1))), "_k")
    d = [F.col(f"_z{i}") - F.col(f"_m{i}") for i in range(q)]
    aggs = [F.first("_n").alias("_n")] + [F.first(f"_m{i}").alias(f"_m{i}") for i in range(q)]
    aggs += [F.sum(w * d[i] * d[j]).alias(f"_c{i}_{j}") for i in range(q) for j in range(i, q)]
    rows = joined.groupBy(*group_cols).agg(*aggs).collect()
    out = {}
    for r in rows:
        mean = np.array([r[f"_m{i}"] for i in range(q)], dtype=float)
        M = np.zeros((q, q))
        for i in range(q):
            for j in range(i, q):
                M[i, j] = M[j, i] = r[f"_c{i}_{j}"] or 0.0
        out[tuple(r[g] for g in group_cols)] = Moments(float(r["_n"]), mean, M)
    return out


def correlation_from(m: Moments) -> np.ndarray:
    """Correlation matrix; rows/cols of constant columns are 0 (diag 0)."""
    sd = np.sqrt(np.clip(np.diag(m.M) / m.n, 0, None))
    safe = np.where(sd > 0, sd, 1.0)
    R = (m.M / m.n) / np.outer(safe, safe)
    R[sd == 0, :] = 0.0
    R[:, sd == 0] = 0.0
    return R
