"""Gaussian-process surrogate with ARD Matern-5/2 kernel.

Inputs are min-max scaled to [0, 1] (constant column -> 0.5), the response
is standardised (population std).  Model: constant mean + outputscale *
Matern-5/2 with one lengthscale per feature + Gaussian noise.

Rows with the same inputs are first merged into one point (mean, count,
sum of squares within); the likelihood of the merged points is exactly that
of the rows, so a setting that a third of all rows share is one point.

Fit: points are dealt by a hash of their inputs into experts of about
``FIT_ROWS`` points, each a sample of the whole space, and the log
likelihood is the sum over experts (Deisenroth & Ng, 2015).  Hyper-parameters
are MAP estimates under Gamma priors, found by L-BFGS whose line search
evaluates all of its step lengths in one Spark job, so a fit takes at most
``MAX_JOBS`` jobs whatever the number of rows.

Prediction: points are cut into regions of at most ``expert_size`` points by
a tree of quantile splits, held as stored split tables; a candidate is routed
down the tree to its own region and to those a fraction of a lengthscale away
in every direction, meets their points by an equi-join on the region, and the
regions' answers are combined with the robust Bayesian committee machine.
Work is linear in candidates.  There is one path at every size: with few
points there is one expert and one region, and the model is the exact GP.
"""

from __future__ import annotations

import sifter._blas  # noqa: F401  (one BLAS thread a process)

import math
from dataclasses import dataclass
from functools import cached_property
from typing import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sifter.functions.broadcasting import broadcast_if_small
from sifter.operators.cleaning import column_moments
from sifter.session import durable

SQRT5 = math.sqrt(5.0)
# Gamma(concentration, rate) hyper-priors of the surrogate
# (lengthscale, outputscale, noise) and the noise floor.
LENGTHSCALE_PRIOR = (3.0, 6.0)
OUTPUTSCALE_PRIOR = (2.0, 0.15)
NOISE_PRIOR = (1.1, 0.05)
NOISE_FLOOR = 1e-4
JITTER = 1e-8
FIT_ROWS = 128              # points of an expert in the fit
REGION_ROWS = 512           # points of a region in prediction
FAN = 4                     # regions that a split makes
REACH = 0.5                 # how far, in lengthscales, a candidate looks for neighbouring regions
CHUNK = 2048                # candidates that meet a region in one group
MAX_JOBS = 24
STEPS = (1.0, 0.2)             # step lengths that one job of the line search evaluates


# ----------------------------------------------------------------------------
# numpy core (used inside tasks)
# ----------------------------------------------------------------------------

def _unpack(theta: np.ndarray, p: int):
    ls = np.exp(theta[:p])
    os_ = math.exp(theta[p])
    noise = NOISE_FLOOR + math.exp(theta[p + 1])
    mean = theta[p + 2]
    return ls, os_, noise, mean


def matern52(A: np.ndarray, B: np.ndarray, ls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kernel matrix without outputscale and the scaled squared differences."""
    D = (A[:, None, :] - B[None, :, :]) / ls[None, None, :]
    d2 = D * D
    r = np.sqrt(np.maximum(d2.sum(axis=2), 0.0))
    K = (1.0 + SQRT5 * r + 5.0 / 3.0 * r * r) * np.exp(-SQRT5 * r)
    return K, d2


def expert_nll_grad(theta: np.ndarray, X: np.ndarray, y: np.ndarray, count: np.ndarray | None = None,
                    within: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Negative log marginal likelihood of one expert and its gradient.

    ``count`` rows were merged into each point and ``y`` is their mean, ``within`` their sum of squares around it.
    """
    m, p = X.shape
    count = np.ones(m) if count is None else count
    within = np.zeros(m) if within is None else within
    ls, os_, noise, mean = _unpack(theta, p)
    K0, d2 = matern52(X, X, ls)
    r = np.sqrt(d2.sum(axis=2))
    L = np.linalg.cholesky(os_ * K0 + np.diag(noise / count + JITTER))
    Linv = np.linalg.inv(L)
    Kinv = Linv.T @ Linv
    resid = y - mean
    alpha = Kinv @ resid
    more = count - 1.0
    nll = (0.5 * resid @ alpha + np.log(np.diag(L)).sum() + 0.5 * m * math.log(2 * math.pi)
           + 0.5 * (more.sum() * math.log(2 * math.pi * noise) + np.log(count).sum() + within.sum() / noise))
    W = np.outer(alpha, alpha) - Kinv
    grad = np.zeros_like(theta)
    common = W * (os_ * (5.0 / 3.0) * (1.0 + SQRT5 * r) * np.exp(-SQRT5 * r))
    for d in range(p):
        grad[d] = -0.5 * np.sum(common * d2[:, :, d])
    grad[p] = -0.5 * np.sum(W * (os_ * K0))
    by_noise = -0.5 * np.sum(np.diag(W) / count) + 0.5 * (more.sum() / noise - within.sum() / noise ** 2)
    grad[p + 1] = by_noise * (noise - NOISE_FLOOR)
    grad[p + 2] = -alpha.sum()
    return float(nll), grad


def prior_nll_grad(theta: np.ndarray, p: int) -> tuple[float, np.ndarray]:
    g = np.zeros_like(theta)
    val = 0.0
    ls, os_, noise, _ = _unpack(theta, p)
    a, b = LENGTHSCALE_PRIOR
    val += float(np.sum(-(a - 1) * np.log(ls) + b * ls))
    g[:p] = -(a - 1) + b * ls
    a, b = OUTPUTSCALE_PRIOR
    val += -(a - 1) * math.log(os_) + b * os_
    g[p] = -(a - 1) + b * os_
    a, b = NOISE_PRIOR
    val += -(a - 1) * math.log(noise) + b * noise
    g[p + 1] = (-(a - 1) / noise + b) * (noise - NOISE_FLOOR)
    return val, g


Evaluate = Callable[[list[np.ndarray]], list[tuple[float, np.ndarray]]]


def lbfgs(evaluate: Evaluate, theta0: np.ndarray, max_jobs: int = MAX_JOBS, memory: int = 8, tol: float = 1e-6) -> np.ndarray:
    """Minimise by L-BFGS; ``evaluate`` gives value and gradient at several points at once, one job a call."""
    theta = theta0.copy()
    value, grad = evaluate([theta])[0]
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    jobs, shrink = 1, 1.0
    while jobs < max_jobs and np.abs(grad).max() > tol * max(1.0, abs(value)):
        q, used = grad.copy(), []
        for s, y, rho in reversed(pairs):
            a = rho * (s @ q)
            used.append(a)
            q -= a * y
        if pairs:
            s, y, _ = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q *= min(1.0, 1.0 / np.abs(grad).max())
        for (s, y, rho), a in zip(pairs, reversed(used)):
            q += (a - rho * (y @ q)) * s
        step = -q * shrink
        step *= min(1.0, 2.0 / np.abs(step).max())                  # log scale: no factor beyond e^2 at once
        found = evaluate([theta + t * step for t in STEPS])
        jobs += 1
        slope = grad @ step
        good = [(v, t, g) for t, (v, g) in zip(STEPS, found) if math.isfinite(v) and np.isfinite(g).all() and v <= value + 1e-4 * t * slope]
        if not good:
            if not pairs and shrink < 1e-6:
                break
            pairs, shrink = [], shrink * 1e-2                       # steepest descent, shorter
            continue
        new_value, t, new_grad = min(good, key=lambda c: c[0])
        s, y = t * step, new_grad - grad
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            pairs = [*pairs[-(memory - 1):], (s, y, 1.0 / (s @ y))]
        settled = value - new_value <= tol * 0.1 * max(1.0, abs(value))
        theta, value, grad, shrink = theta + s, new_value, new_grad, 1.0
        if settled:
            break
    return theta


def expert_predict(theta: np.ndarray, X: np.ndarray, y: np.ndarray, Xs: np.ndarray, count: np.ndarray | None = None):
    """Latent mean and variance of one expert at Xs."""
    m, p = X.shape
    ls, os_, noise, mean = _unpack(theta, p)
    K0, _ = matern52(X, X, ls)
    L = np.linalg.cholesky(os_ * K0 + np.diag(noise / (np.ones(m) if count is None else count) + JITTER))
    Linv = np.linalg.inv(L)
    mu, var = np.empty(len(Xs)), np.empty(len(Xs))
    alpha = Linv.T @ (Linv @ (y - mean))
    for a in range(0, len(Xs), 512):
        Ks = os_ * matern52(Xs[a:a + 512], X, ls)[0]
        mu[a:a + 512] = mean + Ks @ alpha
        V = Linv @ Ks.T
        var[a:a + 512] = np.maximum(os_ - np.sum(V * V, axis=0), 1e-12)
    return mu, var


def rows_of(xs) -> np.ndarray:
    """A nested list of one expert's inputs as a matrix."""
    return np.array([np.asarray(r, dtype=float) for r in xs])


# ----------------------------------------------------------------------------
# Spark side
# ----------------------------------------------------------------------------

def merged_points(df: DataFrame, features: Sequence[str], target: str, lo, rng, const, y_mean: float, y_std: float) -> DataFrame:
    """One row per distinct (scaled) input: x, y (mean), n (rows), ss (sum of squares within)."""
    zs = [F.lit(0.5) if const[j] else (F.col(f"`{f}`").cast("double") - float(lo[j])) / float(rng[j]) for j, f in enumerate(features)]
    rows = df.select(F.array(*zs).alias("x"), ((F.col(f"`{target}`").cast("double") - y_mean) / y_std).alias("y"))
    return rows.groupBy("x").agg(F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("n"),
                                 (F.var_pop("y") * F.count(F.lit(1))).alias("ss"))


def grouped_points(points: DataFrame, by: str) -> DataFrame:
    """One row per expert or region, its points as arrays X, Y, N, S (bounded by how ``by`` was made)."""
    packed = points.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("x", "y", "n", "ss"))).alias("_r"))
    return packed.select(by, *[F.col(f"_r.{c}").alias(name) for c, name in (("x", "X"), ("y", "Y"), ("n", "N"), ("ss", "S"))])


def nll_job(experts: DataFrame, thetas: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """Negative log likelihood and gradient summed over all experts, at every theta, in one job."""
    k = len(thetas[0])

    def run(batches):
        value, grad = np.zeros(len(thetas)), np.zeros((len(thetas), k))
        for pdf in batches:
            for X, Y, N, S in zip(pdf["X"], pdf["Y"], pdf["N"], pdf["S"]):
                X, Y, N, S = rows_of(X), *(np.asarray(v, dtype=float) for v in (Y, N, S))
                for i, theta in enumerate(thetas):
                    try:
                        v, g = expert_nll_grad(theta, X, Y, N, S)
                    except np.linalg.LinAlgError:       # far out: no step goes there
                        v, g = math.inf, np.zeros(k)
                    value[i] += v
                    grad[i] += g
        yield pd.DataFrame({"step": np.arange(len(thetas), dtype=np.int32), "nll": value, "g": grad.tolist()})

    parts = experts.mapInPandas(run, "step int, nll double, g array<double>")
    sums = parts.groupBy("step").agg(F.sum("nll").alias("nll"), *[F.sum(F.col("g")[i]).alias(f"g{i}") for i in range(k)])
    got = {r["step"]: (float(r["nll"]), np.array([r[f"g{i}"] for i in range(k)], dtype=float)) for r in sums.collect()}   # a row a step
    return [got.get(i, (0.0, np.zeros(k))) for i in range(len(thetas))]


class RegionTree:
    """Regions of at most ``size`` points, cut at quantiles of the widest input; one stored split table a level.

    Node 0 is the whole space, the slices of node v are FAN * v + 1 ... FAN * v + FAN; a node without
    a split is a region.
    """

    def __init__(self, points: DataFrame, size: int):
        dims = len(points.select("x").head(1)[0]["x"])
        self.levels: list[DataFrame] = []
        at = points.withColumn("node", F.lit(0).cast("long"))
        while True:
            spread = [F.max(F.col("x")[d]) - F.min(F.col("x")[d]) for d in range(dims)]
            nodes = at.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.array(*spread).alias("width"))
            wide = durable(nodes.where(F.col("n") > size).where(F.array_max("width") > 0)
                           .select("node", (F.array_position("width", F.array_max("width")) - 1).cast("int").alias("dim")))
            if wide.isEmpty():
                break
            inside = at.join(broadcast_if_small(wide), "node").withColumn("v", F.element_at("x", F.col("dim") + 1))
            cuts = F.percentile_approx("v", F.array(*[F.lit(i / FAN) for i in range(1, FAN)]), 1000)
            split = inside.groupBy("node", "dim").agg(cuts.alias("cuts"), F.max("v").alias("top"))
            # a value equal to a cut lies below it; the largest value must not be a cut, or nothing is cut off
            split = split.select("node", "dim", F.array_distinct(F.transform("cuts", lambda c: F.when(c < F.col("top"), c))).alias("cuts"))
            split = split.select("node", "dim", F.filter("cuts", lambda c: c.isNotNull()).alias("cuts"))
            low = inside.groupBy("node").agg(F.min("v").alias("low"), F.max("v").alias("top"))
            split = split.join(low, "node").select("node", "dim", F.when(F.size("cuts") > 0, F.col("cuts")).otherwise(
                F.array((F.col("low") + F.col("top")) / 2)).alias("cuts"))
            self.levels.append(durable(split))
            at = durable(self._down(at, self.levels[-1]))
        self.points = at

    @staticmethod
    def _down(rows: DataFrame, split: DataFrame) -> DataFrame:
        joined = rows.join(broadcast_if_small(split), "node", "left")
        below = F.size(F.filter("cuts", lambda c: c < F.element_at("x", F.col("dim") + 1)))
        return joined.withColumn("node", F.when(F.col("dim").isNull(), F.col("node")).otherwise(F.col("node") * FAN + 1 + below)).drop("dim", "cuts")

    def route(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with x) and the region each of them lies in, as ``node``."""
        rows = rows.withColumn("node", F.lit(0).cast("long"))
        for split in self.levels:
            rows = self._down(rows, split)
        return rows


@dataclass
class GPModel:
    features: list[str]
    target: str
    theta: np.ndarray
    x_lo: np.ndarray
    x_rng: np.ndarray
    x_const: np.ndarray
    y_mean: float
    y_std: float
    points: DataFrame           # stored: x, y, n, ss
    region_size: int

    @cached_property
    def tree(self) -> RegionTree:
        """Cut when predictions are asked for; lengthscales alone need none."""
        return RegionTree(self.points, self.region_size)

    @cached_property
    def regions(self) -> DataFrame:
        """Stored: node, X, Y, N, S."""
        return durable(grouped_points(self.tree.points, "node"))

    @property
    def lengthscales(self) -> np.ndarray:
        return np.exp(self.theta[:len(self.features)])

    def scaled(self) -> Column:
        """The features of a candidate row as the model's x."""
        return F.array(*[F.lit(0.5) if self.x_const[j] else (F.col(f"`{f}`").cast("double") - float(self.x_lo[j])) / float(self.x_rng[j])
                         for j, f in enumerate(self.features)])

    def scale_x(self, X: np.ndarray) -> np.ndarray:
        Z = (X - self.x_lo) / self.x_rng
        Z[:, self.x_const] = 0.5
        return Z


def objective(points: DataFrame, p: int, n: int, fit_rows: int = FIT_ROWS, seed: int = 42) -> Evaluate:
    """What a fit minimises, per row: the experts' negative log likelihoods and the priors', at several theta in one job."""
    n_experts = max(1, math.ceil(points.count() / fit_rows))
    dealt = points.withColumn("expert", F.pmod(F.xxhash64("x", F.lit(seed)), F.lit(n_experts)))
    experts = durable(grouped_points(dealt, "expert"))

    def evaluate(thetas: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        out = []
        for (v, g), theta in zip(nll_job(experts, thetas), thetas):
            pv, pg = prior_nll_grad(theta, p)
            out.append(((v + pv) / n, (g + pg) / n))
        return out
    return evaluate


def fit_gp(df: DataFrame, features: Sequence[str], target: str, n_iter: int = MAX_JOBS, random_state: int = 42,
           expert_size: int = REGION_ROWS, min_rows: int = 2, fit_rows: int = FIT_ROWS) -> GPModel:
    """Fit the surrogate; errors on too few rows or a constant response."""
    feats = list(features)
    data = df.select(*dict.fromkeys(feats + [target])).dropna()
    stats = column_moments(data, list(dict.fromkeys(feats + [target])))
    n, p = stats[target]["n"], len(feats)
    if n < min_rows:
        raise ValueError(f"a surrogate needs {min_rows} rows or more, the table has {n} without missing values")
    if not stats[target]["std"]:
        raise ValueError(f"{target} is constant: zero variance leaves a surrogate nothing to learn")
    lo = np.array([stats[f]["min"] for f in feats], dtype=float)
    rng = np.array([stats[f]["max"] for f in feats], dtype=float) - lo
    const = rng == 0
    rng[const] = 1.0
    y_mean, y_std = stats[target]["mean"], stats[target]["std"]
    points = durable(merged_points(data, feats, target, lo, rng, const, y_mean, y_std))
    theta = lbfgs(objective(points, p, n, fit_rows, random_state), np.r_[np.full(p, math.log(0.693)), 0.0, math.log(0.1), 0.0], min(max(n_iter, 2), MAX_JOBS))
    return GPModel(feats, target, theta, lo, rng, const, y_mean, y_std, points, expert_size)


def predict(model: GPModel, candidates: DataFrame, id_col: str = "cand_id") -> DataFrame:
    """``(id, mean, std)`` of the latent response in original units."""
    theta, p = model.theta, len(model.features)
    os_ = _unpack(theta, p)[1]
    near = F.array(F.col("x"))
    if model.tree.levels:           # probes a fraction of a lengthscale away in every direction
        reach = [float(min(REACH * v, 1.0)) for v in model.lengthscales]
        steps = [(d, s * reach[d]) for d in range(p) for s in (-1.0, 1.0)]
        moved = lambda d, s: F.array(*[F.element_at("x", i + 1) + (s if i == d else 0.0) for i in range(p)])
        near = F.array(F.col("x"), *[moved(d, s) for d, s in steps])
    cands = candidates.select(F.col(id_col).cast("long").alias("_id"), model.scaled().alias("_x"))
    probes = cands.withColumn("x", F.col("_x")).select("_id", "_x", F.explode(near).alias("x"))
    routed = model.tree.route(probes).select("_id", "_x", "node").distinct()
    sizes = durable(routed.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")))
    few = broadcast_if_small(sizes)
    left = routed.join(few, "node").select("_id", "_x", "node", F.pmod(F.xxhash64("_id"), F.col("chunks")).cast("int").alias("chunk"))
    right = model.regions.join(few, "node").select("node", "X", "Y", "N", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))

    def meet(asked: pd.DataFrame, region: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or region.empty:
            return pd.DataFrame({"_id": [], "num": [], "prec": [], "beta": []})
        r = region.iloc[0]
        mu, var = expert_predict(theta, rows_of(r["X"]), np.asarray(r["Y"], float), rows_of(asked["_x"]), np.asarray(r["N"], float))
        beta = 0.5 * (math.log(os_) - np.log(var))
        return pd.DataFrame({"_id": asked["_id"].to_numpy(), "num": beta * mu / var, "prec": beta / var, "beta": beta, "mu": mu, "var": var})

    parts = left.groupBy("node", "chunk").cogroup(right.groupBy("node", "chunk")).applyInPandas(
        meet, "_id long, num double, prec double, beta double, mu double, var double")
    sums = parts.groupBy("_id").agg(F.sum("num").alias("num"), F.sum("prec").alias("prec"), F.sum("beta").alias("beta"),
                                    F.count(F.lit(1)).alias("k"), F.max("mu").alias("mu"), F.max("var").alias("var"))
    total = F.greatest(F.col("prec") + (1.0 - F.col("beta")) / os_, F.lit(1e-12))
    mean = F.when(F.col("k") == 1, F.col("mu")).otherwise(F.col("num") / total)        # one region: its own posterior
    var = F.when(F.col("k") == 1, F.col("var")).otherwise(1.0 / total)
    return sums.select(F.col("_id").alias(id_col), (mean * model.y_std + model.y_mean).alias("mean"), (F.sqrt(var) * model.y_std).alias("std"))


def predict_at(model: GPModel, X: np.ndarray, spark: SparkSession) -> list[tuple[float, float]]:
    """(mean, standard deviation) in original units at a few points."""
    asked = pd.DataFrame(np.asarray(X, float), columns=model.features)
    asked.insert(0, "cand_id", np.arange(len(asked)))
    got = {r["cand_id"]: (r["mean"], r["std"]) for r in predict(model, spark.createDataFrame(asked)).collect()}
    return [got[i] for i in range(len(asked))]


class Correlation:
    """Posterior correlations between any points, from a GP on a sample of at most ``rows`` points (all of them, if fewer).

    Means and variances come from all points (``predict``); only how candidates move together is taken from the
    sample, which makes every batch's covariance that of one proper model.
    """

    def __init__(self, model: GPModel, rows: int = REGION_ROWS):
        chosen = model.points.orderBy(F.xxhash64("x"), "x").limit(rows).collect()          # bounded by ``rows``
        X, count = rows_of([r["x"] for r in chosen]), np.array([r["n"] for r in chosen])
        self.theta, self.X = model.theta, X
        ls, os_, noise, _ = _unpack(model.theta, len(model.features))
        self.ls, self.os = ls, os_
        self.Linv = np.linalg.inv(np.linalg.cholesky(os_ * matern52(X, X, ls)[0] + np.diag(noise / count + JITTER)))

    def half(self, Z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a set of points needs for its correlations: (whitened covariances with the sample, standard deviations)."""
        V = self.Linv @ (self.os * matern52(self.X, Z, self.ls)[0])
        return V, np.sqrt(np.maximum(self.os - (V * V).sum(axis=0), 1e-12))

    def between(self, Za, half_a, Zb, half_b) -> np.ndarray:
        cov = self.os * matern52(Za, Zb, self.ls)[0] - half_a[0].T @ half_b[0]
        return np.clip(cov / np.outer(half_a[1], half_b[1]), -1.0, 1.0)


def ard_importance(model: GPModel, spark: SparkSession, names=("lengthscale", "importance")) -> DataFrame:
    """Lengthscales, normalised inverse lengthscales and their rank."""
    ls = model.lengthscales
    inv = 1.0 / ls
    imp = inv / inv.sum()
    pdf = pd.DataFrame({"target": model.target, "feature": model.features, names[0]: ls, names[1]: imp})
    df = spark.createDataFrame(pdf)
    w = Window.partitionBy("target").orderBy(F.col(names[1]).desc())
    return df.withColumn("rank", F.rank().over(w).cast("long"))


def run_ard_gp(df: DataFrame, feature_cols: Sequence[str], target: str, n_iter: int = MAX_JOBS,
               random_state: int = 42, expert_size: int = REGION_ROWS) -> DataFrame:
    """ARD-GP feature importance; needs n >= p + 2 rows."""
    n = df.where(F.col(target).isNotNull()).count()
    p = len(feature_cols)
    if n == 0:
        raise ValueError("the table must have at least one row with a response")
    if n < p + 2:
        raise ValueError(f"{p} lengthscales need {p + 2} rows or more, the table has {n}")
    model = fit_gp(df, feature_cols, target, n_iter, random_state, expert_size)
    return ard_importance(model, df.sparkSession)
