"""Bootstrap rank stability (K1-K3).

Resampling with replacement is expressed as row weights.  Each (replicate b,
row) gets a Poisson(1) count from a seeded hash of (row key, b, seed), the
standard distributed form of the bootstrap: no draw table, no join, rows
never move.  For methods that need only moments (Pearson, ANOVA, LASSO at a
fixed alpha or with its own cross-validation, PCA) all B replicates come out
of one pass: a task hashes a batch's rows into a weight matrix (rows x B)
and multiplies it with the batch's cross-products; B small matrices a task
are added up in Spark and finished on the driver.  Rows are read a constant
number of times whatever B is.  Any other method (forest, SHAP, a user
callable) is refitted once per replicate with the weight column, or with the weight columns of several replicates at once.

A replicate "fails" (is skipped and not counted) when its statistics are
degenerate, e.g. a zero-variance column.
"""

from __future__ import annotations

import math
from typing import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sifter.functions.draws import PER_HASH, resampling_digits, resampling_draws, resampling_hash
from sifter.operators.consensus import stability_summary
from sifter.operators.linear import _standardised_problem, coordinate_descent, cross_validated_alpha
from sifter.operators.moments import Moments, combine, correlation_from
from sifter.operators.pca import fit_pca
from sifter.session import durable

MOMENT_METHODS = ("pearson", "anova", "lasso", "lasso_cv", "pca")

TOGETHER = 8                # replicates that one refit takes at once

HELD_CATEGORIES = 1000      # categories whose sums a task keeps between batches

# P(K <= k) for K ~ Poisson(1), k = 0..11
_POISSON1_CDF = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


# the same as draws of 32 bits: K > k from here on
_POISSON1_CUTS = [min(math.ceil(v * (1 << 32)), (1 << 32) - 1) for v in _POISSON1_CDF]


def _counted(digits: Column) -> Column:
    """The Poisson(1) count of a draw's eight hexadecimal digits."""
    w = F.lit(len(_POISSON1_CUTS))
    for k in range(len(_POISSON1_CUTS) - 1, -1, -1):
        w = F.when(digits < f"{_POISSON1_CUTS[k]:08x}", F.lit(k)).otherwise(w)
    return w.cast("double")


def poisson_weight(key: Column, b: Column, seed: int) -> Column:
    """Seeded Poisson(1) count for (row, replicate) by inverse CDF of an MD5 draw (any SQL engine can repeat it)."""
    # through a lambda variable: a plain CASE would hash anew in each of its branches
    return F.transform(F.array(resampling_digits(seed, key, b)), _counted)[0]


def weight_matrix(keys, n_bootstrap: int, seed: int) -> np.ndarray:
    """The same counts for a batch of row keys, rows x replicates."""
    draws = resampling_draws(seed, keys, n_bootstrap)
    counts = np.empty(draws.shape)
    for own, drawn in zip(counts, draws):       # a replicate at a time stays in the processor's cache
        n = np.zeros(drawn.shape, np.uint8)
        for cut in _POISSON1_CUTS:
            above = drawn >= np.uint32(cut)
            if not above.any():
                break
            n += above
        own[:] = n
    return counts.T


def replicate_rows(df: DataFrame, n_bootstrap: int, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """K1: ``(b, rows..., _w)``, one weighted copy of every row per replicate
    (rows with weight 0 are dropped)."""
    if n_bootstrap < 1:
        raise ValueError("n_bootstrap must be >= 1.")
    # one hash a row and PER_HASH replicates
    hashed = df.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit((n_bootstrap - 1) // PER_HASH))))
    hashed = hashed.withColumn("_hash", resampling_hash(seed, F.col(row_id), F.col("_group")))
    draws = F.array(*[F.struct((F.col("_group") * PER_HASH + j).alias("b"), F.substr("_hash", F.lit(8 * j + 1), F.lit(8)).alias("draw"))
                      for j in range(PER_HASH)])
    out = hashed.withColumn("_drawn", F.explode(draws))
    out = out.where((F.col("_drawn.b") < n_bootstrap) & (F.col("_drawn.draw") >= f"{_POISSON1_CUTS[0]:08x}"))
    return out.select(*df.columns, F.col("_drawn.b").alias("b"), _counted(F.col("_drawn.draw")).alias("_w"))


def _rank_desc(scores: np.ndarray) -> np.ndarray:
    """Min rank, descending, NaN last."""
    s = np.where(np.isnan(scores), -np.inf, scores)
    return np.array([1 + int(np.sum(s > v)) for v in s])


def _complete(df: DataFrame, cols: Sequence[str], row_id: str) -> DataFrame:
    known = df
    for c in dict.fromkeys([*cols, row_id]):
        known = known.where(F.col(c).isNotNull())
    return known.select(F.col(row_id).cast("long").alias("_row"), *[F.col(c).cast("double").alias(f"_z{i}") for i, c in enumerate(cols)])


def _summed(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial sums (keys, v array) of the tasks added up element by element: (keys, v)."""
    cells = parts.select(*keys, F.posexplode("v").alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"))
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("v"))


def replicate_moments(df: DataFrame, cols: Sequence[str], n_bootstrap: int, seed: int = 42, row_id: str = "row_id",
                      folds: int = 1) -> dict[int, list[Moments]]:
    """``{replicate: moments of each fold}`` of the resampled complete rows, in one pass over them.

    ``folds`` > 1 cuts every replicate's rows, in row order, into as many contiguous parts of equal length (the
    first ones a row longer); a repeated row may lie in two of them.  Range partitions are summed whole; only
    the few in which a fold of some replicate ends are read again, row by row.
    """
    q = len(cols)
    rows = _complete(df, cols, row_id)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"_z{i}").alias(f"m{i}") for i in range(q)]).first()
    if not stats["n"]:
        raise ValueError("X must contain at least one row.")
    centre = np.array([stats[f"m{i}"] for i in range(q)])
    names = [f"_z{i}" for i in range(q)]
    left, right = np.triu_indices(q + 1)
    if folds > 1:
        rows = durable(rows.repartitionByRange("_row").sortWithinPartitions("_row").withColumn("_part", F.spark_partition_id()))
    else:
        rows = rows.withColumn("_part", F.lit(0))

    def blocks(batches):
        """(part, products of the columns, counts): a few thousand rows of one part at a time, in row order."""
        for pdf in batches:
            for part, own in pdf.groupby("_part"):
                for a in range(0, len(own), 1 << 14):
                    some = own.iloc[a:a + (1 << 14)]
                    Z = np.column_stack([np.ones(len(some)), some[names].to_numpy(float) - centre])
                    yield part, Z[:, left] * Z[:, right], weight_matrix(some["_row"], n_bootstrap, seed)

    def whole(batches):
        acc: dict[int, np.ndarray] = {}
        for part, products, W in blocks(batches):
            acc[part] = acc.get(part, 0) + W.T @ products
        for part, sums in acc.items():
            yield pd.DataFrame({"_part": part, "b": np.arange(n_bootstrap), "v": list(sums)})

    parts = rows.mapInPandas(whole, "_part int, b int, v array<double>")
    if folds == 1:
        sums = _summed(parts.withColumn("f", F.lit(0)), ["b", "f"])
    else:
        # a part that lies within one fold of a replicate is added as it is
        drawn = F.col("v")[0]
        placed = durable(parts).withColumn("start", F.coalesce(F.sum(drawn).over(Window.partitionBy("b").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        placed = placed.withColumn("total", F.sum(drawn).over(Window.partitionBy("b")))
        size, longer = F.floor(F.col("total") / folds), F.col("total") % folds
        edges = [size * f + F.least(F.lit(float(f)), longer) for f in range(folds + 1)]
        fold = F.coalesce(*[F.when((F.col("start") >= edges[f]) & (F.col("start") + drawn <= edges[f + 1]), F.lit(f)) for f in range(folds)])
        placed = placed.withColumn("f", fold)
        cut: dict[int, dict[int, tuple]] = {}
        for r in placed.where("f is null").select("_part", "b", "start", "total").toLocalIterator():      # at most one an edge
            cut.setdefault(r["_part"], {})[r["b"]] = r["start"], fold_edges(r["total"], folds)

        def split(batches):
            acc: dict[tuple[int, int], np.ndarray] = {}
            at = {(part, b): start for part, bs in cut.items() for b, (start, _) in bs.items()}
            for part, products, W in blocks(batches):
                ends = np.cumsum(W, axis=0)
                for b, (_, edges) in cut[part].items():
                    w, start = W[:, b], at[part, b]
                    stop = start + ends[:, b]
                    at[part, b] = stop[-1]
                    for f in range(folds):
                        if edges[f + 1] > start and edges[f] < stop[-1]:
                            share = np.clip(np.minimum(stop, edges[f + 1]) - np.maximum(stop - w, edges[f]), 0, None)
                            acc[b, f] = acc.get((b, f), 0) + share @ products
            if acc:
                yield pd.DataFrame({"b": [b for b, _ in acc], "f": [f for _, f in acc], "v": list(acc.values())})

        pieces = placed.where("f is not null").select("b", "f", "v")
        if cut:
            pieces = pieces.unionByName(rows.where(F.col("_part").isin(list(cut))).mapInPandas(split, "b int, f int, v array<double>"))
        sums = _summed(pieces, ["b", "f"])

    out: dict[int, list[Moments]] = {}
    for r in sorted(sums.collect(), key=lambda r: (r["b"], r["f"])):
        S = np.zeros((q + 1, q + 1))
        S[left, right] = S[right, left] = r["v"]
        n = S[0, 0]
        if n > 0:
            out.setdefault(r["b"], []).append(Moments(n, centre + S[0, 1:] / n, S[1:, 1:] - np.outer(S[0, 1:], S[0, 1:]) / n))
    return out


def fold_edges(n: float, folds: int) -> np.ndarray:
    """Where ``folds`` contiguous parts of n rows begin and end."""
    size, longer = divmod(int(n), folds)
    return np.concatenate(([0], np.cumsum([size + (f < longer) for f in range(folds)])))


def _scores(method: str, parts: list[Moments], p: int, alpha: float, variance_threshold: float, max_components: int) -> np.ndarray | None:
    """What a replicate ranks its features by, or None if its statistics are degenerate."""
    m = combine(parts)
    if m.n < 2:
        return None
    sd = np.sqrt(np.clip(np.diag(m.M) / m.n, 0, None))
    if method == "pearson":
        if sd[p] == 0:
            return None
        return np.abs((m.M[:p, p] / m.n) / np.where(sd[:p] > 0, sd[:p] * sd[p], np.nan))
    if method == "lasso":
        return np.abs(coordinate_descent(*_standardised_problem(m, sd[:p]), alpha))
    if method == "lasso_cv":
        best = cross_validated_alpha(parts, m, sd[:p])
        return np.abs(coordinate_descent(*_standardised_problem(m, sd[:p]), best))
    _, comps, k = fit_pca(correlation_from(m), int(m.n), variance_threshold, max_components)
    return np.abs(comps[:, :k]).max(axis=1)


def bootstrap_ranks(df: DataFrame, feature_cols: Sequence[str], target: str | None, method: str,
                    n_bootstrap: int = 100, random_state: int = 42, row_id: str = "row_id",
                    alpha: float = 0.01, variance_threshold: float = 0.90,
                    max_components: int = 5, cv: int = 5) -> DataFrame:
    """K2 for moment-based methods: ``(b, feature, rank)`` of every good replicate.

    ``method``: ``pearson`` (|r|), ``anova`` (eta squared of categorical features), ``lasso`` (|coefficient| at
    ``alpha``), ``lasso_cv`` (alpha chosen anew by ``cv`` contiguous folds of each replicate) or ``pca``
    (max |loading|, unsupervised: ``target`` unused).
    """
    if method not in MOMENT_METHODS:
        raise ValueError(f"unknown moment method {method!r}")
    if n_bootstrap < 1:
        raise ValueError("n_bootstrap must be >= 1.")
    feats = list(feature_cols)
    if method == "anova":
        return _bootstrap_anova(df, feats, target, n_bootstrap, random_state, row_id)
    cols = feats + ([target] if method != "pca" else [])
    parts = replicate_moments(df, cols, n_bootstrap, random_state, row_id, cv if method == "lasso_cv" else 1)
    rows = []
    for b, folds in parts.items():
        score = _scores(method, folds, len(feats), alpha, variance_threshold, max_components)
        if score is not None:
            rows += [(int(b), f, int(rk)) for f, rk in zip(feats, _rank_desc(score))]
    return df.sparkSession.createDataFrame(rows, "b int, feature string, rank long")


def _bootstrap_anova(df: DataFrame, feats: list[str], target: str, n_bootstrap: int, seed: int, row_id: str) -> DataFrame:
    """Eta squared of every categorical feature and replicate, from sums per category added up in the tasks."""
    rows = df.where(F.col(target).isNotNull() & F.col(row_id).isNotNull())
    mean = rows.agg(F.avg(F.col(target).cast("double"))).first()[0]
    if mean is None:
        raise ValueError("X must contain at least one row.")
    slim = rows.select(F.col(row_id).cast("long").alias("_row"), (F.col(target).cast("double") - mean).alias("_y"),
                       *[F.col(f).cast("string").alias(f"_c{i}") for i, f in enumerate(feats)])

    def run(batches):
        held: list[dict] = [{} for _ in feats]      # sums of the categories met, at most HELD_CATEGORIES a feature

        def emptied(i):
            yield pd.DataFrame({"feature": i, "category": list(held[i]), "v": list(held[i].values())})
            held[i].clear()

        for pdf in batches:
            W = weight_matrix(pdf["_row"], n_bootstrap, seed)
            y = pdf["_y"].to_numpy(float)[:, None]
            W = np.hstack([W, W * y, W * y * y])
            for i in range(len(feats)):
                codes, names = pd.factorize(pdf[f"_c{i}"])
                order = np.argsort(codes, kind="stable")[np.count_nonzero(codes < 0):]      # nulls left out
                if not len(order):
                    continue
                sums = np.add.reduceat(W[order], np.flatnonzero(np.diff(codes[order], prepend=-1)), axis=0)
                for name, own in zip(names, sums):
                    held[i][name] = held[i].get(name, 0) + own
                if len(held[i]) > HELD_CATEGORIES:
                    yield from emptied(i)
        for i in range(len(feats)):
            if held[i]:
                yield from emptied(i)

    per = _summed(slim.mapInPandas(run, "feature int, category string, v array<double>"), ["feature", "category"])
    n, s, ss = (F.slice("v", k * n_bootstrap + 1, n_bootstrap) for k in range(3))
    each = per.select("feature", F.posexplode(F.arrays_zip(n.alias("n"), s.alias("s"), ss.alias("ss"))).alias("b", "z")).where("z.n > 0")
    sums = each.groupBy("feature", "b").agg(F.count(F.lit(1)).alias("groups"), F.sum("z.n").alias("n"), F.sum("z.s").alias("s"), F.sum("z.ss").alias("ss"),
                                            F.sum(F.col("z.s") * F.col("z.s") / F.col("z.n")).alias("between"))
    sst = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    eta2 = F.when(F.col("groups") < 2, None).when(sst <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("between") - F.col("s") * F.col("s") / F.col("n")) / sst)))
    scored = sums.select("b", F.element_at(F.array(*[F.lit(f) for f in feats]), F.col("feature") + 1).alias("feature"), eta2.alias("eta2")).where("eta2 is not null")
    w = Window.partitionBy("b").orderBy(F.col("eta2").desc())
    return scored.select(F.col("b").cast("int").alias("b"), "feature", F.rank().over(w).cast("long").alias("rank"))


def resampled(df: DataFrame, b: int, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """K1 as rows: each row as often as replicate ``b`` draws it, every copy with a row id of its own.

    A narrow ``explode`` of the same draws that ``replicate_rows`` uses as weights, for methods that take none.
    """
    times = poisson_weight(F.col(row_id), F.lit(b), seed).cast("int")
    copies = df.select("*", F.posexplode(F.array_repeat(F.lit(0), times)).alias("_copy", "_zero"))
    ids = F.col(row_id) * (len(_POISSON1_CDF) + 1) + F.col("_copy")
    return copies.withColumn(row_id, ids.cast("long")).drop("_copy", "_zero")


def weighted_rows(df: DataFrame, replicates: Sequence[int], seed: int = 42, row_id: str = "row_id") -> tuple[DataFrame, list[str]]:
    """K1 as columns: all rows with a count column for each of the replicates (0: not drawn), and these columns' names."""
    groups = sorted({b // PER_HASH for b in replicates})
    hashed = df.select("*", *[resampling_hash(seed, F.col(row_id), F.lit(g)).alias(f"_hash{g}") for g in groups])     # one a row and PER_HASH replicates
    names = [f"_w{b}" for b in replicates]
    counts = [_counted(F.substr(f"_hash{b // PER_HASH}", F.lit(8 * (b % PER_HASH) + 1), F.lit(8))).cast("tinyint").alias(n) for b, n in zip(replicates, names)]
    return hashed.select(*[F.col(f"`{c}`") for c in df.columns], *counts), names


def bootstrap_refit(df: DataFrame, method: Callable[..., DataFrame], n_bootstrap: int = 100,
                    random_state: int = 42, row_id: str = "row_id", weighted: bool = True, together: bool = False) -> DataFrame:
    """K2 for any method, one refit per replicate; returns ``(feature, rank, b)``.

    ``weighted``: ``method(df, weight_col)`` gets the drawn rows with their counts; otherwise ``method(df)``
    gets the resampled rows themselves, so correlations, Spearman ranks, ANOVA, cross-validated LASSO
    and SHAP run as they are.  ``together``: ``method(df, weight_cols)`` gets the rows with the counts of up to
    ``TOGETHER`` replicates, fits each of them in the same passes and returns (feature, rank, b), b being the
    replicate's place among the columns and missing if it is impossible to fit.  A replicate on which a fit is impossible (``ValueError`` or a singular
    matrix) is skipped and not counted; every other error is raised.
    """
    done: list[tuple] = []
    for start in range(0, n_bootstrap, TOGETHER) if together else ():
        drawn, names = weighted_rows(df, range(start, min(start + TOGETHER, n_bootstrap)), random_state, row_id)
        drawn = drawn.persist()
        try:
            done += [(r["feature"], int(r["rank"]), start + r["b"]) for r in method(drawn, names).select("feature", "rank", "b").collect()]
        except (ValueError, np.linalg.LinAlgError):
            continue
        finally:
            drawn.unpersist()
    for b in range(0 if together else n_bootstrap):
        if weighted:
            drawn = df.withColumn("_w", poisson_weight(F.col(row_id), F.lit(b), random_state)).where(F.col("_w") > 0)
        else:
            drawn = resampled(df, b, random_state, row_id)
        drawn = drawn.persist()         # a fit reads its rows several times; drawn anew, they are the same
        try:
            ranks = method(drawn, "_w") if weighted else method(drawn)
            # one row per feature; kept as values, so that no replicate is computed twice
            done += [(r["feature"], int(r["rank"]), b) for r in ranks.select("feature", "rank").collect()]
        except (ValueError, np.linalg.LinAlgError):
            continue
        finally:
            drawn.unpersist()
    return df.sparkSession.createDataFrame(done, "feature string, rank long, b int")


def rank_stability(boot_ranks: DataFrame) -> DataFrame:
    """K3: median, quartiles, population std and n_success per feature,
    sorted by median rank."""
    return stability_summary(boot_ranks, ()).orderBy("median_rank", "feature")
