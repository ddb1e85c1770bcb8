"""The screening pipeline (M17): every method for every target, then consensus.

``screen`` returns long tables keyed by ``target`` (and ``method``) instead of
nested dicts.  Correlations run for all targets in one job; moment-based
methods share one moment aggregation per target; forest/SHAP/GP fit per
target.  The processed input is checkpointed once so no method recomputes
the ingest.
"""

from __future__ import annotations

from typing import NamedTuple, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.operators import bootstrap as bst
from sifter.operators import consensus as cons
from sifter.operators import correlate as cor
from sifter.operators import forest as frs
from sifter.operators import gp as gpm
from sifter.operators import narrate as nar
from sifter.operators.linear import run_lasso
from sifter.operators.pca import run_pca
from sifter.session import durable

METHODS = ("lasso", "random_forest", "shap", "pca", "correlations", "ard_gp")


class ScreenResult(NamedTuple):
    rankings: DataFrame      # target, method, feature, rank
    tables: dict             # method -> result DataFrame (all targets)
    consensus: DataFrame     # target, feature, <method>_rank..., labels
    narratives: DataFrame    # target, method, narrative
    stability: DataFrame | None = None      # target, method, feature, bootstrap rank statistics


RESAMPLED = ("lasso", "random_forest", "shap", "pca", "correlations")   # a Gaussian process is not refitted


def _stability(data: DataFrame, features: list[str], targets: list[str], methods: Sequence[str], categorical: list[str],
               row_id: str, n_bootstrap: int, seed: int, lasso: dict, trees: tuple) -> DataFrame | None:
    """K1-K3 of every bootstrapped method and target on resampled rows; PCA knows no target and runs once."""
    fits = {
        "lasso": lambda t: lambda d: run_lasso(d, features, t, row_order=[row_id], **lasso),
        "random_forest": lambda t: lambda d: frs.run_random_forest(d, features, t, *trees),
        "shap": lambda t: lambda d: frs.run_shap(d, features, t, row_id, *trees).feature_importance,
        "pca": lambda t: lambda d: run_pca(d, features).feature_rank,
        "correlations": lambda t: lambda d: cor.run_correlations(d, features, t, categorical_cols=categorical),
    }
    out = None
    for m in (m for m in methods if m in RESAMPLED):
        for group in ([targets] if m == "pca" else [[t] for t in targets]):
            ranks = bst.bootstrap_refit(data, fits[m](group[0]), n_bootstrap, seed, row_id, weighted=False)
            part = bst.rank_stability(ranks).withColumn("target", F.explode(F.array(*[F.lit(t) for t in group])))
            part = part.select("target", F.lit(m).alias("method"), *[c for c in part.columns if c != "target"])
            out = part if out is None else out.unionByName(part)
    return out


def screen(df: DataFrame, feature_cols: Sequence[str], target_cols: Sequence[str],
           methods: Sequence[str] = METHODS, categorical_cols: Sequence[str] | None = None,
           row_id: str = "row_id", lasso_alpha: float | None = None, lasso_cv: int = 5,
           n_estimators: int = 100, max_depth: int | None = None, random_state: int = 42,
           gp_iter: int = gpm.MAX_JOBS, n_bootstrap: int = 0) -> ScreenResult:
    """Every method for every target; ``n_bootstrap`` > 0 adds the rank stability of ``RESAMPLED`` methods."""
    unknown = [m for m in methods if m not in METHODS]
    if unknown:
        raise ValueError(f"Unknown methods: {unknown}; valid: {list(METHODS)}")
    feats, targets = list(feature_cols), list(target_cols)
    cats = list(categorical_cols or [])
    data = durable(df.select(row_id, *feats, *targets))
    # as in the reference, encoded categoricals (integer codes) go to every
    # method as numbers; only correlations treats them as groups (ANOVA)
    numeric = feats
    tables: dict[str, DataFrame] = {}
    parts: list[DataFrame] = []

    def add(method, table):
        tables[method] = table if method not in tables else tables[method].unionByName(table)

    for t in targets:
        if "lasso" in methods:
            add("lasso", run_lasso(data, numeric, t, alpha=lasso_alpha, cv=lasso_cv, row_order=[row_id]))
        if "random_forest" in methods:
            add("random_forest", frs.run_random_forest(data, numeric, t, n_estimators, max_depth, random_state))
        if "shap" in methods:
            add("shap", frs.run_shap(data, numeric, t, row_id, n_estimators, max_depth,
                                     random_state).feature_importance)
        if "ard_gp" in methods:
            add("ard_gp", gpm.run_ard_gp(data, numeric, t, gp_iter, random_state))
    if "pca" in methods:
        p = run_pca(data, numeric)
        fr = p.feature_rank
        tables["pca"] = fr
        tables["pca_variance"] = p.variance
        tables["pca_loadings"] = p.loadings
        for t in targets:
            parts.append(fr.select(F.lit(t).alias("target"), F.lit("pca").alias("method"), "feature",
                                   F.col("rank").cast("long")))
    if "correlations" in methods:
        tables["correlations"] = cor.run_correlations(data, feats, targets, categorical_cols=cats)
    for m in methods:
        if m in ("pca",):
            continue
        parts.append(cons.ranking_from(tables[m], m))
    rankings = parts[0]
    for p_ in parts[1:]:
        rankings = rankings.unionByName(p_)
    rankings = durable(rankings)
    c = cons.compute_consensus(rankings, list(methods), feature_order=feats)
    labelled = cons.label_importance(c, len(methods))
    narr = [nar.interpret_consensus(labelled, len(methods))]
    if "correlations" in tables:
        narr.append(nar.interpret_correlations(tables["correlations"], feats))
    if "lasso" in tables:
        narr.append(nar.interpret_lasso(tables["lasso"], feats))
    if "random_forest" in tables:
        narr.append(nar.interpret_random_forest(tables["random_forest"], feats))
    if "shap" in tables:
        narr.append(nar.interpret_shap(tables["shap"], feats))
    if "ard_gp" in tables:
        narr.append(nar.interpret_ard_gp(tables["ard_gp"], feats))
    narratives = narr[0]
    for n_ in narr[1:]:
        narratives = narratives.unionByName(n_)
    if "pca" in tables:
        pn = nar.interpret_pca(tables["pca_variance"], tables["pca_loadings"], tables["pca"], feats)
        tg = data.sparkSession.createDataFrame([(t,) for t in targets], "target string")
        narratives = narratives.unionByName(
            tg.withColumn("_k", F.lit(1)).join(pn.withColumn("_k", F.lit(1)), "_k")
            .select("target", "method", "narrative"))
    stability = None
    if n_bootstrap:
        stability = _stability(data, feats, targets, methods, cats, row_id, n_bootstrap, random_state,
                               {"alpha": lasso_alpha, "cv": lasso_cv}, (n_estimators, max_depth, random_state))
    return ScreenResult(rankings, tables, labelled, narratives, stability)
