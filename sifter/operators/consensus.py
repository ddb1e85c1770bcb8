"""Consensus ranking across methods.

Input is a long ranking table ``(target, method, feature, rank)``; every
screening keeps its results in this shape, so any number of targets is
handled by grouping, never by a driver loop.  The tables are one row per
(target, method, feature): windows partitioned by ``target`` are small.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Importance labels and their thresholds (share of methods that
# rank a feature in the top K), and the top-K rule K = max(3, n // 3).
LABEL_STRONG = "strongly important"
LABEL_MODERATE = "moderately important"
LABEL_WEAK = "weakly important or inconsistent"
STRONG_SHARE, MODERATE_SHARE = 0.75, 0.50
TOP_K_MIN, TOP_K_DIVISOR = 3, 3


def ranking_from(result: DataFrame, method: str, rank_col: str = "rank",
                 group_cols: Sequence[str] = ("target",)) -> DataFrame:
    """K4: ``(target, method, feature, rank)`` from any method result.

    First-seen order in the consensus is (method order, rank, feature order).
    """
    groups = [g for g in group_cols if g in result.columns]
    return result.select(*groups, F.lit(method).alias("method"), "feature",
                         F.col(rank_col).cast("long").alias("rank"))


def compute_consensus(rankings: DataFrame, methods: Sequence[str] | None = None,
                      group_cols: Sequence[str] = ("target",),
                      feature_order: Sequence[str] | None = None) -> DataFrame:
    """K5-K7: consensus per group.

    * features = union over methods, first-seen order = (method order, rank,
      feature order);
    * a feature missing from a method gets rank n_features;
    * ``avg_normalized_rank`` = mean over methods of rank / n_features;
    * ``n_methods_top_k`` = methods ranking it <= max(3, n_features // 3);
    * ``consensus_rank`` 1..n by avg_normalized_rank, ties by first seen.

    Columns: group, feature, ``<method>_rank``..., avg_normalized_rank,
    consensus_rank, n_methods_top_k.
    """
    groups = [g for g in group_cols if g in rankings.columns]
    if methods is None:
        methods = [r[0] for r in rankings.select("method").distinct().orderBy("method").collect()]
    methods = list(methods)
    mpos = F.array_position(F.array(*[F.lit(m) for m in methods]), F.col("method"))
    fpos = (F.array_position(F.array(*[F.lit(f) for f in feature_order]), F.col("feature"))
            if feature_order else F.lit(0))
    r = rankings.withColumn("_mpos", mpos).withColumn("_fpos", fpos)
    feats = (r.groupBy(*groups, "feature")
             .agg(F.min(F.struct("_mpos", "rank", "_fpos", "feature")).alias("_first")))
    wg = Window.partitionBy(*groups)
    feats = feats.withColumn("_n", F.count(F.lit(1)).over(wg))
    grid = feats.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    filled = (grid.join(r.select(*groups, "method", "feature", "rank"),
                        [*groups, "method", "feature"], "left")
              .withColumn("_rank", F.coalesce(F.col("rank"), F.col("_n"))))
    top_k = F.greatest(F.lit(TOP_K_MIN), F.floor(F.col("_n") / TOP_K_DIVISOR))
    aggs = [F.max(F.when(F.col("method") == m, F.col("_rank"))).cast("long").alias(f"{m}_rank")
            for m in methods]
    aggs += [F.avg(F.col("_rank") / F.col("_n")).alias("avg_normalized_rank"),
             F.count_if(F.col("_rank") <= top_k).cast("long").alias("n_methods_top_k")]
    out = filled.groupBy(*groups, "feature", "_first").agg(*aggs)
    w = Window.partitionBy(*groups).orderBy("avg_normalized_rank", "_first")
    out = out.withColumn("consensus_rank", F.row_number().over(w).cast("long"))
    return out.select(*groups, "feature", *[f"{m}_rank" for m in methods],
                      "avg_normalized_rank", "consensus_rank", "n_methods_top_k")


def label_expr(n_top_k: F.Column, n_methods: int) -> F.Column:
    frac = n_top_k / F.lit(float(n_methods))
    return (F.when(frac >= STRONG_SHARE, F.lit(LABEL_STRONG))
            .when(frac >= MODERATE_SHARE, F.lit(LABEL_MODERATE))
            .otherwise(F.lit(LABEL_WEAK)))


def label_importance(consensus: DataFrame, n_methods: int) -> DataFrame:
    """Label by the share of methods that put the feature in the top K."""
    if n_methods <= 0:
        raise ValueError(f"n_methods must be >= 1; got {n_methods}.")
    return consensus.withColumn("importance_label", label_expr(F.col("n_methods_top_k"), n_methods))


def default_selection(labelled: DataFrame, group_cols: Sequence[str] = ("target",),
                      fallback: int = 3) -> DataFrame:
    """Strong + moderate features; if a group has none, its first 3."""
    groups = [g for g in group_cols if g in labelled.columns]
    w = Window.partitionBy(*groups)
    good = F.col("importance_label").isin(LABEL_STRONG, LABEL_MODERATE)
    return (labelled.withColumn("_any", F.max(good.cast("int")).over(w))
            .where(good | ((F.col("_any") == 0) & (F.col("consensus_rank") <= fallback)))
            .drop("_any"))


def cross_target_labels(labelled: DataFrame, targets: Sequence[str] | None = None,
                        missing: str = "—") -> DataFrame:
    """K9: feature x target table of labels, a dash where a feature is absent."""
    if targets is None:
        targets = [r[0] for r in labelled.select("target").distinct().orderBy("target").collect()]
    wide = labelled.groupBy("feature").pivot("target", list(targets)).agg(F.first("importance_label"))
    return wide.fillna(missing, subset=list(targets))


def stability_summary(boot_ranks: DataFrame, group_cols: Sequence[str] = ("target", "method")
                      ) -> DataFrame:
    """K3: per feature median / quartiles / population std of bootstrap ranks.

    ``boot_ranks``: ``(group..., b, feature, rank)`` with one row per
    successful replicate b.  Ranks are small integers (<= p), so the
    per-feature ``percentile`` buffers hold at most p distinct values.
    """
    groups = [g for g in group_cols if g in boot_ranks.columns]
    n_ok = boot_ranks.groupBy(*groups).agg(F.count_distinct("b").alias("n_success"))
    q = (boot_ranks.groupBy(*groups, "feature")
         .agg(F.percentile(F.col("rank").cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
              F.stddev_pop(F.col("rank").cast("double")).alias("rank_std")))
    if not groups:  # one-row totals: equi-join on a constant key
        q, n_ok, groups_j = q.withColumn("_k", F.lit(1)), n_ok.withColumn("_k", F.lit(1)), ["_k"]
    else:
        groups_j = groups
    out = q.join(F.broadcast(n_ok), groups_j)
    return out.select(*groups, "feature", F.col("_q")[1].alias("median_rank"),
                      F.col("_q")[0].alias("rank_q25"), F.col("_q")[2].alias("rank_q75"),
                      "rank_std", F.col("n_success").cast("long"))
