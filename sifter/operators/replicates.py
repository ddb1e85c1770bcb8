"""Replicates: detection, averaging, summary and IQR outliers.

A replicate group is a set of rows with identical feature values.  All
operators group on the feature tuple with one hash aggregation (partial
aggregation happens map-side, so a hot condition holding a third of all rows
is pre-combined before the shuffle).  Group ids follow first appearance in
``row_id`` order and are assigned by ``ordered_index`` over the (one row per
group) group table, never by an un-partitioned window over rows.

Rows with a NULL feature are not part of any group (a data-frame groupby
drops missing keys); ``sifter.operators.cleaning.drop_missing`` reports them.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.functions.broadcasting import spread_join
from sifter.functions.ordering import exact_quantiles, ordered_index
from sifter.session import durable

# Replicate strategies and the IQR fence factor (k = 1.5, at
# least 3 values per group).
STRATEGIES = ("average", "keep_all", "std_uncertainty")
IQR_K = 1.5
IQR_MIN_VALUES = 3


def validate_roles(df: DataFrame, feature_cols: Sequence[str],
                   target_cols: Sequence[str] | None = None) -> None:
    """Each given role names at least one column of ``df``, and no column has two roles."""
    roles = {"feature_cols": list(feature_cols)}
    if target_cols is not None:
        roles["target_cols"] = list(target_cols)
    for role, names in roles.items():
        unknown = [c for c in names if c not in df.columns]
        if unknown or not names:
            raise ValueError(f"{role}: " + (f"not in the table: {unknown}" if unknown else "no column given"))
    twice = sorted(set(roles["feature_cols"]).intersection(roles.get("target_cols", ())))
    if twice:
        raise ValueError(f"a column is either an input or a response, not both: {twice}")


def _keyed(df: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    cond = F.col(feature_cols[0]).isNotNull()
    for c in feature_cols[1:]:
        cond = cond & F.col(c).isNotNull()
    return df.where(cond)


def replicate_groups(df: DataFrame, feature_cols: Sequence[str], row_id: str = "row_id",
                     extra_aggs: Sequence = ()) -> DataFrame:
    """One row per replicated condition: features, first row, size, group id."""
    groups = (_keyed(df, feature_cols).groupBy(*feature_cols)
              .agg(F.count(F.lit(1)).alias("n_replicates"), F.min(row_id).alias("_first"),
                   *extra_aggs)
              .where(F.col("n_replicates") > 1))
    return ordered_index(groups, ["_first"], name="replicate_group")


def detect_replicates(df: DataFrame, feature_cols: Sequence[str],
                      row_id: str = "row_id") -> DataFrame:
    """A1: rows whose feature tuple occurs more than once, plus ``replicate_group``."""
    validate_roles(df, feature_cols)
    groups = replicate_groups(df, feature_cols, row_id).select(*feature_cols, "replicate_group")
    # one row per replicated condition: broadcast if its bytes fit, else only frequent conditions are
    return spread_join(_keyed(df, feature_cols), groups, list(feature_cols), "inner") \
        .withColumn("replicate_group", F.col("replicate_group").cast("long"))


def handle_replicates(df: DataFrame, feature_cols: Sequence[str], target_cols: Sequence[str],
                      strategy: str = "average", row_id: str = "row_id") -> DataFrame:
    """A2/A3/A4: collapse each condition to one row.

    ``average``: mean of each target (NULLs skipped), first non-NULL value
    (in ``row_id`` order) of every other column.  ``std_uncertainty`` adds
    ``<t>_std`` (sample std, NULL for single rows).  ``keep_all`` returns the
    input.  Column order: features, targets, [stds], others.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown strategy '{strategy}'. Valid options: {sorted(STRATEGIES)}")
    validate_roles(df, feature_cols, target_cols)
    if strategy == "keep_all":
        return df
    others = [c for c in df.columns if c not in feature_cols and c not in target_cols and c != row_id]
    aggs = [F.avg(F.col(t).cast("double")).alias(t) for t in target_cols]
    if strategy == "std_uncertainty":
        aggs += [F.stddev_samp(F.col(t).cast("double")).alias(f"{t}_std") for t in target_cols]
    aggs += [F.min_by(F.col(o), F.when(F.col(o).isNotNull(), F.col(row_id))).alias(o)
             for o in others]
    aggs.append(F.min(row_id).alias(row_id))
    out = _keyed(df, feature_cols).groupBy(*feature_cols).agg(*aggs)
    order = list(feature_cols) + list(target_cols)
    if strategy == "std_uncertainty":
        order += [f"{t}_std" for t in target_cols]
    return out.select(*order, *others, row_id)


def replicate_summary(df: DataFrame, feature_cols: Sequence[str], target_cols: Sequence[str],
                      row_id: str = "row_id") -> DataFrame:
    """A5: per replicated condition, size and mean/std of every target."""
    validate_roles(df, feature_cols, target_cols)
    stats = []
    for t in target_cols:
        stats += [F.avg(F.col(t).cast("double")).alias(f"{t}_mean"),
                  F.stddev_samp(F.col(t).cast("double")).alias(f"{t}_std")]
    groups = replicate_groups(df, feature_cols, row_id, stats)
    cols = [*feature_cols, "replicate_group", "n_replicates"] + \
        [f"{t}_{s}" for t in target_cols for s in ("mean", "std")]
    return groups.withColumn("replicate_group", F.col("replicate_group").cast("long")).select(*cols)


def iqr_outliers(df: DataFrame, feature_cols: Sequence[str], target_cols: Sequence[str],
                 row_id: str = "row_id", k: float = IQR_K) -> DataFrame:
    """Rows outside [q1 - k*IQR, q3 + k*IQR] of their replicate group.

    Per target, only groups with >= 3 non-NULL values and IQR != 0 flag rows;
    a row flagged for any target appears once.  Quartiles are exact
    (linear interpolation) and computed by range-partitioned scans, so a
    huge replicate group is never held by one task.
    """
    reps = durable(detect_replicates(df.select(row_id, *feature_cols, *target_cols), feature_cols, row_id))
    long_vals = reps.select("replicate_group", F.explode(F.array(*[
        F.struct(F.lit(t).alias("_t"), F.col(t).cast("double").alias("_v")) for t in target_cols])).alias("s")
    ).select("replicate_group", "s._t", "s._v")
    q = exact_quantiles(long_vals, ["_t", "replicate_group"], "_v", [0.25, 0.75])
    q = q.where((F.col("n") >= IQR_MIN_VALUES) & (F.col("q_1") - F.col("q_0") != 0)).select(
        "_t", "replicate_group",
        (F.col("q_0") - k * (F.col("q_1") - F.col("q_0"))).alias("_lo"),
        (F.col("q_1") + k * (F.col("q_1") - F.col("q_0"))).alias("_hi"))
    # fences wide, one row a group: one join and one filter over the rows
    wide = q.groupBy("replicate_group").agg(*[F.max(F.when(F.col("_t") == t, F.col(e))).alias(f"{e}_{i}")
                                              for i, t in enumerate(target_cols) for e in ("_lo", "_hi")])
    out_of = F.lit(False)
    for i, t in enumerate(target_cols):
        v = F.col(t).cast("double")
        out_of = out_of | F.coalesce((v < F.col(f"_lo_{i}")) | (v > F.col(f"_hi_{i}")), F.lit(False))
    hits = spread_join(reps, wide, ["replicate_group"], "inner").where(out_of).select(row_id).distinct()
    return df.join(hits, row_id, "left_semi")


def remove_rows(df: DataFrame, rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Drop the given rows (anti join on ``row_id``)."""
    return df.join(rows.select(row_id), row_id, "left_anti")


def count_groups(df: DataFrame, col: str = "replicate_group") -> DataFrame:
    """Number of distinct groups."""
    return df.agg(F.count_distinct(col).alias("n_groups"))
