"""Missing values, role projection and scaling.

Column statistics (means, standard deviations, minima, maxima) come from one
aggregation over the rows; the p resulting numbers are applied as literals,
so the scaled table is a narrow projection that stays in whole-stage codegen.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _any_null(cols: Sequence[str]):
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.col(c).isNull()
    return cond


def drop_missing(df: DataFrame, cols: Sequence[str] | None = None,
                 row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Rows without NULLs in ``cols`` (default all) and the dropped row ids.

    The dropped ids come back as a DataFrame, not a driver-side list; without an
    id column the dropped rows themselves.
    """
    check = list(cols) if cols is not None else [c for c in df.columns if c != row_id]
    missing = [c for c in check if c not in df.columns]
    if missing:
        raise ValueError(f"Columns not found in DataFrame: {missing}")
    cleaned = df.where(~_any_null(check))
    dropped = df.where(_any_null(check)).select(*([row_id] if row_id in df.columns else df.columns))
    return cleaned, dropped


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(column, n_missing)`` for the selected columns (one pass)."""
    cols = list(cols) if cols is not None else list(df.columns)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, n_missing long")
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(cols)])
    return wide.unpivot([], [f"_m{i}" for i in range(len(cols))], "_k", "n_missing") \
        .select(F.element_at(F.array(*[F.lit(c) for c in cols]),
                             F.substring("_k", 3, 10).cast("int") + 1).alias("column"),
                F.col("n_missing").cast("long"))


def resolve_missing(df: DataFrame, feature_cols: Sequence[str], target_cols: Sequence[str],
                    drop_rows_for: Sequence[str] = (), exclude: Sequence[str] = ()
                    ) -> tuple[DataFrame, list[str], list[str]]:
    """P5: per column either drop the rows with missing values or drop the column.

    At least one feature and one target must survive.
    """
    features = [c for c in feature_cols if c not in exclude]
    targets = [c for c in target_cols if c not in exclude]
    if not features:
        raise ValueError("At least one feature column must remain after excluding columns.")
    if not targets:
        raise ValueError("At least one target column must remain after excluding columns.")
    out = df.dropna(subset=list(drop_rows_for)) if drop_rows_for else df
    return out.drop(*[c for c in exclude if c in df.columns]), features, targets


def project_roles(df: DataFrame, feature_cols: Sequence[str], target: str | Sequence[str],
                  row_id: str | None = "row_id") -> DataFrame:
    """X and y of one screening (Catalyst prunes the other columns)."""
    targets = [target] if isinstance(target, str) else list(target)
    keep = ([row_id] if row_id and row_id in df.columns else []) + list(feature_cols) + targets
    return df.select(*keep)


def column_moments(df: DataFrame, cols: Sequence[str]) -> dict[str, dict[str, float]]:
    """Mean, population std, min, max and count of each column (one job)."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.count(x).alias(f"n{i}")]
    row = df.agg(*aggs).first()
    return {c: {"mean": row[f"m{i}"], "std": row[f"s{i}"], "min": row[f"lo{i}"],
                "max": row[f"hi{i}"], "n": row[f"n{i}"]} for i, c in enumerate(cols)}


def standardize(df: DataFrame, cols: Sequence[str], stats: dict | None = None,
                suffix: str = "") -> DataFrame:
    """(x - mean) / population std; a constant column becomes 0."""
    stats = stats or column_moments(df, cols)
    new = {}
    for c in cols:
        m, s = stats[c]["mean"], stats[c]["std"]
        x = F.col(c).cast("double")
        new[c + suffix] = (x - F.lit(m)) / F.lit(s) if s and s > 0 else \
            F.when(x.isNotNull(), F.lit(0.0))
    return df.withColumns(new)


def minmax(df: DataFrame, cols: Sequence[str], stats: dict | None = None,
           suffix: str = "") -> DataFrame:
    """Scale to [0, 1] by the observed range; a constant column becomes 0.5."""
    stats = stats or column_moments(df, cols)
    new = {}
    for c in cols:
        lo, hi = stats[c]["min"], stats[c]["max"]
        x = F.col(c).cast("double")
        new[c + suffix] = (x - F.lit(lo)) / F.lit(hi - lo) if hi is not None and hi > lo else \
            F.when(x.isNotNull(), F.lit(0.5))
    return df.withColumns(new)


def scalarize(df: DataFrame, target_cols: Sequence[str], weights: Sequence[float],
              col_name: str = "_combined_score",
              maximize_targets: Sequence[bool] | None = None) -> DataFrame:
    """Weighted sum of min-max scaled targets (minimised targets flipped).

    Weights must be non-negative and not all zero; they are normalised to
    sum to 1.
    """
    total = float(sum(weights))
    if not target_cols or len(weights) != len(target_cols) or min(weights) < 0 or total == 0:
        raise ValueError(f"{list(target_cols)} need one weight each, none negative and some above zero; got {list(weights)}")
    stats = column_moments(df, target_cols)
    score = F.lit(0.0)
    for i, (t, w) in enumerate(zip(target_cols, weights)):
        lo, hi = stats[t]["min"], stats[t]["max"]
        y = F.col(t).cast("double")
        norm = (y - F.lit(lo)) / F.lit(hi - lo) if hi is not None and hi > lo else F.lit(0.5)
        if maximize_targets is not None and not maximize_targets[i]:
            norm = 1.0 - norm
        score = score + F.lit(w / total) * norm
    return df.withColumn(col_name, score)


def scalarize_scenarios(df: DataFrame, target_cols: Sequence[str],
                        maximize_targets: Sequence[bool] | None = None,
                        col_name: str = "_combined_score") -> DataFrame:
    """One one-hot scenario per target ("Max t"/"Min t") plus "Balanced".

    Every row is expanded into its k+1 scenario rows by exploding a literal
    array (no join); the output carries ``Scenario``.
    """
    maximize = list(maximize_targets) if maximize_targets is not None else [True] * len(target_cols)
    k = len(target_cols)
    scen = []
    for i, t in enumerate(target_cols):
        scen.append((f"{'Max' if maximize[i] else 'Min'} {t}", [1.0 if j == i else 0.0 for j in range(k)]))
    scen.append(("Balanced", [1.0 / k] * k))
    scen_col = F.array(*[F.struct(F.lit(name).alias("Scenario"),
                                  F.array(*[F.lit(w) for w in ws]).alias("_w"))
                         for name, ws in scen])
    stats = column_moments(df, target_cols)
    score = F.lit(0.0)
    for i, t in enumerate(target_cols):
        lo, hi = stats[t]["min"], stats[t]["max"]
        y = F.col(t).cast("double")
        norm = (y - F.lit(lo)) / F.lit(hi - lo) if hi is not None and hi > lo else F.lit(0.5)
        if not maximize[i]:
            norm = 1.0 - norm
        score = score + F.col("_s._w")[i] * norm
    return (df.withColumn("_s", F.explode(scen_col))
            .withColumn(col_name, score)
            .withColumn("Scenario", F.col("_s.Scenario")).drop("_s"))
