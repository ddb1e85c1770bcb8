"""Feature-target association: Pearson, Spearman, one-way ANOVA (M1-M6).

* Pearson r for every (target, feature) pair comes from one aggregation of
  numerically stable central moments (``covar_pop``/``var_pop``) over the
  rows; r is formed with ``try_divide`` so a constant column gives NULL
  instead of an ANSI error.
* Spearman rho is Pearson on tie-averaged ranks.  Ranks are exact and come
  from range-partitioned scans (``average_ranks``), joined back by value.
* ANOVA per categorical feature: ``(n, mean, M2)`` per category from one
  grouped aggregate, then between/within sums of squares; eta^2 = SSB/SST.
* p-values (t with n-2 df, F) use the incomplete-beta UDF on the small
  per-feature table.

Output: one row per (target, feature) with the reference's columns plus
``target`` and ``n``; columns that do not apply to a feature are NULL.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sifter.functions.broadcasting import HOT_KEYS, ROW_OVERHEAD, shuffled, spread_join
from sifter.functions.ordering import average_ranks, prefix_sums
from sifter.functions.special import anova_p, corr_p
from sifter.session import durable

METHODS = ("pearson", "spearman", "both")
RANK_ROW_BYTES = ROW_OVERHEAD + 32         # a value and its rank
RANK_BYTES = 64 << 20                      # a column's ranks up to this size are broadcast


def _r(cov, vx, vy):
    return F.try_divide(cov, F.sqrt(vx * vy))


def pearson_table(df: DataFrame, feature_cols: Sequence[str], target_cols: Sequence[str],
                  rank_prefix: str = "") -> DataFrame:
    """``(target, feature, n, r)`` from one aggregate (pairwise complete rows)."""
    aggs, keys = [], []
    for i, t in enumerate(target_cols):
        for j, f in enumerate(feature_cols):
            x = F.col(f"{rank_prefix}{f}").cast("double")
            y = F.col(f"{rank_prefix}{t}").cast("double")
            both = F.col(f).isNotNull() & F.col(t).isNotNull()
            xb, yb = F.when(both, x), F.when(both, y)
            k = f"{i}_{j}"
            aggs += [F.count(xb).alias(f"n_{k}"), F.covar_pop(xb, yb).alias(f"c_{k}"),
                     F.var_pop(xb).alias(f"vx_{k}"), F.var_pop(yb).alias(f"vy_{k}")]
            keys.append((t, f, k))
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(f).alias("feature"),
                              F.col(f"n_{k}").alias("n"),
                              _r(F.col(f"c_{k}"), F.col(f"vx_{k}"), F.col(f"vy_{k}")).alias("r"))
                     for t, f, k in keys])
    out = wide.select(F.explode(rows).alias("s")).select("s.*")
    # a constant column has zero variance: r is NULL (try_divide by 0)
    return out.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def with_ranks(df: DataFrame, cols: Sequence[str], prefix: str = "rk_") -> DataFrame:
    """Add tie-averaged ranks ``<prefix><c>`` of each column (exact, distributed)."""
    long_vals = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_v")) for c in cols
    ])).alias("s")).select("s.*")
    ranks = durable(average_ranks(long_vals, ["_col"], "_v", "_rank", count_col="_times"))
    known = {r["_col"]: r for r in ranks.groupBy("_col").agg(       # a row a column
        F.count(F.lit(1)).alias("values"), F.sum("_times").alias("rows"), F.max("_times").alias("most")).collect()}
    out = df
    for c in cols:      # each column's table by its own size: a few levels are broadcast, many values shuffle
        own_ranks = ranks.where(F.col("_col") == c)
        rc = own_ranks.select(F.col("_v").alias(f"_v_{c}"), F.col("_rank").alias(f"{prefix}{c}"))
        own = out.withColumn(f"_v_{c}", F.col(c).cast("double"))
        if c not in known or known[c]["values"] * RANK_ROW_BYTES <= RANK_BYTES:
            joined = own.join(F.broadcast(rc), f"_v_{c}", "left")
        elif known[c]["most"] * HOT_KEYS <= known[c]["rows"]:
            joined = own.join(rc, f"_v_{c}", "left")
        else:       # the ranks' counts tell the frequent values
            hot = own_ranks.where(F.col("_times") * HOT_KEYS > known[c]["rows"]).select(F.col("_v").alias(f"_v_{c}"))
            joined = spread_join(own, rc, [f"_v_{c}"], hot_keys=hot)
        out = joined.drop(f"_v_{c}")
    return out


def _weighted_ranks(df: DataFrame, cols: Sequence[str], weights: Sequence[str]) -> tuple[DataFrame, dict, dict]:
    """Tie-averaged ranks of each column under each weight column, every row counting as often as it says.

    Values are counted once for all weights.  Returns the rows, ``{column: (values, ranks)}`` (ranks: values x weights) of the
    columns whose tables fit ``RANK_BYTES`` together, smallest first, and ``{column: [rank columns]}`` of the
    others, whose ranks are joined to the rows; ranks are less the column's mean rank.
    """
    long_vals = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("_col"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(cols)])).alias("s"),
                          *weights).select("s.*", *weights).where("_v is not null")
    counts = durable(long_vals.groupBy("_col", "_v").agg(*[F.sum(w).cast("double").alias(w) for w in weights], F.count(F.lit(1)).alias("_times")))
    sizes = {r["_col"]: r for r in counts.groupBy("_col").agg(          # a row a column
        F.count(F.lit(1)).alias("values"), F.sum("_times").alias("rows"), F.max("_times").alias("most"), *[F.sum(w).alias(w) for w in weights]).collect()}
    held, left = [], RANK_BYTES
    for i in sorted(sizes, key=lambda i: sizes[i]["values"]):
        left -= sizes[i]["values"] * 8 * (1 + len(weights))
        if left >= 0:
            held.append(i)
    looked_up = {c: (np.zeros(0), np.zeros((0, len(weights)))) for i, c in enumerate(cols) if i not in sizes}       # no value at all
    got = counts.where(F.col("_col").isin(held)).select("_col", "_v", *weights).toArrow()
    of = got["_col"].to_numpy()
    for i in held:
        own = np.flatnonzero(of == i)
        values = got["_v"].to_numpy()[own]
        order = np.argsort(values)
        times = np.stack([got[w].to_numpy()[own[order]] for w in weights])
        centre = (times.sum(axis=1, keepdims=True) + 1) / 2
        looked_up[cols[i]] = values[order], np.ascontiguousarray((np.cumsum(times, axis=1) - times + (times + 1) / 2 - centre).T)
    out, joined = df, {}
    for i, c in enumerate(cols):
        if i in held or i not in sizes:
            continue
        own = counts.where(F.col("_col") == i)
        joined[c] = [f"_r{i}_{k}" for k in range(len(weights))]
        ranked = [(F.col(f"_before_{w}") + (F.col(w) + 1) / 2 - (sizes[i][w] + 1) / 2).alias(name) for w, name in zip(weights, joined[c])]
        ranks = prefix_sums(own.select("_v", *weights), "_v", weights).select(F.col("_v").alias(f"_v{i}"), *ranked)
        hot = own.where(F.col("_times") * HOT_KEYS > sizes[i]["rows"]).select(F.col("_v").alias(f"_v{i}"))
        keyed = out.withColumn(f"_v{i}", F.col(c).cast("double"))
        if sizes[i]["most"] * HOT_KEYS <= sizes[i]["rows"]:
            out = keyed.join(shuffled(ranks), f"_v{i}", "left").drop(f"_v{i}")
        else:
            out = spread_join(keyed, ranks, [f"_v{i}"], hot_keys=hot).drop(f"_v{i}")
    return out, looked_up, joined


def weighted_table(df: DataFrame, feature_cols: Sequence[str], target_cols: Sequence[str], weights: Sequence[str],
                   spearman: bool = True) -> DataFrame:
    """``(b, target, feature, n, pearson_r[, spearman_r])`` under each of the weight columns (whole numbers), ``b`` counting them.

    The rows are read once to count their values and once to add up the weighted products of values and ranks;
    a weight column that draws no row has no result.  Pairwise complete rows, as in ``pearson_table``.
    """
    cols = list(dict.fromkeys([*feature_cols, *target_cols]))
    pairs = [(t, f) for t in target_cols for f in feature_cols]
    looked_up: dict = {}
    joined: dict = {}
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    centre = {c: means[f"m{i}"] if means[f"m{i}"] is not None and np.isfinite(means[f"m{i}"]) else 0.0 for i, c in enumerate(cols)}
    rows = df
    if spearman:
        rows, looked_up, joined = _weighted_ranks(df, cols, weights)
    tables = df.sparkSession.sparkContext.broadcast(looked_up)
    ranked = [name for names in joined.values() for name in names]
    slim = rows.select(*[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(cols)], *ranked, *[F.col(w).cast("int").alias(w) for w in weights])
    kinds = ["pearson", "spearman"] if spearman else ["pearson"]
    ts, fs = (np.array([cols.index(p[at]) for p in pairs]) for at in range(2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(kinds), len(weights), len(pairs), 6))
        drawn = np.zeros(len(weights))
        low, high = np.full((len(weights), len(pairs), 2), np.inf), np.full((len(weights), len(pairs), 2), -np.inf)

        def bounds(k, j, X, pair, on):
            for e, c in enumerate(pair):        # a constant column has no r, whatever rounding leaves of its variance
                if on.any() and not low[k, j, e] < high[k, j, e]:
                    own = X[c][on]
                    low[k, j, e], high[k, j, e] = min(low[k, j, e], own.min()), max(high[k, j, e], own.max())

        for batch in batches:
            if not batch.num_rows:
                continue
            W = [batch.column(w).to_numpy().astype(float) for w in weights]
            drawn += [w.sum() for w in W]
            X, known, ranks = {}, {}, {}
            for i, c in enumerate(cols):
                own = batch.column(f"_x{i}")
                known[c] = own.is_valid().to_numpy(zero_copy_only=False) if own.null_count else None
                X[c] = own.to_numpy(zero_copy_only=False)
                if c in joined:
                    ranks[c] = [batch.column(name).to_numpy(zero_copy_only=False) for name in joined[c]]
                elif c in tables.value:
                    values, table = tables.value[c]
                    if len(values):
                        at = np.minimum(np.searchsorted(values, X[c]), len(values) - 1)
                        ranks[c] = np.take(table, at, axis=0).T
                    else:       # nulls only
                        ranks[c] = [np.zeros(batch.num_rows)] * len(weights)
            plain = all(v is None for v in known.values()) and all(np.isfinite(x).all() for x in X.values())
            for k, w in enumerate(W):
                if plain:       # all pairs at once
                    if not (low[k] < high[k]).all():
                        for j, pair in enumerate(pairs):
                            bounds(k, j, X, pair, w > 0)
                    for kind in range(len(kinds)):
                        Z = np.stack([X[c] - centre[c] if kind == 0 else ranks[c][k] for c in cols] + [np.ones(len(w))])
                        P = (Z * w) @ Z.T
                        sums[kind, k] += np.column_stack([P[-1, -1] + 0 * P[fs, -1], P[fs, -1], P[ts, -1], P[fs, fs], P[ts, ts], P[fs, ts]])
                    continue
                for j, (t, f) in enumerate(pairs):
                    on = w > 0
                    for c in (t, f):
                        if known[c] is not None:
                            on = on & known[c]
                    if not on.any():
                        continue
                    bounds(k, j, X, (t, f), on)
                    v = w[on]
                    for kind in range(len(kinds)):
                        x, y = (X[f][on] - centre[f], X[t][on] - centre[t]) if kind == 0 else (ranks[f][k][on], ranks[t][k][on])
                        vx, vy = v * x, v * y
                        sums[kind, k, j] += v.sum(), vx.sum(), vy.sum(), vx @ x, vy @ y, vx @ y
        out = [(b, j, kinds[kind], drawn[b], *sums[kind, b, j], *low[b, j, ::-1], *high[b, j, ::-1])
               for kind in range(len(kinds)) for b in range(len(weights)) for j in range(len(pairs)) if drawn[b]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out)], ["b", "pair", "kind", "drawn", "n", "sx", "sy", "sxx", "syy", "sxy", "lx", "ly", "hx", "hy"])

    numbers = ["drawn", "n", "sx", "sy", "sxx", "syy", "sxy"]
    parts = slim.mapInArrow(run, "b long, pair long, kind string, " + ", ".join(f"{c} double" for c in [*numbers, "lx", "ly", "hx", "hy"]))
    s = parts.groupBy("b", "pair", "kind").agg(*[F.sum(c).alias(c) for c in numbers], *[F.min(c).alias(c) for c in ("lx", "ly")], *[F.max(c).alias(c) for c in ("hx", "hy")])
    moment = lambda a, b, ab: F.try_divide(F.col(ab) - F.try_divide(F.col(a) * F.col(b), F.col("n")), F.col("n"))
    spread = lambda a, aa, lo, hi: F.when(F.col(lo) == F.col(hi), F.lit(0.0)).otherwise(F.greatest(moment(a, a, aa), F.lit(0.0)))
    r = _r(moment("sx", "sy", "sxy"), spread("sx", "sxx", "lx", "hx"), spread("sy", "syy", "ly", "hy"))
    s = s.withColumn("r", r).withColumn("r", F.when(F.col("r").isNotNull() & ~F.isnan("r"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r")))))
    named = lambda at: F.element_at(F.array(*[F.lit(p[at]) for p in pairs]), F.col("pair").cast("int") + 1)
    return s.groupBy("b", "pair").agg(F.first("n").cast("long").alias("n"), *[F.max(F.when(F.col("kind") == k, F.col("r"))).alias(f"{k}_r") for k in kinds]).select(
        F.col("b").cast("int").alias("b"), named(0).alias("target"), named(1).alias("feature"), "n", *[f"{k}_r" for k in kinds])


def anova_table(df: DataFrame, categorical_cols: Sequence[str],
                target_cols: Sequence[str]) -> DataFrame:
    """``(target, feature, n, k, ssb, ssw, f_stat, df_b, df_w, eta_squared)``."""
    long_df = df.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.lit(c).alias("feature"),
                 F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")).alias("category"),
                 F.col(t).cast("double").alias("y"))
        for t in target_cols for c in categorical_cols])).alias("s")).select("s.*")
    groups = (long_df.where(F.col("y").isNotNull())
              .groupBy("target", "feature", "category")
              .agg(F.count("y").alias("ng"), F.avg("y").alias("mg"),
                   (F.var_pop("y") * F.count("y")).alias("m2")))
    w = Window.partitionBy("target", "feature")
    g = (groups.withColumn("N", F.sum("ng").over(w))
         .withColumn("grand", F.sum(F.col("ng") * F.col("mg")).over(w) / F.col("N"))
         .withColumn("k", F.count(F.lit(1)).over(w)))
    t = g.groupBy("target", "feature").agg(
        F.first("N").alias("n"), F.first("k").alias("k"),
        F.sum(F.col("ng") * (F.col("mg") - F.col("grand")) ** 2).alias("ssb"),
        F.sum("m2").alias("ssw"))
    dfb = F.col("k") - 1
    dfw = F.col("n") - F.col("k")
    f_stat = F.when(F.col("ssw") > 0, (F.col("ssb") / dfb) / (F.col("ssw") / dfw)) \
        .when(F.col("ssb") > 0, F.lit(float("inf")))
    sst = F.col("ssb") + F.col("ssw")
    eta = F.when(sst == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("ssb") / sst)))
    return (t.withColumn("df_b", dfb).withColumn("df_w", dfw)
            .withColumn("f_stat", F.when((F.col("k") >= 2) & (dfw > 0), f_stat))
            .withColumn("eta_squared", F.when(F.col("k") >= 2, eta)))


def run_correlations(df: DataFrame, feature_cols: Sequence[str], target_cols: Sequence[str] | str,
                     method: str = "both", significance_threshold: float = 0.05,
                     categorical_cols: Sequence[str] | None = None, weight_cols: Sequence[str] | None = None) -> DataFrame:
    """M1-M6 for every target at once.

    ``weight_cols``: whole numbers that tell how often each row counts; the result then has the rows of every such column
    that draws any, told apart by ``b``, its place (continuous features only).

    Columns: target, feature, n, [pearson_r, pearson_p, pearson_significant],
    [spearman_r, spearman_p, spearman_significant], eta_squared, anova_p,
    anova_significant, rank.
    """
    if method not in METHODS:
        raise ValueError(f"Unknown method '{method}'. Valid options: {sorted(METHODS)}")
    targets = [target_cols] if isinstance(target_cols, str) else list(target_cols)
    if not feature_cols:
        raise ValueError("X must contain at least one column.")
    if df.isEmpty():
        raise ValueError("X must contain at least one row.")
    cats = [c for c in feature_cols if c in set(categorical_cols or [])]
    cont = [c for c in feature_cols if c not in set(cats)]
    thr = F.lit(float(significance_threshold))
    null_d = F.lit(None).cast("double")
    null_b = F.lit(None).cast("boolean")
    parts = []
    by = []
    if weight_cols and cats:
        raise ValueError("weight_cols need continuous features.")
    if cont:
        base = None
        if weight_cols:
            by = ["b"]
            base = weighted_table(df, cont, targets, weight_cols, method != "pearson")
            base = base.select("b", "target", "feature", "n", *[f"{m}_r" for m in ("pearson", "spearman") if m == method or method == "both"])
        elif method in ("pearson", "both"):
            pr = pearson_table(df, cont, targets).select(
                "target", "feature", "n", F.col("r").alias("pearson_r"))
            base = pr
        if method in ("spearman", "both") and not weight_cols:
            ranked = with_ranks(df.select(*cont, *targets), list(cont) + targets)
            sp = pearson_table(ranked, cont, targets, rank_prefix="rk_").select(
                "target", "feature", F.col("n").alias("_n2"), F.col("r").alias("spearman_r"))
            base = sp.withColumnRenamed("_n2", "n") if base is None else \
                base.join(sp, ["target", "feature"]).drop("_n2")
        cont_rows = base
        for m in ("pearson", "spearman"):
            if m == method or method == "both":
                p = corr_p(F.col(f"{m}_r"), F.col("n"))
                cont_rows = cont_rows.withColumn(f"{m}_p", p).withColumn(
                    f"{m}_significant", F.when(F.col(f"{m}_p").isNotNull(), F.col(f"{m}_p") < thr))
        cont_rows = cont_rows.withColumn("eta_squared", null_d).withColumn("anova_p", null_d) \
            .withColumn("anova_significant", null_b)
        parts.append(cont_rows)
    if cats:
        an = anova_table(df, cats, targets)
        an = an.withColumn("anova_p", anova_p(F.col("f_stat"), F.col("df_b"), F.col("df_w")))
        cat_rows = an.select(
            "target", "feature", "n", "eta_squared",
            F.when(F.col("k") >= 2, F.col("anova_p")).alias("anova_p"))
        cat_rows = cat_rows.withColumn(
            "anova_significant", F.when(F.col("anova_p").isNotNull(), F.col("anova_p") < thr))
        for m in ("pearson", "spearman"):
            if m == method or method == "both":
                cat_rows = cat_rows.withColumn(f"{m}_r", null_d).withColumn(f"{m}_p", null_d) \
                    .withColumn(f"{m}_significant", null_b)
        parts.append(cat_rows)
    cols = [*by, "target", "feature", "n"]
    for m in ("pearson", "spearman"):
        if m == method or method == "both":
            cols += [f"{m}_r", f"{m}_p", f"{m}_significant"]
    cols += ["eta_squared", "anova_p", "anova_significant"]
    out = parts[0].select(*cols)
    for p in parts[1:]:
        out = out.unionByName(p.select(*cols))
    return add_correlation_rank(out, method, cats, by)


def correlation_score(method: str, categorical: Sequence[str]) -> F.Column:
    """M6 score: sqrt(eta^2) (0 if missing) for categoricals, max |r|/|rho| otherwise."""
    if method == "both":
        cont = F.greatest(F.abs("pearson_r"), F.abs("spearman_r"))
    else:
        cont = F.abs(f"{method}_r")
    cat = F.coalesce(F.sqrt("eta_squared"), F.lit(0.0))
    return F.when(F.col("feature").isin(list(categorical)), cat).otherwise(cont) \
        if categorical else cont


def add_correlation_rank(table: DataFrame, method: str, categorical: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Min rank by descending score per target (and ``by``), missing scores last."""
    w = Window.partitionBy(*by, "target").orderBy(F.col("_score").desc_nulls_last())
    return (table.withColumn("_score", correlation_score(method, categorical))
            .withColumn("rank", F.rank().over(w).cast("long")).drop("_score"))
