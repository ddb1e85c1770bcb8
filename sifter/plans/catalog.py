"""Registered queries over the driver's tables, each with its SQL oracle.

Every query reads the given parquet tables (``lineitem`` as the experiment
table, ``part``/``orders``/``supplier`` where a second shape is needed) and
runs over whole tables.  ``ORACLE`` holds the DuckDB SQL for the queries
whose result SQL can express; the others are checked by unit tests against
numpy re-derivations.

Doubles are rounded to 6 decimals on both sides (sums are order-dependent).
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sifter.functions.draws import resampling_uniform_sql, uniform_sql
from sifter.operators import replicates as rep
from sifter.plans.linear_sql import (beta_ctes, correlation_narrative_sql, lasso_cv_sql, lasso_sql, loadings, names_sql, pca_ctes,
                                     ranked_narrative_sql, scores, sentences, text)
from sifter.session import durable, scratch_path
from sifter.sources.tables import LINEITEM_KEY, lineitem_experiments, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c: str | F.Column, name: str | None = None) -> F.Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6).alias(name or (c if isinstance(c, str) else None))


# SQL pieces shared by the oracles ------------------------------------------
_KEY = ", ".join(LINEITEM_KEY)
LI_SQL = (f"SELECT *, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS net, "
          f"row_number() OVER (ORDER BY {_KEY}) - 1 AS row_id FROM lineitem")


def _li(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return lineitem_experiments(spark, sf, cols=list(cols) or None)


def _plain(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Experiments without row ids, for results that neither show nor need an order (no sort, no checkpoint)."""
    return lineitem_experiments(spark, sf, with_row_id=False, cols=list(cols)).select(*cols)


# ---------------------------------------------------------------------------
# Replicates
# ---------------------------------------------------------------------------
REP_F = ["l_quantity", "l_discount"]
REP_T = ["l_extendedprice", "net"]
REP_O = ["l_returnflag", "l_linestatus"]


def _rep_input(spark, sf):
    return _li(spark, sf, *REP_F, *REP_T, *REP_O).select("row_id", *REP_F, *REP_T, *REP_O)


@register("replicate_average", f"""
WITH li AS ({LI_SQL})
SELECT l_quantity, l_discount, round(avg(l_extendedprice), 6) AS l_extendedprice,
       round(avg(net), 6) AS net,
       arg_min(l_returnflag, row_id) FILTER (WHERE l_returnflag IS NOT NULL) AS l_returnflag,
       arg_min(l_linestatus, row_id) FILTER (WHERE l_linestatus IS NOT NULL) AS l_linestatus,
       min(row_id) AS row_id
FROM li WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL
GROUP BY l_quantity, l_discount""")
def q_replicate_average(spark, sf):
    out = rep.handle_replicates(_rep_input(spark, sf), REP_F, REP_T, "average")
    return out.select(*REP_F, r6("l_extendedprice"), r6("net"), *REP_O, "row_id")


@register("replicate_std", f"""
WITH li AS ({LI_SQL})
SELECT l_quantity, l_discount, round(avg(l_extendedprice), 6) AS l_extendedprice,
       round(avg(net), 6) AS net, round(stddev_samp(l_extendedprice), 6) AS l_extendedprice_std,
       round(stddev_samp(net), 6) AS net_std
FROM li GROUP BY l_quantity, l_discount""")
def q_replicate_std(spark, sf):
    out = rep.handle_replicates(_rep_input(spark, sf), REP_F, REP_T, "std_uncertainty")
    return out.select(*REP_F, *[r6(c) for c in
                                ["l_extendedprice", "net", "l_extendedprice_std", "net_std"]])


REP5_F = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@register("replicate_summary", f"""
WITH li AS ({LI_SQL}),
g AS (SELECT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, count(*) AS n_replicates,
             min(row_id) AS first_row, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s
      FROM li GROUP BY ALL HAVING count(*) > 1)
SELECT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus,
       row_number() OVER (ORDER BY first_row) - 1 AS replicate_group, n_replicates,
       round(m, 6) AS l_extendedprice_mean, round(s, 6) AS l_extendedprice_std
FROM g""")
def q_replicate_summary(spark, sf):
    li = _li(spark, sf, *REP5_F, "l_extendedprice")
    out = rep.replicate_summary(li, REP5_F, ["l_extendedprice"])
    return out.select(*REP5_F, "replicate_group", "n_replicates",
                      r6("l_extendedprice_mean"), r6("l_extendedprice_std"))


@register("replicate_rows", f"""
WITH li AS ({LI_SQL}),
g AS (SELECT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, min(row_id) AS first_row
      FROM li GROUP BY ALL HAVING count(*) > 1),
gid AS (SELECT *, row_number() OVER (ORDER BY first_row) - 1 AS replicate_group FROM g)
SELECT li.row_id, li.l_quantity, li.l_discount, li.l_tax, li.l_returnflag, li.l_linestatus,
       gid.replicate_group
FROM li JOIN gid USING (l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)""")
def q_replicate_rows(spark, sf):
    li = _li(spark, sf, *REP5_F).select("row_id", *REP5_F)
    return rep.detect_replicates(li, REP5_F).select("row_id", *REP5_F, "replicate_group")


IQR_F = ["l_returnflag", "l_linestatus", "l_tax"]
IQR_T = ["qty4", "l_extendedprice"]
_IQR_SQL = f"""
WITH li AS (SELECT *, power(l_quantity, 4) AS qty4 FROM ({LI_SQL})),
g AS (SELECT l_returnflag, l_linestatus, l_tax, min(row_id) AS first_row FROM li
      GROUP BY ALL HAVING count(*) > 1),
reps AS (SELECT li.* FROM li JOIN g USING (l_returnflag, l_linestatus, l_tax)),
q AS (SELECT l_returnflag, l_linestatus, l_tax,
             count(qty4) AS n1, quantile_cont(qty4, 0.25) AS a1, quantile_cont(qty4, 0.75) AS b1,
             count(l_extendedprice) AS n2, quantile_cont(l_extendedprice, 0.25) AS a2,
             quantile_cont(l_extendedprice, 0.75) AS b2
      FROM reps GROUP BY ALL),
flag AS (SELECT DISTINCT reps.row_id FROM reps JOIN q USING (l_returnflag, l_linestatus, l_tax)
         WHERE (n1 >= 3 AND b1 - a1 <> 0 AND (qty4 < a1 - 1.5 * (b1 - a1) OR qty4 > b1 + 1.5 * (b1 - a1)))
            OR (n2 >= 3 AND b2 - a2 <> 0 AND (l_extendedprice < a2 - 1.5 * (b2 - a2)
                                              OR l_extendedprice > b2 + 1.5 * (b2 - a2))))
"""


def _iqr_input(spark, sf):
    return _li(spark, sf, *IQR_F, "l_quantity", "l_extendedprice").withColumn("qty4", F.pow("l_quantity", 4)).select(
        "row_id", *IQR_F, *IQR_T)


@register("iqr_outliers", _IQR_SQL + """
SELECT li.row_id, li.l_returnflag, li.l_linestatus, li.l_tax, round(li.qty4, 6) AS qty4,
       li.l_extendedprice FROM li WHERE row_id IN (SELECT row_id FROM flag)""")
def q_iqr_outliers(spark, sf):
    df = _iqr_input(spark, sf)
    out = rep.iqr_outliers(df, IQR_F, IQR_T)
    return out.select("row_id", *IQR_F, r6("qty4"), "l_extendedprice")


@register("outliers_removed", _IQR_SQL + """
SELECT count(*) AS n_rows, round(avg(l_extendedprice), 6) AS mean_price
FROM li WHERE row_id NOT IN (SELECT row_id FROM flag)""")
def q_outliers_removed(spark, sf):
    df = _iqr_input(spark, sf)
    kept = rep.remove_rows(df, rep.iqr_outliers(df, IQR_F, IQR_T))
    return kept.agg(F.count(F.lit(1)).alias("n_rows"), r6(F.avg("l_extendedprice"), "mean_price"))


@register("replicate_group_count", f"""
WITH li AS ({LI_SQL})
SELECT count(*) AS n_groups FROM (SELECT 1 FROM li GROUP BY l_quantity, l_discount, l_tax,
  l_returnflag, l_linestatus HAVING count(*) > 1)""")
def q_replicate_group_count(spark, sf):
    li = _li(spark, sf, *REP5_F).select("row_id", *REP5_F)
    return rep.count_groups(rep.detect_replicates(li, REP5_F))


# ---------------------------------------------------------------------------
# Correlations, ANOVA, correlation rank (M1-M6)
# ---------------------------------------------------------------------------
from sifter.operators import correlate as cor  # noqa: E402

COR_F = ["l_extendedprice", "l_discount", "l_tax"]
COR_C = ["l_returnflag", "l_linestatus"]
COR_T = ["net", "l_quantity"]
NET_SQL = "SELECT *, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS net FROM lineitem"


def _cor_input(spark, sf):
    return table(spark, sf, "lineitem").withColumn(
        "net", F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    ).select(*COR_F, *COR_C, *COR_T)


def _rank_sql(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


_PEARSON_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS target, '{f}' AS feature, count(*) AS n, round(corr({f}, {t}), 6) AS pearson_r FROM li"
    for t in COR_T for f in COR_F)
_SPEARMAN_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS target, '{f}' AS feature, count(*) AS n, round(corr(rk_{f}, rk_{t}), 6) AS spearman_r FROM rk"
    for t in COR_T for f in COR_F)
_RK_CTE = "rk AS (SELECT " + ", ".join(f"{_rank_sql(c)} AS rk_{c}" for c in COR_F + COR_T) + " FROM li)"
_ANOVA_SQL = " UNION ALL ".join(f"""
SELECT '{t}' AS target, '{c}' AS feature, n, k, ssb, ssw FROM (
  SELECT sum(ng) AS n, count(*) AS k, sum(ng * (mg - grand) * (mg - grand)) AS ssb, sum(m2) AS ssw
  FROM (SELECT *, sum(ng * mg) OVER () / sum(ng) OVER () AS grand FROM (
        SELECT {c} AS category, count({t}) AS ng, avg({t}) AS mg, var_pop({t}) * count({t}) AS m2
        FROM li GROUP BY {c})))""" for t in COR_T for c in COR_C)


@register("pearson", f"WITH li AS ({NET_SQL}) {_PEARSON_SQL}")
def q_pearson(spark, sf):
    out = cor.pearson_table(_cor_input(spark, sf), COR_F, COR_T)
    return out.select("target", "feature", "n", r6("r", "pearson_r"))


@register("spearman", f"WITH li AS ({NET_SQL}), {_RK_CTE} {_SPEARMAN_SQL}")
def q_spearman(spark, sf):
    df = _cor_input(spark, sf)
    res = cor.run_correlations(df, COR_F, COR_T, method="spearman")
    return res.select("target", "feature", "n", r6("spearman_r"))


@register("anova_eta2", f"""WITH li AS ({NET_SQL}), a AS ({_ANOVA_SQL})
SELECT target, feature, n, round(CASE WHEN ssb + ssw = 0 THEN 0 ELSE ssb / (ssb + ssw) END, 6) AS eta_squared,
       round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS f_stat FROM a""")
def q_anova(spark, sf):
    out = cor.anova_table(_cor_input(spark, sf), COR_C, COR_T)
    return out.select("target", "feature", "n", r6("eta_squared"), r6("f_stat"))


@register("corr_rank", f"""WITH li AS ({NET_SQL}), {_RK_CTE},
p AS ({_PEARSON_SQL}), s AS ({_SPEARMAN_SQL}), a AS ({_ANOVA_SQL}),
sc AS (SELECT target, feature, greatest(abs(p.pearson_r), abs(s.spearman_r)) AS score
       FROM p JOIN s USING (target, feature)
       UNION ALL SELECT target, feature, sqrt(ssb / (ssb + ssw)) FROM a)
SELECT target, feature, rank() OVER (PARTITION BY target ORDER BY score DESC NULLS LAST) AS rank FROM sc""")
def q_corr_rank(spark, sf):
    res = cor.run_correlations(_cor_input(spark, sf), COR_F + COR_C, COR_T, categorical_cols=COR_C)
    return res.select("target", "feature", "rank")


_P_CTES = f"""WITH RECURSIVE li AS ({NET_SQL}), {_RK_CTE},
p AS (SELECT * FROM ({_PEARSON_SQL.replace('round(', '(').replace(', 6) AS', ') AS')})), s AS (SELECT * FROM ({_SPEARMAN_SQL.replace('round(', '(').replace(', 6) AS', ') AS')})),
a AS (SELECT *, ssb / (ssb + ssw) AS eta2 FROM ({_ANOVA_SQL})),
asked AS (
  SELECT target, feature, 'p' AS what, (n - 2) / 2.0 AS a, 0.5::DOUBLE AS b, 1 - pearson_r ** 2 AS x FROM p
  UNION ALL SELECT target, feature, 's', (n - 2) / 2.0, 0.5, 1 - spearman_r ** 2 FROM s
  UNION ALL SELECT target, feature, 'a', (n - k) / 2.0, (k - 1) / 2.0, (n - k) / ((n - k) + (k - 1) * (ssb / (k - 1)) / (ssw / (n - k))) FROM a),
{beta_ctes('asked', ['target', 'feature', 'what'])},
t AS (
  SELECT p.target, p.feature, p.n, pearson_r, pp.p AS pearson_p, spearman_r, sp.p AS spearman_p, NULL::DOUBLE AS eta2, NULL::DOUBLE AS anova_p,
    greatest(abs(pearson_r), abs(spearman_r)) AS score
  FROM p JOIN s USING (target, feature) JOIN pv pp ON pp.target = p.target AND pp.feature = p.feature AND pp.what = 'p'
    JOIN pv sp ON sp.target = p.target AND sp.feature = p.feature AND sp.what = 's'
  UNION ALL SELECT a.target, a.feature, n, NULL, NULL, NULL, NULL, eta2, v.p, sqrt(eta2)
  FROM a JOIN pv v ON v.target = a.target AND v.feature = a.feature AND v.what = 'a')"""
_P_SQL = f"""{_P_CTES}
SELECT target, feature, n::BIGINT AS n, round(pearson_r, 6) AS pearson_r, round(pearson_p, 6) AS pearson_p, pearson_p < 0.05 AS pearson_significant,
  round(spearman_r, 6) AS spearman_r, round(spearman_p, 6) AS spearman_p, spearman_p < 0.05 AS spearman_significant, round(eta2, 6) AS eta_squared,
  round(anova_p, 6) AS anova_p, anova_p < 0.05 AS anova_significant, rank() OVER (PARTITION BY target ORDER BY score DESC NULLS LAST) AS rank FROM t"""


def _correlations(spark, sf):
    return cor.run_correlations(_cor_input(spark, sf), COR_F + COR_C, COR_T, categorical_cols=COR_C)


@register("correlations", _P_SQL)
def q_correlations(spark, sf):
    """Full M1-M6 table with p-values and significance flags."""
    out = _correlations(spark, sf)
    return out.select(*[r6(c) if t == "double" else c for c, t in out.dtypes])


# ---------------------------------------------------------------------------
# Consensus, labels, cross-target table, default selection
# ---------------------------------------------------------------------------
from sifter.operators import consensus as cons  # noqa: E402

CONS_METHODS = ["pearson", "spearman", "correlations"]
CONS_FEATS = COR_F + COR_C


def _cons_rankings(spark, sf):
    # tiny (targets x features) result reused by three rankings: materialise once
    res = durable(cor.run_correlations(_cor_input(spark, sf), CONS_FEATS, COR_T,
                                       categorical_cols=COR_C))
    parts = []
    for m in ("pearson", "spearman"):
        w = F.rank().over(Window.partitionBy("target")
                          .orderBy(F.abs(F.col(f"{m}_r")).desc_nulls_last()))
        parts.append(res.where(F.col(f"{m}_r").isNotNull())
                     .select("target", F.lit(m).alias("method"), "feature",
                             w.cast("long").alias("rank")))
    parts.append(cons.ranking_from(res, "correlations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_FPOS_SQL = "CASE feature " + " ".join(f"WHEN '{f}' THEN {i + 1}" for i, f in enumerate(CONS_FEATS)) + " END"
_CONS_SQL = f"""WITH li AS ({NET_SQL}), {_RK_CTE},
p AS ({_PEARSON_SQL}), s AS ({_SPEARMAN_SQL}), a AS ({_ANOVA_SQL}),
sc AS (SELECT target, feature, greatest(abs(p.pearson_r), abs(s.spearman_r)) AS score
       FROM p JOIN s USING (target, feature)
       UNION ALL SELECT target, feature, sqrt(ssb / (ssb + ssw)) FROM a),
r AS (SELECT target, 'pearson' AS method, 1 AS mpos, feature,
             rank() OVER (PARTITION BY target ORDER BY abs(pearson_r) DESC) AS rank FROM p
      UNION ALL SELECT target, 'spearman', 2, feature,
             rank() OVER (PARTITION BY target ORDER BY abs(spearman_r) DESC) FROM s
      UNION ALL SELECT target, 'correlations', 3, feature,
             rank() OVER (PARTITION BY target ORDER BY score DESC NULLS LAST) FROM sc),
f AS (SELECT target, feature, min(mpos * 1000000 + rank * 1000 + {_FPOS_SQL}) AS first_seen,
             count(*) OVER (PARTITION BY target) AS n FROM r GROUP BY target, feature),
g AS (SELECT f.target, f.feature, f.first_seen, f.n, m.method,
             coalesce(r.rank, f.n) AS rk
      FROM f JOIN (VALUES ('pearson'), ('spearman'), ('correlations')) m(method) ON TRUE
      LEFT JOIN r ON r.target = f.target AND r.feature = f.feature AND r.method = m.method),
c AS (SELECT target, feature, first_seen,
             max(CASE WHEN method = 'pearson' THEN rk END) AS pearson_rank,
             max(CASE WHEN method = 'spearman' THEN rk END) AS spearman_rank,
             max(CASE WHEN method = 'correlations' THEN rk END) AS correlations_rank,
             avg(rk / n) AS anr,
             count(*) FILTER (WHERE rk <= greatest(3, n // 3)) AS n_methods_top_k
      FROM g GROUP BY target, feature, first_seen),
cr AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY anr, first_seen) AS consensus_rank FROM c),
lab AS (SELECT *, CASE WHEN n_methods_top_k / 3.0 >= 0.75 THEN 'strongly important'
                       WHEN n_methods_top_k / 3.0 >= 0.5 THEN 'moderately important'
                       ELSE 'weakly important or inconsistent' END AS importance_label FROM cr)
"""


@register("consensus", _CONS_SQL + """
SELECT target, feature, pearson_rank, spearman_rank, correlations_rank,
       round(anr, 6) AS avg_normalized_rank, consensus_rank, n_methods_top_k FROM lab""")
def q_consensus(spark, sf):
    c = cons.compute_consensus(_cons_rankings(spark, sf), CONS_METHODS, feature_order=CONS_FEATS)
    return c.withColumn("avg_normalized_rank", r6("avg_normalized_rank"))


@register("consensus_labels", _CONS_SQL + """
SELECT target, feature, consensus_rank, n_methods_top_k, importance_label FROM lab""")
def q_consensus_labels(spark, sf):
    c = cons.compute_consensus(_cons_rankings(spark, sf), CONS_METHODS, feature_order=CONS_FEATS)
    return cons.label_importance(c, len(CONS_METHODS)).select(
        "target", "feature", "consensus_rank", "n_methods_top_k", "importance_label")


@register("cross_target", _CONS_SQL + """
SELECT feature, coalesce(max(CASE WHEN target = 'net' THEN importance_label END), '—') AS net,
       coalesce(max(CASE WHEN target = 'l_quantity' THEN importance_label END), '—') AS l_quantity
FROM lab GROUP BY feature""")
def q_cross_target(spark, sf):
    c = cons.compute_consensus(_cons_rankings(spark, sf), CONS_METHODS, feature_order=CONS_FEATS)
    return cons.cross_target_labels(cons.label_importance(c, len(CONS_METHODS)), COR_T)


@register("selected_features", _CONS_SQL + """,
sel AS (SELECT *, max(CASE WHEN importance_label IN ('strongly important', 'moderately important')
                           THEN 1 ELSE 0 END) OVER (PARTITION BY target) AS any_good FROM lab)
SELECT target, feature, consensus_rank, importance_label FROM sel
WHERE importance_label IN ('strongly important', 'moderately important')
   OR (any_good = 0 AND consensus_rank <= 3)""")
def q_selected_features(spark, sf):
    c = cons.compute_consensus(_cons_rankings(spark, sf), CONS_METHODS, feature_order=CONS_FEATS)
    lab = cons.label_importance(c, len(CONS_METHODS))
    return cons.default_selection(lab).select("target", "feature", "consensus_rank", "importance_label")


# ---------------------------------------------------------------------------
# Narration
# ---------------------------------------------------------------------------
from sifter.operators import narrate as nar  # noqa: E402


def _join_names_sql(lst: str) -> str:
    return (f"CASE WHEN {lst} IS NULL OR len({lst}) = 0 THEN NULL WHEN len({lst}) = 1 THEN '''' || {lst}[1] || '''' "
            f"ELSE array_to_string(list_transform({lst}[1:len({lst}) - 1], lambda x: '''' || x || ''''), ', ') "
            f"|| ' and ''' || {lst}[len({lst})] || '''' END")


def _group_sentence_sql(lst: str, text: str) -> str:
    return (f"CASE WHEN {lst} IS NOT NULL AND len({lst}) > 0 THEN {_join_names_sql(lst)} || "
            f"CASE WHEN len({lst}) = 1 THEN ' is ' ELSE ' are ' END || '{text}' END")


@register("narrative_consensus", _CONS_SQL + f""",
agg AS (SELECT target,
          arg_min(feature, consensus_rank) AS top, arg_min(n_methods_top_k, consensus_rank) AS topk,
          list(feature ORDER BY consensus_rank) FILTER (WHERE importance_label = 'strongly important') AS st,
          list(feature ORDER BY consensus_rank) FILTER (WHERE importance_label = 'moderately important') AS mo,
          list(feature ORDER BY consensus_rank) FILTER (WHERE importance_label = 'weakly important or inconsistent') AS we
        FROM lab GROUP BY target)
SELECT target, 'consensus' AS method, concat_ws(' ',
  'Across 3 method(s), ''' || top || ''' is the highest-ranked feature for ''' || target ||
  ''', appearing in the top tier for ' || topk || ' of 3 method(s).',
  {_group_sentence_sql('st', "''strongly important'' (ranked in top-K by >= 75% of methods).")},
  {_group_sentence_sql('mo', "''moderately important'' (ranked in top-K by 50-74% of methods).")},
  {_group_sentence_sql('we', "''weakly important or inconsistent across methods''.")},
  '{nar.CAVEAT}') AS narrative FROM agg""")
def q_narrative_consensus(spark, sf):
    c = cons.compute_consensus(_cons_rankings(spark, sf), CONS_METHODS, feature_order=CONS_FEATS)
    return nar.interpret_consensus(cons.label_importance(c, len(CONS_METHODS)), len(CONS_METHODS))


@register("narrative_correlations", _P_CTES + ", n AS (SELECT *, CASE feature " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(CONS_FEATS, 1))
          + " END AS pos FROM t) " + correlation_narrative_sql("n", nar.TEMPLATES, nar.CAVEAT))
def q_narrative_correlations(spark, sf):
    res = cor.run_correlations(_cor_input(spark, sf), CONS_FEATS, COR_T, categorical_cols=COR_C)
    return nar.interpret_correlations(res, CONS_FEATS)


# ---------------------------------------------------------------------------
# LASSO and PCA (M7, M8, M12-M15): numpy-checked in tests, rows-only here
# ---------------------------------------------------------------------------
from sifter.operators.linear import run_lasso  # noqa: E402
from sifter.operators.pca import run_pca  # noqa: E402

LIN_F = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def _rounded_lasso(out):
    return out.select("target", "feature", F.round("coefficient", 4).alias("coefficient"), F.round("abs_coefficient", 4).alias("abs_coefficient"), "rank", r6("alpha"))


@register("lasso_fixed", lasso_sql(LI_SQL, LIN_F, "net", 0.01))
def q_lasso_fixed(spark, sf):
    return _rounded_lasso(run_lasso(_plain(spark, sf, *LIN_F, "net"), LIN_F, "net", alpha=0.01))


def _lasso_cv(spark, sf):
    return run_lasso(_li(spark, sf, *LIN_F, "net"), LIN_F, "net", cv=5, row_order=["row_id"])


@register("lasso_cv", lasso_cv_sql(LI_SQL, LIN_F, "net"))
def q_lasso_cv(spark, sf):
    return _rounded_lasso(_lasso_cv(spark, sf))


def _pca(spark, sf, source=_plain):
    return run_pca(source(spark, sf, *LIN_F), LIN_F, keep_cols=["row_id"] if source is _li else [])


_PCA_SQL = f"WITH RECURSIVE li AS ({LI_SQL}), {pca_ctes('li', LIN_F)}"
_LOADINGS_SQL = f"{_PCA_SQL}, ld AS ({loadings(LIN_F)})"
_SCORES_SQL = f"{_LOADINGS_SQL}, sc AS ({scores('li', LIN_F, 4)})"


@register("pca_variance", f"{_PCA_SQL} SELECT pc, round(evr, 6) AS explained_variance_ratio, round(cum, 6) AS cumulative_variance FROM eig")
def q_pca_variance(spark, sf):
    return _pca(spark, sf).variance.select("pc", r6("explained_variance_ratio"), r6("cumulative_variance"))


@register("pca_loadings", f"{_LOADINGS_SQL} SELECT feature, pc, round(loading, 6) AS loading FROM ld")
def q_pca_loadings(spark, sf):
    return _pca(spark, sf).loadings.select("feature", "pc", r6("loading"))


@register("pca_scores", f"{_SCORES_SQL} SELECT row_id, round(PC1, 5) AS PC1, round(PC2, 5) AS PC2, round(PC3, 5) AS PC3, round(PC4, 5) AS PC4 FROM sc")
def q_pca_scores(spark, sf):
    out = _pca(spark, sf, _li).scores
    return out.select("row_id", *[F.round(c, 5).alias(c) for c in out.columns if c != "row_id"])


@register("pca_feature_rank", f"{_LOADINGS_SQL} SELECT feature, round(m, 6) AS max_loading, rank() OVER (ORDER BY m DESC) AS rank FROM (SELECT feature, max(abs(loading)) AS m FROM ld GROUP BY feature)")
def q_pca_feature_rank(spark, sf):
    return _pca(spark, sf).feature_rank.select("feature", r6("max_loading"), "rank")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_FPOS_LIN = "CASE feature " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(LIN_F)) + " END"
_PCA_TEXT_SQL = f"""{_LOADINGS_SQL},
pcs AS (SELECT pc, printf({_sql_text(nar.TEMPLATES['pca_pc'])}, pc::INT, arg_min(feature, k), arg_min(loading, k)) AS t
        FROM (SELECT *, struct_pack(a := -abs(loading), b := {_FPOS_LIN}) AS k FROM ld) GROUP BY pc),
mx AS (SELECT feature, max(abs(loading)) AS m FROM ld GROUP BY feature)
SELECT 'pca' AS method, printf({_sql_text(nar.TEMPLATES['pca_head'])}, (SELECT count(*) FROM eig)::INT, (SELECT max(cum) FROM eig) * 100) || ' '
  || (SELECT string_agg(t, ' ' ORDER BY pc) FROM pcs) || ' '
  || (SELECT printf({_sql_text(nar.TEMPLATES['pca_overall'])}, feature, m) FROM mx ORDER BY m DESC, {_FPOS_LIN} LIMIT 1) || ' ' || {_sql_text(nar.CAVEAT)} AS narrative"""


@register("narrative_pca", _PCA_TEXT_SQL)
def q_narrative_pca(spark, sf):
    r = _pca(spark, sf)
    return nar.interpret_pca(r.variance, r.loadings, r.feature_rank, LIN_F)


_LASSO_TEXT_SQL = lasso_cv_sql(LI_SQL, LIN_F, "net").rsplit("\nSELECT", 1)[0] + f""",
w AS (SELECT 'net' AS target, * FROM ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {i} AS pos, w{i} AS w FROM fit" for i, f in enumerate(LIN_F, 1))}))
SELECT target, 'lasso' AS method, {sentences(
    f"CASE WHEN count(*) FILTER (w <> 0) = 0 THEN printf({text(nar.TEMPLATES['lasso_all_zero'])}, chr(39) || target || chr(39)) ELSE printf({text(nar.TEMPLATES['lasso_top'])}, "
    "list(feature ORDER BY abs(w) DESC, pos)[1], chr(39) || target || chr(39), list(w ORDER BY abs(w) DESC, pos)[1]) END",
    f"CASE WHEN count(*) FILTER (w <> 0) > 1 THEN printf({text(nar.TEMPLATES['lasso_others'])}, {names_sql('list_filter(list(CASE WHEN w <> 0 THEN feature END ORDER BY abs(w) DESC, pos)[2:], lambda f: f IS NOT NULL)')}) END",
    f"CASE WHEN count(*) FILTER (w = 0) > 0 THEN printf({text(nar.TEMPLATES['lasso_zero'])}, {names_sql('list_filter(list(CASE WHEN w = 0 THEN feature END ORDER BY pos), lambda f: f IS NOT NULL)')}, CASE WHEN count(*) FILTER (w = 0) = 1 THEN 'it' ELSE 'they' END) END",
    text(nar.CAVEAT))} AS narrative FROM w GROUP BY target"""


@register("narrative_lasso", _LASSO_TEXT_SQL)
def q_narrative_lasso(spark, sf):
    return nar.interpret_lasso(_lasso_cv(spark, sf), LIN_F)


_SHARE_SQL = f"""WITH li AS ({NET_SQL}), p AS (SELECT 'net' AS target, feature, pos, abs(r) AS r FROM (
  {' UNION ALL '.join(f"SELECT '{f}' AS feature, {i} AS pos, corr({f}, net) AS r FROM li" for i, f in enumerate(COR_F, 1))})),
i AS (SELECT *, r / sum(r) OVER () AS share FROM p)
{ranked_narrative_sql('i', 'share', 'random_forest', nar.TEMPLATES['rf_top'], nar.TEMPLATES['rf_others'], nar.CAVEAT)}
UNION ALL {ranked_narrative_sql('i', 'share', 'shap', nar.TEMPLATES['shap_top'], nar.TEMPLATES['shap_others'], nar.CAVEAT)}"""


@register("narrative_ranked", _SHARE_SQL)
def q_narrative_ranked(spark, sf):
    """The forest's and the SHAP narrative of importances that SQL can work out (shares of |r|)."""
    r = cor.pearson_table(_cor_input(spark, sf), COR_F, ["net"]).select("target", "feature", F.abs("r").alias("r"))
    share = r.withColumn("importance", F.col("r") / F.sum("r").over(Window.partitionBy("target")))
    share = share.withColumn("mean_abs_shap", F.col("importance")).withColumn("rank", F.rank().over(Window.partitionBy("target").orderBy(F.col("importance").desc())))
    return nar.interpret_random_forest(share, COR_F).unionByName(nar.interpret_shap(share, COR_F))


# ---------------------------------------------------------------------------
# Pareto front, reference point, hypervolume
# ---------------------------------------------------------------------------
from sifter.operators import pareto as par  # noqa: E402

PART_OBJ = ["p_retailprice", "p_size"]


@register("pareto_front", """
SELECT p.p_partkey, p.p_retailprice, p.p_size FROM part p
WHERE NOT EXISTS (SELECT 1 FROM part u WHERE u.p_retailprice >= p.p_retailprice AND u.p_size >= p.p_size
                  AND (u.p_retailprice > p.p_retailprice OR u.p_size > p.p_size))""")
def q_pareto_front(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", *PART_OBJ)
    return par.pareto_front(part, PART_OBJ)


@register("pareto_front_min", """
SELECT o.o_orderkey, o.o_totalprice, o.o_orderdate FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM orders u WHERE u.o_totalprice >= o.o_totalprice
                  AND u.o_orderdate <= o.o_orderdate
                  AND (u.o_totalprice > o.o_totalprice OR u.o_orderdate < o.o_orderdate))""")
def q_pareto_front_min(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    o = o.withColumn("_days", F.unix_micros(F.col("o_orderdate").cast("timestamp")).cast("double"))
    return par.pareto_front(o, ["o_totalprice", "_days"], [True, False]).drop("_days")


_PARTSTATS_SQL = """SELECT l_partkey, sum(l_quantity) AS qty, round(avg(l_discount), 9) AS disc,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 4) AS revenue FROM lineitem GROUP BY l_partkey"""


@register("pareto_front_3d", f"""WITH s AS ({_PARTSTATS_SQL})
SELECT s.l_partkey, s.qty, s.disc, s.revenue FROM s WHERE NOT EXISTS (
  SELECT 1 FROM s u WHERE u.qty >= s.qty AND u.disc >= s.disc AND u.revenue >= s.revenue
  AND (u.qty > s.qty OR u.disc > s.disc OR u.revenue > s.revenue))""")
def q_pareto_front_3d(spark, sf):
    li = table(spark, sf, "lineitem")
    stats = li.groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("qty"), F.round(F.avg("l_discount"), 9).alias("disc"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))), 4)
        .alias("revenue"))
    return par.pareto_front(stats, ["qty", "disc", "revenue"])


@register("ref_point", """
SELECT 'p_retailprice' AS objective, 0 AS pos,
       round(min(p_retailprice) - 0.1 * CASE WHEN max(p_retailprice) > min(p_retailprice)
             THEN max(p_retailprice) - min(p_retailprice) ELSE 1 END, 6) AS ref FROM part
UNION ALL
SELECT 'p_size', 1, round(min(p_size) - 0.1 * CASE WHEN max(p_size) > min(p_size)
             THEN max(p_size) - min(p_size) ELSE 1 END, 6) FROM part""")
def q_ref_point(spark, sf):
    ref = par.reference_point(table(spark, sf, "part"), PART_OBJ)
    return ref.select("objective", "pos", r6("ref"))


@register("hypervolume2d", """
WITH f AS (SELECT DISTINCT p.p_retailprice AS a, p.p_size AS b FROM part p
  WHERE NOT EXISTS (SELECT 1 FROM part u WHERE u.p_retailprice >= p.p_retailprice AND u.p_size >= p.p_size
                    AND (u.p_retailprice > p.p_retailprice OR u.p_size > p.p_size))),
r AS (SELECT min(p_retailprice) - 0.1 * (max(p_retailprice) - min(p_retailprice)) AS ra,
             min(p_size) - 0.1 * (max(p_size) - min(p_size)) AS rb FROM part),
s AS (SELECT a, b, max(b) OVER (ORDER BY a DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM f)
SELECT round(sum(greatest(0, a - ra) * greatest(0, b - greatest(coalesce(prev, rb), rb))), 4) AS hypervolume
FROM s, r""")
def q_hypervolume2d(spark, sf):
    part = table(spark, sf, "part")
    ref = [r["ref"] for r in par.reference_point(part, PART_OBJ).orderBy("pos").collect()]
    front = par.pareto_front(part, PART_OBJ)
    return par.hypervolume_2d(front, PART_OBJ, ref).select(F.round("hypervolume", 4).alias("hypervolume"))


_HV3_SQL = """
WITH p AS (SELECT l_linenumber::DOUBLE AS a, l_quantity::DOUBLE AS b, (l_discount * 100)::INT::DOUBLE AS c FROM lineitem),
e AS (SELECT DISTINCT least(10, floor(avg(a) * 3))::DOUBLE AS a, floor(avg(b))::DOUBLE AS b, round(avg(c))::DOUBLE AS c
      FROM (SELECT l_suppkey AS k, l_linenumber AS a, l_quantity AS b, (l_discount * 100)::INT AS c FROM lineitem) GROUP BY k),
g AS (SELECT x, y, max(c) AS h FROM e, (SELECT unnest(range(0, 12)) AS x), (SELECT unnest(range(0, 60)) AS y) WHERE a > x AND b > y GROUP BY x, y)
SELECT coalesce(sum(h), 0)::DOUBLE AS hypervolume FROM g"""


@register("hypervolume3d", _HV3_SQL)
def q_hypervolume3d(spark, sf):
    """G12 in three whole-numbered objectives per supplier; the SQL adds up unit columns."""
    li = table(spark, sf, "lineitem")
    per = li.groupBy("l_suppkey").agg(F.least(F.lit(10), F.floor(F.avg("l_linenumber") * 3)).cast("double").alias("a"), F.floor(F.avg("l_quantity")).cast("double").alias("b"),
                                      F.round(F.avg(F.round(F.col("l_discount") * 100))).cast("double").alias("c"))
    names = ["a", "b", "c"]
    return box.hypervolume(par.pareto_front(per, names), names, [0.0, 0.0, 0.0])


# ---------------------------------------------------------------------------
# Cleaning and scaling (P3-P5, P11-P13, G7), encoding
# ---------------------------------------------------------------------------
from sifter.operators import boxes as box  # noqa: E402
from sifter.operators import cleaning as cln  # noqa: E402
from sifter.operators import encode as enc  # noqa: E402

MISS_COLS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def _with_missing(spark, sf, source=_plain):
    rows = source(spark, sf, "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return rows.select(*[c for c in ("row_id",) if c in rows.columns], "l_quantity", "l_extendedprice",
                                 F.expr("nullif(l_discount, 0)").alias("l_discount"),
                                 F.expr("nullif(l_tax, 0)").alias("l_tax"))


_MISS_SQL = f"WITH li AS ({LI_SQL}), m AS (SELECT row_id, l_quantity, l_extendedprice, " \
            "nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax FROM li)"


@register("missing_counts", _MISS_SQL + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM m" for c in MISS_COLS))
def q_missing_counts(spark, sf):
    return cln.missing_counts(_with_missing(spark, sf), MISS_COLS)


@register("drop_missing", _MISS_SQL + """
SELECT count(*) AS n_rows, round(avg(l_discount), 6) AS mean_discount, round(avg(l_tax), 6) AS mean_tax
FROM m WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL""")
def q_drop_missing(spark, sf):
    kept, _ = cln.drop_missing(_with_missing(spark, sf), ["l_discount", "l_tax"])
    return kept.agg(F.count(F.lit(1)).alias("n_rows"), r6(F.avg("l_discount"), "mean_discount"),
                    r6(F.avg("l_tax"), "mean_tax"))


@register("dropped_rows", _MISS_SQL + " SELECT row_id FROM m WHERE l_discount IS NULL OR l_tax IS NULL")
def q_dropped_rows(spark, sf):
    _, dropped = cln.drop_missing(_with_missing(spark, sf, _li), ["l_discount", "l_tax"])
    return dropped


SCALE_COLS = ["l_extendedprice", "l_quantity", "net"]


def _r4(c):
    return F.round(F.col(c), 4).alias(c)


@register("standardize", f"WITH li AS ({LI_SQL}) SELECT row_id, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 4) AS {c}" for c in SCALE_COLS) + " FROM li")
def q_standardize(spark, sf):
    out = cln.standardize(_li(spark, sf, *SCALE_COLS).select("row_id", *SCALE_COLS), SCALE_COLS)
    return out.select("row_id", *[_r4(c) for c in SCALE_COLS])


@register("minmax", f"WITH li AS ({LI_SQL}) SELECT row_id, " + ", ".join(
    f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 4) AS {c}" for c in SCALE_COLS)
    + " FROM li")
def q_minmax(spark, sf):
    out = cln.minmax(_li(spark, sf, *SCALE_COLS).select("row_id", *SCALE_COLS), SCALE_COLS)
    return out.select("row_id", *[_r4(c) for c in SCALE_COLS])


_MM = {c: f"(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()))" for c in ["net", "l_quantity"]}


@register("scalarize", f"WITH li AS ({LI_SQL}) SELECT row_id, "
          f"round(0.75 * {_MM['net']} + 0.25 * (1 - {_MM['l_quantity']}), 4) AS score FROM li")
def q_scalarize(spark, sf):
    out = cln.scalarize(_li(spark, sf, "net", "l_quantity").select("row_id", "net", "l_quantity"), ["net", "l_quantity"],
                        [3.0, 1.0], col_name="score", maximize_targets=[True, False])
    return out.select("row_id", _r4("score"))


@register("scenarios", f"WITH li AS ({LI_SQL}), s AS (SELECT row_id, {_MM['net']} AS a, "
          f"1 - {_MM['l_quantity']} AS b FROM li) "
          "SELECT row_id, 'Max net' AS Scenario, round(a, 4) AS score FROM s UNION ALL "
          "SELECT row_id, 'Min l_quantity', round(b, 4) FROM s UNION ALL "
          "SELECT row_id, 'Balanced', round(0.5 * a + 0.5 * b, 4) FROM s")
def q_scenarios(spark, sf):
    out = cln.scalarize_scenarios(_li(spark, sf, "net", "l_quantity").select("row_id", "net", "l_quantity"),
                                  ["net", "l_quantity"], [True, False], col_name="score")
    return out.select("row_id", "Scenario", _r4("score"))


CAT_COLS = ["l_returnflag", "l_linestatus"]


@register("category_map", " UNION ALL ".join(
    f"SELECT '{c}' AS column, label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code "
    f"FROM (SELECT DISTINCT {c} AS label FROM lineitem WHERE {c} IS NOT NULL)" for c in CAT_COLS))
def q_category_map(spark, sf):
    return enc.category_map(table(spark, sf, "lineitem"), CAT_COLS)


@register("encode_categorical", f"WITH li AS ({LI_SQL}) SELECT row_id, " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}" for c in CAT_COLS) + " FROM li")
def q_encode_categorical(spark, sf):
    out, _ = enc.encode_categoricals(_li(spark, sf, *CAT_COLS).select("row_id", *CAT_COLS), CAT_COLS)
    return out


@register("decode_categorical", f"WITH li AS ({LI_SQL}) SELECT row_id, l_returnflag, l_linestatus FROM li")
def q_decode_categorical(spark, sf):
    coded, maps = enc.encode_categoricals(_li(spark, sf, *CAT_COLS).select("row_id", *CAT_COLS), CAT_COLS)
    return enc.decode_categoricals(coded.withColumns({c: F.col(c).cast("double") + 0.3 for c in CAT_COLS}),
                                   maps)


# ---------------------------------------------------------------------------
# Design space
# ---------------------------------------------------------------------------
from sifter.operators import design as dsg  # noqa: E402


@register("snap_grid", f"""WITH li AS ({LI_SQL})
SELECT row_id,
  round(900 + least(greatest(ceil((l_extendedprice - 900) / 250.0 - 0.5), 0), 416) * 250.0, 10) AS grid_price,
  round_even(round_even((l_quantity - 1) / 4.0, 0) * 4.0 + 1, 6) AS step_qty
FROM li""")
def q_snap_grid(spark, sf):
    li = _li(spark, sf, "l_extendedprice", "l_quantity")
    return li.select("row_id",
                     dsg.snap_to_grid(F.col("l_extendedprice"), 900.0, 105000.0, 250.0).alias("grid_price"),
                     dsg.snap_step(F.col("l_quantity"), 1.0, 4.0, None, clamp=False).alias("step_qty"))


BOUND_F = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


@register("bounds", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, 'continuous' AS type, CAST(min({c}) AS DOUBLE) AS lower, "
    f"CAST(max({c}) AS DOUBLE) AS upper FROM lineitem" for c in BOUND_F))
def q_bounds(spark, sf):
    return dsg.observed_bounds(table(spark, sf, "lineitem"), BOUND_F).drop("values")


@register("best_row", f"""WITH li AS ({LI_SQL})
SELECT l_quantity, l_discount, l_tax, round(net, 6) AS net, row_id FROM li
ORDER BY net DESC, row_id LIMIT 1""")
def q_best_row(spark, sf):
    b = dsg.best_row(_li(spark, sf, "l_quantity", "l_discount", "l_tax", "net"), ["l_quantity", "l_discount", "l_tax"], "net")
    return b.select("l_quantity", "l_discount", "l_tax", r6("net"), "row_id")


def _lhs_sql(n: str, dims: list[tuple]) -> str:
    """Latin hypercube in SQL: ``dims`` are (name, lower, upper, step or None), bounds as SQL expressions."""
    parts = []
    for j, (name, lo, hi, step) in enumerate(dims):
        x = f"({lo} + max(CASE WHEN dim = {j} THEN u END) * ({hi} - {lo}))"
        if step:
            x = f"least(round_even(({x} - {lo}) / {step}, 0) * {step} + {lo}, {lo} + floor(({hi} - {lo}) / {step} + 1e-9) * {step})"
        parts.append(f"round_even({x}, 6) AS {name}")
    return f"""(SELECT point, {', '.join(parts)} FROM (
      SELECT point, dim, (row_number() OVER (PARTITION BY dim ORDER BY {uniform_sql(42, 'point', 'dim')}, point) - 1
                          + {uniform_sql(43, 'point', 'dim')}) / n AS u, lim.*
      FROM (SELECT unnest(range(n)) AS point, n FROM (SELECT {n} AS n)), (SELECT unnest(range({len(dims)})) AS dim), lim) GROUP BY point, lim.*)"""


_LIM_SQL = ("WITH lim AS (SELECT " + ", ".join(f"min({c})::DOUBLE AS lo_{c}, max({c})::DOUBLE AS hi_{c}"
                                              for c in ("l_quantity", "l_discount", "l_tax")) + " FROM lineitem)")
_LHS_DIMS = [("l_quantity", "any_value(lo_l_quantity)", "any_value(hi_l_quantity)", 1.0),
             ("l_discount", "any_value(lo_l_discount)", "any_value(hi_l_discount)", None), ("l_tax", "any_value(lo_l_tax)", "any_value(hi_l_tax)", None)]
_LHS_SQL = _lhs_sql("(SELECT count(*) FROM supplier)", _LHS_DIMS).replace("GROUP BY point, lim.*", "GROUP BY point")


@register("lhs_design", f"{_LIM_SQL} SELECT * FROM {_LHS_SQL}")
def q_lhs_design(spark, sf):
    """One new run per supplier over the observed ranges (plan size grows with the data)."""
    n = table(spark, sf, "supplier").count()
    b = dsg.observed_bounds(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).collect()
    params = [(r["feature"], r["lower"], r["upper"], 1.0 if r["feature"] == "l_quantity" else None)
              for r in b]
    return dsg.latin_hypercube(spark, int(n), params, seed=42)


@register("parameter_space", """
SELECT 'l_quantity' AS feature, 'ordinal' AS type, min(l_quantity)::DOUBLE AS lower, max(l_quantity)::DOUBLE AS upper, 1.0::DOUBLE AS step, NULL::VARCHAR AS level_list FROM lineitem
UNION ALL SELECT 'l_discount', 'continuous', min(l_discount)::DOUBLE, max(l_discount)::DOUBLE, NULL, NULL FROM lineitem
UNION ALL SELECT 'l_returnflag', 'categorical', 0.0, count(DISTINCT l_returnflag) - 1.0, NULL,
  (SELECT string_agg(k::DOUBLE::VARCHAR, ',' ORDER BY k) FROM (SELECT row_number() OVER (ORDER BY f) - 1 AS k FROM (SELECT DISTINCT l_returnflag AS f FROM lineitem))) FROM lineitem""")
def q_parameter_space(spark, sf):
    """P17; the levels of a categorical feature as text."""
    levels = F.array_join(F.transform("values", lambda v: v.cast("string")), ",")
    return _parameter_space(spark, sf).withColumn("level_list", levels).drop("values")


def _parameter_space(spark, sf):
    li = table(spark, sf, "lineitem")
    coded, _ = enc.encode_categoricals(li.select("l_quantity", "l_discount", "l_returnflag"), ["l_returnflag"])
    b = {r["feature"]: r.asDict() for r in
         dsg.observed_bounds(coded, ["l_quantity", "l_discount", "l_returnflag"], ["l_returnflag"]).collect()}
    b["l_quantity"]["type"] = "integer"
    return dsg.build_parameter_space(spark, ["l_quantity", "l_discount", "l_returnflag"], b)


@register("candidate_space", f"""{_LIM_SQL}
SELECT q::DOUBLE AS l_quantity, l_discount, f::DOUBLE AS l_returnflag
FROM {_lhs_sql('64', [_LHS_DIMS[1]]).replace('GROUP BY point, lim.*', 'GROUP BY point')},
  (SELECT unnest(range(min(l_quantity)::BIGINT, max(l_quantity)::BIGINT + 1)) AS q FROM lineitem),
  (SELECT unnest(range(count(DISTINCT l_returnflag))) AS f FROM lineitem)""")
def q_candidate_space(spark, sf):
    """64 stratified points (the operator's count parameter) at every level of the discrete features."""
    return dsg.candidate_space(spark, _parameter_space(spark, sf), n_continuous=64).drop("cand_id")


_MIXED_SQL = f"""{_LIM_SQL}, n AS (SELECT count(*) AS n FROM supplier),
u AS (SELECT point, dim, n, row_number() OVER (PARTITION BY dim ORDER BY {uniform_sql(42, 'point', 'dim')}, point) - 1 AS stratum, {uniform_sql(43, 'point', 'dim')} AS jitter
      FROM (SELECT unnest(range(n)) AS point, n FROM n), (SELECT unnest(range(3)) AS dim))
SELECT point, lo_l_quantity + floor(max(CASE WHEN dim = 0 THEN stratum END) * (floor(hi_l_quantity - lo_l_quantity) + 1) / n) AS l_quantity,
  round_even(lo_l_discount + max(CASE WHEN dim = 1 THEN (stratum + jitter) / n END) * (hi_l_discount - lo_l_discount), 6) AS l_discount,
  floor(max(CASE WHEN dim = 2 THEN stratum END) * (SELECT count(DISTINCT l_returnflag) FROM lineitem) / n)::DOUBLE AS l_returnflag
FROM u, lim GROUP BY point, n, lim.*"""


@register("mixed_design", _MIXED_SQL.replace("GROUP BY point, n, lim.*", "GROUP BY point, n, lo_l_quantity, hi_l_quantity, lo_l_discount, hi_l_discount"))
def q_mixed_design(spark, sf):
    """One hypercube over a stepped, a continuous and a categorical parameter, a point per supplier."""
    return dsg.mixed_design(spark, _parameter_space(spark, sf), table(spark, sf, "supplier").count(), seed=42)


# ---------------------------------------------------------------------------
# Random forest and SHAP (M9-M11): checked by unit tests (brute-force Shapley)
# ---------------------------------------------------------------------------
from sifter.operators import forest as frs  # noqa: E402

RF_ARGS = dict(n_estimators=20, max_depth=6, random_state=42)


@register("rf_importance")
def q_rf_importance(spark, sf):
    return frs.run_random_forest(_plain(spark, sf, *LIN_F, "net"), LIN_F, "net", **RF_ARGS)


def _shap(spark, sf):
    return frs.run_shap(_li(spark, sf, *LIN_F, "net"), LIN_F, "net", **RF_ARGS)


@register("shap_importance")
def q_shap_importance(spark, sf):
    return _shap(spark, sf).feature_importance


@register("shap_values")
def q_shap_values(spark, sf):
    return _shap(spark, sf).values


@register("shap_additivity", "SELECT count(*) AS n_rows, 0::BIGINT AS n_violations FROM lineitem")
def q_shap_additivity(spark, sf):
    """For every row, expected value + its SHAP values = the forest's prediction."""
    rows = _li(spark, sf, *LIN_F, "net")
    model = frs.fit_forest(rows, LIN_F, "net", n_estimators=10, max_depth=8)
    shap = frs.run_shap(rows, LIN_F, "net", n_estimators=10, max_depth=8)
    sums = shap.values.groupBy("row_id").agg(F.sum("shap_value").alias("phi"))
    predicted = model.transform(frs._assemble(rows, LIN_F)).select("row_id", "prediction")
    off = F.abs(F.col("prediction") - F.col("phi") - shap.expected_value) > 1e-6 * F.greatest(F.lit(1.0), F.abs("prediction"))
    return predicted.join(sums, "row_id", "left").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce(off, F.lit(True))).alias("n_violations"))


@register("shap_background", f"""WITH li AS ({LI_SQL})
SELECT row_id, {', '.join(LIN_F)} FROM li ORDER BY {uniform_sql(42, 'row_id')}, row_id LIMIT 100""")
def q_shap_background(spark, sf):
    return frs.background_sample(_li(spark, sf, *LIN_F).select("row_id", *LIN_F), 100, 42)


@register("narrative_rf")
def q_narrative_rf(spark, sf):
    return nar.interpret_random_forest(q_rf_importance(spark, sf), LIN_F)


@register("narrative_shap")
def q_narrative_shap(spark, sf):
    return nar.interpret_shap(q_shap_importance(spark, sf), LIN_F)


# ---------------------------------------------------------------------------
# Bootstrap rank stability (K1-K3)
# ---------------------------------------------------------------------------
from sifter.operators import bootstrap as bst  # noqa: E402


_POISSON_SQL = "CASE " + " ".join(
    f"WHEN u < {float(v)!r} THEN {k}" for k, v in enumerate(bst._POISSON1_CDF)) + f" ELSE {len(bst._POISSON1_CDF)} END"
_BOOT_PEARSON_SQL = f"""WITH li AS ({LI_SQL}),
d AS (SELECT b, li.*, {resampling_uniform_sql(42, 'row_id', 'b')} AS u FROM li, (SELECT unnest(range(100)) AS b)),
w AS (SELECT *, {_POISSON_SQL} AS w FROM d),
m AS (SELECT avg(net) AS net, {', '.join(f"avg({f}) AS {f}" for f in LIN_F)} FROM li),
c AS ({' UNION ALL '.join(f"""
  SELECT b, '{f}' AS feature, sum(w) AS n, sum(w * (w.{f} - m.{f})) AS sx, sum(w * (w.net - m.net)) AS sy,
         sum(w * (w.{f} - m.{f}) * (w.net - m.net)) AS sxy, sum(w * (w.{f} - m.{f}) ** 2) AS sxx,
         sum(w * (w.net - m.net) ** 2) AS syy FROM w, m WHERE w > 0 GROUP BY b""" for f in LIN_F)}),
r AS (SELECT b, feature, rank() OVER (PARTITION BY b ORDER BY
        abs((sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n))) DESC) AS rank FROM c)
SELECT feature, quantile_cont(rank, 0.5) AS median_rank, quantile_cont(rank, 0.25) AS rank_q25,
       quantile_cont(rank, 0.75) AS rank_q75, round(stddev_pop(rank), 6) AS rank_std, count(DISTINCT b) AS n_success
FROM r GROUP BY feature"""


@register("bootstrap_pearson", _BOOT_PEARSON_SQL)
def q_bootstrap_pearson(spark, sf):
    ranks = bst.bootstrap_ranks(_li(spark, sf, *LIN_F, "net"), LIN_F, "net", "pearson", n_bootstrap=100)
    return bst.rank_stability(ranks).withColumn("rank_std", F.round("rank_std", 6))


@register("bootstrap_lasso")
def q_bootstrap_lasso(spark, sf):
    ranks = bst.bootstrap_ranks(_li(spark, sf, *LIN_F, "net"), LIN_F, "net", "lasso", n_bootstrap=100, alpha=0.01)
    return bst.rank_stability(ranks)


@register("bootstrap_pca")
def q_bootstrap_pca(spark, sf):
    ranks = bst.bootstrap_ranks(_li(spark, sf, *LIN_F), LIN_F, None, "pca", n_bootstrap=100)
    return bst.rank_stability(ranks)


@register("bootstrap_success", " UNION ALL ".join(f"SELECT '{m}' AS method, '{f}' AS feature, 100::BIGINT AS n_success, true AS ranks_within" for m in ("lasso", "lasso_cv", "pca") for f in LIN_F))
def q_bootstrap_success(spark, sf):
    """K2, K3: all 100 replicates of the fitted methods succeed and their quartiles are ordered ranks."""
    rows = durable(_li(spark, sf, *LIN_F, "net").select("row_id", *LIN_F, "net"))
    out = None
    for m in ("lasso", "lasso_cv", "pca"):
        st = bst.rank_stability(bst.bootstrap_ranks(rows, LIN_F, "net" if m != "pca" else None, m, n_bootstrap=100))
        st = st.select(F.lit(m).alias("method"), "feature", F.col("n_success").cast("long").alias("n_success"),
                       ((F.col("rank_q25") >= 1) & (F.col("rank_q25") <= F.col("median_rank")) & (F.col("median_rank") <= F.col("rank_q75")) & (F.col("rank_q75") <= 4)).alias("ranks_within"))
        out = st if out is None else out.unionByName(st)
    return out


@register("bootstrap_weights", f"""WITH li AS ({LI_SQL}),
d AS (SELECT b, {resampling_uniform_sql(42, 'row_id', 'b')} AS u FROM li, (SELECT unnest(range(100)) AS b)),
w AS (SELECT b, {_POISSON_SQL} AS w FROM d)
SELECT b, CAST(sum(w) AS DOUBLE) AS n_drawn, count(*) AS n_distinct FROM w WHERE w > 0 GROUP BY b""")
def q_bootstrap_weights(spark, sf):
    """K1: per replicate, the number of drawn rows (mean n) and distinct rows used."""
    reps = bst.replicate_rows(_li(spark, sf, "l_orderkey").select("row_id"), 100, 42)
    return reps.groupBy("b").agg(F.sum("_w").alias("n_drawn"), F.count(F.lit(1)).alias("n_distinct"))


# ---------------------------------------------------------------------------
# GP surrogate, suggestions, Pareto batch
# ---------------------------------------------------------------------------
from sifter.operators import gp as gpm  # noqa: E402
from sifter.operators import optimise as opt  # noqa: E402

OPT_F = ["l_quantity", "l_discount"]
OPT_T = ["net", "l_tax", "l_extendedprice"]


def _opt_training(spark, sf):
    """Conditions = replicate-averaged (quantity, discount) settings of lineitem."""
    li = _li(spark, sf, *OPT_F, *OPT_T).select("row_id", *OPT_F, *OPT_T)
    return durable(rep.handle_replicates(li, OPT_F, OPT_T, "average"))


def _opt_params(spark, training):
    b = {r["feature"]: r.asDict() for r in dsg.observed_bounds(training, OPT_F).collect()}
    b["l_quantity"].update(type="integer", step=1.0)
    return dsg.build_parameter_space(spark, OPT_F, b)


@register("gp_importance")
def q_gp_importance(spark, sf):
    return gpm.run_ard_gp(_opt_training(spark, sf), OPT_F, "net")


@register("narrative_ard_gp")
def q_narrative_ard_gp(spark, sf):
    return nar.interpret_ard_gp(q_gp_importance(spark, sf), OPT_F)


@register("gp_optimum", "SELECT 2::BIGINT AS n_features, true AS importances_sum_to_one, true AS shorter_is_more_important, 0::BIGINT AS n_better_nearby")
def q_gp_optimum(spark, sf):
    """No hyper-parameter moved by 5 % either way fits better, and importances are the inverse lengthscales' shares."""
    tr = _opt_training(spark, sf)
    model = gpm.fit_gp(tr, OPT_F, "net")
    evaluate = gpm.objective(model.points, len(OPT_F), tr.count())
    moved = [model.theta + s * (np.arange(len(model.theta)) == i) for i in range(len(model.theta)) for s in (-0.05, 0.05)]
    (best, _), *near = evaluate([model.theta, *moved])
    better = sum(v < best - 1e-4 for v, _ in near)
    ard = gpm.ard_importance(model, spark)
    return ard.agg(F.count(F.lit(1)).alias("n_features"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("importances_sum_to_one"),
                   (F.min_by("rank", "lengthscale") == 1).alias("shorter_is_more_important")).withColumn("n_better_nearby", F.lit(better).cast("long"))


@register("suggest_single")
def q_suggest_single(spark, sf):
    tr = _opt_training(spark, sf)
    return opt.run_optimization(_opt_params(spark, tr), tr, "net", n_suggestions=1)


@register("suggest_batch")
def q_suggest_batch(spark, sf):
    tr = _opt_training(spark, sf)
    return opt.run_optimization(_opt_params(spark, tr), tr, "l_tax", n_suggestions=3, maximize=False)


@register("batch_qei", "SELECT 4::BIGINT AS n_slots, 256::BIGINT AS n_draws, true AS qei_is_the_draws_mean, true AS no_worse_than_greedy")
def q_batch_qei(spark, sf):
    """The joint expected improvement of a batch, worked out again from its stored draws."""
    tr = _opt_training(spark, sf)
    _, batch = opt.joint_suggestions(_opt_params(spark, tr), tr, "net", n_suggestions=4)
    draws = batch.table(spark)
    best = draws.groupBy("draw").agg(F.max("value").alias("top"))
    again = best.agg(F.avg(F.greatest(F.col("top") - batch.best, F.lit(0.0))).alias("qei"), F.count(F.lit(1)).alias("n_draws"))
    same = F.abs(F.col("qei") - batch.qei) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("qei"))
    return again.select(F.lit(len(batch.rows)).cast("long").alias("n_slots"), "n_draws", same.alias("qei_is_the_draws_mean"),
                        F.lit(batch.qei >= batch.greedy_qei).alias("no_worse_than_greedy"))


@register("suggest_aux")
def q_suggest_aux(spark, sf):
    tr = _opt_training(spark, sf)
    return opt.run_optimization(_opt_params(spark, tr), tr, "net", n_suggestions=2,
                                aux_target_cols=["net", "l_extendedprice"])


@register("suggest_ard")
def q_suggest_ard(spark, sf):
    tr = _opt_training(spark, sf)
    _, ard = opt.run_optimization(_opt_params(spark, tr), tr, "net", n_suggestions=1,
                                  return_ard_importance=True)
    return ard


@register("suggest_pareto")
def q_suggest_pareto(spark, sf):
    tr = _opt_training(spark, sf)
    sug, _ = opt.run_pareto_optimization(_opt_params(spark, tr), tr, ["net", "l_tax"], n_suggestions=3,
                                         maximize_targets=[True, False])
    return sug


@register("suggestion_checks", "SELECT * FROM (VALUES ('single', 1::BIGINT, 1::BIGINT, true, true, true), ('batch', 3, 3, true, true, true), ('aux', 2, 2, true, true, true), "
          "('pareto', 3, 3, true, true, true)) t(kind, n, n_distinct, in_bounds, on_grid, uncertain)")
def q_suggestion_checks(spark, sf):
    """Every suggestion is new, feasible and has an uncertainty."""
    lim = table(spark, sf, "lineitem").agg(F.min("l_quantity").alias("q0"), F.max("l_quantity").alias("q1"), F.min("l_discount").alias("d0"), F.max("l_discount").alias("d1")).first()
    out = None
    for kind, q in (("single", q_suggest_single), ("batch", q_suggest_batch), ("aux", q_suggest_aux), ("pareto", q_suggest_pareto)):
        df = q(spark, sf)
        spread = [F.col(c) > 0 for c in df.columns if c.startswith("uncertainty")]
        checks = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*OPT_F).alias("n_distinct"),
                        F.every(F.col("l_quantity").between(lim["q0"], lim["q1"]) & F.col("l_discount").between(lim["d0"] - 1e-6, lim["d1"] + 1e-6)).alias("in_bounds"),
                        F.every(F.col("l_quantity") == F.round("l_quantity")).alias("on_grid"), F.every(reduce(lambda a, b: a & b, spread)).alias("uncertain"))
        checks = checks.select(F.lit(kind).alias("kind"), "*")
        out = checks if out is None else out.unionByName(checks)
    return out


@register("pareto_current", """WITH li AS (SELECT l_quantity, l_discount,
    avg(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS net, avg(l_tax) AS l_tax
  FROM lineitem GROUP BY l_quantity, l_discount)
SELECT round(a.net, 6) AS net, round(a.l_tax, 6) AS l_tax FROM li a
WHERE NOT EXISTS (SELECT 1 FROM li u WHERE u.net >= a.net AND u.l_tax <= a.l_tax
                  AND (u.net > a.net OR u.l_tax < a.l_tax))""")
def q_pareto_current(spark, sf):
    """Current front of the conditions in original scale (tax minimised)."""
    tr = _opt_training(spark, sf)
    front = par.pareto_front(tr.select("net", "l_tax"), ["net", "l_tax"], [True, False])
    return front.select(r6("net"), r6("l_tax"))


# ---------------------------------------------------------------------------
# Plot data (V1-V4, V6-V8)
# ---------------------------------------------------------------------------
from sifter.operators import plotdata as pld  # noqa: E402


@register("scree", f"{_PCA_SQL} SELECT pc, round(evr * 100, 6) AS explained_pct, round(cum * 100, 6) AS cumulative_pct FROM eig")
def q_scree(spark, sf):
    return pld.scree(_pca(spark, sf).variance).select("pc", r6("explained_pct"), r6("cumulative_pct"))


@register("heatmap_long", f"""WITH li AS ({NET_SQL}), {_RK_CTE}, p AS ({_PEARSON_SQL}), s AS ({_SPEARMAN_SQL})
SELECT target, feature, 'pearson' AS method, pearson_r AS value,
       coalesce(CAST(round_even(pearson_r, 3) AS VARCHAR), 'n/a') AS label FROM p
UNION ALL SELECT target, feature, 'spearman', spearman_r,
       coalesce(CAST(round_even(spearman_r, 3) AS VARCHAR), 'n/a') FROM s
UNION ALL SELECT target, feature, m.method, NULL, 'n/a' FROM a_feats, (VALUES ('pearson'), ('spearman')) m(method)""".replace(
    "FROM a_feats", "FROM (SELECT t.target, c.feature FROM (VALUES ('net'), ('l_quantity')) t(target), "
    "(VALUES ('l_returnflag'), ('l_linestatus')) c(feature))"))
def q_heatmap_long(spark, sf):
    res = cor.run_correlations(_cor_input(spark, sf), CONS_FEATS, COR_T, categorical_cols=COR_C)
    return pld.heatmap_long(res).withColumn("value", F.round("value", 6))


@register("loading_heatmap", f"""{_LOADINGS_SQL}
SELECT feature, pc, printf('PC%d (%.1f%%)', pc::INT, evr * 100) AS pc_label, round(loading, 6) AS loading,
  round((SELECT max(abs(loading)) FROM ld), 6) AS color_limit FROM ld JOIN eig USING (pc)""")
def q_loading_heatmap(spark, sf):
    r = _pca(spark, sf)
    return pld.loading_heatmap(r.loadings, r.variance).select("feature", "pc", "pc_label", r6("loading"), r6("color_limit"))


@register("biplot_points", f"{_SCORES_SQL} SELECT row_id, round(PC1, 5) AS x, round(PC2, 5) AS y FROM sc")
def q_biplot_points(spark, sf):
    r = _pca(spark, sf, _li)
    return pld.biplot(r.scores, r.loadings)[0].select("row_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@register("biplot_vectors", f"""{_SCORES_SQL},
xy AS (SELECT feature, max(CASE WHEN pc = 1 THEN loading END) AS lx, max(CASE WHEN pc = 2 THEN loading END) AS ly FROM ld GROUP BY feature),
z AS (SELECT (SELECT greatest(max(abs(PC1)), max(abs(PC2)), 1e-9) FROM sc) * 0.8 / (SELECT greatest(max(abs(lx)), max(abs(ly)), 1e-9) FROM xy) AS k)
SELECT feature, round(lx * k, 5) AS x_end, round(ly * k, 5) AS y_end, round(lx * k * 1.18, 5) AS x_label, round(ly * k * 1.18, 5) AS y_label FROM xy, z""")
def q_biplot_vectors(spark, sf):
    r = _pca(spark, sf, _li)
    vec = pld.biplot(r.scores, r.loadings)[1]
    return vec.select("feature", *[F.round(c, 5).alias(c) for c in vec.columns if c != "feature"])


@register("beeswarm_points")
def q_beeswarm_points(spark, sf):
    return pld.beeswarm(_shap(spark, sf).values, max_display=4)


@register("beeswarm_checks", f"SELECT f AS feature, count(*) AS n_points, true AS scaled_within, true AS jitter_within FROM lineitem, (VALUES {', '.join(f'({chr(39)}{f}{chr(39)})' for f in LIN_F)}) t(f) GROUP BY f")
def q_beeswarm_checks(spark, sf):
    """V6: every row is a point of every feature, scaled to [0, 1], with a jitter of at most 0.35."""
    pts = q_beeswarm_points(spark, sf)
    scaled = next(c for c in pts.columns if "scaled" in c or "norm" in c)
    jitter = next(c for c in pts.columns if "jitter" in c)
    return pts.groupBy("feature").agg(F.count(F.lit(1)).alias("n_points"), F.every(F.col(scaled).between(0, 1)).alias("scaled_within"),
                                      F.every(F.abs(F.col(jitter)) <= 0.35 + 1e-9).alias("jitter_within"))


_FRONT_SQL = """SELECT p.p_retailprice AS x, p.p_size AS y FROM part p
WHERE NOT EXISTS (SELECT 1 FROM part u WHERE u.p_retailprice >= p.p_retailprice AND u.p_size >= p.p_size
                  AND (u.p_retailprice > p.p_retailprice OR u.p_size > p.p_size))"""


@register("staircase", f"""WITH f AS ({_FRONT_SQL}),
k AS (SELECT x, y, row_number() OVER (ORDER BY x, y) - 1 AS k, count(*) OVER () AS n FROM f),
b AS (SELECT min(x) - greatest((max(x) - min(x)) * 0.12, 1e-6) AS xl,
             max(x) + greatest((max(x) - min(x)) * 0.12, 1e-6) AS xr,
             min(y) - greatest((max(y) - min(y)) * 0.12, 1e-6) AS yb FROM f),
pr AS (SELECT k.*, k2.x AS x1, k2.y AS y1 FROM k LEFT JOIN k k2 ON k2.k = k.k + 1),
pts AS (
  SELECT 0 AS seq, xl AS x, y FROM pr, b WHERE k = 0
  UNION ALL SELECT 1, x, y FROM pr WHERE k = 0
  UNION ALL SELECT 2 + 2 * k, x, y1 FROM pr WHERE x1 IS NOT NULL
  UNION ALL SELECT 3 + 2 * k, x1, y1 FROM pr WHERE x1 IS NOT NULL
  UNION ALL SELECT 2 * n, xr, y FROM pr, b WHERE k = n - 1)
SELECT 'step' AS part, seq, round(x, 6) AS x, round(y, 6) AS y FROM pts
UNION ALL SELECT 'dominated', seq, round(x, 6), round(y, 6) FROM pts
UNION ALL SELECT 'dominated', 2 * n + 1, round(xr, 6), round(yb, 6) FROM pr, b WHERE k = n - 1
UNION ALL SELECT 'dominated', 2 * n + 2, round(xl, 6), round(yb, 6) FROM pr, b WHERE k = n - 1""")
def q_staircase(spark, sf):
    front = par.pareto_front(table(spark, sf, "part"), PART_OBJ)
    st = pld.staircase(front, "p_retailprice", "p_size")
    return st.select("part", "seq", r6("x"), r6("y"))


@register("objective_frame")
def q_objective_frame(spark, sf):
    tr = _opt_training(spark, sf)
    front = par.pareto_front(tr.select("net", "l_tax"), ["net", "l_tax"], [True, False])
    sug = q_suggest_pareto(spark, sf)
    return pld.objective_frame(front, sug, "net", "l_tax", "predicted_net", "predicted_l_tax")


# ---------------------------------------------------------------------------
# Full pipeline (M17), report summary (S9), transposed ingest
# ---------------------------------------------------------------------------
from sifter.plans import report as rpt  # noqa: E402
from sifter.plans.screen import screen  # noqa: E402
from sifter.sources import files as src  # noqa: E402

SCREEN_F = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
SCREEN_T = ["net"]
SCREEN_METHODS = ["lasso", "random_forest", "shap", "pca", "correlations", "ard_gp"]


def _screen_input(spark, sf):
    li = _li(spark, sf, *SCREEN_F, "net", "l_extendedprice").select("row_id", *SCREEN_F, "net", "l_extendedprice")
    avg = rep.handle_replicates(li, SCREEN_F, ["net", "l_extendedprice"], "average")
    return enc.encode_categoricals(avg, ["l_returnflag", "l_linestatus"])


def _screen(spark, sf):
    coded, _ = _screen_input(spark, sf)
    return screen(coded, SCREEN_F, SCREEN_T, SCREEN_METHODS, categorical_cols=["l_returnflag", "l_linestatus"],
                  n_estimators=20, max_depth=6)


@register("screen_methods", "SELECT 'net' AS target, m AS method, 5::BIGINT AS n_features, 1::BIGINT AS best_rank, true AS ranks_within FROM (VALUES "
          + ", ".join(f"('{m}')" for m in SCREEN_METHODS) + ") t(m)")
def q_screen_methods(spark, sf):
    """Every one of the six methods ranks every feature."""
    r = _screen(spark, sf).rankings
    return r.groupBy("target", "method").agg(F.count_distinct("feature").alias("n_features"), F.min("rank").cast("long").alias("best_rank"),
                                             (F.max("rank") <= 5).alias("ranks_within"))


_REPORT_F = ["l_quantity", "l_discount", "l_tax"]
_REPORT_SQL = f"""WITH c AS (SELECT l_quantity, l_discount, l_tax FROM lineitem GROUP BY ALL),
b AS (SELECT {', '.join(f'min({f}) AS lo_{f}, max({f}) AS hi_{f}' for f in _REPORT_F)} FROM c)
SELECT 'summary' AS section, 1::BIGINT AS n_rows, 'file_name,generated_at,n_features,n_rows,replicate_strategy,target_cols' AS column_names
UNION ALL SELECT 'lasso', 3, 'abs_coefficient,alpha,coefficient,feature,generated_at,rank,target'
UNION ALL SELECT 'pca', 3, 'feature,generated_at,max_loading,rank'
UNION ALL SELECT 'pca_variance', 3, 'cumulative_variance,explained_variance_ratio,generated_at,pc'
UNION ALL SELECT 'pca_loadings', 9, 'feature,generated_at,loading,pc'
UNION ALL SELECT 'correlations', 3, 'anova_p,anova_significant,eta_squared,feature,generated_at,n,pearson_p,pearson_r,pearson_significant,rank,spearman_p,spearman_r,spearman_significant,target'
UNION ALL SELECT 'consensus', 3, 'avg_normalized_rank,consensus_rank,correlations_rank,feature,generated_at,importance_label,lasso_rank,n_methods_top_k,pca_rank,target'
UNION ALL SELECT 'narratives', 4, 'generated_at,method,narrative,target'
UNION ALL SELECT 'bounds', 3, 'feature,generated_at,lower,type,upper'
UNION ALL SELECT 'suggestions', (SELECT count(*) FROM supplier), 'generated_at,l_discount (fraction),l_quantity (units),l_tax (fraction),point'"""


@register("report_sections", _REPORT_SQL)
def q_report_sections(spark, sf):
    """The assembled report, written and read back: rows and columns of every section."""
    li = _li(spark, sf, *_REPORT_F, "net").select("row_id", *_REPORT_F, "net")
    avg = durable(rep.handle_replicates(li, _REPORT_F, ["net"], "average"))
    result = screen(avg, _REPORT_F, ["net"], ["lasso", "pca", "correlations"])
    bounds = dsg.observed_bounds(avg, _REPORT_F)
    sections = rpt.report_sections(result, rpt.dataset_summary(spark, avg, "lineitem.parquet", _REPORT_F, ["net"], "average"), bounds.drop("values"),
                                   dsg.mixed_design(spark, dsg.build_parameter_space(spark, _REPORT_F, {r["feature"]: r.asDict() for r in bounds.collect()}),
                                                    table(spark, sf, "supplier").count()),
                                   units={"l_quantity": "units", "l_discount": "fraction", "l_tax": "fraction"})
    out = None
    for name, path in zip(sections, rpt.write_report(sections, scratch_path(spark, "report"))):
        read = spark.read.parquet(path)
        row = read.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("section"), "n_rows", F.lit(",".join(sorted(read.columns))).alias("column_names"))
        out = row if out is None else out.unionByName(row)
    return out


@register("screen_consensus")
def q_screen_consensus(spark, sf):
    return _screen(spark, sf).consensus


@register("screen_rankings")
def q_screen_rankings(spark, sf):
    return _screen(spark, sf).rankings


@register("screen_narratives")
def q_screen_narratives(spark, sf):
    return _screen(spark, sf).narratives


@register("report_summary", """SELECT 'lineitem.parquet' AS file_name, count(*) AS n_rows, CAST(5 AS BIGINT) AS n_features,
  'net' AS target_cols, 'average' AS replicate_strategy FROM (SELECT 1 FROM lineitem
  GROUP BY l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)""")
def q_report_summary(spark, sf):
    li = _li(spark, sf, *SCREEN_F, "net").select("row_id", *SCREEN_F, "net")
    avg = rep.handle_replicates(li, SCREEN_F, ["net"], "average")
    return rpt.dataset_summary(spark, avg, "lineitem.parquet", SCREEN_F, SCREEN_T, "average")


@register("transpose_ingest", """SELECT s_suppkey AS exp_no, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey,
  s_acctbal FROM supplier""")
def q_transpose_ingest(spark, sf):
    """Supplier laid out one row per variable, read back one row per experiment."""
    s = table(spark, sf, "supplier")
    cols = ["s_name", "s_nationkey", "s_acctbal"]
    stack = ", ".join(f"'{c}', CAST({c} AS STRING)" for c in cols)
    long_df = s.selectExpr("s_suppkey AS exp_no", f"stack({len(cols)}, {stack}) AS (variable, value)")
    return src.untranspose(long_df, "variable", "exp_no", "value").select("exp_no", *cols)


# ---------------------------------------------------------------------------
# Streaming replicate statistics (A2/A4/A5 incrementally)
# ---------------------------------------------------------------------------
from sifter.streaming.replicates import run_to_completion  # noqa: E402


@register("replicate_stream", """SELECT l_quantity, l_discount, count(*) AS n_replicates,
  round(avg(l_extendedprice), 6) AS l_extendedprice_mean, round(stddev_samp(l_extendedprice), 6) AS l_extendedprice_std
FROM lineitem GROUP BY l_quantity, l_discount""")
def q_replicate_stream(spark, sf):
    schema = table(spark, sf, "lineitem").schema
    out = run_to_completion(spark, sf, schema, REP_F, ["l_extendedprice"], path_glob="lineitem.parquet")
    return out.select(*REP_F, "n_replicates", r6("l_extendedprice_mean"), r6("l_extendedprice_std"))


# ---------------------------------------------------------------------------
# Preview (S6), missing-value resolution (P5), fixed conditions and units
# (P9, P10), generic bootstrap refit (K2)
# ---------------------------------------------------------------------------


@register("preview", f"""WITH li AS ({LI_SQL})
SELECT row_id, l_orderkey, l_quantity, l_extendedprice FROM li ORDER BY row_id LIMIT 10""")
def q_preview(spark, sf):
    """The first 10 experiments in row order (the limit is the feature)."""
    first = lineitem_experiments(spark, sf, with_row_id=False).orderBy(*LINEITEM_KEY).limit(10)       # a top-ten, no sort of all rows
    numbered = first.withColumn("row_id", F.row_number().over(Window.orderBy(*LINEITEM_KEY)).cast("long") - 1)
    return numbered.select("row_id", "l_orderkey", "l_quantity", "l_extendedprice")


@register("resolve_missing", _MISS_SQL + """
SELECT count(*) AS n_rows, round(avg(l_discount), 6) AS mean_discount, 3 AS n_columns
FROM m WHERE l_discount IS NOT NULL""")
def q_resolve_missing(spark, sf):
    """P5: drop rows missing l_discount, exclude the l_tax column."""
    df, feats, targets = cln.resolve_missing(_with_missing(spark, sf), ["l_quantity", "l_discount", "l_tax"],
                                             ["l_extendedprice"], drop_rows_for=["l_discount"],
                                             exclude=["l_tax"])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), r6(F.avg("l_discount"), "mean_discount"),
                  F.lit(len(feats) + len(targets)).alias("n_columns"))


@register("units_rename", f"""WITH li AS ({LI_SQL})
SELECT l_quantity AS "l_quantity (units)", l_discount AS "l_discount (fraction)",
       round_even(avg(l_extendedprice), 6) AS "l_extendedprice (USD)"
FROM li GROUP BY l_quantity, l_discount""")
def q_units_rename(spark, sf):
    """P10 on averaged conditions: half-even rounding to 6 places, units in names."""
    avg = rep.handle_replicates(_rep_input(spark, sf), REP_F, REP_T, "average")
    out = avg.select(*REP_F, "l_extendedprice")
    return enc.rename_with_units(out, {"l_quantity": "units", "l_discount": "fraction",
                                       "l_extendedprice": "USD"})


@register("design_with_fixed", f"""{_LIM_SQL}, li AS ({LI_SQL})
SELECT point, l_quantity, l_discount, (SELECT l_tax FROM li ORDER BY net DESC, row_id LIMIT 1)::DOUBLE AS l_tax FROM {_LHS_SQL}""")
def q_design_with_fixed(spark, sf):
    """P9 + A10: LHS over (quantity, discount); tax fixed at the best row's value."""
    best = dsg.best_row(_li(spark, sf, "l_quantity", "l_discount", "l_tax", "net"), ["l_quantity", "l_discount", "l_tax"], "net").first()
    plan = q_lhs_design(spark, sf).select("point", "l_quantity", "l_discount")
    return enc.attach_fixed(plan, {"l_tax": float(best["l_tax"])})


@register("bootstrap_forest")
def q_bootstrap_forest(spark, sf):
    """K2 generic hook: one weighted forest refit per replicate (5 replicates)."""
    def method(w, wc):
        return frs.run_random_forest(w, LIN_F, "net", n_estimators=10, max_depth=5, weight_col=wc)
    ranks = bst.bootstrap_refit(_li(spark, sf, *LIN_F, "net").select("row_id", *LIN_F, "net"), method, n_bootstrap=5)
    return bst.rank_stability(ranks)


def _refit_on_rows(spark, sf, method, n_bootstrap=5):
    """K2 on resampled rows (5 replicates, each a full refit over all rows)."""
    runs = durable(_li(spark, sf, *LIN_F, "net").select("row_id", *LIN_F, "net"))
    return bst.rank_stability(bst.bootstrap_refit(runs, method, n_bootstrap=n_bootstrap, weighted=False))


@register("bootstrap_correlations")
def q_bootstrap_correlations(spark, sf):
    """K2: Pearson and Spearman together, by the larger of the two (5 replicates, each with ranks of its own over all rows)."""
    runs = lineitem_experiments(spark, sf, cols=[*LIN_F, "net"], keep_key=False)
    ranks = bst.bootstrap_refit(runs, lambda rows, weights: cor.run_correlations(rows, LIN_F, "net", weight_cols=weights), n_bootstrap=5, together=True)
    return bst.rank_stability(ranks)


@register("bootstrap_lasso_cv")
def q_bootstrap_lasso_cv(spark, sf):
    """K2: LASSO with its penalty cross-validated anew in each of 100 replicates."""
    return bst.rank_stability(bst.bootstrap_ranks(_li(spark, sf, *LIN_F, "net"), LIN_F, "net", "lasso_cv", n_bootstrap=100))


_BOOT_ANOVA_SQL = f"""WITH li AS ({LI_SQL}),
d AS (SELECT b, li.*, {resampling_uniform_sql(42, 'row_id', 'b')} AS u FROM li, (SELECT unnest(range(100)) AS b)),
w AS (SELECT *, {_POISSON_SQL} AS w FROM d), m AS (SELECT avg(net) AS m FROM li),
g AS ({' UNION ALL '.join(f"""
  SELECT b, '{f}' AS feature, {f}::VARCHAR AS k, sum(w) AS n, sum(w * (net - m)) AS s, sum(w * (net - m) ** 2) AS ss FROM w, m WHERE w > 0 GROUP BY b, {f}""" for f in ("l_returnflag", "l_linestatus", "l_linenumber"))}),
e AS (SELECT b, feature, (sum(s * s / n) - sum(s) ** 2 / sum(n)) / (sum(ss) - sum(s) ** 2 / sum(n)) AS eta2 FROM g GROUP BY b, feature),
r AS (SELECT b, feature, rank() OVER (PARTITION BY b ORDER BY eta2 DESC) AS rank FROM e)
SELECT feature, quantile_cont(rank, 0.5) AS median_rank, quantile_cont(rank, 0.25) AS rank_q25,
       quantile_cont(rank, 0.75) AS rank_q75, round(stddev_pop(rank), 6) AS rank_std, count(DISTINCT b) AS n_success
FROM r GROUP BY feature"""


@register("bootstrap_anova", _BOOT_ANOVA_SQL)
def q_bootstrap_anova(spark, sf):
    """K2: eta squared of three categorical columns in 100 replicates."""
    cats = ["l_returnflag", "l_linestatus", "l_linenumber"]
    ranks = bst.bootstrap_ranks(_li(spark, sf, *cats, "net"), cats, "net", "anova", n_bootstrap=100)
    return bst.rank_stability(ranks).withColumn("rank_std", F.round("rank_std", 6))


@register("bootstrap_shap")
def q_bootstrap_shap(spark, sf):
    """K2: SHAP importance of a forest grown anew in each replicate."""
    return _refit_on_rows(spark, sf, lambda rows: frs.run_shap(rows, LIN_F, "net", **RF_ARGS).feature_importance, 2)


# ---------------------------------------------------------------------------
# Round trips (S1, S7, S8), role projection (P6), keep_all (A3), plot points (V8)
# ---------------------------------------------------------------------------


def _workbook(rows: list[tuple], names: list[str]) -> bytes:
    """A workbook of two sheets: the rows with their header, and a note."""
    import io
    import zipfile
    from xml.sax.saxutils import escape
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda c, r, v: (f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' if isinstance(v, str)
                            else f'<c r="{chr(65 + c)}{r}"><v>{v!r}</v></c>')
    lines = "".join(f'<row r="{i}">' + "".join(cell(c, i, v) for c, v in enumerate(row)) + "</row>" for i, row in enumerate([tuple(names), *rows], 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
                                      '<sheet name="Suppliers" sheetId="1" r:id="a"/><sheet name="Note" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{lines}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1"><v>{len(rows)}</v></c></row></sheetData></worksheet>')
    return out.getvalue()


_XLSX_COLS = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]


def _supplier_workbooks(spark, sf) -> str:
    """A workbook per nation with its suppliers, written by the tasks into the shared scratch folder."""
    folder = scratch_path(spark, "workbooks")

    def write(key, pdf):
        import pandas as pd
        from pyarrow import fs
        store, at = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/nation-{key[0]}.xlsx", compression=None) as f:
            f.write(_workbook(list(pdf[_XLSX_COLS].itertuples(index=False, name=None)), _XLSX_COLS))
        return pd.DataFrame({"rows": [len(pdf)]})

    sup = table(spark, sf, "supplier").selectExpr("cast(s_suppkey as bigint) s_suppkey", "s_name", "cast(s_nationkey as bigint) s_nationkey", "cast(s_acctbal as double) s_acctbal")
    sup.groupBy("s_nationkey").applyInPandas(write, "rows long").collect()          # a row a nation
    return folder


@register("excel_scan", "SELECT s_suppkey::BIGINT AS s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal::DOUBLE AS s_acctbal FROM supplier")
def q_excel_scan(spark, sf):
    """The first sheets of a folder of workbooks, types restored."""
    out = src.load_file(spark, _supplier_workbooks(spark, sf) + "/*.xlsx")
    return out.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_nationkey").cast("long").alias("s_nationkey"), F.col("s_acctbal").cast("double").alias("s_acctbal"))


@register("excel_sheets", "SELECT 'nation-' || s_nationkey || '.xlsx' AS file, position::INT AS position, sheet FROM (SELECT DISTINCT s_nationkey FROM supplier), (VALUES (0, 'Suppliers'), (1, 'Note')) v(position, sheet)")
def q_excel_sheets(spark, sf):
    """S3: the sheets of a folder of workbooks."""
    return src.list_sheets(spark, _supplier_workbooks(spark, sf) + "/*.xlsx").withColumn("file", F.regexp_extract("file", r"[^/]+$", 0))


_CSV_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]


@register("csv_round_trip", f"SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber::BIGINT AS l_linenumber, {', '.join(_CSV_COLS[2:])} FROM lineitem")
def q_csv_round_trip(spark, sf):
    """S7 then S1: the experiments written as CSV parts and loaded with their types restored."""
    path = scratch_path(spark, "experiments") + ".csv"
    rpt.write_csv(table(spark, sf, "lineitem").select(*_CSV_COLS), path)
    return src.load_file(spark, path)


@register("result_store", f"""WITH li AS ({NET_SQL})
SELECT target, 'pearson' AS method, feature, pearson_r FROM ({_PEARSON_SQL})""")
def q_result_store(spark, sf):
    """Correlations of every target written to the result store and read back."""
    path = scratch_path(spark, "results")
    found = cor.pearson_table(_cor_input(spark, sf), COR_F, COR_T)
    rpt.write_result_store(found.select("target", F.lit("pearson").alias("method"), "feature", r6("r", "pearson_r")), path)
    return spark.read.parquet(path).select("target", "method", "feature", "pearson_r")


@register("role_projection", f"WITH li AS ({LI_SQL}) SELECT row_id, l_quantity, l_discount, round(net, 6) AS net FROM li")
def q_role_projection(spark, sf):
    """Inputs and response of one screening."""
    return cln.project_roles(_li(spark, sf, *OPT_F, *OPT_T), OPT_F, "net").withColumn("net", F.round("net", 6))


@register("replicate_keep_all", f"""WITH li AS ({LI_SQL})
SELECT row_id, l_quantity, l_discount, l_extendedprice, round(net, 6) AS net, l_returnflag, l_linestatus FROM li""")
def q_replicate_keep_all(spark, sf):
    """A3: every row stays as it is."""
    kept = rep.handle_replicates(_rep_input(spark, sf), REP_F, REP_T, "keep_all")
    return kept.withColumn("net", F.round("net", 6))


@register("objective_points", f"""WITH f AS ({_FRONT_SQL}),
s AS (SELECT p_size, max(p_retailprice) AS x FROM part GROUP BY p_size)
SELECT 'front' AS kind, row_number() OVER (ORDER BY x, y) - 1 AS seq, NULL::VARCHAR AS label, round(x, 6) AS x, round(y, 6) AS y,
       NULL::VARCHAR AS category FROM f
UNION ALL SELECT 'suggestion', row_number() OVER (ORDER BY p_size) - 1, '#' || row_number() OVER (ORDER BY p_size),
       round(x, 6), p_size::DOUBLE, p_size::VARCHAR FROM s""")
def q_objective_points(spark, sf):
    """V8: the front of price and size, and the dearest part of each size as numbered points."""
    part = table(spark, sf, "part")
    dearest = part.groupBy("p_size").agg(F.max("p_retailprice").alias("p_retailprice"))
    pts = pld.objective_points(par.pareto_front(part, PART_OBJ), dearest, "p_retailprice", "p_size",
                               order_by=["p_size"], category="p_size")
    return pts.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})
