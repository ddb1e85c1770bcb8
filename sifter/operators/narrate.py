"""Plain-English narration of method results as Spark string expressions.

Each narrator aggregates a method's result table (one row per target and
feature) per target and emits ``(target, method, narrative)``.  Sentences are
built with ``format_string``/``array_join``; lists of names are collected per
target, so their size is bounded by the number of features.  Result order
(what the "top" and "others" refer to) is the method's rank order with ties
broken by the feature order given by the caller.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The sentence templates and thresholds of the narration.  They
# must read exactly like the reference's sentences, so they are kept here
# together, in the order the narratives use them.  ``%s``/``%d``/``%.3f``
# placeholders are filled by ``format_string``.
CAVEAT = ("These are data-driven suggestions. "
          "Domain expertise should guide final decisions.")
TEMPLATES = {
    "corr_none": "No features show a statistically significant {label} correlation with %s.",
    "corr_top": ("{label} correlation found '%s' has a %s %s {assoc} association with %s "
                 "({sym} = %.3f, p = %.3f)."),
    "corr_total": "In total, %d features show a significant {label} correlation with %s.",
    "corr_no_linear": "%s: no significant linear correlation detected with %s (|r| < 0.1, p > 0.05).",
    "anova_none": "One-way ANOVA found no statistically significant difference in %s across groups of %s.",
    "anova_top": "One-way ANOVA found '%s' groups differ significantly in %s (η² = %.3f, p = %.3f; %s effect).",
    "anova_others": "%s also show a significant group effect on %s.",
    "anova_non_sig": "%s: ANOVA found no significant group difference in %s (p > 0.05).",
    "lasso_all_zero": ("LASSO assigned zero weight to all features for %s, indicating no detectable linear "
                       "relationships at the selected regularization strength."),
    "lasso_top": "LASSO identified '%s' as the most influential feature for %s (regression coefficient %+.4f).",
    "lasso_others": "Other features retained by LASSO: %s.",
    "lasso_zero": "%s received zero weight from LASSO, suggesting %s may be irrelevant under linear assumptions.",
    "rf_top": "Random Forest ranked '%s' as the most important feature for %s (importance score %.4f).",
    "rf_others": "Other features in descending order of importance: %s.",
    "shap_top": "SHAP analysis identified '%s' as the most impactful feature for %s (mean |SHAP| = %.4f).",
    "shap_others": "Features of secondary SHAP importance (descending): %s.",
    "pca_head": "PCA selected %d component(s), together explaining %.1f%% of the total feature-space variance.",
    "pca_pc": "PC%d is most strongly associated with '%s' (loading %+.3f).",
    "pca_overall": ("Overall, '%s' shows the highest PCA loading (max |loading| = %.3f) across all "
                    "retained components."),
    "consensus_head": ("Across {n} method(s), '%s' is the highest-ranked feature for %s, appearing in the "
                       "top tier for %d of {n} method(s)."),
    "label_strong": "%s %s 'strongly important' (ranked in top-K by >= 75%% of methods).",
    "label_moderate": "%s %s 'moderately important' (ranked in top-K by 50-74%% of methods).",
    "label_weak": "%s %s 'weakly important or inconsistent across methods'.",
    "interaction": ("%s rank highly in PCA but show low direct correlation — they may be important in "
                    "combination with other features (nonlinear/interaction effect)."),
    "gp_top": ("The ARD Gaussian Process identified '%s' as the most influential feature for %s, with the "
               "shortest ARD lengthscale (%.4f). A short lengthscale means the model predicts rapid change "
               "in the response along that dimension — a strong signal of relevance."),
    "gp_long": ("%s %s long lengthscales, suggesting the GP response surface is relatively flat in %s and "
                "%s may be less critical."),
    "gp_others": "Remaining features in descending order of GP importance: %s.",
}
# |r| >= 0.5 strong, >= 0.3 moderate, else weak; eta^2 >= 0.14 large,
# >= 0.06 medium, else small; "no linear" = |r| < 0.1 and p > 0.05;
# a lengthscale is long above 2 x the median.
R_STRONG, R_MODERATE = 0.5, 0.3
ETA_LARGE, ETA_MEDIUM = 0.14, 0.06
NO_LINEAR_R, NO_LINEAR_P = 0.1, 0.05
LONG_LENGTHSCALE = 2.0


def join_names(arr: Column) -> Column:
    """['a'] -> 'a'; ['a','b','c'] -> 'a', 'b' and 'c' (quoted)."""
    q = F.transform(arr, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    n = F.size(q)
    return (F.when(n == 0, F.lit(""))
            .when(n == 1, F.element_at(q, 1))
            .otherwise(F.concat(F.array_join(F.slice(q, 1, n - 1), ", "), F.lit(" and "),
                                F.element_at(q, -1))))


def _names(sorted_structs: Column, field: str = "feature") -> Column:
    return join_names(F.transform(sorted_structs, lambda s: s[field]))


def paragraph(*sentences: Column) -> Column:
    return F.array_join(F.filter(F.array(*sentences, F.lit(CAVEAT)), lambda x: x.isNotNull()), " ")


def _fpos(feature_order: Sequence[str] | None) -> Column:
    if not feature_order:
        return F.lit(0)
    return F.array_position(F.array(*[F.lit(f) for f in feature_order]), F.col("feature"))


def _groups(df: DataFrame, group_cols: Sequence[str]) -> list[str]:
    return [g for g in group_cols if g in df.columns]


def _tq(col: str = "target") -> Column:
    return F.concat(F.lit("'"), F.col(col), F.lit("'"))


def _strength_r(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a >= R_STRONG, "strong").when(a >= R_MODERATE, "moderate").otherwise("weak")


def _corr_sentences(tbl: DataFrame, m: str, label: str, assoc: str, sym: str,
                    no_linear: bool) -> DataFrame:
    r, p, sig = F.col(f"{m}_r"), F.col(f"{m}_p"), F.col(f"{m}_significant")
    sig_b = F.coalesce(sig, F.lit(False))
    g = tbl.where(r.isNotNull()).groupBy("target").agg(
        F.count_if(sig_b).alias("n_sig"),
        F.max_by(F.struct(F.col("feature"), r.alias("r"), p.alias("p")),
                 F.when(sig_b, F.struct(F.abs(r), -F.col("_fpos")))).alias("top"),
        F.sort_array(F.collect_list(F.when((F.abs(r) < NO_LINEAR_R) & (p > NO_LINEAR_P),
                                           F.struct("_fpos", "feature")))).alias("nl"))
    top = F.col("top")
    s1 = F.when(F.col("n_sig") == 0, F.format_string(
        TEMPLATES["corr_none"].format(label=label), _tq())
    ).otherwise(F.format_string(
        TEMPLATES["corr_top"].format(label=label, assoc=assoc, sym=sym),
        top["feature"], _strength_r(top["r"]),
        F.when(top["r"] > 0, "positive").otherwise("negative"), _tq(), top["r"], top["p"]))
    s2 = F.when(F.col("n_sig") > 1, F.format_string(
        TEMPLATES["corr_total"].format(label=label),
        F.col("n_sig"), _tq()))
    s3 = F.when(F.size("nl") > 0, F.format_string(
        TEMPLATES["corr_no_linear"],
        _names(F.col("nl")), _tq())) if no_linear else F.lit(None).cast("string")
    return g.select("target", F.array(s1, s2, s3).alias(f"_{m}"))


def _anova_sentences(tbl: DataFrame) -> DataFrame:
    sig_b = F.coalesce(F.col("anova_significant"), F.lit(False))
    g = tbl.where(F.col("eta_squared").isNotNull()).groupBy("target").agg(
        F.count_if(sig_b).alias("n_sig"),
        F.max_by(F.struct("feature", "eta_squared", "anova_p"),
                 F.when(sig_b, F.struct(F.col("eta_squared"), -F.col("_fpos")))).alias("top"),
        F.sort_array(F.collect_list(F.struct("_fpos", "feature"))).alias("all"),
        F.sort_array(F.collect_list(F.when(sig_b, F.struct("_fpos", "feature")))).alias("sig"),
        F.sort_array(F.collect_list(F.when(~sig_b, F.struct("_fpos", "feature")))).alias("ns"))
    top = F.col("top")
    eta = top["eta_squared"]
    strength = F.when(eta >= ETA_LARGE, "large").when(eta >= ETA_MEDIUM, "medium").otherwise("small")
    s1 = F.when(F.col("n_sig") == 0, F.format_string(
        TEMPLATES["anova_none"],
        _tq(), _names(F.col("all")))
    ).otherwise(F.format_string(
        TEMPLATES["anova_top"],
        top["feature"], _tq(), eta, top["anova_p"], strength))
    others = F.filter(F.col("sig"), lambda s: s["feature"] != top["feature"])
    s2 = F.when(F.col("n_sig") > 1, F.format_string(
        TEMPLATES["anova_others"], _names(others), _tq()))
    s3 = F.when(F.size("ns") > 0, F.format_string(
        TEMPLATES["anova_non_sig"], _names(F.col("ns")), _tq()))
    return g.select("target", F.array(s1, s2, s3).alias("_anova"))


def interpret_correlations(result: DataFrame, feature_order: Sequence[str] | None = None
                           ) -> DataFrame:
    """Pearson, Spearman and ANOVA sentences for each target."""
    tbl = result.withColumn("_fpos", _fpos(feature_order))
    targets = tbl.select("target").distinct()
    parts = {}
    if "pearson_r" in tbl.columns:
        parts["_pearson"] = _corr_sentences(tbl, "pearson", "Pearson", "linear", "r", True)
    if "spearman_r" in tbl.columns:
        parts["_spearman"] = _corr_sentences(tbl, "spearman", "Spearman", "monotonic", "rho", False)
    if "eta_squared" in tbl.columns:
        parts["_anova"] = _anova_sentences(tbl)
    out = targets
    for k, p in parts.items():
        out = out.join(p, "target", "left")
    arrays = [F.coalesce(F.col(k), F.array().cast("array<string>")) for k in parts]
    sentences = F.flatten(F.array(*arrays)) if arrays else F.array().cast("array<string>")
    return out.select("target", F.lit("correlations").alias("method"),
                      F.array_join(F.filter(F.concat(sentences, F.array(F.lit(CAVEAT))),
                                            lambda x: x.isNotNull()), " ").alias("narrative"))


def _ordered(tbl: DataFrame, score: str, feature_order, extra: Sequence[str] = ()) -> Column:
    """Features in result order: score descending, then feature order."""
    return F.sort_array(F.collect_list(F.struct(
        (-F.col(score)).alias("_k"), F.col("_fpos"), F.col("feature"),
        *[F.col(c) for c in extra])))


def interpret_lasso(result: DataFrame, feature_order: Sequence[str] | None = None,
                    group_cols: Sequence[str] = ("target",)) -> DataFrame:
    """N5 from ``(target, feature, coefficient, abs_coefficient, rank)``."""
    tbl = result.withColumn("_fpos", _fpos(feature_order))
    gs = _groups(tbl, group_cols)
    g = tbl.groupBy(*gs).agg(
        F.sort_array(F.collect_list(F.when(F.col("coefficient") != 0, F.struct(
            (-F.col("abs_coefficient")).alias("_k"), F.col("_fpos"), F.col("feature"),
            F.col("coefficient"))))).alias("nz"),
        F.sort_array(F.collect_list(F.when(F.col("coefficient") == 0, F.struct(
            F.col("_fpos"), F.col("feature"))))).alias("zero"))
    top = F.element_at(F.col("nz"), 1)
    t = _tq(gs[0]) if gs else F.lit("'target'")
    s1 = F.when(F.size("nz") == 0, F.format_string(
        TEMPLATES["lasso_all_zero"], t)
    ).otherwise(F.format_string(
        TEMPLATES["lasso_top"],
        top["feature"], t, top["coefficient"]))
    s2 = F.when(F.size("nz") > 1, F.format_string(
        TEMPLATES["lasso_others"], _names(F.slice(F.col("nz"), 2, 1 << 30))))
    s3 = F.when(F.size("zero") > 0, F.format_string(
        TEMPLATES["lasso_zero"],
        _names(F.col("zero")), F.when(F.size("zero") == 1, "it").otherwise("they")))
    return g.select(*gs, F.lit("lasso").alias("method"), paragraph(s1, s2, s3).alias("narrative"))


def _top_and_rest(result: DataFrame, score: str, method: str, first: str, rest: str,
                  feature_order, group_cols) -> DataFrame:
    tbl = result.withColumn("_fpos", _fpos(feature_order))
    gs = _groups(tbl, group_cols)
    g = tbl.groupBy(*gs).agg(_ordered(tbl, score, feature_order, [score]).alias("o"))
    top = F.element_at(F.col("o"), 1)
    t = _tq(gs[0]) if gs else F.lit("'target'")
    s1 = F.format_string(first, top["feature"], t, top[score])
    s2 = F.when(F.size("o") > 1, F.format_string(rest, _names(F.slice(F.col("o"), 2, 1 << 30))))
    return g.select(*gs, F.lit(method).alias("method"), paragraph(s1, s2).alias("narrative"))


def interpret_random_forest(result: DataFrame, feature_order=None, group_cols=("target",)):
    """N6 from ``(target, feature, importance, rank)``."""
    return _top_and_rest(result, "importance", "random_forest",
                         TEMPLATES["rf_top"], TEMPLATES["rf_others"], feature_order, group_cols)


def interpret_shap(result: DataFrame, feature_order=None, group_cols=("target",)):
    """N7 from ``(target, feature, mean_abs_shap, rank)``."""
    return _top_and_rest(result, "mean_abs_shap", "shap",
                         TEMPLATES["shap_top"], TEMPLATES["shap_others"], feature_order, group_cols)


def interpret_pca(variance: DataFrame, loadings: DataFrame, feature_rank: DataFrame,
                  feature_order=None, group_cols: Sequence[str] = ()) -> DataFrame:
    """N8 from the PCA tables: variance ``(pc, explained_variance_ratio,
    cumulative_variance)``, loadings ``(feature, pc, loading)`` and
    ``feature_rank`` ``(feature, max_loading, rank)``; ``pc`` = 1, 2, ..."""
    gs = _groups(variance, group_cols)
    v = variance.groupBy(*gs).agg(F.count(F.lit(1)).alias("k"),
                                  F.max_by("cumulative_variance", "pc").alias("cum"))
    ld = loadings.withColumn("_fpos", _fpos(feature_order))
    per_pc = ld.groupBy(*gs, "pc").agg(
        F.max_by(F.struct("feature", "loading"), F.struct(F.abs("loading"), -F.col("_fpos"))).alias("t"))
    pcs = per_pc.groupBy(*gs).agg(F.sort_array(F.collect_list(F.struct(
        "pc", F.format_string(TEMPLATES["pca_pc"],
                              F.col("pc"), F.col("t.feature"), F.col("t.loading")).alias("s")))).alias("pcs"))
    fr = feature_rank.withColumn("_fpos", _fpos(feature_order))
    best = fr.groupBy(*gs).agg(F.min_by(F.struct("feature", "max_loading"),
                                        F.struct("rank", "_fpos")).alias("b"))
    j = v.join(pcs, gs, "left").join(best, gs, "left") if gs else \
        v.withColumn("_k", F.lit(1)).join(pcs.withColumn("_k", F.lit(1)), "_k") \
         .join(best.withColumn("_k", F.lit(1)), "_k")
    s1 = F.format_string(TEMPLATES["pca_head"], F.col("k"), F.col("cum") * 100)
    s3 = F.format_string(TEMPLATES["pca_overall"], F.col("b.feature"), F.col("b.max_loading"))
    sentences = F.concat(F.array(s1), F.transform(F.col("pcs"), lambda s: s["s"]), F.array(s3, F.lit(CAVEAT)))
    return j.select(*gs, F.lit("pca").alias("method"), F.array_join(sentences, " ").alias("narrative"))


def interpret_consensus(labelled: DataFrame, n_methods: int,
                        group_cols: Sequence[str] = ("target",)) -> DataFrame:
    """N10/N11 from the labelled consensus table."""
    gs = _groups(labelled, group_cols)
    corr_cols = [c for c in ("pearson_rank", "spearman_rank", "correlation_rank", "correlations_rank")
                 if c in labelled.columns]
    has_flag = "pca_rank" in labelled.columns and corr_cols
    tbl = labelled
    if has_flag:
        cc = F.col(corr_cols[0])
        n = F.count(F.lit(1)).over(Window.partitionBy(*gs))
        k = F.greatest(F.lit(3), F.floor(n / 3))
        tbl = tbl.withColumn("_flag", (F.col("pca_rank") <= k) & (cc > n - k))
    else:
        tbl = tbl.withColumn("_flag", F.lit(False))

    def lst(label):
        return F.sort_array(F.collect_list(F.when(F.col("importance_label") == label,
                                                  F.struct("consensus_rank", "feature"))))
    g = tbl.groupBy(*gs).agg(
        F.min_by(F.struct("feature", "n_methods_top_k"), "consensus_rank").alias("top"),
        lst("strongly important").alias("st"), lst("moderately important").alias("mo"),
        lst("weakly important or inconsistent").alias("we"),
        F.sort_array(F.collect_list(F.when(F.col("_flag"), F.struct("consensus_rank", "feature")))).alias("fl"))
    t = _tq(gs[0]) if gs else F.lit("'target'")
    s1 = F.format_string(TEMPLATES["consensus_head"].format(n=n_methods), F.col("top.feature"), t,
                         F.col("top.n_methods_top_k"))

    def grp(c, template):
        verb = F.when(F.size(c) == 1, "is").otherwise("are")
        return F.when(F.size(c) > 0, F.format_string(template, _names(F.col(c)), verb))
    s2 = grp("st", TEMPLATES["label_strong"])
    s3 = grp("mo", TEMPLATES["label_moderate"])
    s4 = grp("we", TEMPLATES["label_weak"])
    s5 = F.when(F.size("fl") > 0, F.format_string(TEMPLATES["interaction"], _names(F.col("fl"))))
    return g.select(*gs, F.lit("consensus").alias("method"),
                    paragraph(s1, s2, s3, s4, s5).alias("narrative"))


def interpret_ard_gp(result: DataFrame, feature_order=None, group_cols=("target",)) -> DataFrame:
    """N12 from ``(target, feature, lengthscale, importance, rank)``."""
    tbl = result.withColumn("_fpos", _fpos(feature_order))
    gs = _groups(tbl, group_cols)
    g = tbl.groupBy(*gs).agg(
        _ordered(tbl, "importance", feature_order, ["lengthscale"]).alias("o"),
        F.median("lengthscale").alias("med"))
    top = F.element_at(F.col("o"), 1)
    t = _tq(gs[0]) if gs else F.lit("'target'")
    long_ls = F.filter(F.col("o"), lambda s: s["lengthscale"] > F.col("med") * LONG_LENGTHSCALE)
    many = F.size(long_ls) > 1
    s1 = F.format_string(TEMPLATES["gp_top"], top["feature"], t, top["lengthscale"])
    s2 = F.when((F.size("o") > 1) & (F.size(long_ls) > 0), F.format_string(
        TEMPLATES["gp_long"], _names(long_ls), F.when(many, "have").otherwise("has"),
        F.when(many, "those directions").otherwise("that direction"),
        F.when(many, "those features").otherwise("that feature")))
    s3 = F.when(F.size("o") > 1, F.format_string(
        TEMPLATES["gp_others"], _names(F.slice(F.col("o"), 2, 1 << 30))))
    return g.select(*gs, F.lit("ard_gp").alias("method"), paragraph(s1, s2, s3).alias("narrative"))


def sentences_table(narratives: DataFrame) -> DataFrame:
    """``(…, method, seq, sentence)``: a narrative split into its sentences."""
    keep = [c for c in narratives.columns if c != "narrative"]
    return narratives.select(*keep, F.posexplode(F.split("narrative", r"(?<=\.) (?=[A-Z'])")).alias("seq", "sentence"))
