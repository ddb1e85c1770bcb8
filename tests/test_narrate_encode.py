"""Narration sentences (FIXTURES §5) and categorical encode/decode."""

import pytest
from pyspark.sql import functions as F

from sifter.operators import encode as enc
from sifter.operators import narrate as nar


def test_join_names(spark):
    df = spark.createDataFrame([(["a"],), (["a", "b", "c"],), ([],)], "v array<string>")
    got = [r[0] for r in df.select(nar.join_names(F.col("v"))).collect()]
    assert got == ["'a'", "'a', 'b' and 'c'", ""]


def _one(df):
    return df.collect()[0]["narrative"]


def test_lasso_narrative(spark):
    res = spark.createDataFrame([("y", "a", 1.5, 1.5, 1), ("y", "b", -0.3, 0.3, 2), ("y", "c", 0.0, 0.0, 3)],
                                "target string, feature string, coefficient double, abs_coefficient double, rank long")
    text = _one(nar.interpret_lasso(res, ["a", "b", "c"]))
    assert "'a' as the most influential feature for 'y' (regression coefficient +1.5000)" in text
    assert "Other features retained by LASSO: 'b'." in text
    assert "'c' received zero weight from LASSO, suggesting it may be irrelevant" in text
    assert text.endswith(nar.CAVEAT)
    zero = spark.createDataFrame([("y", "a", 0.0, 0.0, 1), ("y", "b", 0.0, 0.0, 1)],
                                 "target string, feature string, coefficient double, abs_coefficient double, rank long")
    assert "zero weight to all features" in _one(nar.interpret_lasso(zero))


def test_forest_and_shap_narratives(spark):
    rf = spark.createDataFrame([("y", "a", .7, 1), ("y", "b", .2, 2), ("y", "c", .1, 3)],
                               "target string, feature string, importance double, rank long")
    t = _one(nar.interpret_random_forest(rf))
    assert "ranked 'a' as the most important feature for 'y' (importance score 0.7000)" in t
    assert "descending order of importance: 'b' and 'c'." in t
    sh = spark.createDataFrame([("y", "a", .5, 1), ("y", "b", .2, 2), ("y", "c", .1, 3)],
                               "target string, feature string, mean_abs_shap double, rank long")
    assert "(mean |SHAP| = 0.5000)" in _one(nar.interpret_shap(sh))


def test_correlation_narrative(spark):
    rows = [("y", "a", 0.9, 0.001, True, None, None, None), ("y", "b", 0.05, 0.8, False, None, None, None),
            ("y", "c", -0.02, 0.9, False, None, None, None)]
    df = spark.createDataFrame(rows, "target string, feature string, pearson_r double, pearson_p double, "
                                     "pearson_significant boolean, eta_squared double, anova_p double, "
                                     "anova_significant boolean")
    t = _one(nar.interpret_correlations(df, ["a", "b", "c"]))
    assert "'a' has a strong positive linear association with 'y' (r = 0.900, p = 0.001)" in t
    assert "'b' and 'c': no significant linear correlation detected" in t
    assert "Spearman" not in t


def test_consensus_narrative_and_flag(spark):
    rows = [("y", "feat_a", 1, 3, 1, 1, "strongly important"), ("y", "feat_b", 3, 1, 2, 1, "weakly important or inconsistent"),
            ("y", "feat_c", 2, 2, 3, 1, "weakly important or inconsistent"),
            ("y", "feat_d", 4, 4, 4, 0, "weakly important or inconsistent")]
    df = spark.createDataFrame(rows, "target string, feature string, pca_rank long, pearson_rank long, "
                                     "consensus_rank long, n_methods_top_k long, importance_label string")
    t = _one(nar.interpret_consensus(df, 2))
    assert t.startswith("Across 2 method(s), 'feat_a' is the highest-ranked feature for 'y'")
    assert "'feat_a' is 'strongly important'" in t
    assert "are 'weakly important or inconsistent across methods'" in t


def test_encode_decode_roundtrip(spark):
    df = spark.createDataFrame([("Pt",), ("Ni",), (None,), ("Pd",), ("Ni",)], "cat string")
    coded, maps = enc.encode_categoricals(df)
    assert [r[0] for r in coded.collect()] == [2, 0, -1, 1, 0]
    assert enc.maps_to_dict(maps) == {"cat": {"Ni": 0, "Pd": 1, "Pt": 2}}
    dec = enc.decode_categoricals(coded.withColumn("cat", F.col("cat") + 0.4), maps)
    assert [r[0] for r in dec.collect()] == ["Pt", "Ni", None, "Pd", "Ni"]
