"""Bootstrap stability, consensus and labels on literal fixtures (FIXTURES §4)."""

import numpy as np
import pytest

from sifter.operators import bootstrap as bst
from sifter.operators import consensus as cons


@pytest.fixture(scope="module")
def synthetic(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(200, 4))
    y = 2 * X[:, 0] + 0.3 * X[:, 1] + rng.normal(0, 0.1, 200)
    rows = [(i, *map(float, X[i]), float(y[i])) for i in range(200)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double, y double")


@pytest.mark.parametrize("method", ["pearson", "lasso", "pca"])
def test_bootstrap_summary(synthetic, method):
    ranks = bst.bootstrap_ranks(synthetic, ["a", "b", "c", "d"], "y", method, n_bootstrap=30)
    summ = bst.rank_stability(ranks).toPandas()
    assert set(summ.columns) == {"feature", "median_rank", "rank_q25", "rank_q75", "rank_std", "n_success"}
    assert (summ["n_success"] == 30).all()
    if method != "pca":
        assert summ.iloc[0]["feature"] == "a" and summ.iloc[0]["median_rank"] == 1


def test_poisson_weights_mean_one(spark):
    reps = bst.replicate_rows(spark.range(20000).withColumnRenamed("id", "row_id"), 5, 7)
    tot = reps.groupBy("b").agg({"_w": "sum"}).toPandas()
    assert np.allclose(tot["sum(_w)"] / 20000, 1.0, atol=0.03)


def _ranks(spark, data):
    rows = [(m, f, r) for m, lst in data.items() for f, r in lst]
    return spark.createDataFrame(rows, "method string, feature string, rank long")


def test_consensus_fixture(spark):
    rk = _ranks(spark, {"lasso": [("A", 1), ("B", 2), ("C", 3), ("D", 4)],
                        "random_forest": [("A", 1), ("C", 2), ("B", 3), ("D", 4)],
                        "shap": [("B", 1), ("A", 2), ("D", 3), ("C", 4)]})
    c = cons.compute_consensus(rk, ["lasso", "random_forest", "shap"], group_cols=())
    lab = cons.label_importance(c, 3).toPandas().set_index("feature")
    assert lab.loc["A", "avg_normalized_rank"] == pytest.approx(1 / 3)
    assert lab.loc["B", "avg_normalized_rank"] == pytest.approx(0.5)
    assert lab.loc["C", "avg_normalized_rank"] == pytest.approx(0.75)
    assert lab.loc["D", "avg_normalized_rank"] == pytest.approx(11 / 12)
    assert lab["n_methods_top_k"].to_dict() == {"A": 3, "B": 3, "C": 2, "D": 1}
    assert lab["importance_label"].to_dict() == {
        "A": "strongly important", "B": "strongly important",
        "C": "moderately important", "D": "weakly important or inconsistent"}
    assert lab["consensus_rank"].to_dict() == {"A": 1, "B": 2, "C": 3, "D": 4}


def test_consensus_missing_feature_counts_as_top_k(spark):
    rk = _ranks(spark, {"m1": [("A", 1), ("B", 2), ("C", 3)], "m2": [("A", 1), ("B", 2)]})
    c = cons.compute_consensus(rk, ["m1", "m2"], group_cols=()).toPandas().set_index("feature")
    assert c.loc["C", "m2_rank"] == 3
    assert c.loc["C", "n_methods_top_k"] == 2     # rank 3 <= K = 3 (quirk kept)


def test_label_requires_methods(spark):
    rk = _ranks(spark, {"m1": [("X", 1)]})
    with pytest.raises(ValueError):
        cons.label_importance(cons.compute_consensus(rk, ["m1"], group_cols=()), 0)


def test_empty_rankings_give_empty_consensus(spark):
    empty = spark.createDataFrame([], "method string, feature string, rank long")
    c = cons.compute_consensus(empty, [], group_cols=())
    assert c.count() == 0
    assert {"feature", "avg_normalized_rank", "consensus_rank", "n_methods_top_k"} <= set(c.columns)


def test_error_contract(spark):
    from sifter.operators.forest import run_random_forest
    from sifter.operators.linear import run_lasso
    from sifter.operators.pca import run_pca
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, 2.0, 3.0), (2, 3.0, 5.0)], "row_id long, a double, y double")
    with pytest.raises(ValueError):
        run_lasso(df, ["a"], "y", alpha=0)
    with pytest.raises(ValueError):
        run_random_forest(df, ["a"], "y", n_estimators=0)
    with pytest.raises(ValueError):
        bst.bootstrap_ranks(df, ["a"], "y", "pearson", n_bootstrap=0)
    with pytest.raises(ValueError):
        run_pca(df, ["a"], variance_threshold=1.5)
    empty = df.where("false")
    with pytest.raises(ValueError):
        run_random_forest(empty, ["a"], "y")


def test_weight_matrix_is_the_column_expression(spark):
    from pyspark.sql import functions as F
    df = spark.range(50).select((F.col("id") * 977 - 20).alias("row_id"))
    got = {(r["row_id"], r["b"]): r["w"] for r in df.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("b"))
           .withColumn("w", bst.poisson_weight(F.col("row_id"), F.col("b"), 7)).collect()}
    keys = [r["row_id"] for r in df.collect()]
    W = bst.weight_matrix(keys, 11, 7)
    assert all(W[i, b] == got[k, b] for i, k in enumerate(keys) for b in range(11)) and W.max() >= 2


def test_folds_of_a_replicate_are_those_of_its_rows(synthetic):
    cols = ["a", "b", "y"]
    parts = bst.replicate_moments(synthetic.repartition(5), cols, 4, 9, folds=3)
    rows = synthetic.orderBy("row_id").toPandas()
    W = bst.weight_matrix(rows["row_id"], 4, 9).astype(int)
    for b in range(4):
        drawn = np.repeat(rows[cols].to_numpy(), W[:, b], axis=0)
        for m, part in zip(parts[b], np.array_split(drawn, 3), strict=True):
            assert m.n == len(part) and np.allclose(m.mean, part.mean(0))
            assert np.allclose(m.M, (part - part.mean(0)).T @ (part - part.mean(0)))


def test_one_pass_cross_validation_equals_refits(synthetic):
    from sifter.operators.linear import run_lasso
    feats = ["a", "b", "c", "d"]
    fast = bst.bootstrap_ranks(synthetic, feats, "y", "lasso_cv", n_bootstrap=3)
    slow = bst.bootstrap_refit(synthetic, lambda d: run_lasso(d, feats, "y", row_order=["row_id"]), n_bootstrap=3, weighted=False)
    key = lambda df: sorted((r["b"], r["feature"], r["rank"]) for r in df.collect())
    assert key(fast) == key(slow)


def test_anova_replicates_against_numpy(spark):
    rng = np.random.default_rng(4)
    g, h = rng.integers(0, 4, 300), rng.integers(0, 2, 300)
    y = g + rng.normal(0, 2, 300)
    rows = [(i, "abcd"[a] if i % 50 else None, str(b), "same", float(v)) for i, (a, b, v) in enumerate(zip(g, h, y))]
    df = spark.createDataFrame(rows, "row_id long, g string, h string, k string, y double")
    got = {(r["b"], r["feature"]): r["rank"] for r in bst.bootstrap_ranks(df, ["g", "h", "k"], "y", "anova", n_bootstrap=5).collect()}
    W = bst.weight_matrix(range(300), 5, 42)
    for b in range(5):
        eta = {}
        for f, col in (("g", 1), ("h", 2)):
            use = [r for r in rows if r[col] is not None]
            v = np.repeat([r[4] for r in use], [int(W[r[0], b]) for r in use])
            k = np.repeat([r[col] for r in use], [int(W[r[0], b]) for r in use])
            eta[f] = sum(len(v[k == c]) * (v[k == c].mean() - v.mean()) ** 2 for c in set(k)) / ((v - v.mean()) ** 2).sum()
        assert [got[b, f] for f in sorted(eta, key=eta.get, reverse=True)] == [1, 2] and (b, "k") not in got
