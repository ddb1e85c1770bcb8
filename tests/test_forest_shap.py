"""Random forest and TreeSHAP: additivity and brute-force Shapley values."""

import itertools
import math

import numpy as np
import pytest

from sifter.operators import forest as fr


@pytest.fixture(scope="module")
def synthetic(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(50, 4))
    y = 2 * X[:, 0] + 0.3 * X[:, 1] + rng.normal(0, 0.1, 50)
    rows = [(i, *map(float, X[i]), float(y[i])) for i in range(50)]
    return spark.createDataFrame(rows, "row_id long, feat_a double, feat_b double, feat_c double, "
                                       "feat_d double, y double")


FEATS = ["feat_a", "feat_b", "feat_c", "feat_d"]


def test_random_forest_importance(synthetic):
    res = fr.run_random_forest(synthetic, FEATS, "y", n_estimators=20, max_depth=6).toPandas()
    assert res["importance"].sum() == pytest.approx(1.0)
    assert res.sort_values("rank").iloc[0]["feature"] == "feat_a"


def _brute_shap(tree, x, p):
    """Exact path-dependent Shapley values by enumerating all subsets."""
    by_id = {int(r.id): r for r in tree.itertuples()}

    def f_s(S):
        def rec(nid):
            r = by_id[nid]
            if r.left < 0:
                return r.value
            if int(r.feature) in S:
                return rec(int(r.left) if x[int(r.feature)] <= r.threshold else int(r.right))
            lc, rc = by_id[int(r.left)], by_id[int(r.right)]
            return (lc.cover * rec(int(r.left)) + rc.cover * rec(int(r.right))) / r.cover
        return rec(0)

    phi = np.zeros(p)
    for i in range(p):
        others = [j for j in range(p) if j != i]
        for k in range(p):
            for S in itertools.combinations(others, k):
                w = math.factorial(k) * math.factorial(p - k - 1) / math.factorial(p)
                phi[i] += w * (f_s(set(S) | {i}) - f_s(set(S)))
    return phi


def test_treeshap_matches_brute_force_and_is_additive(synthetic):
    model = fr.fit_forest(synthetic, FEATS, "y", n_estimators=3, max_depth=4)
    nodes = fr.forest_nodes(model)
    trees = [fr.tree_tables(g) for _, g in nodes.groupby("treeID", sort=True)]
    X = synthetic.orderBy("row_id").toPandas()[FEATS].to_numpy(float)
    phi = fr.shap_batch(X, trees, 4)
    brute = np.mean([[_brute_shap(g, x, 4) for x in X[:8]] for _, g in nodes.groupby("treeID")], axis=0)
    assert np.allclose(phi[:8], brute, atol=1e-10)
    pred = fr.forest_predict_numpy(nodes, X)
    expected = np.mean([t.expected for t in trees])
    assert np.allclose(phi.sum(1) + expected, pred, atol=1e-9)


def test_run_shap_ranks_dominant_feature(synthetic):
    res = fr.run_shap(synthetic, FEATS, "y", n_estimators=20, max_depth=6)
    top = res.feature_importance.orderBy("rank").first()
    assert top["feature"] == "feat_a"
    assert res.values.count() == 50 * 4
    assert res.background.count() == 50


def test_shap_runs_at_defaults_on_many_features_and_stays_additive(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(400, 12))
    y = X[:, 0] * X[:, 1] + X[:, 2] + 0.1 * rng.normal(size=400)
    feats = [f"f{i}" for i in range(12)]
    df = spark.createDataFrame([(i, *map(float, X[i]), float(y[i])) for i in range(400)],
                               "row_id long, " + ", ".join(f"{f} double" for f in feats) + ", y double")
    model = fr.fit_forest(df, feats, "y", n_estimators=3)
    nodes = fr.forest_nodes(model)
    trees = [fr.tree_tables(g) for _, g in nodes.groupby("treeID", sort=True)]
    phi = fr.shap_batch(X, trees, 12)
    assert max(t.cond_node.shape[1] for t in trees) > 8 and max(t.z.shape[1] for t in trees) > 8
    assert np.allclose(phi.sum(1) + np.mean([t.expected for t in trees]), fr.forest_predict_numpy(nodes, X), atol=1e-8)
    res = fr.run_shap(df, feats, "y", n_estimators=5)
    sums = res.values.groupBy("feature").agg({"shap_value": "count"}).collect()
    assert {r[1] for r in sums} == {400} and res.feature_importance.count() == 12


def test_depth_beyond_the_limit_raises(synthetic):
    with pytest.raises(ValueError):
        fr.fit_forest(synthetic, FEATS, "y", n_estimators=1, max_depth=31)


def test_skyline_with_more_partitions_than_rows(spark):
    from sifter.operators.pareto import pareto_front
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, 0.5, 1.0, 2.0)], "row_id long, a double, b double, c double").repartition(6)
    assert [r["row_id"] for r in pareto_front(df, ["a", "b", "c"]).collect()] == [1]
    rng = np.random.default_rng(2)
    Y = rng.integers(0, 12, (1500, 3)).astype(float)
    got = pareto_front(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(Y)], "row_id long, a double, b double, c double"), ["a", "b", "c"])
    want = {i for i in range(len(Y)) if not (np.all(Y >= Y[i], 1) & np.any(Y > Y[i], 1)).any()}
    assert {r["row_id"] for r in got.collect()} == want


def test_importance_by_cells_equals_the_rows_own_sums(spark):
    rng = np.random.default_rng(5)
    X = np.column_stack([rng.integers(0, 4, 500), rng.integers(0, 2, 500), np.round(rng.normal(size=500), 1)]).astype(float)
    y = X[:, 0] * X[:, 1] + X[:, 2]
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(X, y))], "row_id long, a double, b double, c double, y double")
    res = fr.run_shap(df, ["a", "b", "c"], "y", n_estimators=5, max_depth=5)
    by_rows = res.values.groupBy("feature").agg({"shap_value": "count"}).collect()
    assert {r[1] for r in by_rows} == {500}
    want = {r["feature"]: r["m"] for r in res.values.selectExpr("feature", "abs(shap_value) as v").groupBy("feature").avg("v").withColumnRenamed("avg(v)", "m").collect()}
    got = {r["feature"]: r["mean_abs_shap"] for r in res.feature_importance.collect()}
    assert got == pytest.approx(want, rel=1e-9)
