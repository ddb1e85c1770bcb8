"""Feature methods against the hand-computed example values (FIXTURES §1)."""

import numpy as np
import pytest

from conftest import FEATURES
from sifter.operators import correlate as cor
from sifter.operators.linear import run_lasso
from sifter.operators.pca import run_pca


def test_averaging_example(averaged):
    rows = {r["temperature"]: r for r in averaged.collect() if r["temperature"] in (200,)}
    assert averaged.count() == 11
    got = sorted((round(r["yield"], 6), round(r["selectivity"], 6)) for r in averaged.collect()
                 if r["pressure"] in (2.0, 2.5) and r["catalyst_loading"] in (0.1, 0.15)
                 and r["reaction_time"] in (90, 120) and r["solvent_ratio"] == 1.0)
    assert (0.795, 0.825) in got and (0.855, 0.775) in got
    assert rows


def test_correlations_example(averaged):
    res = cor.run_correlations(averaged, FEATURES, "yield").toPandas().set_index("feature")
    want = {"temperature": (0.816568, 0.002162, 0.768650, 0.005704),
            "pressure": (0.441380, 0.174141, 0.439890, 0.175771),
            "catalyst_loading": (0.639964, 0.033943, 0.670100, 0.024064),
            "solvent_ratio": (-0.054260, 0.874105, 0.0, 1.0),
            "reaction_time": (0.519201, 0.101699, 0.573070, 0.065345)}
    for f, (r, p, rho, ps) in want.items():
        assert res.loc[f, "pearson_r"] == pytest.approx(r, abs=1e-6)
        assert res.loc[f, "pearson_p"] == pytest.approx(p, abs=1e-6)
        assert res.loc[f, "spearman_r"] == pytest.approx(rho, abs=1e-6)
        assert res.loc[f, "spearman_p"] == pytest.approx(ps, abs=1e-6)
    ranks = res["rank"].to_dict()
    assert ranks == {"temperature": 1, "catalyst_loading": 2, "reaction_time": 3,
                     "pressure": 4, "solvent_ratio": 5}


def test_anova_example(example):
    from sifter.operators.replicates import handle_replicates
    avg12 = handle_replicates(example, FEATURES + ["Catalyst"], ["yield", "selectivity"])
    assert avg12.count() == 12
    res = cor.run_correlations(avg12, ["Catalyst"], "yield", categorical_cols=["Catalyst"])
    r = res.collect()[0]
    assert r["eta_squared"] == pytest.approx(0.054403, abs=1e-6)
    assert r["anova_p"] == pytest.approx(0.924570, abs=1e-6)
    assert r["pearson_r"] is None and r["anova_significant"] is False


def test_categorical_fixture(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 1.1), ("B", 5.0), ("B", 5.1), ("C", 9.0), ("C", 9.1)],
                               "cat string, y double")
    r = cor.run_correlations(df, ["cat"], "y", categorical_cols=["cat"]).collect()[0]
    assert r["pearson_r"] is None and r["spearman_r"] is None
    assert 0 <= r["eta_squared"] <= 1 and r["anova_significant"] is True


def test_pca_example(averaged):
    res = run_pca(averaged, FEATURES)
    evr = [r["explained_variance_ratio"] for r in res.variance.orderBy("pc").collect()]
    assert res.n_components == 4
    assert evr == pytest.approx([0.529112, 0.195033, 0.132192, 0.107541], abs=1e-6)
    mx = {r["feature"]: r["max_loading"] for r in res.feature_rank.collect()}
    want = {"temperature": 0.5892, "pressure": 0.5576, "catalyst_loading": 0.7599,
            "solvent_ratio": 0.8053, "reaction_time": 0.9060}
    for f, v in want.items():
        assert mx[f] == pytest.approx(v, abs=1e-4)
    # scores are uncorrelated projections with variance = eigenvalue
    sc = res.scores.toPandas()
    assert abs(np.corrcoef(sc["PC1"], sc["PC2"])[0, 1]) < 1e-8


@pytest.mark.parametrize("alpha,want", [
    (0.01, [0.054328, 0, 0.026249, -0.007543, 0.012545]),
    (0.001, [0.070160, -0.031993, 0.045697, -0.007208, 0.021888]),
])
def test_lasso_fixed_alpha(averaged, alpha, want):
    res = run_lasso(averaged, FEATURES, "yield", alpha=alpha).toPandas().set_index("feature")
    got = [res.loc[f, "coefficient"] for f in FEATURES]
    assert got == pytest.approx(want, abs=2e-4)
    assert res["rank"].min() == 1


def test_lasso_cv_matches_numpy(averaged):
    """CV path from fold moments == brute-force per-fold fits in numpy."""
    from sifter.operators.linear import alpha_grid, coordinate_descent
    res = run_lasso(averaged, FEATURES, "yield", cv=5, row_order=["row_id"]).toPandas()
    pdf = averaged.orderBy("row_id").toPandas()
    X = pdf[FEATURES].to_numpy(float)
    y = pdf["yield"].to_numpy(float)
    Xs = (X - X.mean(0)) / X.std(0)
    n = len(y)
    alphas = alpha_grid(Xs.T @ (y - y.mean()) / n)
    sizes = [n // 5 + (1 if i < n % 5 else 0) for i in range(5)]
    bounds = np.cumsum([0] + sizes)
    mse = np.zeros((len(alphas), 5))
    for k in range(5):
        te = np.arange(bounds[k], bounds[k + 1])
        tr = np.setdiff1d(np.arange(n), te)
        Xt, yt = Xs[tr], y[tr]
        mx, my = Xt.mean(0), yt.mean()
        G = (Xt - mx).T @ (Xt - mx) / len(tr)
        c = (Xt - mx).T @ (yt - my) / len(tr)
        for i, a in enumerate(alphas):
            w = coordinate_descent(G, c, a)
            pred = my + (Xs[te] - mx) @ w
            mse[i, k] = np.mean((y[te] - pred) ** 2)
    best = alphas[int(np.argmin(mse.mean(1)))]
    assert res["alpha"].iloc[0] == pytest.approx(best, rel=1e-9)


def _synthetic(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(50, 4))
    y = 2 * X[:, 0] + 0.3 * X[:, 1] + rng.normal(0, 0.1, 50)
    rows = [(i, *map(float, X[i]), float(y[i])) for i in range(50)]
    return spark.createDataFrame(rows, "row_id long, feat_a double, feat_b double, feat_c double, "
                                       "feat_d double, yield double")


def test_synthetic_feat_a_first(spark):
    df = _synthetic(spark)
    feats = ["feat_a", "feat_b", "feat_c", "feat_d"]
    lasso = run_lasso(df, feats, "yield", cv=5).orderBy("rank").first()
    assert lasso["feature"] == "feat_a"
    res = cor.run_correlations(df, feats, "yield").toPandas().set_index("feature")
    assert res.loc["feat_a", "rank"] == 1 and res.loc["feat_a", "pearson_r"] > 0.95


def test_dominant_component(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=100)
    X = np.column_stack([z + rng.normal(0, 0.01, 100) for _ in range(3)])
    df = spark.createDataFrame([(i, *map(float, X[i])) for i in range(100)], "row_id long, f1 double, f2 double, f3 double")
    res = run_pca(df, ["f1", "f2", "f3"])
    assert res.n_components == 1
    with pytest.raises(ValueError):
        run_pca(df, ["f1", "f2", "f3"], variance_threshold=0)


@pytest.mark.parametrize("weighted", [False, True])
def test_wide_moment_path_matches_expressions(spark, monkeypatch, weighted):
    import sifter.operators.moments as mo
    rng = np.random.default_rng(9)
    X = rng.normal(size=(300, 5)) * [1, 10, 100, 0.1, 3] + [5, -2, 1e4, 0, 1]
    rows = [(int(i % 3), float(rng.integers(0, 3)), *map(float, X[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, w double, a double, b double, c double, d double, e double")
    cols = ["a", "b", "c", "d", "e"]
    kw = dict(weight="w") if weighted else {}
    narrow = mo.moment_table(df, cols, ["g"], **kw)
    monkeypatch.setattr(mo, "WIDE_COLS", 2)
    wide = mo.moment_table(df, cols, ["g"], **kw)
    for k in narrow:
        assert wide[k].n == pytest.approx(narrow[k].n)
        assert np.allclose(wide[k].mean, narrow[k].mean)
        assert np.allclose(wide[k].M, narrow[k].M, rtol=1e-9, atol=1e-6)
