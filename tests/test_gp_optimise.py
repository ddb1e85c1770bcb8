"""GP surrogate, suggestions and Pareto operators."""

import numpy as np
import pytest

from conftest import FEATURES
from sifter.operators import design as dsg
from sifter.operators import gp as gpm
from sifter.operators import optimise as opt
from sifter.operators import pareto as par


def test_gp_gradient_matches_finite_differences():
    rng = np.random.default_rng(1)
    X = rng.random((15, 3))
    y = np.sin(3 * X[:, 0]) + 0.1 * rng.normal(size=15)
    th = np.r_[np.log([0.5, 0.8, 1.2]), 0.1, np.log(0.05), 0.2]
    v, g = gpm.expert_nll_grad(th, X, y)
    for i in range(len(th)):
        e = np.zeros_like(th)
        e[i] = 1e-6
        num = (gpm.expert_nll_grad(th + e, X, y)[0] - gpm.expert_nll_grad(th - e, X, y)[0]) / 2e-6
        assert g[i] == pytest.approx(num, rel=1e-4, abs=1e-6)


@pytest.fixture(scope="module")
def gp_data(spark):
    rng = np.random.default_rng(3)
    X = rng.random((120, 3))
    y = 3 * X[:, 0] + 0.2 * np.sin(X[:, 1]) + 0.01 * rng.normal(size=120)
    return spark.createDataFrame([(i, *map(float, X[i]), float(y[i])) for i in range(120)],
                                 "row_id long, a double, b double, c double, y double")


@pytest.mark.parametrize("expert_size,fit_rows", [(512, 256), (40, 40)])
def test_ard_gp_ranks_driving_feature(gp_data, expert_size, fit_rows):
    model = gpm.fit_gp(gp_data, ["a", "b", "c"], "y", expert_size=expert_size, fit_rows=fit_rows)
    ls = model.lengthscales
    assert ls[0] < ls[1] and ls[0] < ls[2]
    cands = gp_data.select(gp_data.row_id.alias("cand_id"), "a", "b", "c")
    pred = gpm.predict(model, cands).join(gp_data.withColumnRenamed("row_id", "cand_id"), "cand_id").toPandas()
    assert np.corrcoef(pred["mean"], pred["y"])[0, 1] > 0.95
    assert (pred["std"] > 0).all()


def test_merged_rows_have_the_rows_own_likelihood():
    rng = np.random.default_rng(7)
    X = np.repeat(rng.random((6, 2)), [1, 4, 2, 1, 5, 3], axis=0)
    y = np.sin(4 * X[:, 0]) + 0.3 * rng.normal(size=len(X))
    th = np.r_[np.log([0.6, 0.9]), 0.2, np.log(0.08), 0.1]
    points, at = np.unique(X, axis=0, return_inverse=True)
    n = np.bincount(at.ravel()).astype(float)
    mean = np.bincount(at.ravel(), y) / n
    within = np.bincount(at.ravel(), (y - mean[at.ravel()]) ** 2)
    v, g = gpm.expert_nll_grad(th, X, y)
    mv, mg = gpm.expert_nll_grad(th, points, mean, n, within)
    assert mv == pytest.approx(v, rel=1e-6)
    assert mg == pytest.approx(g, rel=1e-4, abs=1e-5)


def test_lbfgs_needs_few_jobs():
    calls = []

    def valley(thetas):
        calls.append(len(thetas))
        out = []
        for t in thetas:
            a, b = 1 - t[0], t[1] - t[0] ** 2
            out.append((a * a + 5 * b * b, np.array([-2 * a - 20 * b * t[0], 10 * b])))
        return out
    got = gpm.lbfgs(valley, np.array([-1.0, 1.5]))
    assert len(calls) <= gpm.MAX_JOBS < 25 and got == pytest.approx([1, 1], abs=1e-2)


@pytest.fixture(scope="module")
def wave(spark):
    rng = np.random.default_rng(11)
    X = rng.random((300, 2))
    y = np.sin(5 * X[:, 0]) + 0.5 * X[:, 1] + 0.05 * rng.normal(size=300)
    rows = [(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(X, y))]
    return X, y, spark.createDataFrame(rows, "cand_id long, a double, b double, y double")


def test_regions_agree_with_the_exact_gp(wave, spark):
    X, y, df = wave
    whole = gpm.fit_gp(df, ["a", "b"], "y")
    rng = np.random.default_rng(1)
    asked = rng.random((200, 2))
    table = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(asked)], "cand_id long, a double, b double")
    exact = gpm.expert_predict(whole.theta, whole.scale_x(X.copy()), (y - whole.y_mean) / whole.y_std, whole.scale_x(asked.copy()))
    got = gpm.predict(whole, table).orderBy("cand_id").toPandas()
    assert np.allclose(got["mean"], exact[0] * whole.y_std + whole.y_mean, atol=1e-6)
    assert np.allclose(got["std"], np.sqrt(exact[1]) * whole.y_std, atol=1e-6)
    cut = gpm.fit_gp(df, ["a", "b"], "y", expert_size=60)
    assert len(cut.tree.levels) >= 1 and cut.regions.count() > 4 and np.allclose(cut.theta, whole.theta)
    near = gpm.predict(cut, table).orderBy("cand_id").toPandas()
    assert np.sqrt(np.mean((near["mean"] - got["mean"]) ** 2)) < 0.05 * np.std(y)


def test_lengthscales_for_one_and_for_twenty_experts(wave):
    _, _, df = wave
    one = gpm.fit_gp(df, ["a", "b"], "y", fit_rows=300)
    many = gpm.fit_gp(df, ["a", "b"], "y", fit_rows=15)
    assert np.abs(np.log(one.lengthscales / many.lengthscales)).max() < np.log(2.5)
    assert (one.lengthscales[0] < one.lengthscales[1]) and (many.lengthscales[0] < many.lengthscales[1])


def test_regions_hold_at_most_their_size_whatever_repeats(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), float(a + b)) for a, b in zip(rng.integers(0, 30, 900), rng.integers(0, 3, 900))]
    rows += [(7.0, 1.0, float(v)) for v in rng.normal(size=450)]              # a third of all rows in one setting
    df = spark.createDataFrame(rows, "a double, b double, y double")
    model = gpm.fit_gp(df, ["a", "b"], "y", expert_size=16)
    sizes = [len(r["Y"]) for r in model.regions.collect()]
    assert max(sizes) <= 16 and sum(sizes) == len({r[:2] for r in rows})
    assert sum(sum(r["N"]) for r in model.regions.collect()) == len(rows)


def test_ard_gp_errors(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, 2.0, 2.0)], "row_id long, a double, y double")
    with pytest.raises(ValueError):
        gpm.run_ard_gp(df, ["a"], "y")


def _params(spark):
    return dsg.build_parameter_space(spark, ["temperature", "pressure", "reaction_time"], {
        "temperature": {"lower": 100, "upper": 300, "type": "continuous"},
        "pressure": {"lower": 1, "upper": 3, "type": "continuous"},
        "reaction_time": {"lower": 60, "upper": 120, "type": "integer", "step": 30}})


def test_single_and_batch_suggestions(spark, averaged):
    p = _params(spark)
    one = opt.run_optimization(p, averaged, "yield", n_suggestions=1, n_candidates=128).toPandas()
    assert list(one.columns) == ["temperature", "pressure", "reaction_time", "predicted_yield", "uncertainty"]
    assert len(one) == 1 and (one["uncertainty"] >= 0).all()
    batch = opt.run_optimization(p, averaged, "selectivity", n_suggestions=3, n_candidates=128).toPandas()
    assert len(batch) == 3
    assert batch["reaction_time"].isin([60.0, 90.0, 120.0]).all()
    assert batch["temperature"].between(100, 300).all()
    with pytest.raises(ValueError):
        opt.run_optimization(p, averaged, "yield", n_suggestions=0)


def test_pareto_suggestions(spark, averaged):
    sug, front = opt.run_pareto_optimization(_params(spark), averaged, ["yield", "selectivity"],
                                             n_suggestions=2, n_candidates=64)
    s = sug.toPandas()
    assert len(s) == 2 and {"predicted_yield", "uncertainty_selectivity"} <= set(s.columns)
    assert front.count() == 10     # FIXTURES: every averaged row but the (0.62, 0.88) one


def test_pareto_front_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    for m in (2, 3):
        Y = np.round(rng.random((300, m)) * 20) / 2     # ties on purpose
        df = spark.createDataFrame([(i, *map(float, Y[i])) for i in range(300)],
                                   "id long, " + ", ".join(f"o{j} double" for j in range(m)))
        got = sorted(r["id"] for r in par.pareto_front(df, [f"o{j}" for j in range(m)]).collect())
        want = sorted(np.flatnonzero(par.pareto_mask_numpy(Y)).tolist())
        assert got == want


def test_pareto_fixture_and_hypervolume(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 4.0), (1.0, 4.0), (2.0, 4.0)], "a double, b double")
    front = sorted(tuple(r) for r in par.pareto_front(df, ["a", "b"]).collect())
    assert front == [(1.0, 5.0), (2.0, 4.0), (2.0, 4.0)]
    hv = par.hypervolume_2d(df, ["a", "b"], [0.0, 0.0]).first()["hypervolume"]
    assert hv == pytest.approx(2 * 4 + 1 * 1)


def test_a_batch_is_scored_by_the_exact_joint_posterior(wave, spark):
    X, y, df = wave
    few = df.where("cand_id < 40")
    model = gpm.fit_gp(few, ["a", "b"], "y")
    rng = np.random.default_rng(4)
    asked = rng.random((60, 2))
    cands = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(asked)], "cand_id long, a double, b double")
    scored = gpm.predict(model, cands).join(cands, "cand_id").cache()
    best = float(y[:40].max())
    batch = opt.select_batch(model, scored, best, 4, seed=3)
    assert batch.qei >= batch.greedy_qei > 0 and len({r["cand_id"] for r in batch.rows}) == 4
    # the same batch by the dense posterior of the model
    ls, os_, noise, _ = gpm._unpack(model.theta, 2)
    T, C = model.scale_x(X[:40].copy()), model.scale_x(np.array([[r["a"], r["b"]] for r in batch.rows]))
    K = os_ * gpm.matern52(T, T, ls)[0] + (noise + gpm.JITTER) * np.eye(40)
    Kc = os_ * gpm.matern52(C, T, ls)[0]
    cov = (os_ * gpm.matern52(C, C, ls)[0] - Kc @ np.linalg.solve(K, Kc.T)) * model.y_std ** 2
    z = np.random.default_rng(3).standard_normal((opt.DRAWS, 4))
    draws = np.array([r["mean"] for r in batch.rows]) + z @ np.linalg.cholesky(cov + 1e-9 * np.diag(np.diag(cov))).T
    assert np.allclose(draws, batch.draws, atol=1e-5)
    assert batch.qei == pytest.approx(np.maximum(draws.max(1) - best, 0).mean(), rel=1e-5)
    again = batch.table(spark).groupBy("draw").max("value").toPandas()["max(value)"]
    assert np.maximum(again - best, 0).mean() == pytest.approx(batch.qei)
    # no single candidate in any slot would have scored better than the pick, the others given
    scorer = opt.JointScorer(model, gpm.Correlation(model), z, best)
    held = scorer.held(batch.rows[:3], [0, 1, 2])
    scores = scorer.score(held, scored.toPandas(), 3)
    assert scores.max() >= batch.qei - 1e-9


def test_small_regions_suggest_the_same(wave, spark):
    _, _, df = wave
    params = dsg.build_parameter_space(spark, ["a", "b"], {"a": {"lower": 0, "upper": 1}, "b": {"lower": 0, "upper": 1}})
    one, many = (opt.run_optimization(params, df, "y", n_suggestions=1, n_candidates=200, expert_size=n).first() for n in (512, 100))
    assert abs(one["a"] - many["a"]) < 0.1 and abs(one["b"] - many["b"]) < 0.1
    assert one["predicted_y"] == pytest.approx(many["predicted_y"], abs=0.05)


def test_snap_and_lhs(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(65.0,), (119.0,), (70.0,), (59.0,)], "v double")
    got = [r[0] for r in df.select(dsg.snap_to_grid(F.col("v"), 60, 120, 10)).collect()]
    assert got == [60.0, 120.0, 70.0, 60.0]
    lhs = dsg.latin_hypercube(spark, 10, [("x", 0.0, 1.0), ("y", 5.0, 6.0)], seed=1).toPandas()
    assert len(lhs) == 10
    assert sorted(np.floor(lhs["x"] * 10).astype(int)) == list(range(10))
    assert sorted(np.floor((lhs["y"] - 5) * 10).astype(int)) == list(range(10))


def test_mixed_design_is_balanced_and_linear(spark):
    names = [f"o{i}" for i in range(10)]
    bounds = {n: {"type": "integer", "lower": 0, "upper": 99} for n in names}
    bounds |= {"c": {"type": "categorical", "values": [0, 1, 2]}, "x": {"lower": -1, "upper": 1}}
    got = dsg.mixed_design(spark, dsg.build_parameter_space(spark, [*names, "c", "x"], bounds), 500, seed=2).toPandas()
    assert len(got) == 500
    for n in names:
        assert (got[n].value_counts() == 5).all() and got[n].nunique() == 100
    assert sorted(got["c"].value_counts()) == [166, 167, 167]
    assert sorted(np.floor((got["x"] + 1) / 2 * 500 - 1e-9).astype(int).clip(0)) == pytest.approx(list(range(500)), abs=1)
