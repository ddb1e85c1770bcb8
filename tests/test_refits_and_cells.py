"""Draws hashed in bulk, replicates drawn once, ranks without a second count, SHAP values looked up by cell."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sifter.functions import broadcasting
from sifter.functions.draws import resampling_draws
from sifter.functions.ordering import exact_quantiles
from sifter.operators import bootstrap as bst
from sifter.operators import correlate as cor
from sifter.operators import forest as frs
from sifter.operators import plotdata as pld
from sifter.plans import catalog


def _draw(key, b, seed):
    return int(hashlib.md5(f"{key}|{b // 4}|{seed}".encode()).hexdigest()[b % 4 * 8:][:8], 16)


def test_bulk_draws_are_md5():
    keys = [0, 7, 10, 99, 100, 123456, -5, 2 ** 62, *range(990, 1010)]
    for n in (1, 6, 9):
        assert resampling_draws(42, keys, n).tolist() == [[_draw(k, b, 42) for k in keys] for b in range(n)]
    with pytest.raises(ValueError):
        resampling_draws(10 ** 40, [2 ** 62], 4)


def test_replicate_rows_hash_once_a_group(spark):
    df = spark.range(300).select(F.col("id").alias("row_id"), F.lit("x").alias("b2"))
    reps = bst.replicate_rows(df, 6, 42)
    assert reps.columns == ["row_id", "b2", "b", "_w"]
    got = {(r["row_id"], r["b"]): r["_w"] for r in reps.collect()}
    counts = {(k, b): float(np.searchsorted(bst._POISSON1_CDF, _draw(k, b, 42) / 2 ** 32, side="right")) for k in range(300) for b in range(6)}
    assert got == {k: w for k, w in counts.items() if w}
    plan = reps._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and "_group" in plan         # of row and group, not of row and replicate


def test_folds_of_several_parts(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(500, 2))
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(500), "x": X[:, 0], "y": X[:, 1]})).repartition(7)
    got = bst.replicate_moments(df, ["x", "y"], 5, 42, folds=3)
    W = bst.weight_matrix(np.arange(500), 5, 42)
    for b in range(5):
        rows = np.repeat(X, W[:, b].astype(int), axis=0)
        for m, part in zip(got[b], np.array_split(rows, 3), strict=True):
            assert m.n == len(part)
            np.testing.assert_allclose(m.mean, part.mean(axis=0), atol=1e-12)
            np.testing.assert_allclose(m.M / m.n, np.cov(part.T, bias=True), atol=1e-12)


def test_a_refit_draws_its_rows_once(spark):
    df = spark.range(50).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"))
    seen = []

    def method(rows, weight=None):
        seen.append(rows)
        assert rows.storageLevel.useMemory or rows.storageLevel.useDisk
        if len(seen) == 2:
            raise ValueError("a replicate that cannot be fitted")
        return spark.createDataFrame([("x", 1)], "feature string, rank long")

    for weighted in (True, False):
        seen.clear()
        assert {r["b"] for r in bst.bootstrap_refit(df, method, 3, weighted=weighted).collect()} == {0, 2}
        assert not any(rows.storageLevel.useMemory or rows.storageLevel.useDisk for rows in seen)


def test_shuffled_ranks_are_not_counted_again(spark, monkeypatch):
    values = [5.0] * 400 + [float(i % 90) for i in range(300)] + [None] * 3
    df = spark.createDataFrame([(i, v, None if i == 1 else float(i)) for i, v in enumerate(values)], "k long, x double, y double").repartition(4)
    monkeypatch.setattr(cor, "RANK_BYTES", 0)

    def counted(*_):
        raise AssertionError("the rows are counted again")
    monkeypatch.setattr(broadcasting, "fits", counted)
    got = cor.with_ranks(df, ["x", "y"]).orderBy("k").toPandas()
    want = pd.Series(values, dtype=float).rank()
    np.testing.assert_array_equal(got["rk_x"], want)
    np.testing.assert_array_equal(got["rk_y"], got["y"].rank())


def test_quantiles_of_counted_values(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 4.0, 2), ("a", None, 5), ("b", 2.0, 1)], "g string, v double, n long")
    for limit in (10, 0):
        monkeypatch.setattr("sifter.functions.ordering.FAST_ROWS", limit)
        got = {r["g"]: (r["n"], r["q_0"], r["q_1"]) for r in exact_quantiles(df, ["g"], "v", [0.25, 0.75], count_col="n").collect()}
        assert got == {"a": (5, 1.0, 4.0), "b": (1, 2.0, 2.0)}


def test_shap_values_come_from_their_cells(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, z = rng.integers(0, 5, 400) / 4, rng.integers(0, 3, 400) / 2
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(400), "x": x, "z": z, "y": 3 * x - z}))
    model = frs.fit_forest(df, ["x", "z"], "y", 5, 3)
    nodes = frs.forest_nodes(model)
    monkeypatch.setattr(frs, "fit_forest", lambda *a, **k: model)
    got = frs.run_shap(df, ["x", "z"], "y", n_estimators=5, max_depth=3)
    assert "cell" in got.values._jdf.queryExecution().optimizedPlan().toString()
    wide = got.values.groupBy("row_id").pivot("feature", ["x", "z"]).agg(F.first("shap_value")).orderBy("row_id").toPandas()
    want = frs.shap_batch(np.column_stack([x, z]), [frs.tree_tables(g) for _, g in nodes.groupby("treeID")], 2)
    np.testing.assert_allclose(wide[["x", "z"]].to_numpy(), want, atol=1e-12)
    imp = {r["feature"]: r["mean_abs_shap"] for r in got.feature_importance.collect()}
    np.testing.assert_allclose([imp["x"], imp["z"]], np.abs(want).mean(axis=0))


def test_beeswarm_does_not_store_its_points(spark, monkeypatch):
    stored = []
    real = pld.durable
    monkeypatch.setattr(pld, "durable", lambda df: stored.append(set(df.columns)) or real(df))
    rows = [(i, f, float(i % 4) * k, float(i)) for i in range(40) for f, k in (("a", 1), ("b", 3))]
    pts = pld.beeswarm(spark.createDataFrame(rows, "row_id long, feature string, shap_value double, feature_value double"))
    assert stored and not any("row_id" in cols for cols in stored)
    got = pts.collect()
    assert len(got) == 80 and all(0 <= r["value_norm"] <= 1 and abs(r["jitter"]) <= 0.35 for r in got)
    assert {r["feature"]: r["feature_rank"] for r in got} == {"b": 1, "a": 2}
    assert math.isclose(max(r["shap_value"] for r in got), 9.0)


def test_beeswarm_query_hands_the_values_on(monkeypatch):
    values = object()
    monkeypatch.setattr(catalog, "_shap", lambda spark, sf: type("R", (), {"values": values}))
    monkeypatch.setattr(catalog.pld, "beeswarm", lambda df, max_display: df)
    assert catalog.q_beeswarm_points(None, None) is values
