"""Replicates fitted in the same passes: the weighted correlations are those of the resampled rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sifter.functions.ordering import ordered_index, prefix_sums
from sifter.operators import bootstrap as bst
from sifter.operators import correlate as cor
from sifter.plans import catalog

FEATS = ["a", "b", "m"]


def _runs(spark, n=400):
    """Ties, nulls, a constant, some NaNs, negative zero and a nearly distinct column."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(n):
        a = float(rng.integers(0, 9)) * (-1.0 if i % 50 == 0 else 1.0)
        b = float(rng.normal())
        y = a * 0.4 + b + float(rng.normal())
        rows.append((i * 7, a, None if i % 13 == 0 else b, 0.1, float("nan") if i in (5, 6, 7, 8) else float(i % 17), None if i % 31 == 0 else y))
    return spark.createDataFrame(rows, "row_id long, a double, b double, k double, m double, y double")


def _both_ways(df, feats, n=3):
    slow = {}
    for b in range(n):
        for r in cor.run_correlations(bst.resampled(df, b, 42), feats, "y").collect():
            slow[b, r["feature"]] = r
    drawn, names = bst.weighted_rows(df, range(n), 42)
    fast = {(r["b"], r["feature"]): r for r in cor.run_correlations(drawn, feats, "y", weight_cols=names).collect()}
    return slow, fast


@pytest.mark.parametrize("limit", [64 << 20, 2000, 0])
def test_weighted_correlations_are_those_of_the_copies(spark, monkeypatch, limit):
    monkeypatch.setattr(cor, "RANK_BYTES", limit)       # looked up, some joined, all joined
    slow, fast = _both_ways(_runs(spark), FEATS)
    assert slow.keys() == fast.keys() and len(fast) == 9
    for key, want in slow.items():
        got = fast[key]
        assert (got["n"], got["rank"], got["target"]) == (want["n"], want["rank"], "y")
        for c in ("pearson_r", "spearman_r", "pearson_p", "spearman_p"):
            assert (got[c] is None) == (want[c] is None), (key, c)
            assert want[c] is None or got[c] == pytest.approx(want[c], abs=1e-9), (key, c)
    assert fast[0, "m"]["pearson_r"] is None and fast[0, "m"]["spearman_r"] is not None


def test_constant_columns_have_no_correlation(spark):
    for df in (_runs(spark), _runs(spark).fillna(0.5).where("not isnan(m)")):
        drawn, names = bst.weighted_rows(df, range(3), 42)
        got = cor.run_correlations(drawn, ["k", "a"], "y", weight_cols=names).where("feature = 'k'").collect()
        assert [(r["pearson_r"], r["spearman_r"], r["rank"]) for r in got] == [(None, None, 2)] * 3     # not what rounding leaves


def test_complete_columns_too(spark):
    df = _runs(spark).fillna(0.5).where("not isnan(m)")
    slow, fast = _both_ways(df, FEATS)
    for key, want in slow.items():
        for c in ("pearson_r", "spearman_r"):
            assert (fast[key][c] is None) == (want[c] is None) and (want[c] is None or fast[key][c] == pytest.approx(want[c], abs=1e-9))


def test_refit_together_is_refit_one_by_one(spark, monkeypatch):
    df = _runs(spark, 60)
    one = bst.bootstrap_refit(df, lambda d: cor.run_correlations(d, FEATS, "y"), n_bootstrap=5, weighted=False)
    monkeypatch.setattr(bst, "TOGETHER", 2)
    calls = []
    both = bst.bootstrap_refit(df, lambda d, w: calls.append(w) or cor.run_correlations(d, FEATS, "y", weight_cols=w), n_bootstrap=5, together=True)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, one.collect())) and [len(w) for w in calls] == [2, 2, 1]


def test_replicates_without_rows_are_not_counted(spark):
    df = _runs(spark, 2).withColumn("b", F.col("a"))
    drawn = [b for b in range(30) if bst.resampled(df, b, 42).count()]
    ranks = bst.bootstrap_refit(df, lambda d, w: cor.run_correlations(d, ["a", "b"], "y", weight_cols=w), n_bootstrap=30, together=True)
    assert sorted({r["b"] for r in ranks.collect()}) == drawn and len(drawn) < 30
    empty = bst.bootstrap_refit(df.limit(0), lambda d, w: cor.run_correlations(d, ["a"], "y", weight_cols=w), n_bootstrap=3, together=True)
    assert empty.count() == 0


def test_weights_and_kept_columns(spark):
    df = _runs(spark, 50)
    drawn, names = bst.weighted_rows(df, [1, 6], 9)
    want = {b: {r["row_id"]: r["w"] for r in df.select("row_id", bst.poisson_weight(F.col("row_id"), F.lit(b), 9).alias("w")).collect()} for b in (1, 6)}
    assert all(r[n] == want[b][r["row_id"]] for r in drawn.collect() for b, n in zip((1, 6), names))
    kept = ordered_index(df, ["row_id"], name="at", keep=["a"])
    assert kept.columns == ["a", "at"] and [r["a"] for r in kept.orderBy("at").collect()] == [r["a"] for r in df.orderBy("row_id").collect()]


def test_prefix_sums(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double").alias("v"), (F.col("id") % 5).cast("double").alias("p"), F.lit(1.0).alias("q"))
    rows = df.collect()
    got = {r["v"]: (r["_before_p"], r["_before_q"]) for r in prefix_sums(df.repartition(7), "v", ["p", "q"]).collect()}
    p = q = 0.0
    for r in sorted(rows, key=lambda r: r["v"]):
        assert got[r["v"]] == (p, q)
        p, q = p + r["p"], q + r["q"]


def test_query_reads_its_rows_for_all_replicates_at_once(spark, monkeypatch, tmp_path):
    li = spark.range(300).selectExpr("id as l_orderkey", "id % 7 as l_partkey", "id % 3 as l_suppkey", "cast(1 as int) as l_linenumber", "cast(id % 50 as double) as l_quantity",
                                     "cast(pmod(id * 37, 101) as double) as l_extendedprice", "(id % 11) / 100D as l_discount", "(id % 9) / 100D as l_tax", "timestamp'1995-01-01' as l_shipdate")
    li.write.parquet(str(tmp_path / "lineitem.parquet"))
    calls = []
    real = cor.run_correlations
    monkeypatch.setattr(cor, "run_correlations", lambda df, *a, **k: calls.append(k) or real(df, *a, **k))
    got = {r["feature"]: r for r in catalog.QUERIES["bootstrap_correlations"](spark, str(tmp_path)).collect()}
    assert len(calls) == 1 and len(calls[0]["weight_cols"]) == 5      # before: a call, with a sort and joins of its own, for each replicate
    assert set(got) == set(catalog.LIN_F) and all(r["n_success"] == 5 for r in got.values()) and got["l_extendedprice"]["median_rank"] == 1
