"""Headers per workbook, dotted column names, resampled rows, objective points, stable GP experts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sifter.operators import bootstrap as bst
from sifter.operators import correlate as cor
from sifter.operators import gp as gpm
from sifter.operators import plotdata as pld
from sifter.plans.screen import screen
from sifter.sources import files as src
from tests.test_sources_replicates import _xlsx


def test_workbooks_with_differently_ordered_columns(spark, tmp_path):
    _xlsx(str(tmp_path / "a.xlsx"), [["t", "p"], [1, 10], [2, 20]])
    _xlsx(str(tmp_path / "b.xlsx"), [["p", "t", "extra"], [30, 3, "x"]])
    rows = {tuple(r) for r in src.read_xlsx(spark, str(tmp_path)).select("t", "p", "extra").collect()}
    assert rows == {(1, 10, None), (2, 20, None), (3, 30, "x")}


def test_repeated_header_gets_a_number(spark, tmp_path):
    _xlsx(str(tmp_path / "a.xlsx"), [["t", "t"], [1, 2]])
    df = src.read_xlsx(spark, str(tmp_path / "a.xlsx"))
    assert df.columns == ["t", "t.1"]
    assert tuple(df.first()) == (1, 2)


def test_csv_headers_with_dots_and_brackets(spark, tmp_path):
    path = tmp_path / "runs.csv"
    path.write_text("Temp. (C),a`b,yield.pct\n10,NA,0.5\n20,x,0.75\n")
    df = src.load_file(spark, str(path))
    assert df.columns == ["Temp. (C)", "a`b", "yield.pct"]
    assert sorted(tuple(r) for r in df.collect()) == [(10, None, 0.5), (20, "x", 0.75)]


def test_unreadable_ending_and_missing_file(spark, tmp_path):
    bad = tmp_path / "x.json"
    bad.write_text("{}")
    with pytest.raises(ValueError, match="Unsupported file extension"):
        src.load_file(spark, str(bad))
    with pytest.raises(FileNotFoundError):
        src.load_file(spark, str(tmp_path / "none.csv"))


def _runs(spark, n=400):
    x = F.col("row_id")
    return spark.range(n).withColumnRenamed("id", "row_id").select(
        "row_id", (x % 7).cast("double").alias("a"), (x % 11).cast("double").alias("c"),
        ((x % 7) * 3.0 + (x % 11) * 0.2).alias("y"))


def test_resampled_rows_are_the_weighted_rows(spark):
    df = _runs(spark)
    copies = bst.resampled(df, 3, seed=5)
    assert copies.select("row_id").distinct().count() == copies.count()
    weights = bst.replicate_rows(df, 4, seed=5).where("b = 3")
    assert copies.count() == weights.agg(F.sum("_w")).first()[0]
    assert copies.agg(F.sum("y")).first()[0] == pytest.approx(weights.agg(F.sum(F.col("y") * F.col("_w"))).first()[0])


def test_refit_on_resampled_rows(spark):
    def method(d):
        return cor.run_correlations(d, ["a", "c"], "y").where("target = 'y'")
    ranks = bst.bootstrap_refit(_runs(spark), method, n_bootstrap=2, weighted=False)
    assert {(r["feature"], r["rank"]) for r in ranks.collect()} == {("a", 1), ("c", 2)}


def test_refit_skips_degenerate_fits_only(spark):
    def degenerate(d):
        raise ValueError("no variance")

    def broken(d):
        raise KeyError("a bug")
    assert bst.bootstrap_refit(_runs(spark), degenerate, n_bootstrap=2, weighted=False).count() == 0
    with pytest.raises(KeyError):
        bst.bootstrap_refit(_runs(spark), broken, n_bootstrap=1, weighted=False)


def test_objective_points(spark):
    front = spark.createDataFrame([(2.0, 1.0), (1.0, 3.0), (None, 1.0)], "x double, y double")
    sug = spark.createDataFrame([(5.0, 5.0, "new", 2), (4.0, 4.0, "old", 1)], "x double, y double, k string, n int")
    got = [tuple(r) for r in pld.objective_points(front, sug, "x", "y", order_by=["n"], category="k").orderBy("kind", "seq").collect()]
    assert got == [("front", 0, None, 1.0, 3.0, None), ("front", 1, None, 2.0, 1.0, None),
                   ("suggestion", 0, "#1", 4.0, 4.0, "old"), ("suggestion", 1, "#2", 5.0, 5.0, "new")]
    assert pld.objective_points(None, sug, "x", "y").where("kind = 'front'").isEmpty()


def test_experts_without_a_key_do_not_depend_on_partitions(spark):
    df = _runs(spark).drop("row_id")
    args = (["a", "c"], "y", [0.0, 0.0], [6.0, 10.0], [False, False], 0.0, 1.0)

    def content(d):
        points = gpm.merged_points(d, *args).selectExpr("*", "pmod(xxhash64(x, 42), 4) as expert")
        return {(r["expert"], tuple(map(tuple, r["X"])), tuple(r["N"])) for r in gpm.grouped_points(points, "expert").collect()}
    assert content(df.repartition(3)) == content(df.repartition(5, "a"))


def test_screen_with_bootstrap(spark):
    res = screen(_runs(spark), ["a", "c"], ["y"], methods=["lasso", "pca", "correlations"], n_bootstrap=2)
    rows = {(r["target"], r["method"], r["feature"]): r for r in res.stability.collect()}
    assert set(rows) == {("y", m, f) for m in ("lasso", "pca", "correlations") for f in ("a", "c")}
    assert all(r["n_success"] == 2 for r in rows.values())
    assert rows["y", "correlations", "a"]["median_rank"] == 1 and rows["y", "lasso", "a"]["median_rank"] == 1
    assert screen(_runs(spark), ["a", "c"], ["y"], methods=["correlations"]).stability is None
