"""Joins beyond the broadcast bound give the same rows, hot keys included."""

from pyspark.sql import functions as F

from sifter.functions import broadcasting
from sifter.functions.draws import uniform, uniform_sql
from sifter.operators.correlate import with_ranks
from sifter.operators.replicates import iqr_outliers


def _hot(spark):
    """A third of all rows on one condition, the rest spread; some nulls."""
    return spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).cast("double").alias("a"),
                                    F.when(F.col("id") % 97 != 0, F.pmod(F.xxhash64("id"), F.lit(40))).cast("double").alias("y"))


def test_spread_join_equals_plain_join(spark, monkeypatch):
    df = _hot(spark)
    lookup = df.groupBy("a").agg(F.count("*").alias("n"))
    want = sorted(map(tuple, df.join(lookup, "a").select("row_id", "n").collect()))
    for limit in (broadcasting.BROADCAST_BYTES, 0):
        monkeypatch.setattr(broadcasting, "BROADCAST_BYTES", limit)
        for how in ("inner", "left"):
            assert sorted(map(tuple, broadcasting.spread_join(df, lookup, ["a"], how).select("row_id", "n").collect())) == want


def test_ranks_and_fences_beyond_the_bound(spark, monkeypatch):
    df = _hot(spark)
    ranks = sorted(map(str, with_ranks(df, ["a", "y"]).collect()))
    out = sorted(r["row_id"] for r in iqr_outliers(df, ["a"], ["y"], k=0.2).collect())
    monkeypatch.setattr(broadcasting, "BROADCAST_BYTES", 0)
    assert sorted(map(str, with_ranks(df, ["a", "y"]).collect())) == ranks
    assert sorted(r["row_id"] for r in iqr_outliers(df, ["a"], ["y"], k=0.2).collect()) == out and out


def test_draws_repeat_in_sql(spark):
    import duckdb
    got = [r[0] for r in spark.range(50).select(uniform(42, F.col("id"), F.col("id") * 2)).collect()]
    want = [r[0] for r in duckdb.sql(f"SELECT {uniform_sql(42, 'id', 'id * 2')} FROM range(50) t(id)").fetchall()]
    assert got == want and len(set(got)) == 50 and 0 <= min(got) and max(got) < 1
