"""Connected components of a link table, as alternating star contractions.

Every round is two grouped minima and two equi-joins over the link table; the
table is stored between rounds, so a lost executor only repeats one round.
Nothing is collected: the driver sees one row of totals per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.functions.broadcasting import shuffled_beyond
from sifter.llm.common import stored


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(e: DataFrame, n: int) -> DataFrame:
    """Larger neighbours of u are hooked to the smallest node near u; ``e`` has ``n`` links."""
    both = _both_ways(e)
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return (both.where("v > u").join(shuffled_beyond(low, 2 * n), "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())


def _small_star(e: DataFrame, n: int) -> DataFrame:
    """u and its smaller neighbours are hooked to the smallest of them (here u > v always); at most ``n`` links."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    hooked = e.join(shuffled_beyond(low, n), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _totals(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) longs, either order -> (node, component), component = smallest node.

    Only nodes with a link appear; self-links, nulls and repeats are ignored.  An empty table gives
    an empty result.  Ends when a round leaves the links as they were (then every node but the
    smallest of its component points at that smallest one).
    """
    e = (links.where("u is not null and v is not null and u <> v")
         .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    e = stored(e, "links")
    before = _totals(e)
    while before[0]:
        e = stored(_small_star(_large_star(e, before[0]), before[0]), "links")
        after = _totals(e)
        if after == before:
            break
        before = after
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
