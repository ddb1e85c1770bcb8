"""Broadcasts behind a measured size, and equi-joins whose hot keys are spread.

A side is broadcast only if the bytes of its rows fit ``BROADCAST_BYTES``; Spark's own estimate comes from
file sizes and row widths, so it misses what an ``explode`` multiplies (``shuffled`` keeps such a join a shuffle).
``spread_join`` is the other way: keys with more than 1/HOT_KEYS of the probe
side's rows (so fewer than HOT_KEYS of them, whatever the data) are looked up
in a broadcast of just those rows; all other keys shuffle.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 32 << 20
HOT_KEYS = 256
ROW_OVERHEAD = 24


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows of ``df``: fixed widths by type, other values by their own length."""
    fixed, own = ROW_OVERHEAD, []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)):
            fixed += 16
        else:
            c = F.col(f"`{f.name}`")
            own.append(F.coalesce(F.octet_length(c if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.to_json(F.struct(c))), F.lit(0)) + 16)
    total = F.count(F.lit(1)) * fixed
    for c in own:
        total = total + F.coalesce(F.sum(c), F.lit(0))
    return int(df.agg(total.alias("b")).first()["b"])


def fits(df: DataFrame, limit: int | None = None) -> bool:
    return measured_bytes(df) <= (BROADCAST_BYTES if limit is None else limit)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its measured bytes fit, else as it is (the join shuffles)."""
    return F.broadcast(df) if fits(df) else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` with a hint that its join shuffles, however small Spark takes either side to be."""
    return df.hint("merge")


def shuffled_beyond(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` rows of a few numbers: Spark may broadcast it only if so many fit ``BROADCAST_BYTES``."""
    return df if rows * (ROW_OVERHEAD + 16 * len(df.columns)) <= BROADCAST_BYTES else shuffled(df)


def spread_join(df: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left",
                hot_keys: DataFrame | None = None) -> DataFrame:
    """Join ``df`` with ``lookup`` (unique on ``keys``) so that no key gathers in one task.

    ``how`` is ``left`` or ``inner``; columns of ``lookup`` other than the keys must be new to ``df``.
    ``hot_keys``: the keys with more than 1/HOT_KEYS of the rows, if they are known; else they are counted.
    """
    if hot_keys is None:
        if fits(lookup):
            return df.join(F.broadcast(lookup), list(keys), how)
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_hot_n"))
        total = df.count()
        hot_keys = counts.where(F.col("_hot_n") * HOT_KEYS > total).drop("_hot_n")
    hot = lookup.join(F.broadcast(hot_keys), list(keys), "left_semi").withColumn("_hot", F.lit(True))
    is_hot = df.join(F.broadcast(hot.select(*keys, "_hot")), list(keys), "left")
    with_hot = is_hot.where("_hot").drop("_hot").join(F.broadcast(hot.drop("_hot")), list(keys), "inner")
    cold = is_hot.where("_hot is null").drop("_hot").join(shuffled(lookup), list(keys), how)
    return with_hot.unionByName(cold)
