"""Global order without a single-partition window.

``prefix_scan`` computes, for every row, a running SUM or MAX of a column over
all rows that precede it in a global order (optionally restarting per group).
The rows are range-partitioned on the order, each partition scans locally in
Arrow batches, the per-partition totals (one row per partition and group)
give exclusive offsets, and a join adds them back.  The range-partitioned
table is checkpointed so both passes see the same partitions even if an
executor is lost.

Everything order-dependent in the library is built on the same pattern:
``ordered_index`` (dense 0-based row ids / group ids, JVM-only variant), ``average_ranks``
(Spearman, ties get the mean rank) and ``exact_quantiles`` (linear
interpolation, like ``percentile`` but without holding a group in memory).
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sifter.functions.broadcasting import broadcast_if_small
from sifter.session import durable

# A table (or group) of at most this many rows may be ordered by an ordinary
# window / exact ``percentile`` buffer in one task; beyond it the
# range-partitioned scan is used.  Both give identical results.
FAST_ROWS = 1_000_000


def _local_scan(group_cols: list[str], value_col: str, op: str, out_col: str):
    """Per-partition running op of ``value_col`` within groups.

    Adds ``out_col`` (inclusive), ``_excl`` (over strictly earlier rows of the
    same partition and group, NaN when none) and ``_pid``.
    """

    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        carry_key = None
        carry_val = None
        for pdf in batches:
            if pdf.empty:
                continue
            vals = pdf[value_col].to_numpy(dtype="float64")
            if group_cols:
                keys = pd.MultiIndex.from_frame(pdf[group_cols]) if len(group_cols) > 1 \
                    else pd.Index(pdf[group_cols[0]])
                codes, _ = pd.factorize(keys)
                # groups arrive sorted, so equal keys are adjacent
                starts = np.r_[True, codes[1:] != codes[:-1]]
            else:
                starts = np.zeros(len(pdf), dtype=bool)
                starts[0] = True
            seg = np.cumsum(starts) - 1
            if op == "sum":
                cs = np.cumsum(vals)
                base = np.r_[0.0, cs][np.flatnonzero(starts)]
                run_vals = cs - base[seg]
            else:
                run_vals = pd.Series(vals).groupby(seg).cummax().to_numpy()
            first_key = tuple(pdf[group_cols].iloc[0]) if group_cols else ()
            continued = carry_key is not None and first_key == carry_key
            if continued:
                first_seg = seg == 0
                if op == "sum":
                    run_vals[first_seg] += carry_val
                else:
                    run_vals[first_seg] = np.maximum(run_vals[first_seg], carry_val)
            if op == "sum":
                excl = run_vals - vals
            else:
                excl = np.r_[np.nan, run_vals[:-1]]
                excl[starts] = np.nan
                if continued:
                    excl[0] = carry_val
            carry_key = tuple(pdf[group_cols].iloc[-1]) if group_cols else ()
            carry_val = run_vals[-1]
            out = pdf.copy()
            out[out_col] = run_vals
            out["_excl"] = excl
            out["_pid"] = np.int32(pid)
            yield out

    return run


def prefix_scan(
    df: DataFrame,
    order_cols: Sequence[str],
    value_col: str,
    op: str = "sum",
    group_cols: Sequence[str] = (),
    out_col: str = "_scan",
    inclusive: bool = True,
    num_partitions: int | None = None,
) -> DataFrame:
    """Running ``op`` (sum | max) of ``value_col`` in ``order_cols`` order.

    Restarts for every distinct ``group_cols`` value.  ``inclusive=False``
    gives the value over strictly earlier rows (NULL/0 for the first).  Rows
    that tie on ``group_cols + order_cols`` are scanned in an arbitrary but
    fixed order, so callers pass unique keys when ties matter.
    """
    if op not in ("sum", "max"):
        raise ValueError(f"op must be 'sum' or 'max'; got {op!r}")
    group_cols = list(group_cols)
    order_cols = list(order_cols)
    keys = group_cols + order_cols
    # without an explicit count AQE may coalesce adjacent ranges to fit the
    # data; partition ids stay in key order, which is all the scan needs
    ranged = (df.repartitionByRange(num_partitions, *keys) if num_partitions
              else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    schema = T.StructType(
        ranged.schema.fields
        + [T.StructField(out_col, T.DoubleType()), T.StructField("_excl", T.DoubleType()),
           T.StructField("_pid", T.IntegerType())]
    )
    local = durable(ranged.mapInPandas(_local_scan(group_cols, value_col, op, out_col), schema))

    # last inclusive value of each (partition, group) block = its total / max
    blocks = local.groupBy("_pid", *group_cols).agg(
        F.max_by(F.col(out_col), F.struct(*order_cols)).alias("_blk"))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off_expr = F.sum("_blk").over(w) if op == "sum" else F.max("_blk").over(w)
    offsets = blocks.withColumn("_off", off_expr).drop("_blk")
    offsets = broadcast_if_small(offsets)
    joined = local.join(offsets, on=["_pid", *group_cols], how="left")
    col = out_col if inclusive else "_excl"
    local_val = F.when(~F.isnan(F.col(col)), F.col(col))
    if op == "sum":
        res = local_val + F.coalesce(F.col("_off"), F.lit(0.0))
    else:
        res = F.greatest(local_val, F.col("_off"))
    return joined.withColumn(out_col, res).drop("_off", "_pid", "_excl")


def ordered_index(df: DataFrame, order_cols: Sequence[str], name: str = "row_id",
                  group_cols: Sequence[str] = (), keep: Sequence[str] | None = None) -> DataFrame:
    """Dense 0-based position of each row in ``order_cols`` order (per group).

    JVM only: after the range exchange and the sort, each row carries its
    partition id and its position inside the partition (the low bits of
    ``monotonically_increasing_id``); the table is checkpointed, the counts
    of every (partition, group) block give the offsets, a join adds them.
    Ties on the keys are numbered in an arbitrary but fixed order.  ``keep``: the columns that are checkpointed and
    returned with the index (default all).
    """
    group_cols = list(group_cols)
    keys = group_cols + list(order_cols)
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)   # AQE may coalesce ranges
    tagged = durable(ranged.select(*[F.col(f"`{c}`") for c in (df.columns if keep is None else dict.fromkeys([*group_cols, *keep]))])
                     .withColumn("_oi_pid", F.spark_partition_id())
                     .withColumn("_oi_loc", F.monotonically_increasing_id()
                                 - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    blocks = durable(tagged.groupBy("_oi_pid", *group_cols).agg(F.count(F.lit(1)).alias("_oi_cnt"),      # sized, then joined
                                                             F.min("_oi_loc").alias("_oi_first")))
    w = Window.partitionBy(*group_cols).orderBy("_oi_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_oi_off", F.coalesce(F.sum("_oi_cnt").over(w), F.lit(0))).drop("_oi_cnt")
    offsets = broadcast_if_small(offsets)
    out = tagged.join(offsets, on=["_oi_pid", *group_cols])
    return out.withColumn(name, (F.col("_oi_off") + F.col("_oi_loc") - F.col("_oi_first")).cast("long")) \
        .drop("_oi_pid", "_oi_loc", "_oi_first", "_oi_off")


def average_ranks(values: DataFrame, group_cols: Sequence[str], value_col: str,
                  rank_col: str = "avg_rank", count_col: str | None = None) -> DataFrame:
    """Average (tie-mean) 1-based ranks of ``value_col`` within groups.

    Returns one row per distinct ``(group, value)`` with its rank (and its number
    of rows as ``count_col``, if given); join it back to the rows.  NULL values are not ranked.
    """
    counts = (values.where(F.col(value_col).isNotNull())
              .groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).cast("double").alias("_cnt")))
    counts = durable(counts)
    sizes = counts.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_gn"))
    if (sizes.agg(F.max("_gn")).first()[0] or 0) <= FAST_ROWS:
        # size-checked: every group window holds at most FAST_ROWS values
        w = Window.partitionBy(*group_cols).orderBy(value_col).rowsBetween(Window.unboundedPreceding, -1)
        scanned = counts.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0.0)))
    else:
        scanned = prefix_scan(counts, [value_col], "_cnt", "sum", group_cols,
                              out_col="_before", inclusive=False)
    return scanned.select(*group_cols, value_col,
                          (F.col("_before") + (F.col("_cnt") + 1.0) / 2.0).alias(rank_col),
                          *([F.col("_cnt").alias(count_col)] if count_col else []))


def prefix_sums(df: DataFrame, order_col: str, value_cols: Sequence[str], prefix: str = "_before_") -> DataFrame:
    """Sums ``<prefix><v>`` of several columns over all rows before a row (``order_col`` is unique), from one sort."""
    value_cols = list(value_cols)
    before = [f"{prefix}{v}" for v in value_cols]
    ranged = df.repartitionByRange(order_col).sortWithinPartitions(order_col)
    schema = T.StructType(ranged.schema.fields + [T.StructField(c, T.DoubleType()) for c in before] + [T.StructField("_pid", T.IntegerType())])

    def run(batches):
        from pyspark import TaskContext

        pid, total = TaskContext.get().partitionId(), 0.0
        for b in batches:       # Arrow: pandas would turn a NaN into a null
            if not b.num_rows:
                continue
            own = np.column_stack([b.column(v).to_numpy() for v in value_cols])
            upto = total + np.cumsum(own, axis=0)
            total = upto[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x) for x in (upto - own).T], pa.array(np.full(b.num_rows, pid, np.int32))],
                                             [f.name for f in schema.fields])

    local = durable(ranged.mapInArrow(run, schema))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)       # a row a partition
    blocks = local.groupBy("_pid").agg(*[F.sum(v).alias(f"_o{i}") for i, v in enumerate(value_cols)])
    offsets = blocks.select("_pid", *[F.coalesce(F.sum(f"_o{i}").over(w), F.lit(0.0)).alias(f"_o{i}") for i in range(len(value_cols))])
    joined = local.join(F.broadcast(offsets), "_pid")
    return joined.select(*df.columns, *[(F.col(c) + F.col(f"_o{i}")).alias(c) for i, c in enumerate(before)])


def exact_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str,
                    probs: Sequence[float], prefix: str = "q", count_col: str | None = None) -> DataFrame:
    """Linear-interpolated quantiles per group (numpy/pandas 'linear').

    Same result as ``percentile(value, p)`` but the values of a large group
    are spread over range partitions instead of one aggregation buffer.
    Returns ``group_cols, n, <prefix>_<i>`` for each prob (in order).  A row stands for ``count_col``
    equal values (default 1).
    """
    group_cols = list(group_cols)
    times = F.col(count_col) if count_col else F.lit(1)
    vals = df.where(F.col(value_col).isNotNull())
    sizes = vals.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_gn"))
    biggest = sizes.agg(F.max("_gn")).first()[0] or 0
    if biggest <= FAST_ROWS:
        # size-checked: no group buffer exceeds FAST_ROWS values
        q = vals.groupBy(*group_cols).agg(
            F.sum(times).alias("n"),
            F.percentile(F.col(value_col).cast("double"), F.array(*[F.lit(float(p)) for p in probs]), times).alias("_q"))
        return q.select(*group_cols, F.col("n").cast("long"),
                        *[F.col("_q")[i].alias(f"{prefix}_{i}") for i in range(len(probs))])
    counts = vals.groupBy(*group_cols, value_col).agg(F.sum(times).cast("double").alias("_cnt"))
    scanned = prefix_scan(counts, [value_col], "_cnt", "sum", group_cols,
                          out_col="_before", inclusive=False)
    totals = counts.groupBy(*group_cols).agg(F.sum("_cnt").alias("_n"))
    if group_cols:
        scanned = scanned.join(totals, on=group_cols)
    else:  # one-row totals: equi-join on a constant key
        scanned = scanned.withColumn("_k", F.lit(1)).join(
            F.broadcast(totals.withColumn("_k", F.lit(1))), "_k").drop("_k")
    # positions of the lower/upper neighbour for every prob
    picks = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        picks.append(F.struct(F.lit(i).alias("qi"), F.floor(pos).alias("lo"),
                              F.ceil(pos).alias("hi"), pos.alias("pos")))
    exploded = scanned.withColumn("_pk", F.explode(F.array(*picks)))
    hit_lo = (F.col("_before") <= F.col("_pk.lo")) & (F.col("_pk.lo") < F.col("_before") + F.col("_cnt"))
    hit_hi = (F.col("_before") <= F.col("_pk.hi")) & (F.col("_pk.hi") < F.col("_before") + F.col("_cnt"))
    sel = exploded.where(hit_lo | hit_hi).select(
        *group_cols, "_n", F.col("_pk.qi").alias("qi"), F.col("_pk.pos").alias("pos"),
        F.col("_pk.lo").alias("lo"),
        F.when(hit_lo, F.col(value_col)).alias("v_lo"),
        F.when(hit_hi, F.col(value_col)).alias("v_hi"))
    per_q = sel.groupBy(*group_cols, "_n", "qi").agg(
        F.max("pos").alias("pos"), F.max("lo").alias("lo"),
        F.max("v_lo").alias("v_lo"), F.max("v_hi").alias("v_hi"))
    val = F.col("v_lo") + (F.col("pos") - F.col("lo")) * (F.col("v_hi") - F.col("v_lo"))
    out = per_q.groupBy(*group_cols, "_n").agg(
        *[F.max(F.when(F.col("qi") == i, val)).alias(f"{prefix}_{i}") for i in range(len(probs))])
    return out.withColumnRenamed("_n", "n").withColumn("n", F.col("n").cast("long"))
