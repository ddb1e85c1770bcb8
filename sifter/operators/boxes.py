"""Boxes of the region that a Pareto front leaves undominated.

All objectives are maximised, and only what lies above a reference point counts.  The region above it that
no front point dominates is cut into disjoint boxes [l, u) (u may be infinite), a stored table.  From the
boxes follow, for any number of objectives and without approximation,

* the front's hypervolume: the box from the reference to the front's maxima, less the boxes' parts in it;
* the hypervolume improvement of a point: the sum over boxes of prod (min(u, y) - l)+;
* its expectation for independent normal objectives: the sum over boxes of prod (g(l) - g(u)), where
  g(t) = E[(Y - t)+] has a closed form.

Two objectives: strips between neighbours, by a range-partitioned prefix scan.  More objectives: the front is
range-partitioned on the last objective and every range is swept downwards on its own, starting from the staircase of
all points above it (the ranges' own staircases are merged per target range, not the points).  Within a
sweep three objectives keep the open strips of the staircase and close those that a new point cuts, so their
boxes grow with the points; more objectives take one slab per point and recurse, which is exact but grows
with a power of the points.  A task holds one range and one staircase.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.functions.ordering import prefix_scan
from sifter.operators.pareto import _signed, undominated
from sifter.session import durable

PACK = 2048         # boxes, and candidates, that meet in one group
_erf = np.frompyfunc(math.erf, 1, 1)


def strips(points: np.ndarray, ref: np.ndarray) -> list[tuple]:
    """Boxes of the undominated region for two objectives."""
    best: dict[float, float] = {}
    for a, b in points:
        if a > ref[0] and b > ref[1]:
            best[a] = max(b, best.get(a, -math.inf))
    out, left, stairs = [], ref[0], []
    for a in sorted(best, reverse=True):            # from the right: keep what rises
        if not stairs or best[a] > stairs[-1][1]:
            stairs.append((a, best[a]))
    for a, b in reversed(stairs):
        out.append(((left, b), (a, math.inf)))
        left = a
    out.append(((left, ref[1]), (math.inf, math.inf)))
    return out


def boxes_of(points: np.ndarray, ref: np.ndarray) -> list[tuple]:
    """Boxes of the undominated region above ``ref``, for any number of objectives."""
    if len(ref) == 2:
        return strips(points, ref)
    points = points[(points > ref).all(axis=1)]
    return sweep(points, np.empty((0, len(ref) - 1)), ref, math.inf, float(ref[-1]))


def sweep(points: np.ndarray, above: np.ndarray, ref: np.ndarray, top: float, bottom: float) -> list[tuple]:
    """Boxes with the last objective in [bottom, top): ``points`` lie there, ``above`` (without it) over it."""
    if len(ref) == 3:
        return _sweep3(points, above, ref, top, bottom)
    out, active, high = [], above, top
    for p in points[np.argsort(-points[:, -1], kind="stable")]:
        if p[-1] < high:
            out += [((*low, p[-1]), (*up, high)) for low, up in boxes_of(active, ref[:-1])]
            high = p[-1]
        active = np.vstack([active, p[None, :-1]])
        active = active[undominated(active)]
    if bottom < high:
        out += [((*low, bottom), (*up, high)) for low, up in boxes_of(active, ref[:-1])]
    return out


def _sweep3(points: np.ndarray, above: np.ndarray, ref: np.ndarray, top: float, bottom: float) -> list[tuple]:
    """Open strips (left, right, height, opened at); a point closes those it cuts."""
    out: list[tuple] = []
    open_ = [(low[0], up[0], low[1], top) for low, up in strips(above, ref[:2])]

    def close(strip, at: float) -> None:
        left, right, height, opened = strip
        if at < opened:
            out.append(((left, height, at), (right, math.inf, opened)))

    for a, b, z in points[np.argsort(-points[:, 2], kind="stable")]:
        # strips run from left to right with falling heights; those cut begin left of a and lie below b
        cut = [i for i, s in enumerate(open_) if s[0] < a and s[2] < b]
        if not cut:
            continue
        first, last = cut[0], cut[-1]
        for s in open_[first:last + 1]:
            close(s, z)
        fresh = [(open_[first][0], a, b, z)]
        if a < open_[last][1]:
            fresh.append((a, open_[last][1], open_[last][2], z))
        open_[first:last + 1] = fresh
    for s in open_:
        close(s, bottom)
    return out


def _frame(found: list[tuple], m: int) -> pd.DataFrame:
    flat = np.array([[*low, *up] for low, up in found], dtype=float).reshape(-1, 2 * m)
    return pd.DataFrame(flat, columns=[f"l{i}" for i in range(m)] + [f"u{i}" for i in range(m)])


def undominated_boxes(front: DataFrame, objectives: Sequence[str], ref: Sequence[float], maximize: Sequence[bool] | None = None) -> DataFrame:
    """Boxes (l0.., u0..) of the region above ``ref`` (in maximised sign) that no row of ``front`` dominates; a stored table."""
    m, ref = len(objectives), np.asarray(ref, dtype=float)
    if m < 2 or len(ref) != m:
        raise ValueError("two objectives or more are needed, and a reference value for each")
    cols, spark = [f"_o{i}" for i in range(m)], front.sparkSession
    points = _signed(front, objectives, maximize).select(*cols).distinct()
    for i in range(m):
        points = points.where(F.col(cols[i]) > float(ref[i]))
    schema = ", ".join([f"l{i} double" for i in range(m)] + [f"u{i} double" for i in range(m)])
    if m == 2:
        stairs = points.groupBy("_o0").agg(F.max("_o1").alias("_o1"))
        right = prefix_scan(stairs.withColumn("_neg", -F.col("_o0")), ["_neg"], "_o1", op="max", out_col="_over", inclusive=False)
        stairs = durable(right.where(F.col("_over").isNull() | (F.col("_o1") > F.col("_over"))).select("_o0", "_o1"))
        placed = prefix_scan(stairs, ["_o0"], "_o0", op="max", out_col="_left", inclusive=False)
        inf = F.lit(math.inf)
        cut = placed.select(F.coalesce("_left", F.lit(float(ref[0]))).alias("l0"), F.col("_o1").alias("l1"), F.col("_o0").alias("u0"), inf.alias("u1"))
        last = stairs.agg(F.coalesce(F.max("_o0"), F.lit(float(ref[0]))).alias("l0")).select("l0", F.lit(float(ref[1])).alias("l1"), inf.alias("u0"), inf.alias("u1"))
        return durable(cut.unionByName(last).select("l0", "l1", "u0", "u1"))

    z = cols[-1]
    ranged = durable(points.repartitionByRange(F.col(z).desc()).withColumn("range", F.spark_partition_id()))
    tops = {r["range"]: r["top"] for r in ranged.groupBy("range").agg(F.max(z).alias("top")).collect()}      # a row a partition
    order = sorted(tops)
    bottoms = {r: tops[s] for r, s in zip(order, order[1:])}
    if not order:
        return spark.createDataFrame(_frame(boxes_of(np.empty((0, m)), ref), m), schema)
    staircase = ranged.groupBy("range").applyInPandas(
        lambda pdf: pdf[undominated(pdf[cols[:-1]].to_numpy(float))], ranged.schema)
    later = F.filter(F.array(*[F.lit(r) for r in order]), lambda r: r > F.col("range"))
    above = staircase.select(*cols[:-1], F.explode(later).alias("range"))

    def run(own: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        r = int((own if len(own) else over)["range"].iloc[0])
        held = over[cols[:-1]].to_numpy(float)
        held = held[undominated(held)] if len(held) else held.reshape(-1, m - 1)
        top = math.inf if r == order[0] else tops[r]
        return _frame(sweep(own[cols].to_numpy(float), held, ref, top, bottoms.get(r, float(ref[-1]))), m)

    return durable(ranged.groupBy("range").cogroup(above.groupBy("range")).applyInPandas(run, schema))


def hypervolume(front: DataFrame, objectives: Sequence[str], ref: Sequence[float], maximize: Sequence[bool] | None = None) -> DataFrame:
    """Volume above ``ref`` (in maximised sign) that the front dominates, for two objectives or more."""
    m = len(objectives)
    boxes = undominated_boxes(front, objectives, ref, maximize)
    tops = _signed(front, objectives, maximize).agg(*[F.greatest(F.max(f"_o{i}"), F.lit(float(r))).alias(f"t{i}") for i, r in enumerate(ref)])
    whole, free = F.lit(1.0), F.lit(1.0)
    for i, r in enumerate(ref):
        whole = whole * (F.col(f"t{i}") - float(r))
        free = free * F.greatest(F.least(f"u{i}", f"t{i}") - F.col(f"l{i}"), F.lit(0.0))
    clipped = boxes.withColumn("_k", F.lit(1)).join(F.broadcast(tops.withColumn("_k", F.lit(1))), "_k")      # one row
    return clipped.agg(F.coalesce(F.first(whole) - F.sum(free), F.lit(0.0)).alias("hypervolume"))


def dominate(boxes: DataFrame, point: Sequence[float]) -> DataFrame:
    """The boxes left when ``point`` joins the front: a box it cuts gives at most m pieces."""
    m = len(point)
    here = F.lit(True)
    for i, p in enumerate(point):
        here = here & (F.col(f"l{i}") < float(p))
    pieces = []
    for d in range(m):      # beyond the point in objective d, under it in those before
        low = [F.greatest(f"l{i}", F.lit(float(point[i]))) if i == d else F.col(f"l{i}") for i in range(m)]
        up = [F.least(f"u{i}", F.lit(float(point[i]))) if i < d else F.col(f"u{i}") for i in range(m)]
        pieces.append(F.struct(*[c.alias(f"l{i}") for i, c in enumerate(low)], *[c.alias(f"u{i}") for i, c in enumerate(up)]))
    whole = F.array(F.struct(*[F.col(c) for c in boxes.columns]))
    full = boxes.select(F.explode(F.when(here, F.array(*pieces)).otherwise(whole)).alias("b")).select("b.*")
    for i in range(m):
        full = full.where(F.col(f"l{i}") < F.col(f"u{i}"))
    return durable(full)


def beyond(t: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """E[(Y - t)+] for normal Y: rows candidates, columns thresholds; 0 at infinity."""
    z = (mean[:, None] - t[None, :]) / std[:, None]
    cdf = 0.5 * (1.0 + _erf(z / math.sqrt(2.0)).astype(float))
    with np.errstate(invalid="ignore"):
        out = (mean[:, None] - t[None, :]) * cdf + std[:, None] * np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    return np.where(np.isinf(t)[None, :], 0.0, out)


def expected_improvement(boxes: DataFrame, candidates: DataFrame, id_col: str = "cand_id") -> DataFrame:
    """(id, ehvi): expected hypervolume improvement of candidates (id, m0, s0, m1, ...) with independent normal objectives.

    Packs of boxes meet packs of candidates; the sums over packs are added up in Spark.
    """
    m = len(boxes.columns) // 2
    n_box, n_cand = max(1, -(-boxes.count() // PACK)), max(1, -(-candidates.count() // PACK))
    left = candidates.select(F.col(id_col).alias("_id"), *[f"{k}{i}" for i in range(m) for k in "ms"],
                             F.pmod(F.xxhash64(id_col), F.lit(n_cand)).alias("cp"), F.explode(F.sequence(F.lit(0), F.lit(n_box - 1))).alias("bp"))
    right = boxes.withColumn("bp", F.pmod(F.xxhash64(*boxes.columns), F.lit(n_box)).cast("int")) \
        .withColumn("cp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_cand - 1).cast("long"))))

    def meet(asked: pd.DataFrame, pack: pd.DataFrame) -> pd.DataFrame:
        total = np.ones((len(asked), len(pack)))
        for i in range(m):
            edges, at = np.unique(pack[[f"l{i}", f"u{i}"]].to_numpy(float), return_inverse=True)
            g = beyond(edges, asked[f"m{i}"].to_numpy(float), asked[f"s{i}"].to_numpy(float))
            at = at.reshape(-1, 2)
            total *= g[:, at[:, 0]] - g[:, at[:, 1]]
        return pd.DataFrame({"_id": asked["_id"].to_numpy(), "v": total.sum(axis=1)})

    parts = left.groupBy("bp", "cp").cogroup(right.groupBy("bp", "cp")).applyInPandas(meet, "_id long, v double")
    return parts.groupBy("_id").agg(F.sum("v").alias("ehvi")).withColumnRenamed("_id", id_col)
