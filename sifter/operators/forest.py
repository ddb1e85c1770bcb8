"""Random-forest importance (M9), SHAP values (M10) and background sample.

The forest is MLlib's ``RandomForestRegressor`` (all features per split,
bootstrap on), so training is distributed; ``featureImportances`` is the
normalised mean decrease in impurity.

SHAP values are path-dependent TreeSHAP (Lundberg et al., 2018), exact for every
row and any depth.  A leaf of value v whose path tests d distinct features, with
cover fractions z_j and the row's satisfied flags o_j, gives feature i

    v (o_i - z_i) * integral over t in (0, 1) of prod_{j != i} (z_j (1 - t) + o_j t)

The integrand is a polynomial of degree d - 1, so Gauss-Legendre quadrature with
ceil(d / 2) points is exact; nothing grows with 2^d.  The fitted forest is saved to
the shared checkpoint folder, its paths are broadcast once, and ``mapInPandas``
evaluates batches in blocks of bounded size.  Rows that lie in one cell of the grid of all thresholds have the
same values, so cells are counted (a grouped sum) and each is explained once: importance adds up |phi|
by the counts, rows look their cell up.
"""

from __future__ import annotations

from typing import NamedTuple, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sifter.functions.broadcasting import spread_join
from sifter.functions.draws import uniform
from sifter.session import durable, scratch_path, shuffle_partitions

MAX_DEPTH_CAP = 30          # MLlib's limit; "unlimited" depth maps to it
BLOCK_ENTRIES = 2_000_000   # rows x leaves x path features held at once


def _assemble(df: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(feature_cols), outputCol="_features",
                           handleInvalid="skip").transform(df)


def fit_forest(df: DataFrame, feature_cols: Sequence[str], target: str, n_estimators: int = 100,
               max_depth: int | None = None, random_state: int = 42, max_bins: int = 32,
               min_instances_per_node: int = 1, weight_col: str | None = None) -> RandomForestRegressionModel:
    if n_estimators < 1:
        raise ValueError(f"n_estimators must be at least 1; got {n_estimators}.")
    depth = MAX_DEPTH_CAP if max_depth is None else int(max_depth)
    if depth > MAX_DEPTH_CAP:
        raise ValueError(f"trees can be at most {MAX_DEPTH_CAP} levels deep; got {depth}")
    data = _assemble(df.where(F.col(target).isNotNull()), feature_cols)
    rf = RandomForestRegressor(featuresCol="_features", labelCol=target, numTrees=n_estimators,
                               maxDepth=depth, featureSubsetStrategy="all", subsamplingRate=1.0,
                               bootstrap=True, seed=random_state, maxBins=max_bins,
                               minInstancesPerNode=min_instances_per_node)
    if weight_col:
        rf = rf.setWeightCol(weight_col)
    return rf.fit(data)


def _ranked(df: DataFrame, score: str) -> DataFrame:
    w = Window.partitionBy("target").orderBy(F.col(score).desc())
    return df.withColumn("rank", F.rank().over(w).cast("long"))


def run_random_forest(df: DataFrame, feature_cols: Sequence[str], target: str,
                      n_estimators: int = 100, max_depth: int | None = None,
                      random_state: int = 42, max_bins: int = 32,
                      weight_col: str | None = None) -> DataFrame:
    """M9: (target, feature, importance, rank); importances sum to 1."""
    if df.isEmpty():
        raise ValueError("X must contain at least one row.")
    model = fit_forest(df, feature_cols, target, n_estimators, max_depth, random_state, max_bins,
                       weight_col=weight_col)
    imp = model.featureImportances.toArray()
    spark = df.sparkSession
    out = spark.createDataFrame([(target, f, float(v)) for f, v in zip(feature_cols, imp)],
                                "target string, feature string, importance double")
    return _ranked(out, "importance")


# --------------------------------------------------------------------------
# TreeSHAP paths
# --------------------------------------------------------------------------

def forest_nodes(model: RandomForestRegressionModel) -> pd.DataFrame:
    """Node table of all trees, via the saved model (as large as the model the driver already holds)."""
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "forest")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(path + "/data").select(
        "treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.prediction").alias("value"),
        F.try_element_at(F.col("nodeData.impurityStats"), F.lit(1)).alias("cover"),
        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.try_element_at(F.col("nodeData.split.leftCategoriesOrThreshold"), F.lit(1)).alias("threshold"))
    return nodes.toPandas().sort_values(["treeID", "id"]).reset_index(drop=True)


class TreePaths(NamedTuple):
    feat: np.ndarray        # internal node -> feature index
    thr: np.ndarray         # internal node -> threshold (x <= thr goes left)
    cond_node: np.ndarray   # (L, D) internal-node position per path condition (-1 pad)
    cond_left: np.ndarray   # (L, D) bool: condition is "goes left"
    cond_slot: np.ndarray   # (L, D) slot (0..d-1) of the condition's feature (-1 pad)
    slot_feat: np.ndarray   # (L, S) feature index of each slot (-1 pad)
    z: np.ndarray           # (L, S) cover fraction of each slot's conditions (1 in pads)
    value: np.ndarray       # (L,) leaf values
    expected: float


def tree_tables(tree: pd.DataFrame) -> TreePaths:
    """Paths of one tree as padded arrays."""
    left, right = ({int(i): int(c) for i, c in zip(tree["id"], tree[side])} for side in ("left", "right"))
    cover, value = ({int(i): float(c) for i, c in zip(tree["id"], tree[c])} for c in ("cover", "value"))
    internal = [i for i in left if left[i] >= 0]
    pos = {nid: k for k, nid in enumerate(internal)}
    feature = {int(i): int(f) for i, f, c in zip(tree["id"], tree["feature"], tree["left"]) if c >= 0}
    thr = {int(i): float(t) for i, t, c in zip(tree["id"], tree["threshold"], tree["left"]) if c >= 0}
    leaves: list[tuple[int, list[tuple[int, bool, float]]]] = []
    todo: list[tuple[int, list]] = [(0, [])]
    while todo:
        nid, path = todo.pop()
        if left[nid] < 0:
            leaves.append((nid, path))
            continue
        for child, goes_left in ((left[nid], True), (right[nid], False)):
            share = cover[child] / cover[nid] if cover[nid] else 0.0
            todo.append((child, [*path, (nid, goes_left, share)]))
    slots = [list(dict.fromkeys(feature[n] for n, _, _ in path)) for _, path in leaves]
    L, D, S = len(leaves), max(1, max(len(p) for _, p in leaves)), max(1, max(map(len, slots)))
    cond_node, cond_slot = -np.ones((L, D), dtype=np.int64), -np.ones((L, D), dtype=np.int64)
    cond_left, slot_feat, z = np.zeros((L, D), dtype=bool), -np.ones((L, S), dtype=np.int64), np.ones((L, S))
    for k, ((_, path), own) in enumerate(zip(leaves, slots)):
        slot_feat[k, :len(own)] = own
        for c, (n, goes_left, share) in enumerate(path):
            at = own.index(feature[n])
            cond_node[k, c], cond_left[k, c], cond_slot[k, c] = pos[n], goes_left, at
            z[k, at] *= share
    values = np.array([value[n] for n, _ in leaves])
    expected = float(values @ np.array([cover[n] for n, _ in leaves]) / cover[0])
    return TreePaths(np.array([feature[i] for i in internal], dtype=np.int64), np.array([thr[i] for i in internal], dtype=float),
                     cond_node, cond_left, cond_slot, slot_feat, z, values, expected)


def _leaf_contributions(o: np.ndarray, t: TreePaths) -> np.ndarray:
    """(rows, L, S) Shapley contributions from the satisfied flags ``o`` of a block of rows."""
    points, weights = np.polynomial.legendre.leggauss((t.z.shape[1] + 1) // 2)
    total = np.zeros(o.shape)
    for x, w in zip((points + 1) / 2, weights / 2):
        factor = t.z * (1 - x) + o * x
        # a factor is 0 only for an unsatisfied slot without cover; its own term then has weight o - z = 0
        safe = np.where(factor > 0, factor, 1.0)
        total += w * (factor.prod(axis=2)[:, :, None] / safe)
    return t.value[:, None] * (o - t.z) * total


def shap_batch(X: np.ndarray, trees: Sequence[TreePaths], p: int) -> np.ndarray:
    """Forest SHAP matrix (rows x p) = mean over trees of tree SHAP values."""
    n = X.shape[0]
    phi = np.zeros((n, p))
    for t in trees:
        L, S = t.slot_feat.shape
        flat = t.slot_feat.reshape(-1)
        order = np.argsort(flat, kind="stable")[np.count_nonzero(flat < 0):]     # slots by feature, pads left out
        if not len(order):
            continue
        features, starts = np.unique(flat[order], return_index=True)
        conds = [(lv, t.cond_node[lv, c], t.cond_left[lv, c], t.cond_slot[lv, c])
                 for c in range(t.cond_node.shape[1]) if len(lv := np.flatnonzero(t.cond_node[:, c] >= 0))]
        rows = max(1, BLOCK_ENTRIES // (L * S))
        for start in range(0, n, rows):
            goes_left = X[start:start + rows][:, t.feat] <= t.thr[None, :]
            o = np.ones((goes_left.shape[0], L, S), dtype=bool)
            for lv, nodes, is_left, slots in conds:
                o[:, lv, slots] &= goes_left[:, nodes] == is_left[None, :]
            out = _leaf_contributions(o, t).reshape(len(o), L * S)
            phi[start:start + rows, features] += np.add.reduceat(out[:, order], starts, axis=1)
    return phi / max(len(trees), 1)


class Cells:
    """The grid that a forest's thresholds cut the inputs into: rows of one cell go the same way in every tree."""

    def __init__(self, trees: Sequence[TreePaths], p: int):
        self.cuts = [np.unique(np.concatenate([t.thr[t.feat == j] for t in trees] or [np.empty(0)])) for j in range(p)]
        # a point inside each cell: its upper cut, or one past the last
        self.inside = [np.append(c, (c[-1] if len(c) else 0.0) + 1.0) for c in self.cuts]

    def of(self, X: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, X[:, j], side="left") for j, c in enumerate(self.cuts)]).astype(np.int32)

    def points(self, cells: np.ndarray) -> np.ndarray:
        return np.column_stack([v[cells[:, j]] for j, v in enumerate(self.inside)])


class SHAPResult(NamedTuple):
    values: DataFrame            # row_id, feature, shap_value, feature_value
    feature_importance: DataFrame  # target, feature, mean_abs_shap, rank
    expected_value: float
    background: DataFrame


def background_sample(df: DataFrame, k: int = 100, seed: int = 42,
                      row_id: str = "row_id") -> DataFrame:
    """min(n, k) rows without replacement (seeded hash order), in row order."""
    return (df.orderBy(uniform(seed, F.col(row_id)), row_id).limit(k)
            .orderBy(row_id))


def run_shap(df: DataFrame, feature_cols: Sequence[str], target: str, row_id: str = "row_id",
             n_estimators: int = 100, max_depth: int | None = None, random_state: int = 42,
             background_samples: int = 100, max_bins: int = 32) -> SHAPResult:
    """Exact path-dependent SHAP of every row under a fresh forest."""
    feats = list(feature_cols)
    if df.isEmpty():
        raise ValueError("X must contain at least one row.")
    model = fit_forest(df, feats, target, n_estimators, max_depth, random_state, max_bins)
    nodes = forest_nodes(model)
    trees = [tree_tables(g) for _, g in nodes.groupby("treeID", sort=True)]
    expected = float(np.mean([t.expected for t in trees]))
    p = len(feats)

    shared = df.sparkSession.sparkContext.broadcast((trees, Cells(trees, p)))
    parts = max(1, 4096 // max(1, p))                   # cells explained at once within a batch

    def placed(batches):
        for b in batches:
            cells = shared.value[1].of(np.column_stack([b.column(1 + j).to_numpy(zero_copy_only=False) for j in range(p)]))
            starts = np.arange(b.num_rows + 1, dtype=np.int32) * (4 * p)
            keys = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(cells))])
            yield pa.RecordBatch.from_arrays([*b.columns, keys], [*[f"_x{i}" for i in range(p + 1)], "cell"])

    def counted(batches):
        for pdf in batches:
            if len(pdf):
                cells, n = np.unique(shared.value[1].of(pdf.to_numpy(dtype=float)), axis=0, return_counts=True)
                yield pd.DataFrame({"cell": [c.tobytes() for c in cells], "n": n})

    def explain(batches):
        trees, grid = shared.value
        for pdf in batches:
            for start in range(0, len(pdf), parts):
                part = pdf.iloc[start:start + parts]
                cells = np.frombuffer(b"".join(part["cell"]), np.int32).reshape(-1, p)
                yield pd.DataFrame({"cell": part["cell"], "n": part["n"], "phi": list(shap_batch(grid.points(cells), trees, p))})

    rows = df.where(F.col(target).isNotNull()).select(F.col(row_id).cast("long").alias("_x0"), *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(feats, 1)])
    for i in range(1, p + 1):
        rows = rows.where(F.col(f"_x{i}").isNotNull())
    # each cell that holds rows is explained once, with the number of its rows; the rows look their cell up
    held = rows.drop("_x0").mapInPandas(counted, "cell binary, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    held = held.repartition(shuffle_partitions(df.sparkSession), "cell")        # a given number: AQE would merge them
    explained = durable(held.mapInPandas(explain, "cell binary, n long, phi array<double>"))
    schema = "_x0 long, " + ", ".join(f"_x{i} double" for i in range(1, p + 1)) + ", cell binary"
    known = spread_join(rows.mapInArrow(placed, schema), explained.select("cell", *[F.col("phi")[j].alias(f"_s{j}") for j in range(p)]), ["cell"])
    of_row = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_s{j}").alias("shap_value"), F.col(f"_x{j + 1}").alias("feature_value"))
                       for j, f in enumerate(feats)])
    values = known.select(F.col("_x0").alias(row_id), F.explode(of_row).alias("_v")).select(row_id, "_v.*")
    imp = (explained.select("n", F.posexplode("phi").alias("j", "s")).groupBy("j")
           .agg((F.sum(F.abs("s") * F.col("n")) / F.sum("n")).alias("mean_abs_shap"))
           .select(F.element_at(F.array(*[F.lit(f) for f in feats]), F.col("j") + 1).alias("feature"), "mean_abs_shap").withColumn("target", F.lit(target)))
    imp = _ranked(imp, "mean_abs_shap").select("target", "feature", "mean_abs_shap", "rank")
    bg = background_sample(df.select(row_id, *feats), background_samples, random_state, row_id)
    return SHAPResult(values, imp, expected, bg)


def forest_predict_numpy(nodes: pd.DataFrame, X: np.ndarray) -> np.ndarray:
    """Mean of tree predictions from the node table (used by tests)."""
    preds = []
    for _, g in nodes.groupby("treeID", sort=True):
        by_id = {int(r.id): r for r in g.itertuples()}
        out = np.empty(len(X))
        for i, x in enumerate(X):
            nid = 0
            while by_id[nid].left >= 0:
                r = by_id[nid]
                nid = int(r.left) if x[int(r.feature)] <= r.threshold else int(r.right)
            out[i] = by_id[nid].value
        preds.append(out)
    return np.mean(preds, axis=0)
