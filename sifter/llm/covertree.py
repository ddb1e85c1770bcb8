"""Embedding near-duplicates: dual traversal of a cover tree, distributed by its upper levels.

Vectors are scaled to the unit sphere, where cosine >= c means Euclidean distance <= sqrt(2 - 2c).
Equal vectors are merged into classes first.  The tree's levels:

* root -> cells: every class goes to its nearest of a bounded set of pivots (the cell's centre);
* cells -> blocks: a cell is cut into blocks of a bounded number of classes, so a hot cell is many
  blocks; each block keeps its own covering radius about the centre;
* inside a block, nested nets whose radii halve from level to level (``Tree``), down to the points.

The dual traversal starts with the pair (root, root).  Cell pairs, then block pairs, are joined on
their parent pair and kept while d(centres) <= r1 + r2 + threshold.  A surviving block pair goes to
one task, where numpy descends both trees level by level: node pairs too far apart by their
covering radii are dropped, the rest is expanded; point pairs are decided by the cosine in double precision.  A task returns, per class, the
number of vectors linked and a spanning forest of the links, never the pairs themselves.

Scale: the nets adapt to the data's intrinsic dimension.  Vectors without any near neighbours in a
high dimension give covering radii too large to prune cells, so block pairs then grow with the square
of the number of distinct vectors (any exact metric tree has this limit); memory per task stays two
blocks and one tile of distances.

Defined cases: a vector that is null, empty, zero, or has a null or non-finite component, or a
length other than its partner's, links with nothing (n_links 0, its own component); repeated
vec_ids each keep a row and count as vectors; a null vec_id is never a component id unless nothing
else is (component_id null, kept false); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm.common import prepare, stored, table
from sifter.llm.components import connected_components

MAX_PIVOTS = 1024          # cells below the root
BLOCK = 2048               # classes in a block
TILE = 512                 # rows of a distance tile
SLACK = 1e-9               # bounds are widened by this much, the exact cosine decides
FIRST_RADIUS = 0.5         # of the nets inside a block; halved down to the smallest
LAST_RADIUS = 0.03
PACKED = ("cls", "n", "vecs", "lens", "starts", "radii")


class Tree:
    """Nested nets over the unit vectors of one block, laid out so that every node is a run of rows.

    Level 0 covers with FIRST_RADIUS, every next level splits each node with half the radius.  A node
    is (start, covering radius); it ends where the next one starts, and its centre is its first row, which
    is also the centre of its first child.  ``order`` gives the rows' places in the vectors given.
    """

    def __init__(self, x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.x32, self.levels = x, x.astype(np.float32), levels

    @classmethod
    def build(cls, x: np.ndarray) -> tuple[Tree, np.ndarray]:
        groups, levels, radius = [np.arange(len(x))], [], FIRST_RADIUS
        while radius >= LAST_RADIUS:
            parts = [n for g in groups for n in (net(x, g, radius) if len(g) > 1 else [(0.0, g)])]
            groups = [g for _, g in parts]
            sizes = np.array([len(g) for g in groups])
            levels.append((np.cumsum(sizes) - sizes, np.array([r for r, _ in parts])))
            if (sizes == 1).all():
                break
            radius /= 2
        order = np.concatenate(groups)
        return cls(x[order], levels), order

    def ends(self, level: int) -> np.ndarray:
        return np.append(self.levels[level][0][1:], len(self.x))

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) child of every node of ``level``; a node of the last level stands for itself."""
        starts = self.levels[level][0]
        if level == len(self.levels) - 1:
            return np.arange(len(starts)), np.arange(1, len(starts) + 1)
        below = self.levels[level + 1][0]
        return np.searchsorted(below, starts), np.searchsorted(below, self.ends(level))


def net(x: np.ndarray, members: np.ndarray, radius: float) -> Iterator[tuple[float, np.ndarray]]:
    """Greedy net: the first uncovered point becomes a centre and takes the uncovered points within ``radius``."""
    own = x[members]
    near = (own @ own.T) >= 1 - radius * radius / 2
    left = np.ones(len(members), bool)
    for c in range(len(members)):
        if left[c]:
            left[c] = False
            taken = np.flatnonzero(near[c] & left)
            left[taken] = False
            reach = float(np.sqrt(((own[taken] - own[c]) ** 2).sum(axis=1)).max()) if len(taken) else 0.0
            yield reach, members[np.concatenate(([c], taken))]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def dual_links(a: Tree, b: Tree, limit: float, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (i, j) of row pairs of ``a`` x ``b`` with cosine >= ``cosine``; for ``same`` each pair once, i < j."""
    if not (len(a.x) and len(b.x)):
        return
    (ca, ra), (cb, rb) = a.levels[0], b.levels[0]
    right = b.x32[cb].T
    for s in range(0, len(ca), TILE):
        # single precision with the widest radius first (bound eased by more than its error), then the pair's own
        reach = ra[s:s + TILE] + rb.max() + limit + 1e-3
        close = a.x32[ca[s:s + TILE]] @ right >= (1 - reach * reach / 2).astype(np.float32)[:, None]
        i, j = np.nonzero(close)
        i = i + s
        if same:
            i, j = i[i <= j], j[i <= j]
        keep = _within(a.x[ca[i]], b.x[cb[j]], ra[i] + rb[j] + limit)
        yield from _descend(a, b, 0, i[keep], j[keep], limit, cosine, same)


def _within(p: np.ndarray, q: np.ndarray, reach: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", p, q), 0))
    return d <= reach + SLACK


def _descend(a: Tree, b: Tree, level: int, i: np.ndarray, j: np.ndarray, limit: float, cosine: float, same: bool):
    """Expand surviving node pairs of one level; every step handles a bounded number of pairs."""
    if not len(i):
        return
    la, lb = min(level, len(a.levels) - 1), min(level, len(b.levels) - 1)
    if level >= len(a.levels) - 1 and level >= len(b.levels) - 1:
        sa, ea, sb, eb = a.levels[la][0], a.ends(la), b.levels[lb][0], b.ends(lb)
        for p, q in zip(i.tolist(), j.tolist()):
            yield from _points(a, b, np.arange(sa[p], ea[p]), np.arange(sb[q], eb[q]), cosine, same and p == q)
        return
    (fa, ta), (fb, tb) = a.children(la), b.children(lb)
    (ca, ra), (cb, rb) = a.levels[min(level + 1, len(a.levels) - 1)], b.levels[min(level + 1, len(b.levels) - 1)]
    sizes = (ta - fa)[i] * (tb - fb)[j]
    at = 0
    while at < len(i):
        stop = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), 1 << 16)) + at)
        p, q, size = i[at:stop], j[at:stop], sizes[at:stop]
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        width = np.repeat((tb - fb)[q], size)
        u, v = np.repeat(fa[p], size) + k // width, np.repeat(fb[q], size) + k % width
        if same:
            u, v = u[u <= v], v[u <= v]
        keep = _within(a.x[ca[u]], b.x[cb[v]], ra[u] + rb[v] + limit)
        yield from _descend(a, b, level + 1, u[keep], v[keep], limit, cosine, same)
        at = stop


def _points(a: Tree, b: Tree, ga: np.ndarray, gb: np.ndarray, cosine: float, same: bool):
    for s in range(0, len(ga), TILE):
        i, j = np.nonzero(a.x[ga[s:s + TILE]] @ b.x[gb].T >= cosine)
        i = i + s
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield ga[i], gb[j]


def forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Node and smallest node of its component, for the nodes of ``pairs`` that are not smallest themselves."""
    label = np.arange(n)
    moved = True
    while moved:
        moved = False
        for u, v in pairs:
            lu, lv = label[u], label[v]
            if (lu != lv).any():
                low = np.minimum(lu, lv)
                for end in (u, v, lu, lv):
                    np.minimum.at(label, end, low)
                moved = True
        while (label[label] != label).any():
            label = label[label]
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)          # no overflow or underflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def valid_vector(col: str = "embedding"):
    """Neither null nor zero, every component present and finite."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    x = F.col(col)
    return F.coalesce(x.isNotNull() & F.forall(x, finite) & F.exists(x, lambda v: v != 0), F.lit(False))


def classes(vectors: DataFrame) -> DataFrame:
    """(vec, n, first_id, cls): distinct usable vectors, their copies and smallest id, a stored class number."""
    use = vectors.where(valid_vector()).select(F.col("vec_id").cast("long").alias("vec_id"),
                                               F.transform("embedding", lambda v: v + F.lit(0.0).cast("float")).alias("vec"))
    groups = use.groupBy("vec").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
    return stored(groups.withColumn("cls", F.monotonically_increasing_id()), "vector_classes")


def assign_cells(reps: DataFrame, pivots: int, block: int) -> DataFrame:
    """(dim, cell, dist, vec, cls, n): every class with its nearest pivot of the same length."""
    spark = reps.sparkSession
    sized = reps.withColumn("dim", F.size("vec"))
    picked = (sized.withColumn("h", F.xxhash64("vec")).orderBy("h", "cls").limit(pivots)
              .select("dim", "vec").collect())            # a bounded sample: at most ``pivots`` rows
    by_dim: dict[int, np.ndarray] = {}
    for r in picked:
        by_dim.setdefault(r["dim"], []).append(r["vec"])
    by_dim = {d: _unit(np.array(v)) for d, v in by_dim.items()}
    shared = spark.sparkContext.broadcast(by_dim)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby("dim"):
                c = shared.value.get(dim)
                for s in range(0, len(part), TILE):
                    rows = part.iloc[s:s + TILE]
                    if c is None:                         # a length the sample missed: one cell of its own
                        cell, dist = np.zeros(len(rows), np.int64), np.full(len(rows), 2.0)
                    else:
                        d = distance(_unit(np.stack(rows["vec"])), c)
                        cell, dist = d.argmin(axis=1), d.min(axis=1)
                    yield pd.DataFrame({"dim": rows["dim"], "cell": cell, "dist": dist, "vec": rows["vec"],
                                        "cls": rows["cls"], "n": rows["n"]})

    return sized.select("dim", "vec", "cls", "n").mapInPandas(
        run, "dim int, cell long, dist double, vec array<float>, cls long, n long")


def _pack(part: pd.DataFrame) -> pd.DataFrame:
    """A block's vectors, class numbers and copies in the order of its tree, and the tree's levels."""
    part = part.sort_values("cls")
    raw = np.stack(part["vec"]).astype(np.float32)
    tree, order = Tree.build(_unit(raw))
    levels = {"lens": np.array([len(s) for s, _ in tree.levels], np.int64), "starts": np.concatenate([s for s, _ in tree.levels]).astype(np.int64),
              "radii": np.concatenate([r for _, r in tree.levels]).astype(np.float64)}
    rows = {"cls": part["cls"].to_numpy(np.int64)[order], "n": part["n"].to_numpy(np.int64)[order], "vecs": raw[order]}
    return pd.DataFrame({"dim": [part["dim"].iloc[0]], "cell": [part["cell"].iloc[0]], "block": [part["block"].iloc[0]],
                         "radius": [float(part["dist"].max())], **{k: [v.tobytes()] for k, v in {**rows, **levels}.items()}})


def _unpack(row: dict, side: str) -> Tree:
    x = _unit(np.frombuffer(row[f"vecs_{side}"], np.float32).reshape(-1, row["dim"]))
    cuts = np.cumsum(np.frombuffer(row[f"lens_{side}"], np.int64))[:-1]
    starts, radii = np.frombuffer(row[f"starts_{side}"], np.int64), np.frombuffer(row[f"radii_{side}"], np.float64)
    return Tree(x, list(zip(np.split(starts, cuts), np.split(radii, cuts))))


def near_links(reps: DataFrame, cosine: float, pivots: int = MAX_PIVOTS, block: int = BLOCK) -> DataFrame:
    """(cls, linked, hook): vectors linked with each class and a class it hangs together with, by task."""
    spark = reps.sparkSession
    total = reps.count()
    cells = min(pivots, max(1, total // block))
    limit = float(np.sqrt(2 - 2 * cosine))
    placed = stored(assign_cells(reps, cells, block), "cells")
    sizes = placed.groupBy("dim", "cell").agg(F.count("*").alias("members"))
    cut = placed.join(F.broadcast(sizes), ["dim", "cell"])           # at most ``pivots`` rows per vector length
    cut = cut.withColumn("part", F.pmod(F.xxhash64("cls"), F.ceil(F.col("members") / block)))
    cut = cut.withColumn("block", F.concat_ws("/", "dim", "cell", "part"))
    packed = stored(cut.groupBy("block").applyInPandas(
        _pack, "dim int, cell long, block string, radius double, cls binary, n binary, vecs binary, lens binary, starts binary, radii binary"), "blocks")
    nodes = packed.select("dim", "cell", "block", "radius")
    up = nodes.groupBy("dim", "cell").agg(F.max("radius").alias("radius"))
    centres = spark.sparkContext.broadcast(_centres(placed.sparkSession, reps, cells))

    @F.pandas_udf("double")
    def apart(dim: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_centre_distance(centres.value, d, i, j) for d, i, j in zip(dim, x, y)], dtype=float)

    def pairs(level: DataFrame, key: list[str], node: list[str]) -> DataFrame:
        left = level.select(*key, *[F.col(c).alias(f"{c}_a") for c in node])
        right = level.select(*key, *[F.col(c).alias(f"{c}_b") for c in node])
        return left.join(right, key)

    root = pairs(up, ["dim"], ["cell", "radius"]).where("cell_a <= cell_b")
    reach = F.col("radius_a") + F.col("radius_b") + F.lit(limit + SLACK)
    cell_pairs = root.withColumn("gap", apart("dim", "cell_a", "cell_b")).where(F.col("gap") <= reach).select("dim", "cell_a", "cell_b", "gap")
    a = nodes.select("dim", F.col("cell").alias("cell_a"), F.col("block").alias("a"), F.col("radius").alias("radius_a"))
    b = nodes.select("dim", F.col("cell").alias("cell_b"), F.col("block").alias("b"), F.col("radius").alias("radius_b"))
    block_pairs = (cell_pairs.join(a, ["dim", "cell_a"]).join(b, ["dim", "cell_b"])
                   .where((F.col("cell_a") < F.col("cell_b")) | (F.col("a") <= F.col("b")))
                   .where(F.col("gap") <= reach).select("dim", "a", "b"))
    block_pairs = stored(block_pairs, "block_pairs")
    side = lambda s: packed.select(F.col("block").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in PACKED])
    work = block_pairs.repartition(F.col("a"), F.col("b")).join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, Tree] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in ("dim", "a", "b", *[f"{c}_{s}" for s in "ab" for c in PACKED])}
                yield _block_pair(row, trees, limit, cosine)

    return work.mapInArrow(run, "cls long, linked long, hook long")


def _block_pair(row: dict, trees: dict[str, Tree], limit: float, cosine: float) -> pa.RecordBatch:
    same = row["a"] == row["b"]
    side = {}
    for s in "ab":
        name = row[s]
        if name not in trees:
            if len(trees) > 3:
                trees.clear()
            trees[name] = _unpack(row, s)
        side[s] = (trees[name], np.frombuffer(row[f"cls_{s}"], np.int64), np.frombuffer(row[f"n_{s}"], np.int64))
    (ta, cls_a, n_a), (tb, cls_b, n_b) = side["a"], side["b"]
    shift = 0 if same else len(cls_a)
    cls = cls_a if same else np.concatenate([cls_a, cls_b])
    linked, found = np.zeros(len(cls), np.int64), []
    for i, j in dual_links(ta, tb, limit, cosine, same):
        np.add.at(linked, i, n_b[j])
        np.add.at(linked, j + shift, n_a[i])
        found.append(_thin(i, j + shift, len(cls)))
    node, low = forest(len(cls), found)
    hook = cls.copy()
    hook[node] = cls[low]
    keep = linked > 0
    return pa.RecordBatch.from_arrays([pa.array(cls[keep]), pa.array(linked[keep]), pa.array(hook[keep])], ["cls", "linked", "hook"])


def _thin(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs, or a spanning forest of them once they are many."""
    if len(i) < 4 * n:
        return i, j
    return forest(n, [(i, j)])


def _centres(spark: SparkSession, reps: DataFrame, cells: int) -> dict[int, np.ndarray]:
    rows = (reps.withColumn("h", F.xxhash64("vec")).orderBy("h", "cls").limit(cells).select("vec").collect())
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(len(r["vec"]), []).append(r["vec"])
    return {d: _unit(np.array(v)) for d, v in by_dim.items()}


def _centre_distance(centres: dict[int, np.ndarray], dim: int, i: int, j: int) -> float:
    c = centres.get(dim)
    return 0.0 if c is None or i == j else float(np.sqrt(max(0.0, 2 - 2 * c[i] @ c[j])))


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, pivots: int = MAX_PIVOTS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding)."""
    prepare(vectors.sparkSession)
    reps = classes(vectors)
    found = stored(near_links(reps, cosine, pivots, block), "vector_links")
    comp = connected_components(found.select(F.col("cls").alias("u"), F.col("hook").alias("v")))
    linked = found.groupBy("cls").agg(F.sum("linked").alias("linked"))
    full = (reps.join(linked, "cls", "left").join(comp, F.col("cls") == F.col("node"), "left")
            .select("vec", "first_id", "n", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("component", "cls").alias("root")))
    low = full.groupBy("root").agg(F.min("first_id").alias("component_id"))
    per_class = full.join(low, "root").select("vec", (F.col("n") - 1 + F.col("linked")).alias("links"), "component_id")
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", valid_vector().alias("ok"))
    usable = slim.where("ok").withColumn("vec", F.transform("embedding", lambda v: v + F.lit(0.0).cast("float")))
    out = usable.join(per_class, "vec").select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = slim.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_links, component_id and kept of every embedding, at cosine 0.95."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


ORACLE_OP2 = """
WITH RECURSIVE e AS (
  SELECT vec_id, [v::DOUBLE FOR v IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([v FOR v IN embedding IF v IS NULL OR NOT isfinite(v)]) = 0
    AND len([v FOR v IN embedding IF v <> 0]) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b
  ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.95
), reach(u, v) AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), low AS (SELECT u, min(v) AS m FROM reach GROUP BY u), deg AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN deg ON deg.u = vec_id LEFT JOIN low ON low.u = vec_id
"""
