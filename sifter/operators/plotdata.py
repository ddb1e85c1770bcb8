"""Tables behind the plots (V1-V4, V6-V8).

Only the data is produced (rendering is out of scope).  Row-level tables
(biplot scores, beeswarm points) stay distributed; per-feature statistics
(quartiles, ranges, histogram bins) come from grouped aggregates and exact
range-partitioned quantiles, then join back.  Ordered polylines (Pareto
staircase) number their points with ``ordered_index`` and pair neighbours by
an equi-join on the index, not by an un-partitioned window.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sifter.functions.broadcasting import broadcast_if_small
from sifter.functions.ordering import exact_quantiles, ordered_index
from sifter.session import durable


def _small(df: DataFrame) -> DataFrame:
    return broadcast_if_small(df)


def scree(variance: DataFrame) -> DataFrame:
    """V1: explained variance % and running total per component (<= 5 rows)."""
    w = Window.orderBy("pc").rowsBetween(Window.unboundedPreceding, 0)
    return variance.select("pc", (F.col("explained_variance_ratio") * 100).alias("explained_pct"),
                           (F.sum("explained_variance_ratio").over(w) * 100).alias("cumulative_pct"))


def heatmap_long(correlations: DataFrame, methods: Sequence[str] = ("pearson", "spearman")) -> DataFrame:
    """V2: (target, feature, method, value, label); missing values read 'n/a'."""
    cols = [m for m in methods if f"{m}_r" in correlations.columns]
    arr = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"{m}_r").alias("value")) for m in cols])
    out = correlations.select("target", "feature", F.explode(arr).alias("s")).select(
        "target", "feature", "s.method", "s.value")
    return out.withColumn("label", F.coalesce(F.bround("value", 3).cast("string"), F.lit("n/a")))


def loading_heatmap(loadings: DataFrame, variance: DataFrame) -> DataFrame:
    """V3: loadings with ``PCi (x%)`` labels and the symmetric colour limit."""
    lab = variance.select("pc", F.format_string("PC%d (%.1f%%)", F.col("pc"),
                                                F.col("explained_variance_ratio") * 100).alias("pc_label"))
    lim = loadings.agg(F.max(F.abs("loading")).alias("m")).select(
        F.when(F.col("m") > 0, F.col("m")).otherwise(F.lit(1.0)).alias("color_limit"))
    return _loading_heatmap(loadings, lab, lim)


def _loading_heatmap(loadings, lab, lim):
    lim_k = lim.withColumn("_k", F.lit(1))
    return (loadings.join(F.broadcast(lab), "pc").withColumn("_k", F.lit(1))
            .join(F.broadcast(lim_k), "_k").drop("_k")
            .select("feature", "pc", "pc_label", "loading", "color_limit"))


def biplot(scores: DataFrame, loadings: DataFrame, id_col: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """V4: score points (PC1, PC2) and loading vectors scaled into the cloud.

    scale = 0.8 * max|score| / max|loading| (both floored at 1e-9); labels
    sit at 1.18 x the arrow tip.
    """
    has2 = "PC2" in scores.columns
    y_sc = F.col("PC2") if has2 else F.lit(0.0)
    pts = scores.select(id_col, F.col("PC1").alias("x"), y_sc.alias("y"))
    sc = pts.agg(F.greatest(F.max(F.abs("x")), F.max(F.abs("y")), F.lit(1e-9)).alias("sc"))
    wide = loadings.groupBy("feature").agg(
        F.max(F.when(F.col("pc") == 1, F.col("loading"))).alias("lx"),
        F.coalesce(F.max(F.when(F.col("pc") == 2, F.col("loading"))), F.lit(0.0)).alias("ly"))
    ld = wide.agg(F.greatest(F.max(F.abs("lx")), F.max(F.abs("ly")), F.lit(1e-9)).alias("ld"))
    scale = sc.withColumn("_k", F.lit(1)).join(ld.withColumn("_k", F.lit(1)), "_k") \
        .select("_k", (F.col("sc") * 0.8 / F.col("ld")).alias("scale"))
    vec = (wide.withColumn("_k", F.lit(1)).join(F.broadcast(scale), "_k")
           .select("feature", (F.col("lx") * F.col("scale")).alias("x_end"),
                   (F.col("ly") * F.col("scale")).alias("y_end"),
                   (F.col("lx") * F.col("scale") * 1.18).alias("x_label"),
                   (F.col("ly") * F.col("scale") * 1.18).alias("y_label")))
    return pts, vec


def _uniform(seed: int, *cols) -> F.Column:
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)


def beeswarm(shap_values: DataFrame, max_display: int | None = None, seed: int = 42,
             max_jitter: float = 0.35, id_col: str = "row_id") -> DataFrame:
    """V6: beeswarm points per feature.

    Features are ordered by mean |SHAP| (``feature_rank``), optionally the
    top ``max_display``.  Each point gets its min-max scaled feature value
    (constant or missing -> 0.5) and a seeded jitter whose amplitude grows
    from 0.15 to 1.0 x ``max_jitter`` with the local density of SHAP values
    (histogram with Freedman-Diaconis bins clipped to 10..80, 30 if
    degenerate; fewer than 5 points: plain jitter).
    """
    if max_display is not None and max_display <= 0:
        raise ValueError("max_display must be a positive integer or None.")
    # every statistic comes from the distinct values and their numbers; the points are read once more at the end
    per = durable(shap_values.groupBy("feature", "shap_value").agg(
        F.count(F.lit(1)).alias("_c"), F.min("feature_value").alias("_v0"), F.max("feature_value").alias("_v1")))
    known = F.when(F.col("shap_value").isNotNull(), F.col("_c"))
    imp = per.groupBy("feature").agg((F.sum(F.abs("shap_value") * F.col("_c")) / F.sum(known)).alias("_imp"))
    imp = imp.withColumn("feature_rank", F.row_number().over(Window.orderBy(F.col("_imp").desc(), "feature")))
    if max_display is not None:
        imp = imp.where(F.col("feature_rank") <= max_display)
    imp = imp.select("feature", "feature_rank")
    per = per.join(F.broadcast(imp), "feature")
    fin = per.where(~F.isnan("shap_value"))
    q = exact_quantiles(fin, ["feature"], "shap_value", [0.25, 0.75], count_col="_c")
    rng_ = fin.groupBy("feature").agg(F.min("shap_value").alias("_lo"), F.max("shap_value").alias("_hi"),
                                      F.min("_v0").alias("_vlo"), F.max("_v1").alias("_vhi"))
    st = q.join(rng_, "feature")
    iqr = F.greatest(F.col("q_1") - F.col("q_0"), F.lit(1e-12))
    bw = 2.0 * iqr / F.pow(F.col("n").cast("double"), 1.0 / 3.0)
    nb = F.when(bw > 0, F.least(F.greatest(F.floor((F.col("_hi") - F.col("_lo")) / bw), F.lit(10)), F.lit(80))) \
        .otherwise(F.lit(30))
    st = st.withColumn("_nb", nb.cast("int"))
    st = durable(imp.join(st, "feature", "left"))        # a row a feature
    width = (F.col("_hi") - F.col("_lo")) / F.col("_nb")
    binc = F.when(width > 0, F.least(F.greatest(F.floor((F.col("shap_value") - F.col("_lo")) / width),
                                                F.lit(0)), F.col("_nb") - 1)).otherwise(F.lit(0)).cast("int")
    counts = (per.drop("feature_rank").join(_small(st), "feature").withColumn("_bin", binc)
              .groupBy("feature", "_bin").agg(F.sum("_c").alias("_dens")))      # at most 80 bins a feature
    counts = durable(counts)
    dr = counts.groupBy("feature").agg(F.min("_dens").alias("_dmin"), F.max("_dens").alias("_dmax"))
    j = shap_values.join(_small(st.join(dr, "feature")), "feature").withColumn("_bin", binc)
    j = j.join(_small(counts), ["feature", "_bin"])
    dn = F.when(F.col("_dmax") > F.col("_dmin"),
                (F.col("_dens") - F.col("_dmin")) / (F.col("_dmax") - F.col("_dmin"))).otherwise(F.lit(0.0))
    scale = F.when(F.col("n") < 5, F.lit(1.0)).otherwise(0.15 + 0.85 * dn) * max_jitter
    u = _uniform(seed, F.col(id_col), F.col("feature")) * 2.0 - 1.0
    vnorm = F.when((F.col("_vhi") > F.col("_vlo")) & F.col("feature_value").isNotNull(),
                   (F.col("feature_value") - F.col("_vlo")) / (F.col("_vhi") - F.col("_vlo"))).otherwise(F.lit(0.5))
    return j.select("feature", "feature_rank", id_col, "shap_value", "feature_value",
                    vnorm.alias("value_norm"), (u * scale).alias("jitter"))


def staircase(front: DataFrame, x: str, y: str, x_left: float | None = None,
              x_right: float | None = None, y_bottom: float | None = None) -> DataFrame:
    """V7: Pareto staircase and dominated-region polygon, points numbered by ``seq``.

    ``part`` is ``step`` or ``dominated``.  Bounds default to the front's own
    range padded by 12 %.
    """
    pf = front.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) \
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    if x_left is None or x_right is None or y_bottom is None:
        b = pf.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        xp = max((b[1] - b[0]) * 0.12, 1e-6)
        yp = max((b[3] - b[2]) * 0.12, 1e-6)
        x_left = b[0] - xp if x_left is None else x_left
        x_right = b[1] + xp if x_right is None else x_right
        y_bottom = b[2] - yp if y_bottom is None else y_bottom
    idx = ordered_index(pf, ["x", "y"], name="k")
    n = idx.count()
    nxt = idx.select((F.col("k") - 1).alias("k"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    pairs = idx.join(nxt, "k", "left")
    mids = F.when(F.col("x1").isNotNull(), F.array(
        F.struct((2 + 2 * F.col("k")).alias("seq"), F.col("x").alias("px"), F.col("y1").alias("py")),
        F.struct((3 + 2 * F.col("k")).alias("seq"), F.col("x1").alias("px"), F.col("y1").alias("py"))))
    first = F.when(F.col("k") == 0, F.array(
        F.struct(F.lit(0).cast("long").alias("seq"), F.lit(float(x_left)).alias("px"), F.col("y").alias("py")),
        F.struct(F.lit(1).cast("long").alias("seq"), F.col("x").alias("px"), F.col("y").alias("py"))))
    last_step = F.when(F.col("k") == n - 1, F.array(
        F.struct(F.lit(2 * n).cast("long").alias("seq"), F.lit(float(x_right)).alias("px"), F.col("y").alias("py"))))
    last_dom = F.when(F.col("k") == n - 1, F.array(
        F.struct(F.lit(2 * n).cast("long").alias("seq"), F.lit(float(x_right)).alias("px"), F.col("y").alias("py")),
        F.struct(F.lit(2 * n + 1).cast("long").alias("seq"), F.lit(float(x_right)).alias("px"),
                 F.lit(float(y_bottom)).alias("py")),
        F.struct(F.lit(2 * n + 2).cast("long").alias("seq"), F.lit(float(x_left)).alias("px"),
                 F.lit(float(y_bottom)).alias("py"))))
    empty = F.array().cast("array<struct<seq:bigint,px:double,py:double>>")

    def pts(last):
        return F.concat(F.coalesce(first, empty), F.coalesce(mids, empty), F.coalesce(last, empty))
    step = pairs.select(F.lit("step").alias("part"), F.explode(pts(last_step)).alias("p"))
    dom = pairs.select(F.lit("dominated").alias("part"), F.explode(pts(last_dom)).alias("p"))
    return step.unionByName(dom).select("part", F.col("p.seq").alias("seq"),
                                        F.col("p.px").alias("x"), F.col("p.py").alias("y"))


def objective_frame(front: DataFrame, suggestions: DataFrame, x: str, y: str,
                    sx: str | None = None, sy: str | None = None) -> DataFrame:
    """V8: axis frame over front and suggestions (12 % padding, min 1e-6)."""
    sx, sy = sx or x, sy or y
    allp = front.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) \
        .unionByName(suggestions.select(F.col(sx).cast("double").alias("x"), F.col(sy).cast("double").alias("y")))
    b = allp.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    xp = F.greatest((F.col("x1") - F.col("x0")) * 0.12, F.lit(1e-6))
    yp = F.greatest((F.col("y1") - F.col("y0")) * 0.12, F.lit(1e-6))
    return b.select((F.col("x0") - xp).alias("x_left"), (F.col("x1") + xp).alias("x_right"),
                    (F.col("y0") - yp).alias("y_bottom"), (F.col("y1") + yp).alias("y_top"))


def objective_points(front: DataFrame | None, suggestions: DataFrame, x: str, y: str, sx: str | None = None,
                     sy: str | None = None, order_by: Sequence[str] | None = None,
                     category: str | None = None) -> DataFrame:
    """V8: the points of the objective plot, ``(kind, seq, label, x, y, category)``.

    The front comes sorted by x (then y) and numbered from 0; suggestions are numbered ``#1``, ``#2``, ... in the
    order of ``order_by`` (default: their x, then y) and carry ``category`` as the colour.  Without a front
    (``None``), only suggestions come; points without an x or y are not drawn.
    """
    def points(df: DataFrame, cx: str, cy: str, order: Sequence[str], colour: str | None) -> DataFrame:
        tint = F.col(colour).cast("string") if colour else F.lit(None).cast("string")
        rows = df.select(F.col(cx).cast("double").alias("x"), F.col(cy).cast("double").alias("y"), tint.alias("category"),
                         *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
        rows = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull())
        return ordered_index(rows, [*[f"_o{i}" for i in range(len(order))], "x", "y"], name="seq")

    drawn = points(suggestions, sx or x, sy or y, list(order_by or ()), category).select(
        F.lit("suggestion").alias("kind"), "seq", F.concat(F.lit("#"), F.col("seq") + 1).alias("label"), "x", "y", "category")
    if front is None:
        return drawn
    line = points(front, x, y, (), None).select(
        F.lit("front").alias("kind"), "seq", F.lit(None).cast("string").alias("label"), "x", "y", "category")
    return line.unionByName(drawn)
