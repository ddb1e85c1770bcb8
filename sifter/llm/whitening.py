"""PCA whitening of embeddings by incremental eigendecomposition.

1. Vectors become integers x = floor(scale * c) + shift; the fit list is every distinct x once.
2. Each partition of the fit list keeps the spectrum (eigenvalues and vectors) of its scatter matrix and
   adds one vector at a time: a centred rank-one update.  The eigenvalues of diag(d) + rho z z' are
   the roots of a secular equation, found for all poles at once between their neighbours; entries of z that
   are negligible, and poles that coincide, are deflated first.  z is then recomputed from the roots,
   so the eigenvectors stay orthogonal however close the roots lie.
3. Spectra are combined ``MERGE`` at a time in Spark: one rank-one update for every eigenpair of the
   other spectrum and one for the distance of the means.
4. Rayleigh-Ritz: with the combined vectors as the basis, every partition adds up the products of its
   centred, projected vectors; the eigenvectors of that sum rotate the basis.  Centring uses the exact
   integers n * x - S, so nothing of the update's rounding is left.
5. A second pass over the fit list measures how far the whitened covariance is from the identity.

Scale: the fit list is a distinct (copies fold on the map side, so a vector that a third of all rows share is
one row a task) and a stored table.  A partition's state is d x d numbers, whatever its rows; the driver
sees one combined d x d spectrum and one d x d sum of products, never vectors.  The update costs about
d^2 for the roots and d^3 for the basis a vector.  n and S are exact 64-bit sums.

Defined cases: rows with a null vector, null or non-finite entries, no entries, or entries too large for an exact
integer (2^46 or more) are dropped; so are rows of a length other than the most common one (of
equally common ones the longer); repeated vectors and ids each keep their rows; a null id stays null; components whose
eigenvalue is zero (within rounding) have null ``whitened``; with no positive eigenvalue ``explained`` and
``identity_error`` are null; an empty table gives no rows; extra columns are ignored.  If a deviation
does not fit 64 bits, an OverflowError says so.
"""

from __future__ import annotations

import sifter._blas  # noqa: F401  (one BLAS thread a process)

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm.common import prepare, stored, table
from sifter.session import shuffle_partitions

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
MERGE = 8
EXACT = float(1 << 46)
EPS = np.finfo(float).eps
STATE = "part long, n long, sums array<long>, mean array<double>, values array<double>, vectors binary"


# ---- rank-one updates ---------------------------------------------------------------------------

def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum z_k^2 / (d_k - t), one in every interval (d_i, d_i+1), d rising, z without zeros.

    Returns (nearest pole of each root, distance of the root from it): the distance keeps its digits
    where root and pole almost coincide.  All roots are found together, by interpolation with the two
    poles at hand inside a bracket that bisection keeps shrinking.
    """
    n, w = len(d), rho * z * z
    ends = np.append(d[1:], d[-1] + w.sum())
    gap = ends - d
    # which pole is nearer: the sign of the function in the middle
    diff = d[None, :] - d[:, None]                                  # d_k - d_i
    middle = 1 + (w / (diff - gap[:, None] / 2)).sum(1)
    left = (middle >= 0) | (np.arange(n) == n - 1)
    near = np.where(left, np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    delta = d[None, :] - d[near][:, None]                           # poles as seen from the nearest one
    lo = np.where(left, np.where(middle >= 0, 0.0, gap / 2), -gap / 2)
    hi = np.where(left, np.where(middle >= 0, gap / 2, gap), 0.0)
    rows, nxt = np.arange(n), np.minimum(np.arange(n) + 1, n - 1)
    at = (lo + hi) / 2
    p1, p2 = delta[rows, rows], delta[rows, nxt]                    # the interval's two poles
    inner = rows < n - 1
    upper = np.triu(np.ones((n, n), bool), 1)
    for _ in range(60):
        inv = 1 / (delta - at[:, None])
        terms = w * inv
        f = 1 + terms.sum(1)
        size = 1 + np.abs(terms).sum(1)
        lo, hi = np.where(f < 0, at, lo), np.where(f < 0, hi, at)
        done = (np.abs(f) <= 8 * EPS * size) | (hi - lo <= 2 * EPS * np.maximum(np.abs(lo), np.abs(hi)))
        if done.all():
            break
        slopes = terms * inv
        psi, phi = np.where(upper, 0, slopes).sum(1), np.where(upper, slopes, 0).sum(1)
        # c + s / (p1 - t) + r / (p2 - t) with the function's value and slopes at t
        a, b = p1 - at, p2 - at
        c = f - a * psi - np.where(inner, b * phi, 0)
        s, r = a * a * psi, np.where(inner, b * b * phi, 0)
        # c (p1-t)(p2-t) + s (p2-t) + r (p1-t) = 0, written for the step t - at
        qa, qb, qc = c, -(c * (a + b) + s + r), c * a * b + s * b + r * a
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(qb * qb - 4 * qa * qc, 0))
            step = np.where(qb <= 0, 2 * qc / (-qb + root), (-qb - root) / (2 * qa))
            step = np.where(inner, step, a + s / c)                 # one pole only: c + s / (p1 - t)
            new = at + step
            ok = np.isfinite(new) & (new > lo) & (new < hi)
        at = np.where(done, at, np.where(ok, new, (lo + hi) / 2))
    return near, at


def rank_one(values: np.ndarray, vectors: np.ndarray, x: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of V diag(values) V' + rho x x' (values rising, rho > 0)."""
    z = vectors.T @ x
    scale = float(z @ z)
    if not rho * scale > 0:
        return values, vectors
    tol = 8 * EPS * max(float(np.abs(values).max()), rho * scale)
    length = np.sqrt(scale)
    live = np.abs(z) * length * rho > tol                           # else the pair stays as it is
    # poles that coincide: turn their vectors so that one of them takes all of z
    at = np.flatnonzero(live)
    copied = False
    while len(at) > 1:
        i, j = at[:-1], at[1:]
        tau = np.hypot(z[i], z[j])
        near = np.abs((values[j] - values[i]) * z[i] * z[j]) <= tol * tau * tau
        if not near.any():
            break
        if not copied:
            vectors, values, copied = vectors.copy(), values.copy(), True
        held = at[0]
        for k in at[1:]:
            t = np.hypot(z[held], z[k])
            c, s = z[k] / t, z[held] / t
            if abs((values[k] - values[held]) * c * s) <= tol:
                q, v = vectors[:, held].copy(), vectors[:, k].copy()
                vectors[:, held], vectors[:, k] = c * q - s * v, s * q + c * v
                a, b = values[held], values[k]
                values[held], values[k] = c * c * a + s * s * b, s * s * a + c * c * b
                z[held], z[k], live[held] = 0.0, t, False
            held = k
        at = np.flatnonzero(live)
        if copied:
            order = np.argsort(values, kind="stable")
            values, vectors, z, live = values[order], vectors[:, order], z[order], live[order]
            at = np.flatnonzero(live)
    if not len(at):
        return values, vectors
    d, zl = values[at], z[at]
    near, dist = secular_roots(d, zl, rho)
    # d_k - root_i without cancellation
    away = (d[None, :] - d[near][:, None]) - dist[:, None]          # [root, pole]
    n = len(at)
    # the z whose roots these are exactly: prod_i (root_i - d_k) / prod_(i != k) (d_i - d_k)
    between = d[:, None] - d[None, :]                               # [i, k] d_i - d_k
    ratio = np.empty((n, n))
    rows = np.arange(n)
    np.fill_diagonal(between, 1.0)
    ratio = -away / between                                         # (root_i - d_k) / (d_i - d_k)
    exact = np.sqrt(np.abs(np.prod(ratio, axis=0))) * np.sign(zl)
    u = exact[None, :] / away
    u /= np.sqrt((u * u).sum(1))[:, None]
    values, vectors = values.copy(), vectors.copy() if not copied else vectors
    vectors[:, at] = vectors[:, at] @ u.T
    values[at] = d[near] + dist
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, exact sums, mean and the scatter matrix's spectrum of a set of vectors."""

    def __init__(self, dim: int):
        self.n, self.sums, self.mean = 0, np.zeros(dim, np.int64), np.zeros(dim)
        self.values, self.vectors = np.zeros(dim), np.eye(dim)

    def add(self, x: np.ndarray) -> None:
        apart = x - self.mean
        self.sums += x
        self.n += 1
        if self.n > 1:
            self.values, self.vectors = rank_one(self.values, self.vectors, apart, (self.n - 1) / self.n)
        self.mean = self.mean + apart / self.n

    def combine(self, other: "Spectrum") -> None:
        if not other.n:
            return
        if not self.n:
            self.__dict__.update(other.__dict__)
            return
        apart, n = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        self.values, self.vectors = rank_one(self.values, self.vectors, apart, self.n * other.n / n)
        self.mean = self.mean + apart * (other.n / n)
        self.n, self.sums = n, self.sums + other.sums

    def row(self, part: int) -> tuple:
        return part, self.n, self.sums.tolist(), self.mean.tolist(), self.values.tolist(), self.vectors.tobytes()

    @classmethod
    def of(cls, row) -> "Spectrum":
        s = cls(len(row["sums"]))
        s.n, s.sums, s.mean, s.values = row["n"], np.array(row["sums"], np.int64), np.array(row["mean"]), np.array(row["values"])
        s.vectors = np.frombuffer(row["vectors"], float).reshape(len(s.mean), -1).copy()
        return s


# ---- tables -------------------------------------------------------------------------------------

def integers(table_: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, x of the usable rows; x has the most common length."""
    c = F.col(vector).cast("array<double>")
    sound = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < EXACT)) & (F.size(c) > 0)
    usable = table_.where(c.isNotNull()).where(sound)
    lengths = usable.groupBy(F.size(c).alias("len")).agg(F.count("*").alias("n"))
    length = lengths.agg(F.max(F.struct("n", "len")).alias("m")).first()["m"]
    usable = usable.where(F.size(c) == (length["len"] if length else 0))
    return usable.select(F.col(id_column).cast("long").alias("id"), F.transform(c, lambda v: F.floor(v * SCALE) + SHIFT).alias("x"))


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists of 64-bit integers as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _states(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary()]
    names = ["part", "n", "sums", "mean", "values", "vectors"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def spectrum(fit: DataFrame) -> Spectrum | None:
    """The combined spectrum of the fit list (x), by rank-one updates in its partitions."""
    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        own = None
        for b in batches:
            if b.num_rows:
                rows = matrix(b.column("x"))
                own = own or Spectrum(rows.shape[1])
                for x in rows:
                    own.add(x)
        yield _states([own.row(TaskContext.get().partitionId())] if own else [])

    def merge(key, frame):
        import pandas as pd
        own = None
        for row in frame.sort_values("part").to_dict("records"):
            if own is None:
                own = Spectrum.of(row)
            else:
                own.combine(Spectrum.of(row))
        return pd.DataFrame([own.row(int(key[0]))], columns=["part", "n", "sums", "mean", "values", "vectors"])

    states = stored(fit.mapInArrow(update, STATE), "spectra")
    left = states.agg(F.max("part")).first()[0]
    while left:
        left //= MERGE
        states = stored(states.withColumn("group", F.floor(F.col("part") / MERGE).cast("long")).groupBy("group").applyInPandas(merge, STATE), "spectra")
    row = states.first()
    return Spectrum.of(row.asDict()) if row else None


def sum_of_products(fit: DataFrame, width: int, project) -> np.ndarray:
    """Sum over the fit list of y y', y = project(rows), added up in Spark entry by entry."""
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            if b.num_rows:
                y = project(matrix(b.column("x")))
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "line"])

    lines = fit.mapInArrow(products, "i long, line array<double>")
    cells = lines.select("i", F.posexplode("line").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    got = cells.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("line")).collect()
    out = np.zeros((width, width))
    for r in got:
        out[r["i"]] = [c["v"] for c in r["line"]]
    return (out + out.T) / 2


class Whitening:
    """Mean (n, S), eigenvalues and vectors, falling; ``rank`` of them are positive."""

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray):
        self.n, self.sums, self.values, self.vectors = n, sums, values, vectors
        top = values[0] if len(values) else 0.0
        self.rank = int((values > top * len(values) * EPS * 16).sum()) if top > 0 else 0
        self.explained = values / values.sum() if top > 0 else None
        self.identity_error: float | None = None

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """x - S/n from exact integers."""
        if abs(rows).max(initial=0) > (1 << 62) // max(self.n, 1):
            return np.array([[float(self.n * int(a) - int(s)) for a, s in zip(r, self.sums)] for r in rows]) / self.n
        return (rows * self.n - self.sums) / self.n

    def whitened(self, rows: np.ndarray, components: int) -> np.ndarray:
        k = min(components, self.rank)
        return self.centred(rows) @ self.vectors[:, :k] / np.sqrt(self.values[:k])

    def deviation(self, rows: np.ndarray) -> np.ndarray:
        """Exact sum of (n * x - S)^2 of each row."""
        wide = max(int(abs(rows).max(initial=0)) * self.n, int(abs(self.sums).max(initial=0))) * 2
        apart = (rows * self.n - self.sums) if wide < 1 << 62 else np.array([[self.n * int(a) - int(s) for a, s in zip(r, self.sums)] for r in rows], object)
        most = int(abs(apart).max(initial=0))
        if most * most * rows.shape[1] >= 1 << 63:
            exact = [sum(int(a) ** 2 for a in r) for r in apart]
            if max(exact) >= 1 << 63:
                raise OverflowError("a deviation does not fit 64 bits")
            return np.array(exact, np.int64)
        return (apart * apart).sum(1).astype(np.int64)


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct vectors ``fit`` (x), a stored table."""
    start = spectrum(fit)
    if start is None:
        return None
    dim, spark = len(start.mean), fit.sparkSession
    first = spark.sparkContext.broadcast(Whitening(start.n, start.sums, start.values[::-1], start.vectors[:, ::-1]))
    ritz = sum_of_products(fit, dim, lambda rows: first.value.centred(rows) @ first.value.vectors) / start.n
    values, turn = np.linalg.eigh(ritz)
    vectors = first.value.vectors @ turn[:, ::-1]
    vectors /= np.sqrt((vectors * vectors).sum(0))
    vectors *= np.where(vectors[abs(vectors).argmax(0), np.arange(dim)] < 0, -1.0, 1.0)       # the largest entry is positive
    out = Whitening(start.n, start.sums, np.maximum(values[::-1], 0.0), vectors)
    k = min(components, out.rank)
    if k:
        model = spark.sparkContext.broadcast(out)
        out.identity_error = float(abs(sum_of_products(fit, k, lambda rows: model.value.whitened(rows, k)) / out.n - np.eye(k)).max())
    return out


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = integers(vectors, id_column, vector)
    fit = stored(rows.select("x").distinct(), "fit_list").repartition(shuffle_partitions(spark), "x")     # small files would share a task
    model = fit_whitening(fit, components)
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            if not b.num_rows or m is None:
                continue
            x = matrix(b.column("x"))
            n, k, have = len(x), min(components, x.shape[1]), min(components, m.rank)
            w = np.full((n, k), np.nan)
            w[:, :have] = m.whitened(x, components)
            explained = np.full(k, np.nan) if m.explained is None else m.explained[:k]
            yield pa.RecordBatch.from_arrays([
                b.column("id").take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, m.n)),
                pa.array(np.repeat(m.deviation(x), k)), pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(explained, n), from_pandas=True),
                pa.array(np.full(n * k, np.nan if m.identity_error is None else m.identity_error), from_pandas=True)], names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embeddings, up to 16 components a vector."""
    return whiten(table(spark, sf_dir, "embeddings"))
