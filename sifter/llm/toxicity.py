"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) over the distinct hashed terms of a whole
text: its words and their 4- and 5-letter beginnings (so inflected forms share evidence).  The pairwise
part is what an additive model lacks: two terms may mean together what neither means alone.

Training uses a bounded sample of the labelled rows (documented parameter ``per_class``: about that many
of each label, chosen by a hash of the id), whose terms are hashed in Spark tasks; the machine is fitted on
the sample by AdaGrad with the classes' sampling rates undone in the intercept.  Scoring is one pass over
all texts with the weights broadcast (a fixed size, dims x (factors + 2) floats), no shuffle.

Defined cases: null and empty texts have no terms and get the score of the intercept; labels that are null are
not learned from, an id labelled more than once counts as toxic if any of its labels says so; without
any usable label every score is 0, with one class only the (smoothed) share of label 1; a sample without a class that
the labels have raises an error; a null doc_id is not held out; repeated rows each get their score; an empty table gives an empty result; other columns
are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm.common import drawn, prepare, stored, table

DIMS = 1 << 17
FACTORS = 8
PER_CLASS = 4000
EPOCHS = 10
WORD = re.compile(r"[^\W_]+")
_TERMS: dict[str, tuple[int, ...]] = {}
_TERMS_MAX = 300_000


def _word_terms(word: str) -> tuple[int, ...]:
    parts = [word] + [f"^{word[:n]}" for n in (4, 5) if len(word) > n]
    return tuple(crc32(p.encode()) % DIMS for p in parts)


def terms(text: str | None) -> np.ndarray:
    """Distinct hashed terms of a text, ascending."""
    if not text:
        return np.zeros(0, np.int32)
    if len(_TERMS) > _TERMS_MAX:
        _TERMS.clear()
    out: set[int] = set()
    for w in set(WORD.findall(text.lower())):
        got = _TERMS.get(w)
        if got is None:
            got = _word_terms(w)
            if len(w) <= 64:
                _TERMS[w] = got
        out.update(got)
    return np.sort(np.fromiter(out, np.int32, len(out)))


def significance(rows: list[np.ndarray], y: np.ndarray, least: float = 2.5) -> np.ndarray:
    """Per feature, by how much the root of its G statistic against the label exceeds ``least``.

    The value x_i of a present feature: terms whose link with the label chance explains count for nothing,
    so a machine trained on few labels doesn't learn the texts by heart.
    """
    flat = np.concatenate([*rows, np.zeros(0, np.int32)])
    side = np.repeat(y > 0.5, [len(r) for r in rows])
    n1, n0 = float((y > 0.5).sum()), float((y <= 0.5).sum())
    a, b = (np.bincount(flat[m], minlength=DIMS).astype(float) for m in (side, ~side))
    g = np.zeros(DIMS)
    for observed, share, total in ((a, n1, a + b), (b, n0, a + b), (n1 - a, n1, n1 + n0 - a - b), (n0 - b, n0, n1 + n0 - a - b)):
        expected = total * share / (n1 + n0)
        some = observed > 0
        g[some] += 2 * observed[some] * np.log(observed[some] / expected[some])
    return np.maximum(np.sqrt(np.maximum(g, 0)) - least, 0).clip(max=8).astype(np.float32)


class Machine:
    """Second-order factorization machine; a present feature has the value ``scale`` gives it."""

    def __init__(self, dims: int = DIMS, factors: int = FACTORS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0 = 0.0
        self.w = np.zeros(dims, np.float32)
        self.v = rng.normal(0, 0.01, (dims, factors)).astype(np.float32)
        self.scale = np.ones(dims, np.float32)

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, decay: float = 1e-3, seed: int = 7) -> Machine:
        """Stochastic AdaGrad on the logistic loss with weight decay."""
        self.scale = significance(rows, y)
        rows = [r[self.scale[r] > 0] for r in rows]
        rng = np.random.default_rng(seed)
        self.w0 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        gw, gv = np.full(len(self.w), 1.0, np.float32), np.full(self.v.shape, 1.0, np.float32)
        for epoch in range(epochs):
            for r in rng.permutation(len(rows)):
                x = rows[r]
                c = self.scale[x]
                v = self.v[x] * c[:, None]
                s = v.sum(axis=0)
                z = self.w0 + self.w[x] @ c + 0.5 * (s @ s - np.einsum("ij,ij->", v, v))
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[r]
                self.w0 -= rate * g / (1 + epoch)
                dw = g * c + decay * self.w[x]
                gw[x] += dw * dw
                self.w[x] -= rate * dw / np.sqrt(gw[x])
                dv = g * c[:, None] * (s - v) + decay * self.v[x]
                gv[x] += dv * dv
                self.v[x] -= rate * dv / np.sqrt(gv[x])
        return self

    def packed(self) -> np.ndarray:
        """One row per feature: weight, factors, squared length of the factors; a text's score needs their sums only."""
        v = self.v * self.scale[:, None]
        return np.concatenate([(self.w * self.scale)[:, None], v, (v ** 2).sum(axis=1, keepdims=True)], axis=1)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, float], dict[int, int]]:
    """Sampled (y, text) rows that may be learned from, the sampling rate and the count of each class."""
    usable = (labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.max(F.col("toxic").cast("int")).alias("y")).where(~held_out()))
    usable = stored(usable, "toxic_labels")
    count = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}       # two rows
    rate = {y: min(1.0, per_class / n) for y, n in count.items()}
    keep = F.lit(False)
    for y, p in rate.items():
        keep = keep | ((F.col("y") == y) & drawn("toxicity", ["doc_id"], p))
    picked = usable.where(keep)                                     # about 2 x per_class rows, whatever the input
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    return texts, rate, count


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine | float:
    """The fitted machine, or a constant probability if there is only one class to learn from."""
    texts, rate, count = training_rows(docs, labels, per_class)
    if set(count) != {0, 1}:
        return (count.get(1, 0) + 1) / (sum(count.values()) + 2) if count else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([terms(t.as_py()) for t in b.column("text")], pa.list_(pa.int32()))],
                                             ["doc_id", "y", "terms"])

    sample = texts.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, terms array<int>").toArrow()   # the bounded sample
    absent = {0, 1} - set(sample["y"].to_pylist())
    if any(rate[y] < 1 for y in absent):
        raise RuntimeError(f"no document of label {absent} was drawn; raise per_class ({per_class})")
    if absent:                                                      # labels of documents that the table does not have
        return (count[1] + 1) / (count[0] + count[1] + 2)
    order = np.argsort(sample["doc_id"].to_numpy(), kind="stable")
    lists, y = sample["terms"].to_pylist(), sample["y"].to_numpy()
    model = Machine().fit([np.array(lists[i], np.int32) for i in order], y[order].astype(float))
    model.w0 += float(np.log(rate[0] / rate[1]))                    # undo the unequal sampling of the classes
    return model


def score(docs: DataFrame, model: Machine | float) -> DataFrame:
    """(doc_id, held_out, score) of every row of ``docs``."""
    spark = docs.sparkSession
    constant = model if isinstance(model, float) else None
    shared = spark.sparkContext.broadcast(None if constant is not None else (model.w0, model.packed()))
    k = FACTORS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.empty(b.num_rows)
            for i, t in enumerate(b.column("text")):
                if constant is not None:
                    out[i] = constant
                    continue
                w0, rows = shared.value
                s = rows[terms(t.as_py())].sum(axis=0, dtype=np.float64)
                z = w0 + s[0] + 0.5 * (s[1:k + 1] @ s[1:k + 1] - s[k + 1])
                out[i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(out)], ["doc_id", "held_out", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole document, learned from the labelled rows that are not held out."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
