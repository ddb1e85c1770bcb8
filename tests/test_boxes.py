"""Boxes of the undominated region: volumes, improvements and expectations against brute force."""

import math

import numpy as np
import pytest

from sifter.operators import boxes as box


def fronts(m, n, seed):
    rng = np.random.default_rng(seed)
    Y = np.round(rng.random((n, m)) * 8) / 8        # ties on purpose
    return Y


def dominated_share(Y, grid):
    out = np.zeros(len(grid), bool)
    for y in Y:
        out |= (y > grid).all(axis=1)
    return out


def cells(m, k=8):
    return np.stack(np.meshgrid(*[(np.arange(k) + 0.5) / k] * m), -1).reshape(-1, m)


@pytest.mark.parametrize("m,n", [(2, 1), (2, 40), (3, 1), (3, 25), (4, 12)])
def test_boxes_are_disjoint_and_cover_what_is_undominated(m, n):
    for seed in range(6):
        Y = fronts(m, n, seed)
        found = box.boxes_of(Y, np.zeros(m))
        grid = cells(m)
        hits = np.zeros(len(grid), int)
        for low, up in found:
            hits += ((grid >= np.array(low)) & (grid < np.array(up))).all(axis=1)
        assert (hits == ~dominated_share(Y, grid)).all()


def table(spark, Y):
    m = Y.shape[1]
    return spark.createDataFrame([tuple(map(float, r)) for r in Y], ", ".join(f"o{i} double" for i in range(m)))


@pytest.mark.parametrize("m,n", [(2, 60), (3, 60), (4, 20)])
def test_hypervolume_of_any_dimension(spark, m, n):
    Y = np.vstack([fronts(m, n, 3), fronts(m, n, 3)[:5], np.full((1, m), -0.5)])      # repeats, and a point below the reference
    want = dominated_share(Y, cells(m)).mean()
    names = [f"o{i}" for i in range(m)]
    df = table(spark, Y).repartition(5)
    assert box.hypervolume(df, names, [0.0] * m).first()[0] == pytest.approx(want, abs=1e-12)
    flipped = df.selectExpr("-o0 as o0", *names[1:])
    assert box.hypervolume(flipped, names, [0.0] * m, [False] + [True] * (m - 1)).first()[0] == pytest.approx(want, abs=1e-12)
    assert box.hypervolume(df.limit(0), names, [0.0] * m).first()[0] == 0.0


@pytest.mark.parametrize("m", [2, 3, 4])
def test_expected_improvement_equals_simulation(spark, m):
    rng = np.random.default_rng(m)
    Y = rng.random((8, m))
    boxes = box.undominated_boxes(table(spark, Y), [f"o{i}" for i in range(m)], [0.0] * m)
    cand = [(i, *[float(v) for _ in range(m) for v in (rng.random() * 1.2, 0.02 + 0.3 * rng.random())]) for i in range(12)]
    df = spark.createDataFrame(cand, "cand_id long, " + ", ".join(f"m{i} double, s{i} double" for i in range(m)))
    got = {r["cand_id"]: r["ehvi"] for r in box.expected_improvement(boxes, df).collect()}
    parts = np.array([[*low, *up] for low, up in box.boxes_of(Y, np.zeros(m))])
    for i, *ms in cand:
        draws = np.array(ms[::2]) + np.array(ms[1::2]) * rng.standard_normal((20_000, m))
        hvi = np.zeros(len(draws))
        for b in parts:
            hvi += np.prod(np.clip(np.minimum(draws, b[m:]) - b[:m], 0, None), axis=1)
        assert got[i] == pytest.approx(hvi.mean(), abs=5 * hvi.std() / math.sqrt(len(draws)) + 1e-9)


def test_a_joining_point_cuts_the_boxes(spark):
    for m in (2, 3):
        Y, p = fronts(m, 20, 9), [0.75] * m
        names = [f"o{i}" for i in range(m)]
        cut = box.dominate(box.undominated_boxes(table(spark, Y), names, [0.0] * m), p).toPandas().to_numpy()
        grid = cells(m)
        hits = sum(((grid >= b[:m]) & (grid < b[m:])).all(axis=1).astype(int) for b in cut)
        assert (hits == ~dominated_share(np.vstack([Y, p]), grid)).all()


def test_pieces_of_many_packs_add_up(spark, monkeypatch):
    monkeypatch.setattr(box, "PACK", 3)
    Y = np.random.default_rng(0).random((10, 2))
    boxes = box.undominated_boxes(table(spark, Y), ["o0", "o1"], [0.0, 0.0])
    df = spark.createDataFrame([(i, 0.5, 1e-9, 0.1 * i, 1e-9) for i in range(11)], "cand_id long, m0 double, s0 double, m1 double, s1 double")
    for r in box.expected_improvement(boxes, df).collect():
        y = np.array([0.5, 0.1 * r["cand_id"]])
        want = sum(np.prod(np.clip(np.minimum(y, np.array(up)) - np.array(low), 0, None)) for low, up in box.boxes_of(Y, np.zeros(2)))
        assert r["ehvi"] == pytest.approx(want, abs=1e-6)
