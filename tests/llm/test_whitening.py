"""Whitening: secular equations, updates and merges against numpy; the whole operator by its definition."""
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sifter.llm import whitening
from sifter.llm.whitening import Spectrum, rank_one, secular_roots

SCHEMA = "vec_id long, embedding array<float>, label int, x array<long>, id string, n int"


def scatter(rows):
    c = rows - rows.mean(0)
    return c.T @ c


def holds(s, rows):
    want = scatter(rows)
    top = max(1.0, abs(want).max())
    assert abs(s.vectors @ np.diag(s.values) @ s.vectors.T - want).max() < 1e-9 * top
    assert abs(s.vectors.T @ s.vectors - np.eye(len(want))).max() < 1e-10
    assert (np.diff(s.values) >= -1e-9 * top).all()


def spectrum_of(rows):
    s = Spectrum(rows.shape[1])
    for x in rows:
        s.add(x)
    return s


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_roots_lie_between_the_poles(n):
    rng = np.random.default_rng(n)
    for spread in (1.0, 1e-7, 1e5):
        d, z = np.sort(rng.random(n)) * spread, rng.standard_normal(n)
        near, at = secular_roots(d, z, 0.7)
        want = np.linalg.eigvalsh(np.diag(d) + 0.7 * np.outer(z, z))
        assert abs(d[near] + at - want).max() <= 1e-12 * max(1.0, abs(want).max())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=2, max_size=9), st.data())
def test_equal_poles_and_zero_entries_are_deflated(poles, data):
    d = np.sort(np.array(poles, float))
    x = np.array(data.draw(st.lists(st.sampled_from([0.0, 1.0, -2.0, 1e-18, 0.5]), min_size=len(d), max_size=len(d))))
    values, vectors = rank_one(d, np.eye(len(d)), x, 0.5)
    assert abs(vectors @ np.diag(values) @ vectors.T - (np.diag(d) + 0.5 * np.outer(x, x))).max() < 1e-12
    assert abs(vectors.T @ vectors - np.eye(len(d))).max() < 1e-12


def test_updates_and_merges_equal_the_scatter_matrix():
    rng = np.random.default_rng(1)
    wide = np.floor(64 * rng.standard_normal((400, 12)) * rng.random(12)).astype(np.int64) + 1_000_000
    flat = wide @ np.diag([1] * 4 + [0] * 8)                        # zero variance in eight dimensions
    line = np.outer(np.arange(60), np.ones(5, np.int64))            # rank one
    for rows in (wide, flat, line, np.repeat(np.eye(6, dtype=np.int64) * 64, 5, 0), wide[:1], wide[:3]):
        holds(spectrum_of(rows), rows)
        if len(rows) > 3:
            a, b, c = (spectrum_of(r) for r in np.split(rows, [len(rows) // 3, len(rows) // 3 + 1]))
            a.combine(b)
            a.combine(c)
            holds(a, rows)
            assert a.n == len(rows) and (a.sums == rows.sum(0)).all()


def brute(rows, components=16):
    """{(vec_id, component): n, deviation, |whitened|, explained} by exact integers and a full eigendecomposition."""
    kept = []
    for i, v in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)))
    if not kept:
        return {}
    sizes = Counter(len(x) for _, x in kept)
    dim = max((n, size) for size, n in sizes.items())[1]
    kept = [r for r in kept if len(r[1]) == dim]
    fit = np.array(sorted({x for _, x in kept}), object)
    n, sums = len(fit), fit.sum(0)
    centred = ((fit * n - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = defaultdict(list)
    for i, x in kept:
        apart = np.array(x, object) * n - sums
        for k in range(min(components, dim)):
            flat = values[k] <= 1e-9 * max(values[0], 1e-300)
            w = None if flat else abs(float((apart / n).astype(float) @ vectors[:, k]) / math.sqrt(values[k]))
            out[i, k + 1].append((n, int((apart * apart).sum()), w, None if values[0] <= 0 else values[k] / values.sum()))
    return out


def compare(df, rows, components=16):
    want, got, errors = brute(rows, components), defaultdict(list), set()
    for r in df.collect():
        got[r["vec_id"], r["component"]].append((r["n"], r["deviation"], None if r["whitened"] is None else abs(r["whitened"]), r["explained"]))
        errors.add(r["identity_error"])
    assert got.keys() == want.keys()
    for key, ws in want.items():
        for g, w in zip(sorted(got[key], key=str), sorted(ws, key=str), strict=True):
            assert g[:2] == w[:2]
            assert (g[2] is None) == (w[2] is None) and (w[2] is None or abs(g[2] - w[2]) < 1e-7)
            assert (g[3] is None) == (w[3] is None) and (w[3] is None or math.isclose(g[3], w[3], rel_tol=1e-6, abs_tol=1e-12))
    assert len(errors) <= 1
    return errors


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, [1], "z", 3) for i, v in rows], SCHEMA)


def test_the_operator_equals_its_definition(llm):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 20)) @ np.diag(np.linspace(0.2, 3, 20)) @ np.linalg.qr(rng.standard_normal((20, 20)))[0]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]            # a vector that a third of all rows share counts once
    errors = compare(whitening.whiten(frame(llm, rows)), rows)
    assert max(errors) < 1e-9


def test_one_sign_per_component_and_unit_variance(llm):
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.standard_normal((200, 6)) * [9, 5, 3, 2, 1, 0.5])]
    got = whitening.whiten(frame(llm, rows)).toPandas().pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert abs(got.T @ got / len(got) - np.eye(6)).max() < 1e-9 and abs(got.mean(0)).max() < 1e-9


def test_odd_rows(llm):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, None, 2.0]), (4, [nan, 0.0, 0.0]), (5, [inf, 0.0, 0.0]), (6, [1.0, 2.0, 3.0]), (6, [1.0, 2.0, 3.0]),
            (6, [4.0, 1.0, 0.0]), (None, [-1.0, 0.5, 2.0]), (7, [0.0, -0.0, 0.001]), (8, [1.0, 2.0]), (9, [1.0, 2.0, 3.0, 4.0]), (10, [-7.5, 1e-9, -1e-9])]
    compare(whitening.whiten(frame(llm, rows)), rows)


def test_flat_and_tiny_tables(llm):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [3.0, 2.0])], [(1, [0.0]), (2, [5.0]), (3, [9.0])]):
        compare(whitening.whiten(frame(llm, rows)), rows)
    far = [(1, [3e38, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 1.0]), (4, [0.0, 5.0])]
    assert {r["vec_id"] for r in whitening.whiten(frame(llm, far)).collect()} == {2, 3, 4}


def test_a_deviation_beyond_64_bits_is_refused():
    model = whitening.Whitening(2, np.array([2**45, 0]), np.ones(2), np.eye(2))
    with pytest.raises(OverflowError):
        model.deviation(np.array([[2**40, 0]]))
    assert model.deviation(np.array([[2**44, 3]])).tolist() == [36]
