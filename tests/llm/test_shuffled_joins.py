"""Joins whose sides Spark takes for small but are not: never broadcast beyond the measured bound, same rows."""

from itertools import combinations

import numpy as np

from sifter.functions import broadcasting
from sifter.llm import components, decontaminate, simhash
from sifter.llm.decontaminate import drop_contaminated


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _fingerprints(llm, n=300):
    rng = np.random.default_rng(5)
    own = rng.integers(-2 ** 63, 2 ** 63 - 1, n, dtype=np.int64)
    near = own[:40] ^ (np.int64(1) << rng.integers(0, 62, 40)) ^ np.int64(1)
    return llm.createDataFrame([(int(x),) for x in {*own.tolist(), *near.tolist()}], "fp long")


def test_variants_of_fingerprints_are_not_broadcast(llm, tmp_path):
    _fingerprints(llm).write.parquet(str(tmp_path / "fps"))
    fps = llm.read.parquet(str(tmp_path / "fps"))       # a few kilobytes of file: far below Spark's threshold
    links = simhash.hamming_links(fps, tau=2)
    plan = _plan(links)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    all_fps = sorted(r["fp"] for r in fps.collect())
    want = {(a, b) for a, b in combinations(all_fps, 2) if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 2}
    assert {(r["u"], r["v"]) for r in links.collect()} == want and len(want) >= 30


def test_tables_beyond_the_bound_are_shuffled(llm, monkeypatch, tmp_path):
    llm.createDataFrame([(i + 1, i) for i in range(0, 60, 2)] + [(2, 1), (40, 7)], "u long, v long").write.parquet(str(tmp_path / "links"))
    links = llm.read.parquet(str(tmp_path / "links"))
    want = sorted(map(tuple, components.connected_components(links).collect()))
    assert "Broadcast" in _plan(components._small_star(links, 32)) and broadcasting.BROADCAST_BYTES > 0
    docs = llm.createDataFrame([(i, f"word{i % 7} and more of text {i % 7} here") for i in range(50)], "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs).collect())
    monkeypatch.setattr(broadcasting, "BROADCAST_BYTES", 0)
    assert "Broadcast" not in _plan(components._large_star(links, 32)) + _plan(components._small_star(links, 32))
    assert sorted(map(tuple, components.connected_components(links).collect())) == want
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == kept
    rows = llm.range(100).selectExpr("id % 10 as a", "id")
    rows.select("a").distinct().selectExpr("a", "a * 2 as b").write.parquet(str(tmp_path / "lookup"))
    joined = broadcasting.spread_join(rows, llm.read.parquet(str(tmp_path / "lookup")), ["a"])
    assert "SortMergeJoin" in _plan(joined) and joined.where("b = a * 2").count() == 100


def test_candidates_beyond_the_bound_are_shuffled(llm, monkeypatch):
    passage = " ".join(f"t{i}" for i in range(30))
    docs = llm.createDataFrame([(i, f"some words {i} " + (passage if i % 3 == 0 else "of their own")) for i in range(30)], "doc_id long, text string")
    items = llm.createDataFrame([("a", passage)], "item_id string, text string")
    for limit in (32 << 20, 0):
        monkeypatch.setattr(broadcasting, "BROADCAST_BYTES", limit)
        plan = _plan(decontaminate.Index(docs, items).phrase_matches())
        assert ("SortMergeJoin" in plan) == (limit == 0)
        assert sorted(r["doc_id"] for r in drop_contaminated(docs, items).collect()) == [i for i in range(30) if i % 3]
