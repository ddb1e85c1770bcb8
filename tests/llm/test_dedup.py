import random
import re

import numpy as np
import xxhash

from sifter.llm import covertree, simhash
from sifter.llm.components import connected_components


def brute_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if len(words) >= n else [" ".join(words)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def test_fingerprint_against_bit_by_bit():
    for t in ["", None, "a", "A b", "a b c", "A  b\tc d\x0be", "é É ß x y z", "x " * 70000]:
        assert simhash.simhash(t) == brute_fingerprint(t)


def test_pigeonring_finds_all_pairs_within_tau(llm):
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(6):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for tau, m, chain in ((2, 4, 3), (3, 4, 2), (2, 3, 1)):
        got = {tuple(sorted(r)) for r in simhash.hamming_links(llm.createDataFrame([(f,) for f in signed], "fp long"), tau, m, chain).collect()}
        want = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= tau}
        assert got == want


def test_components_of_chains_stars_and_nothing(llm):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, j) for j in range(8, 40)] + [(5, 5), (None, 3), (8, 7)]
    got = {r["node"]: r["component"] for r in connected_components(llm.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(7, 40), 7)}
    assert connected_components(llm.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {1}
    assert {r["component_id"] for r in rows if r["doc_id"] in (4, 5, 7) or (r["doc_id"] is None and r["fp"])} == {4}
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 6, 8, 9]
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


def test_repeated_rows_of_the_one_kept_become_one(llm):
    docs = llm.createDataFrame([(3, "a b c d"), (3, "a b c d"), (5, "a b c d"), (3, "quite another text here")], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.keep_one(docs).collect()) == ["a b c d", "quite another text here"]


def _vectors(seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 16))
    rows = [v.tolist() for v in x] + [(v + rng.normal(scale=s, size=16)).tolist() for v in x[:12] for s in (0.02, 0.08, 0.1, 0.3)]
    rows += [(3 * x[0]).tolist(), x[1].tolist(), x[1].tolist(), [1e-30] * 16, [2e30] * 16]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [0.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    return [(i, v, "junk") for i, v in enumerate(rows + odd)] + [(None, x[2].tolist(), "junk")]


def test_cover_tree_against_all_pairs(llm):
    data = _vectors()
    df = llm.createDataFrame(data, "vec_id long, embedding array<float>, cls string")
    good = {i: np.array(v, np.float32).astype(float) for i, v, _ in data if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}

    def cos(a, b):
        a, b = good[a], good[b]
        if len(a) != len(b):
            return -1
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return a @ b / np.sqrt((a @ a) * (b @ b))
    twins = {i for i in good if len(good[i]) == 16 and cos(i, 2) >= 0.95}          # the row without id is a copy of vector 2
    comp = components(list(good), lambda a, b: cos(a, b) >= 0.95)
    for pivots, block in ((1024, 2048), (4, 8)):
        got = covertree.near_duplicates(df, 0.95, pivots, block).collect()
        assert len(got) == len(data)
        for r in got:
            i = r["vec_id"]
            if i is None:
                assert r["n_links"] == len(twins) and r["component_id"] == comp[2] and r["kept"] is False
            elif i not in good:
                assert (r["n_links"], r["component_id"], r["kept"]) == (0, i, True)
            else:
                assert r["n_links"] == sum(cos(i, j) >= 0.95 for j in good if j != i) + (i in twins)
                assert r["component_id"] == comp[i] and r["kept"] == (comp[i] == i)
    assert covertree.near_duplicates(df.limit(0)).count() == 0
