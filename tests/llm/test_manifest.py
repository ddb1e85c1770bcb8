"""Merkle manifest: trees by hand, odd rows, proofs that hold or break."""
import hashlib
import zlib

import pytest

from sifter.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, pos long, grp string, path string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(hashes, fanout=8):
    """(root, [siblings left and right of every leaf, level by level])."""
    ways = [[] for _ in hashes]
    groups, level = [[i] for i in range(len(hashes))], list(hashes)
    while len(level) > 1:
        up, up_groups = [], []
        for at in range(0, len(level), fanout):
            run = level[at:at + fanout]
            for j in range(len(run)):
                for leaf in groups[at + j]:
                    ways[leaf].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(sha("".join(run)))
            up_groups.append(sum(groups[at:at + fanout], []))
        level, groups = up, up_groups
    return level[0], ways


def brute(rows):
    def leaf(i, source, lang, n, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))
    langs = {}
    for i, text, lang, source, n in rows:
        low = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        own = leaf(i, source, lang, n, text)
        langs.setdefault(lang, []).append((i is not None, i or 0, own, i, leaf(i, source, lang, n, low) if hit else own))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        langs[lang].sort(key=lambda r: r[:3])
        trees[lang] = tree([r[2] for r in langs[lang]])
    root, over = tree([trees[x][0] for x in order])
    out = []
    for k, lang in enumerate(order):
        for r, way in zip(langs[lang], trees[lang][1]):
            steps, h = way + over[k], r[4]
            for left, right in steps:
                h = sha(left + h + right)
            out.append((r[3], r[2], trees[lang][0], root, sha("".join(a + b for a, b in steps)), h, h == root))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "g", "p") for r in rows], SCHEMA)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 600])
def test_trees_of_every_shape_equal_brute_force(llm, n):
    rows = [(i * 7 - 20, f"Text {i} Ünïcode A", "en", "web", i) for i in range(n)]
    assert rows_of(merkle.document_manifest(frame(llm, rows))) == sorted(brute(rows), key=str)


def test_many_languages_null_columns_ties_and_repeats(llm):
    rows = [(i, f"Doc {i}", f"l{i % 13}", None, None) for i in range(40)]
    rows += [(1, "A", None, "s", 1), (None, "B", None, None, None), (None, "C", "é", None, 3), (5, "Same", "z", None, 1), (5, "Same", "z", None, 1),
             (5, "Other", "z", None, 1), (6, None, "", "s", 0), (7, "", "", "s", 0), (8, "X" * 300_000, "en", "s", 1), (9, "only", "lone", "s", 4)]
    got = rows_of(merkle.document_manifest(frame(llm, rows)))
    assert got == sorted(brute(rows), key=str)
    assert {r[6] for r in got} == {True, False}


def test_only_changed_texts_break_the_proof(llm):
    rows = [(i, "no capitals" if i % 2 else "Capital", "en", "web", 7) for i in range(100)]
    for r in rows_of(merkle.document_manifest(frame(llm, rows))):
        assert r[6] == (bool(r[0] % 2) or zlib.crc32(str(r[0]).encode()) % 3 != 0)


def test_another_fanout_and_an_empty_table(llm):
    leaves = llm.createDataFrame([("=a", i, sha(str(i)), None) for i in range(11)], "grp string, id long, leaf string, other string")
    got = merkle.manifest(leaves, fanout=3).collect()
    root, ways = tree([sha(str(i)) for i in range(11)], 3)
    assert {r["root"] for r in got} == {root}
    assert {r["id"]: [(s["left"], s["right"]) for s in r["path"]] for r in got} == dict(enumerate(ways))
    assert merkle.document_manifest(frame(llm, [])).count() == 0
