import hashlib
import os
import random
import re

from tokenizers import Tokenizer

import corpus_pipeline
from sifter.llm import bpe, pii

from .test_dedup import brute_fingerprint, components
from .test_text import _words


def test_pipeline_against_brute_force(llm, tmp_path):
    rng = random.Random(8)
    vocab = {"en": "the of and house words river garden stone light north".split(), "de": "der die und haus nicht wort garten stein licht fluss".split()}
    text = lambda lang, n=40: " ".join(rng.choice(vocab[lang]) + rng.choice(["", "er", "en"]) for _ in range(n))
    bench = [(0, text("en", 14)), (1, text("de", 6))]
    rows = [(i, text(x), x, f"src{i % 3}") for i, x in enumerate(["en", "de"] * 15)]
    rows += [(40 + k, rows[k][1], rows[k][2], "copy") for k in range(4)]
    rows += [(50, text("en") + " " + bench[0][1] + " " + text("en"), "en", "src0"), (51, text("de") + " " + bench[1][1], "de", "src1")]
    rows += [(60, None, "en", "src0"), (61, "123 456", None, None), (62, text("en") + " mail bob.7@mail.example.com now", "en", "src2")]
    docs = llm.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(os.path.join(tmp_path, "documents.parquet"))
    llm.createDataFrame(bench, "item_id long, text string").write.parquet(os.path.join(tmp_path, "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(llm, str(tmp_path)).collect()}

    left = {i: t for i, t, _, _ in rows if t and re.search("[a-z]", t)}
    fps = {i: brute_fingerprint(t) for i, t in left.items()}
    comp = components(sorted(left), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 2)
    left = {i: t for i, t in left.items() if comp[i] == i}

    def dirty(t):
        ws = _words(t)
        for _, item in bench:
            iw = _words(item)
            n = min(10, len(iw))
            if any(ws[p:p + n] == iw[s:s + n] for s in range(len(iw) - n + 1) for p in range(len(ws) - n + 1)):
                return True
        return False
    left = {i: t for i, t in left.items() if not dirty(t)}
    assert set(got) == set(left) and 0 in got and 40 not in got and 50 not in got and 51 not in got
    ref = Tokenizer.from_file(bpe.default_vocabulary())
    for i, t in left.items():
        if i != 62:
            ids = ref.encode(t, add_special_tokens=False).ids
            assert got[i]["token_ids"] == ids
            assert got[i]["decoded_sha256"] == hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    decoded = ref.decode(got[62]["token_ids"], skip_special_tokens=False)
    assert "bob" not in decoded and "@</w>" in decoded
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "pii_surrogates", "bpe_encode"]
    assert pii.ENTITY


def test_every_stage_takes_an_empty_table(llm, tmp_path):
    docs = llm.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    llm.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(os.path.join(tmp_path, "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(llm, docs, str(tmp_path)).count() == 0
