"""Token files: blocks, files, encoding against the library, global starts."""
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sifter.llm import tokenfile
from sifter.llm.tokenfile import Chunks, TokenFile, TokenFileWriter, decode_block, encode_block


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(tokenfile.default_vocabulary())
    model.no_truncation()
    model.no_padding()
    return model


@pytest.fixture(scope="module")
def chunks():
    with open(tokenfile.default_vocabulary(), encoding="utf-8") as f:
        return Chunks(f.read())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.just(7), min_size=1, max_size=400), st.sampled_from([0, 50, 90, 98, 100]))
def test_a_block_gives_back_its_values(values, percentile):
    ids = np.array(values, np.uint32)
    assert decode_block(encode_block(ids, percentile), len(ids)).tolist() == values


@pytest.mark.parametrize("width", [1, 7, 8, 9, 15, 16, 17, 31, 32])
def test_packing_is_one_bit_string(width):
    """Every width is the same format: value after value, lowest bit first."""
    values = np.random.default_rng(width).integers(0, 1 << width, 1001, dtype=np.uint64).astype(np.uint32)
    bits = "".join(f"{v:0{width}b}"[::-1] for v in values.tolist())
    want = bytes(int(bits[i:i + 8].ljust(8, "0")[::-1], 2) for i in range(0, len(bits), 8))
    assert tokenfile.pack(values, width) == want and (tokenfile.unpack(want, len(values), width) == values).all()


def test_outliers_do_not_widen_a_block():
    ids = np.full(4096, 1000, np.uint32) + np.arange(4096, dtype=np.uint32) % 16
    plain = len(encode_block(ids))
    ids[[5, 4000]] = 4_000_000_000
    data = encode_block(ids)
    assert data[4] == 4 and len(data) == plain + 2 * 6          # width 4 bits, two exceptions of 6 bytes
    assert len(encode_block(np.full(4096, 9, np.uint32))) == tokenfile.BLOCK_HEAD.size


def test_a_file_reads_back_any_range(tmp_path):
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (0, 1, 3, 10_000, 0, 63, 64, 65, 1)]
    w = TokenFileWriter(str(tmp_path), "t", block=64)
    for i, d in enumerate(docs):
        w.add(None if i == 0 else -i, d)
    path, n, ids = w.close()
    f, whole = TokenFile(str(tmp_path), path), np.concatenate(docs)
    assert (n, ids, f.ids) == (len(docs), len(whole), len(whole))
    assert f.null_ids.tolist() == [True] + [False] * 8 and f.doc_ids[1:].tolist() == [-i for i in range(1, 9)]
    assert all((f.document(k) == d).all() for k, d in enumerate(docs))
    for first, last in ((0, len(whole)), (63, 65), (64, 128), (5000, 5000), (9999, 10_190)):
        assert (f.read(first, last) == whole[first:last]).all()
    assert [(a, b) for a, b, _ in f.spans(100)][:2] == [(0, 3), (3, 4)] and np.concatenate([x for *_, x in f.spans(100)]).tolist() == whole.tolist()


def test_a_damaged_or_foreign_file_is_refused(tmp_path):
    w = TokenFileWriter(str(tmp_path), "t")
    w.add(1, np.arange(9, dtype=np.uint32))
    path, *_ = w.close()
    raw = bytearray(open(path, "rb").read())
    raw[-tokenfile.FOOTER.size - 3] ^= 1
    for name, data in (("damaged", bytes(raw)), ("foreign", b"x" * 100), ("short", b"")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError):
            TokenFile(str(tmp_path), str(tmp_path / name))


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "a\x1c b", "a\x85 b", "a  b", "a　  b ", "it's we'll 'tis I'd", "<|endoftext|> a <|endoftext|>",
       "a <|endoftext|>b", "x" * 5000, "ab " * 3000, "\t\t a\r\n\r\n b", "🙂 ß ǅ İstanbul", "数 字 12345 6", "﻿ a", "a​ b", "a᠎ b", "<|endof text|>"]


def test_encoding_equals_the_library_on_odd_texts(library, chunks):
    for t in ODD * 2:                       # the second time from memory
        assert chunks.encode(t, None).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    texts = [t for t in ODD for _ in range(2)]
    for got, t in zip(chunks.encode_all(texts), texts, strict=True):
        assert got.tolist() == library.encode(t, add_special_tokens=False).ids + [2], repr(t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\x1c", " ", "a", "b's", "'", "12", ".", "é", "字", "the", "<|endoftext|>"]), max_size=14).map("".join))
def test_encoding_equals_the_library_on_mixed_pieces(library, chunks, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert chunks.encode(text, None).tolist() == want
    assert [x.tolist() for x in chunks.encode_all([text, "the end", text], None)] == [want, [1169, 886], want]


def brute(library, rows):
    out, at = [], 0
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_starts_lengths_and_checksums_over_many_files(llm, library, tmp_path):
    rows = [(i, f"Text number {i} " * (i % 7) + "long " * (9000 if i == 50 else 0)) for i in range(-5, 120)]
    docs = llm.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row long, part long").repartition(7)
    files = tokenfile.write_tokens(docs, str(tmp_path), file_ids=200, block=32)
    assert files.count() > 5
    assert sorted(tuple(r) for r in tokenfile.read_tokens(files, str(tmp_path)).collect()) == sorted(brute(library, rows))
    ids = {r["doc_id"]: r["token_ids"] for r in tokenfile.read_tokens(files, str(tmp_path), with_ids=True).collect()}
    assert ids[50] == library.encode(rows[55][1], add_special_tokens=False).ids + [2]


def test_runs_of_partitions_sum_to_the_same_starts(llm, library, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "RUN", 2)
    rows = [(i, f"w{i} " * (i % 5)) for i in range(200)]
    llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = llm.createDataFrame(rows, "doc_id long, text string")
        got = tokenfile.read_tokens(tokenfile.write_tokens(docs, str(tmp_path)), str(tmp_path)).collect()
    finally:
        llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(tuple(r) for r in got) == sorted(brute(library, rows))


def test_odd_documents_and_an_empty_table(llm, odd_docs, no_docs, library, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = [tuple(r) for r in tokenfile.read_tokens(tokenfile.write_tokens(odd_docs, str(tmp_path)), str(tmp_path)).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[2:])
    assert sorted((key(r) for r in got), key=str) == sorted((key(r) for r in brute(library, rows)), key=str)
    got.sort(key=lambda r: r[1])
    assert [r[1] for r in got] == np.concatenate(([0], np.cumsum([r[2] for r in got])))[:-1].tolist()
    assert [r[0] for r in got][:2] == [None, None] and [r[0] for r in got][2:] == sorted(r[0] for r in got if r[0] is not None)
    assert tokenfile.read_tokens(tokenfile.write_tokens(no_docs, str(tmp_path / "none")), str(tmp_path / "none")).count() == 0
