"""BPE encoding by backtracking over longest matches, decoding through an offset table.

A word is a string over 512 symbols: 256 bytes and 256 word-ending bytes.  An Aho-Corasick
automaton over the vocabulary's symbol strings gives, for every start in the word, the longest token
there.  The encoder takes the longest token, keeps it if it is compatible with the token before,
else tries the next shorter prefix token, else steps back; a bit per position that led nowhere
keeps the work linear.  Two tokens are compatible if undoing merges from the boundary outward, newest
first, never meets a pair that would have merged earlier: the result is exactly what applying the
merges in rank order gives.  A pair's answer is looked up in a table filled on first use.

Decoding gathers byte ranges: token i is ``blob[offset[i]:offset[i + 1]]``; the same gather over a
second table spells the ids in decimal.

Scale: one pass over the texts, no shuffle.  Only the vocabulary (a fixed size) is broadcast.  Each
worker remembers the ids of at most ``cache_words`` white-space separated chunks; the cache is emptied
when full, which changes speed only.

Defined cases: a null text counts as empty (no tokens, the SHA-256 of nothing); very long texts are
handled chunk by chunk; repeated rows and ids each give a row; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm.common import prepare, table

# Fixed values of the tokenizer format: its word pattern, the ending of a word, the symbol order.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]

CACHE_WORDS = 400_000
SEPARATORS = "\x1c\x1d\x1e\x1f"        # str.split() parts at these, the tokenizer does not
_MODELS: dict[str, "Encoder"] = {}


def load_spec(path: str) -> dict:
    """Vocabulary, merges and added tokens of a word-BPE tokenizer file, as plain lists."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    model = raw["model"]
    if model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END:
        raise ValueError("expected a BPE vocabulary whose words end in " + WORD_END)
    added = {t["content"]: t["id"] for t in raw["added_tokens"]}
    size = max([*model["vocab"].values(), *added.values()]) + 1
    tokens: list[str] = [""] * size
    for text, i in [*model["vocab"].items(), *added.items()]:
        tokens[i] = text
    merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
    ids = model["vocab"]
    spec = {"tokens": tokens, "merges": [(ids[a], ids[b], ids[a + b]) for a, b in merges], "added": added}
    spec["key"] = hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()
    return spec


def byte_chars() -> list[str]:
    """The printable character that stands for each byte."""
    spare = iter(range(256, 512))
    return [chr(b) if b in set(PRINTABLE) else chr(next(spare)) for b in range(256)]


class Encoder:
    """Automaton, pair-compatibility table and offset tables of one vocabulary."""

    def __init__(self, spec: dict):
        import ahocorasick
        import regex
        self.added = spec["added"]
        self.words = regex.compile(WORD_PATTERN)
        self.spaces = regex.compile(r"\s+")
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        tokens = spec["tokens"]
        ids = {t: i for i, t in enumerate(tokens)}
        chars = byte_chars()
        self.inner = [ids[c] for c in chars]                 # symbol id of a byte inside a word
        self.final = [ids[c + WORD_END] for c in chars]      # and at its end
        base = [*self.inner, *self.final]
        self.spelling = {i: chr(i + 1) for i in base}        # a symbol is one character of the automaton's alphabet
        self.inner_char, self.final_char = [self.spelling[i] for i in self.inner], [self.spelling[i] for i in self.final]
        self.rank = dict.fromkeys(base, -1)                  # symbols exist before any merge
        self.parts = {i: (i, i) for i in base}
        self.merged: dict[tuple[int, int], int] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        automaton = ahocorasick.Automaton()
        for i in base:
            automaton.add_word(self.spelling[i], (i, 1))
        for r, (a, b, c) in enumerate(spec["merges"]):
            self.merged.setdefault((a, b), r)
            # a token stands only if its own two parts survive until the merge that makes it
            if c not in self.rank and a in self.rank and b in self.rank and self._stable(a, b, r):
                self.rank[c], self.parts[c] = r, (a, b)
                self.spelling[c] = self.spelling[a] + self.spelling[b]
                automaton.add_word(self.spelling[c], (c, len(self.spelling[c])))
        automaton.make_automaton()
        self.automaton = automaton
        self.length = {i: len(s) for i, s in self.spelling.items()}
        self.by_spelling = {s: i for i, s in self.spelling.items()}
        self.shorter: dict[int, int] = {}
        for i, s in self.spelling.items():
            self.shorter[i] = next((self.by_spelling[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.by_spelling), -1)
        self.text_table = offset_table([t.encode() + b" " for t in tokens])
        self.id_table = offset_table([b"%d " % i for i in range(len(tokens))])
        self.cache: dict[str, bytes] = {}
        self.cache_words = CACHE_WORDS

    def _stable(self, left: int, right: int, before: int) -> bool:
        """No merge of rank < ``before`` crosses the boundary while both sides are built up.

        Undo the newer of the two boundary tokens step by step.  At each stage the pair at the
        boundary existed only until that token was made, so a merge crossing it must come earlier than
        that (ties: the leftmost merge wins, so the left token's own rank still blocks, the right's does not).
        """
        limit = before
        while True:
            r = self.merged.get((left, right))
            if r is not None and r < limit:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, self.parts[left][1]
            else:
                limit, right = b + 1, self.parts[right][0]

    def fits(self, left: int, right: int) -> bool:
        got = self.compatible.get((left, right))
        if got is None:
            if len(self.compatible) > CACHE_WORDS:
                self.compatible.clear()
            got = self.compatible[left, right] = self._stable(left, right, 1 << 60)
        return got

    def encode_word(self, data: bytes) -> list[int]:
        """Ids of one word's bytes."""
        n = len(data)
        spelled = "".join([self.inner_char[x] for x in data[:-1]]) + self.final_char[data[-1]]
        longest = [-1] * n
        for end, (token, size) in self.automaton.iter(spelled):     # ends grow, so the last match of a start is its longest
            longest[end + 1 - size] = token
        if longest[0] >= 0 and self.length[longest[0]] == n:
            return [longest[0]]                                     # a token that stands is its own encoding
        out: list[int] = []
        dead = bytearray(n + 1)
        pos, token = 0, longest[0]
        while pos < n:
            while token >= 0 and (dead[pos + self.length[token]] or (out and not self.fits(out[-1], token))):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                pos += self.length[token]
                token = longest[pos] if pos < n else -1
            else:                                   # no token continues from here: step back and shorten
                dead[pos] = 1
                token = out.pop()
                pos -= self.length[token]
        return out

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids (int32 bytes) of a text without white space or added tokens."""
        if chunk.isascii() and chunk.isalpha():         # normal already, and one word of the pattern
            return self._word(chunk.lower())
        text = unicodedata.normalize("NFC", chunk)
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()   # no final-sigma rule
        return b"".join([self._word(w) for w in self.words.findall(text)])

    def _word(self, word: str) -> bytes:
        ids = self.cache.get(word)
        if ids is None:
            ids = array("i", self.encode_word(word.encode())).tobytes()
            if len(word) <= 64 and len(self.cache) <= self.cache_words:
                self.cache[word] = ids
        return ids

    def _ordinary(self, text: str) -> bytes:
        chunks = self.spaces.split(text) if any(c in text for c in SEPARATORS) else text.split()
        cache = self.cache
        if len(cache) > self.cache_words:
            cache.clear()
        try:
            return b"".join([cache[c] for c in chunks])
        except KeyError:
            out = []
            for c in chunks:
                ids = cache.get(c)
                if ids is None:
                    ids = self.encode_chunk(c)
                    if len(cache) <= self.cache_words and len(c) <= 64:
                        cache[c] = ids
                out.append(ids)
            return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        if self.special is None or not any(t in text for t in self.added):
            return np.frombuffer(self._ordinary(text), np.int32)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._ordinary(text[at:m.start()]), np.int32(self.added[m[0]]).tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*out, self._ordinary(text[at:])]), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens' texts, a space between them."""
        return gather(self.text_table, ids)[:-1]

    def spell(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, a space between them."""
        return gather(self.id_table, ids)[:-1]


def offset_table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def gather(tab: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> bytes:
    """The byte ranges of ``ids``, one after the other, in blocks of bounded size."""
    blob, off = tab
    out = []
    for i in range(0, len(ids), 1 << 18):
        part = ids[i:i + (1 << 18)]
        start, size = off[part], off[part + 1] - off[part]
        ends = np.cumsum(size)
        out.append(blob[np.repeat(start - ends + size, size) + np.arange(ends[-1])].tobytes())
    return b"".join(out)


def encoder(spec: dict) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if spec["key"] not in _MODELS:
        _MODELS[spec["key"]] = Encoder(spec)
    return _MODELS[spec["key"]]


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = True, cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and token_ids, if asked) of every row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    spec = spark.sparkContext.broadcast(load_spec(path or default_vocabulary()))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        enc.cache_words = cache_words
        sha = hashlib.sha256
        for b in batches:
            n, spelled, decoded, ids = [], [], [], []
            for t in b.column("text"):
                got = enc.encode(t.as_py() or "")
                n.append(len(got))
                spelled.append(sha(enc.spell(got)).hexdigest())
                decoded.append(sha(enc.decode(got)).hexdigest())
                if with_ids:
                    ids.append(got)
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(spelled, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded text of every document."""
    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)
