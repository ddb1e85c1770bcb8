"""Reproducible uniform draws from MD5, the same in Spark and in any SQL engine that has MD5."""

from __future__ import annotations

import math
import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 13         # hexadecimal digits used: 52 bits, exact in a double


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys' text and the seed only."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double") / float(16 ** DIGITS)


def uniform_sql(seed: int, *keys: str) -> str:
    """The same draw as a DuckDB expression."""
    text = " || '|' || ".join([*[f"({k})::VARCHAR" for k in keys], f"'{seed}'"])
    return f"(('0x' || substr(md5({text}), 1, {DIGITS}))::BIGINT / {float(16 ** DIGITS)!r})"


# Resampling draws: one MD5 of row and group of replicates gives a 32-bit draw for each of PER_HASH replicates.
PER_HASH = 4


def resampling_hash(seed: int, key: Column, group: Column) -> Column:
    """Row ``key``'s draws in the PER_HASH replicates of ``group``, eight hexadecimal digits each."""
    return F.md5(F.concat_ws("|", key.cast("string"), group.cast("string"), F.lit(str(seed))).cast("binary"))


def resampling_digits(seed: int, key: Column, b: Column) -> Column:
    """The draw of row ``key`` in replicate ``b``, as eight hexadecimal digits (they sort like the draws)."""
    group = F.floor(b / PER_HASH).cast("long")
    return F.substr(resampling_hash(seed, key, group), (F.pmod(b, F.lit(PER_HASH)) * 8 + 1).cast("int"), F.lit(8))


def resampling_uniform(seed: int, key: Column, b: Column) -> Column:
    """The draw in [0, 1) of row ``key`` in replicate ``b``."""
    return F.conv(resampling_digits(seed, key, b), 16, 10).cast("double") / float(1 << 32)


def resampling_uniform_sql(seed: int, key: str, b: str) -> str:
    """The same draw as a DuckDB expression."""
    text = f"({key})::VARCHAR || '|' || (({b}) // {PER_HASH})::VARCHAR || '|{seed}'"
    return f"(('0x' || substr(md5({text}), (({b}) % {PER_HASH} * 8 + 1)::INT, 8))::BIGINT / {float(1 << 32)!r})"


def resampling_uniforms(seed: int, keys, n_replicates: int):
    """The same draws as a numpy matrix, rows x replicates."""
    return resampling_draws(seed, keys, n_replicates).T / float(1 << 32)


def resampling_draws(seed: int, keys, n_replicates: int):
    """The draws' 32 bits as a numpy matrix, replicates x rows."""
    groups = -(-n_replicates // PER_HASH)
    keys = np.asarray(keys, dtype=np.int64)
    out = np.empty((groups * PER_HASH, len(keys)), np.uint32)
    text = keys.astype("S20")
    lengths = np.char.str_len(text)
    raw = text.view(np.uint8).reshape(len(keys), 20)
    for length in np.unique(lengths):       # rows of equally long keys have the same message but for the key's digits
        own = np.flatnonzero(lengths == length)
        for at in range(0, len(own), HASHED_ROWS):
            rows = own[at:at + HASHED_ROWS]
            if rows[-1] - rows[0] == len(rows) - 1:     # neighbours
                rows = slice(rows[0], rows[-1] + 1)
            digits = np.zeros((len(own[at:at + HASHED_ROWS]), -(-int(length) // 4) * 4), np.uint8)
            digits[:, :length] = raw[rows, :length]
            varying = np.ascontiguousarray(digits.view("<u4").T)
            for g in range(groups):
                out[g * PER_HASH:(g + 1) * PER_HASH, rows] = _md5(varying, int(length), f"|{g}|{seed}".encode())
    return out[:n_replicates]


HASHED_ROWS = 1 << 14
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xefcdab89, 0x98badcfe, 0x10325476)


def _md5(varying: np.ndarray, length: int, tail: bytes) -> np.ndarray:
    """MD5 of many messages at once (hashlib takes one a call): ``length`` bytes of their own, then ``tail``.

    ``varying`` holds the own bytes as little-endian words (words x rows), zero past ``length``.  Returns the digests
    as four big-endian words (4 x rows).
    """
    size = length + len(tail)
    if size > 55:
        raise ValueError("the text of a key, its group and the seed must fit one MD5 block")
    rest = struct.unpack("<16I", bytes(length) + tail + b"\x80" + bytes(55 - size) + struct.pack("<Q", 8 * size))
    words = [varying[j] | np.uint32(w) if j < len(varying) else None for j, w in enumerate(rest)]
    a, b, c, d = (np.full(varying.shape[1], v, np.uint32) for v in _START)
    for i in range(64):
        if i < 16:
            f, g = c ^ d, i
            f &= b
            f ^= d
        elif i < 32:
            f, g = b ^ c, (5 * i + 1) % 16
            f &= d
            f ^= c
        elif i < 48:
            f, g = b ^ c, (3 * i + 5) % 16
            f ^= d
        else:
            f, g = ~d, 7 * i % 16
            f |= b
            f ^= c
        f += a
        if words[g] is None:
            f += np.uint32((_SINES[i] + rest[g]) % (1 << 32))
        else:
            f += words[g]
            f += np.uint32(_SINES[i])
        turn = _TURNS[i // 16][i % 4]
        high = f >> np.uint32(32 - turn)
        f <<= np.uint32(turn)
        f |= high
        f += b
        a, d, c, b = d, c, b, f
    return np.stack([x + np.uint32(v) for x, v in zip((a, b, c, d), _START)]).byteswap()
