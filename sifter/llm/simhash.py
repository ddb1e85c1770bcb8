"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is the bitwise majority of the shingles' XXH64.  Two fingerprints within
``tau`` bits are found by the pigeonring principle: cut the 64 bits into ``m`` segments on a ring;
if the total difference is <= tau, some start segment exists from which every chain of l = 1..m
consecutive segments differs in at most floor(l * tau / m) bits.  Chains of up to ``chain`` segments
are the join key (one side lists the fingerprint, the other the variants within the chain's
proportional budget), the longer chains are checked on the joined pair, and only then the full
Hamming distance.

Scale: texts are read once, by Arrow batch, and only (id, text hash, fingerprint) go on.  Equal
fingerprints are merged before the search, so copies never meet in a bucket.  A fingerprint has at
most C(64,1)+..+C(64,tau) neighbours, whatever the size of its group, so links stay linear in the
number of fingerprints.  Components run over stored link tables, see ``components``.  Rows meet their fingerprint's
component and their group's first row by ``spread_join``: frequent keys are looked up apart.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; rows that
repeat an id each keep a result row; a null id never becomes a component id unless its whole group
has none (then component_id is null); an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.functions.broadcasting import shuffled, shuffled_beyond, spread_join
from sifter.llm.common import prepare, stored, table, text_key
from sifter.llm.components import connected_components

SEED = 42
BITS = 64
_CHUNK = 1 << 16


def simhash(text: str | None, shingle: int = 3) -> int:
    """Fingerprint of a text as an unsigned 64-bit number (bit set in over half the hashes)."""
    from xxhash import xxh64_intdigest
    words = text.encode("utf-8").lower().split() if text else []     # bytes.lower: A-Z only; ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, _CHUNK):
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[i:i + _CHUNK], ends[i:i + _CHUNK])],
                     dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) for every row of ``docs`` (doc_id, text); fp is the signed 64-bit pattern."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t.as_py(), shingle) for t in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fp)],
                                             ["doc_id", "text_hash", "fp"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_hash"), F.col("text"))
    return slim.mapInArrow(run, "doc_id long, text_hash long, fp long")


def segment_bounds(m: int) -> list[tuple[int, int]]:
    """(shift, width) of the m ring segments of a 64-bit fingerprint, from the high end."""
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(BITS - cuts[i + 1], cuts[i + 1] - cuts[i]) for i in range(m)]


def chain_variants(start: int, chain: int, m: int, tau: int) -> list[int]:
    """XOR masks over segments start..start+chain-1 that stay within every chain budget floor(l*tau/m)."""
    bounds = segment_bounds(m)
    ring = [bounds[(start + k) % m] for k in range(chain)]
    bits = [(k, shift + b) for k, (shift, width) in enumerate(ring) for b in range(width)]
    budget = [(k + 1) * tau // m for k in range(chain)]
    out = []
    for r in range(budget[-1] + 1):
        for pick in combinations(bits, r):
            if all(sum(1 for k, _ in pick if k <= upto) <= budget[upto] for upto in range(chain)):
                out.append(sum(1 << b for _, b in pick))
    return out


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def _mask(start: int, chain: int, m: int) -> int:
    bounds = segment_bounds(m)
    return sum(((1 << w) - 1) << s for s, w in (bounds[(start + k) % m] for k in range(chain)))


def hamming_links(fps: DataFrame, tau: int = 2, m: int = 4, chain: int = 3) -> DataFrame:
    """Pairs (u, v), u < v, of distinct fingerprints (column ``fp``) at most ``tau`` bits apart.

    Segment ``start`` and its ``chain`` successors give the join key; chains longer than that are
    checked against their budgets on the pair, then the full distance.  A pair that several starts
    accept is kept by ``distinct`` once.  The join always shuffles: the probe side is well over a hundred times
    the fingerprints, which Spark's estimate does not see.
    """
    masks = [_signed(_mask(s, chain, m)) for s in range(m)]
    one = F.col("fp")
    exact = F.array(*[F.struct(F.lit(s).alias("s"), one.bitwiseAND(F.lit(masks[s])).alias("k")) for s in range(m)])
    index = fps.select(one.alias("u"), F.explode(exact).alias("x")).select("u", "x.s", "x.k")
    flips = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(masks[s]).alias("mask"), F.lit(_signed(v)).alias("flip"))
                      for s in range(m) for v in chain_variants(s, chain, m, tau)])
    probe = (fps.select(one.alias("v"), F.explode(flips).alias("x"))
             .select("v", F.col("x.s").alias("s"),
                     F.col("v").bitwiseAND(F.col("x.mask")).bitwiseXOR(F.col("x.flip")).alias("k")))
    diff = F.col("u").bitwiseXOR(F.col("v"))
    pairs = shuffled(index).join(shuffled(probe), ["s", "k"]).where("u < v")
    for longer in range(chain + 1, m + 1):          # the ring's remaining chains, then the whole distance
        budget = longer * tau // m
        fits = F.lit(False)
        for s in range(m):
            fits = fits | ((F.col("s") == s) & (F.bit_count(diff.bitwiseAND(F.lit(_signed(_mask(s, longer, m))))) <= budget))
        pairs = pairs.where(fits)
    return pairs.where(F.bit_count(diff) <= tau).select("u", "v").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, tau: int = 2) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable through links of at most ``tau`` bits, itself included.
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    ids = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fp_ids")
    comp = connected_components(hamming_links(ids.select("fp"), tau))
    n = ids.count()
    linked = ids.join(shuffled_beyond(comp, n), F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("component", "fp"))
    low = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = linked.select("fp", "root").join(shuffled_beyond(low, n), "root")
    of_fp = stored(of_fp, "fp_components")
    return spread_join(rows, of_fp, ["fp"], "inner").select("doc_id", "text_hash", "fp", "component_id", "root")


def hex_fp(col: str = "fp"):
    """A signed 64-bit fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document: 3-word shingles, at most 2 differing bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, tau=2)
    return found.select("doc_id", hex_fp().alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, tau: int = 2) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the smallest (doc_id, text hash), null ids last.

    Rows that repeat both id and text of the one that stays are themselves reduced to one row.
    """
    found = near_duplicates(docs, shingle, tau)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"))
    rows = stored(found.withColumn("rank", rank).groupBy("root", "rank").agg(F.count("*").alias("n")), "ranked")
    first = stored(rows.groupBy("root").agg(F.min("rank").alias("first")), "group_first")
    judged = spread_join(rows, first, ["root"], "inner")           # a group of a third of all documents is not one task's
    pick = [F.col("rank.doc_id").alias("k_id"), F.col("rank.text_hash").alias("k_hash")]
    gone = judged.where("rank <> first").select(*pick)
    repeated = judged.where("rank = first and n > 1").select(*pick)
    d = docs.alias("d")
    here = (F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.k_id"))
            & (F.xxhash64(F.col("d.text")) == F.col("k.k_hash")))
    out = d.join(gone.alias("k"), here, "left_anti")
    if repeated.isEmpty():
        return out
    repeated = stored(repeated, "repeated").alias("k")
    once = out.alias("d").join(repeated, here, "left_semi").dropDuplicates(["doc_id", "text"])
    return out.alias("d").join(repeated, here, "left_anti").unionByName(once)
