"""Language identification by fusing evidence: text, declared markup language, address suffix, host.

log P(l | all) = log P(text | l) + log P(markup | l) + log P(suffix | l) + log P(l | host) + const.

* Text: a multinomial model of hashed byte trigrams per language, trained on a bounded sample of labelled
  documents (``per_language`` texts of each, chosen by hash).  Neighbouring trigrams depend on each other, so a
  text counts as at most ``EVIDENCE`` independent trigrams.
* Markup and suffix: P(value | l) from grouped sums of the text posteriors over all rows, smoothed.
* Host: P(l | host) from the same sums, smoothed towards the parent domain's, that towards the whole
  corpus'; a row's own vote is taken out of its host's sums first.

Scale: one pass over the texts; what is grouped and joined is a narrow stored table (ids, hosts, posteriors).
Sums aggregate on the map side, so a host with a third of all rows is one partial row per task; the
joins back are left equi-joins whose hot side AQE splits.

Defined cases: a null, empty or letterless text is no evidence (the other evidence decides); missing
markup, suffix or host likewise; a row without any evidence gets the corpus prior; ``lang`` is null if no
language was labelled at all; rows keep their repeats and null ids; empty tables give empty results;
clashing extra columns are ignored, ``keep_identified`` returns them untouched.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm.common import drawn, prepare, stored, table

GRAMS = 1 << 16
EVIDENCE = 40.0
PER_LANGUAGE = 400
MAX_LANGUAGES = 256
HOST_WEIGHT = 5.0          # pseudo-rows that a parent's distribution counts for
SMOOTH = 1.0
MIN_POSTERIOR = 0.5
_LETTERS = np.array([b | 0x20 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0x20 for b in range(256)], np.uint8)
_CHUNK = 1 << 16


def trigrams(data: bytes) -> Iterator[np.ndarray]:
    """Hashed byte trigrams that touch a letter, in blocks; ASCII case, digits and signs are levelled."""
    a = _LETTERS[np.frombuffer(data, np.uint8)]
    a = np.concatenate(([32], a, [32])).astype(np.uint32)
    for s in range(0, len(a) - 2, _CHUNK):
        x, y, z = a[s:s + _CHUNK + 2][:-2], a[s + 1:s + _CHUNK + 2][:-1], a[s + 2:s + _CHUNK + 2]
        n = min(len(x), len(z))
        x, y, z = x[:n], y[:n], z[:n]
        h = (x * 40503 + y * 30011 + z * 65003) & (GRAMS - 1)
        yield h[y != 32]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities of the hashed trigrams, shape (GRAMS, languages).

    The ``MAX_LANGUAGES`` most frequent labels are learned; further ones (stray labels, as a rule) are named in a warning and
    their documents are judged among the learned ones.
    """
    labelled = docs.where("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()        # a bounded number of rows
    if len(most) > MAX_LANGUAGES:
        warnings.warn(f"more than {MAX_LANGUAGES} languages are labelled; {most[-1]['lang']!r} ({most[-1]['n']} texts) and rarer ones are not learned", stacklevel=2)
    counts = {r["lang"]: r["n"] for r in most[:MAX_LANGUAGES]}
    languages = sorted(counts)
    keep = F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col("lang") == lang) & drawn("langid", ["doc_id", "text"], per_language / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        texts: Counter[str] = Counter()
        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text")):
                texts[lang] += 1
                into = sums.setdefault(lang, np.zeros(GRAMS, np.int64))
                for h in trigrams(t.as_py().encode()):
                    into += np.bincount(h, minlength=GRAMS)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array([-1, *at]), pa.array([texts[lang], *c[at]])], ["lang", "gram", "n"])

    sampled = labelled.where(keep).select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    totals = sampled.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()           # languages x GRAMS rows at most
    m = np.full((GRAMS, max(1, len(languages))), 0.5)
    lang, gram, n = (totals[c].to_numpy() for c in ("lang", "gram", "n"))
    unseen = set(languages) - set(lang[gram < 0])               # gram -1 counts texts
    if unseen:
        raise RuntimeError(f"no text of {sorted(unseen)} was drawn for training; raise per_language ({per_language})")
    if len(languages):
        np.add.at(m, (gram[gram >= 0], np.searchsorted(np.array(languages, object), lang[gram >= 0])), n[gram >= 0])
    return languages, np.log(m / m.sum(axis=0)).astype(np.float32)


def text_posteriors(rows: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """``rows`` (any columns, one called text) -> the same without text, with ``ll``, the tempered log-likelihoods."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    others = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in others]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["ll array<double>"])
    width = len(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = []
            for t in b.column("text"):
                total, n = np.zeros(width), 0
                for h in trigrams((t.as_py() or "").encode()):
                    total += m[h].sum(axis=0, dtype=np.float64)
                    n += len(h)
                out.append(total * (min(n, EVIDENCE) / n) if n else total)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(out, pa.list_(pa.float64()))], [*names, "ll"])

    return rows.select(*names, "text").mapInArrow(run, schema)


def _normalised(log: Column) -> Column:
    top = F.array_max(log)
    raw = F.transform(log, lambda v: F.exp(v - top))
    return F.transform(raw, lambda v: v / F.aggregate(raw, F.lit(0.0), lambda a, x: a + x))


def _posterior(name: str) -> Column:
    """exp and normalise an array of logs, worked out once."""
    return F.transform(F.array(_normalised(F.col(name))), lambda v: v)[0]


def _sums(df: DataFrame, by: list[str], width: int, prefix: str) -> DataFrame:
    """Summed posteriors per group, as one array column."""
    g = df.groupBy(*by).agg(*[F.sum(F.col("post")[i]).alias(f"{prefix}{i}") for i in range(width)])
    return g.select(*by, F.array(*[F.col(f"{prefix}{i}") for i in range(width)]).alias(prefix))


def identify(rows: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """``rows`` (ids ..., text, markup, suffix, host, parent) -> ids, lang, confidence, text_lang.

    markup and suffix are declared values of any spelling, host and parent the place and its domain; all may be null.
    """
    prepare(rows.sparkSession)
    ids = [c for c in rows.columns if c not in ("text", "markup", "suffix", "host", "parent")]
    width = len(languages)
    if not width:
        return rows.select(*ids, F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"))
    seen = text_posteriors(rows, languages, model).withColumn("post", _posterior("ll"))
    seen = stored(seen, "lang_evidence")
    total = seen.agg(*[F.sum(F.col("post")[i]).alias(f"t{i}") for i in range(width)]).first()
    corpus = np.array([total[i] or 0.0 for i in range(width)]) + SMOOTH
    share = corpus / corpus.sum()
    arr = lambda v: F.array(*[F.lit(float(x)) for x in v])
    fused, out = F.col("ll"), seen
    for what in ("markup", "suffix"):
        of = _sums(seen.where(F.col(what).isNotNull()), [what], width, what[0])
        out = out.join(of, what, "left")
        likely = lambda v, t, c: F.log((v + SMOOTH * t) / c)
        lift = F.transform(F.arrays_zip(F.col(what[0]).alias("v"), arr(share).alias("t"), arr(corpus).alias("c")), lambda z: likely(z["v"], z["t"], z["c"]))
        fused = F.zip_with(fused, F.coalesce(lift, arr([0.0] * width)), lambda a, b: a + b)
    out = out.join(_sums(seen.where("parent is not null"), ["parent"], width, "up"), "parent", "left")
    out = out.join(_sums(seen.where("host is not null"), ["host"], width, "at"), "host", "left")
    zero = arr([0.0] * width)
    without = lambda name: F.zip_with(F.coalesce(F.col(name), zero), F.when(F.col(name).isNotNull(), F.col("post")).otherwise(zero), lambda a, b: F.greatest(a - b, F.lit(0.0)))
    mixed = lambda counts, prior: _mix(counts, prior)
    prior = mixed(without("at"), mixed(without("up"), arr(share)))
    out = out.withColumn("prior", prior).withColumn("fused", F.zip_with(fused, F.col("prior"), lambda a, b: a + F.log(b)))
    out = out.withColumn("final", _posterior("fused"))
    pick = lambda c: F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position(c, F.array_max(c)).cast("int"))
    text_lang = F.when(F.array_max("ll") < 0, pick(F.col("ll")))
    return out.select(*ids, pick(F.col("final")).alias("lang"), F.array_max("final").alias("confidence"), text_lang.alias("text_lang"))


def _mix(counts: Column, prior: Column) -> Column:
    """(counts + HOST_WEIGHT * prior) / (sum of counts + HOST_WEIGHT)."""
    n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, prior, lambda c, p: (c + HOST_WEIGHT * p) / (n + HOST_WEIGHT))


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as evidence rows: text, and the source as host.  ``lang`` is what is learned, so it is no evidence."""
    return docs.select(F.lit("documents").alias("origin"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text",
                       F.lit(None).cast("string").alias("markup"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"),
                       F.lit(None).cast("string").alias("parent"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as evidence rows: visible text, the html tag's lang, the address's language segment or last label, the host."""
    html = F.col("html")
    hidden = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>"
    host = F.lower(F.regexp_extract("url", r"(?s)\A.*?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    segment = F.regexp_extract(F.lower("url"), r"(?s)\A.*?://[^/?#]*/([a-z]{2})(?:[/?#]|\z)", 1)
    last = F.regexp_extract(host, r"\.([^.]+)\z", 1)
    some = lambda c: F.when(c != "", c)
    return pages.select(F.lit("pages").alias("origin"), F.col("page_id").cast("long").alias("doc_id"), F.xxhash64("html").alias("text_hash"),
                        F.regexp_replace(html, hidden, " ").alias("text"),
                        some(F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""", 1))).alias("markup"),
                        F.coalesce(some(segment), some(last)).alias("suffix"), some(host).alias("host"),
                        some(F.regexp_extract(host, r"([^.]+\.[^.]+)\z", 1)).alias("parent"))


def keep_identified(docs: DataFrame, least: float = MIN_POSTERIOR) -> DataFrame:
    """``docs`` without those whose language stays unclear: fused posterior under ``least``, or a text without any letter."""
    prepare(docs.sparkSession)
    languages, model = train(docs)
    found = identify(document_rows(docs), languages, model)
    out = stored(found.where((F.col("confidence") < least) | F.col("text_lang").isNull()).select("doc_id", "text_hash").distinct(), "unidentified").alias("r")
    d = docs.alias("d")
    return d.join(out, F.col("d.doc_id").cast("long").eqNullSafe(F.col("r.doc_id")) & (F.xxhash64(F.col("d.text")) == F.col("r.text_hash")), "left_anti")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and every page: origin says which table the row's doc_id (or page_id) is of."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    languages, model = train(docs)
    rows = document_rows(docs).unionByName(page_rows(pages))
    found = identify(rows, languages, model)
    kept = (F.col("confidence") >= MIN_POSTERIOR) & F.col("text_lang").isNotNull()
    return found.select("origin", F.when(F.col("origin") == "documents", F.col("doc_id")).alias("doc_id"),
                        F.when(F.col("origin") == "pages", F.col("doc_id")).alias("page_id"), "lang", "confidence", "text_lang", kept.alias("kept"))
