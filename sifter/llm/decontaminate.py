"""Benchmark decontamination over a distributed positional inverted index, in DataFrame functions only.

A test item's windows are its runs of ``window`` consecutive words (all its words, if it has fewer).
1. Corpus frequencies of the test terms are counted over all documents.
2. Every window names its ``depth`` rarest terms; windows with a term the corpus lacks are out.
3. The index stores the postings (term, document, position) of those terms.
4. A posting minus the term's offset is a window start; the lists of a window's rarest terms are
   intersected by counting, per (document, window, start), how many of the terms agree.
5. The surviving starts are compared with the document's own words: exact phrase matches.
6. An item is covered by stretches of ``span`` words; where a stretch's rarest distinct terms lie within
   ``span`` words of a document, in any order, that is a proximity match of the item.

Scale: documents are tokenised three times (frequencies, postings, word counts) and never shuffled
as a whole: only postings of rare terms are.  Frequencies aggregate on the map side; a passage that a
third of all documents share costs its postings.  Term tables are broadcast only when their measured
bytes fit a bound and are shuffled otherwise; the same holds for the keys of documents to compare.

Words: A-Z lower-cased, runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.  Index terms are
these words and nothing is folded beyond them, so a word is the same term wherever it stands.

Defined cases: null or empty texts have no words and are never contaminated; items without words
match nothing; a null item_id is matched but not listed or counted; repeated items or documents each
keep their rows; an empty benchmark or document table gives clean or no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sifter.functions.broadcasting import broadcast_if_small, fits, shuffled
from sifter.llm.common import BROADCAST_BYTES, checked_broadcast, stored, table

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KEY_BYTES = 64                # a document's key in a broadcast table
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else; plain ASCII texts take the fast path to the same result."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(c, F.lit(""))), GAP), lambda w: w != "")


def doc_key(docs: DataFrame) -> list[Column]:
    """96 bits that name a document's id and text: results depend on nothing else."""
    return [F.xxhash64(docs["doc_id"], docs["text"]).alias("k"), F.hash(docs["text"]).alias("k2")]


def _tokens(docs: DataFrame, keyed: bool) -> DataFrame:
    """(k, k2, term, pos) for every word, A-Z lower-cased; pos counts from 0 over the words."""
    key = doc_key(docs) if keyed else []
    split = docs.select(*key, F.split(docs["text"], ANY_CASE_GAP).alias("parts"))
    # hashes and the leading gap are worked out per document, below the explode, not per word
    split = split.select(*["k", "k2"] * keyed, "parts", F.when(F.col("parts")[0] == "", 1).otherwise(0).alias("skip"))
    flat = split.select(*["k", "k2"] * keyed, "skip", F.posexplode_outer("parts").alias("at", "term"))    # outer: no filter that splits again
    return flat.where("term <> ''").select(*["k", "k2"] * keyed, ascii_lower(F.col("term")).alias("term"), *[(F.col("at") - F.col("skip")).alias("pos")] * keyed)


def _small(terms: DataFrame) -> DataFrame:
    """A stored table of strings, broadcast if its measured bytes fit the bound."""
    size = terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    return F.broadcast(terms) if size <= BROADCAST_BYTES else shuffled(terms)


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """(wid, phrase, len, item_id): one row for each distinct phrase and item that has it."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("ws")).where("size(ws) > 0")
    n = F.least(F.size("ws"), F.lit(window))
    w = w.select("item_id", "ws", n.alias("len"), F.explode(F.sequence(F.lit(1), F.size("ws") - n + 1)).alias("s"))
    return w.select("item_id", "len", F.array_join(F.slice("ws", F.col("s"), F.col("len")), " ").alias("phrase")).distinct()


def stretches_of(items: DataFrame, span: int) -> DataFrame:
    """(item_id, stretch): the word lists that cover an item, ``span`` words each (the last one ends with the item)."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("ws")).where("size(ws) > 0")
    first = F.greatest(F.size("ws") - span + 1, F.lit(1))
    starts = F.transform(F.sequence(F.lit(1), F.size("ws"), F.lit(span)), lambda s: F.least(s, first))
    return w.select("item_id", F.explode(F.array_distinct(F.transform(starts, lambda s: F.slice("ws", s, span)))).alias("stretch")).distinct()


class Index:
    """Postings of the rarest test terms over a corpus, and the window and item terms that look them up."""

    def __init__(self, docs: DataFrame, items: DataFrame, window: int = 10, depth: int = 2, near: int = 3, span: int = 20):
        self.docs, self.span = docs, span
        self.depth, self.near = depth, near
        self.window_items = stored(windows_of(items, window), "window_items")
        phrases = self.window_items.select("phrase", "len").distinct().withColumn("wid", F.monotonically_increasing_id())
        self.phrases = stored(phrases, "phrases")
        slots = self.phrases.select("wid", "len", F.posexplode(F.split("phrase", " ")).alias("off", "term"))
        stretch_terms = stretches_of(items, span).select("item_id", "stretch", F.explode(F.array_distinct("stretch")).alias("term"))
        vocabulary = stored(slots.select("term").unionByName(stretch_terms.select("term")).distinct(), "vocabulary")
        counts = _tokens(docs, False).join(_small(vocabulary), "term").groupBy("term").agg(F.count("*").alias("n"))
        self.counts = stored(counts, "term_counts")
        ranked = slots.join(self.counts, "term").withColumn(
            "rank", F.row_number().over(Window.partitionBy("wid").orderBy("n", "off")))
        whole = ranked.groupBy("wid").agg(F.count("*").alias("present"))
        anchors = ranked.where(F.col("rank") <= depth).join(whole, "wid").where("present = len")
        self.anchors = stored(anchors.select("wid", "len", "off", "term"), "anchors")
        rare = stretch_terms.join(self.counts, "term").withColumn(
            "rank", F.row_number().over(Window.partitionBy("item_id", "stretch").orderBy("n", "term")))
        terms = F.array_sort(F.collect_set(F.struct("rank", "term")))
        stretch_keys = rare.where(F.col("rank") <= near).groupBy("item_id", "stretch").agg(terms.alias("ts")).select("item_id", "ts").distinct()
        self.item_anchors = stored(stretch_keys.withColumn("sid", F.xxhash64("item_id", "ts")).select("item_id", "sid", F.explode("ts").alias("t"))
                                   .select("item_id", "sid", "t.term", "t.rank"), "item_anchors")
        looked_up = stored(self.anchors.select("term").unionByName(self.item_anchors.select("term")).distinct(), "looked_up")
        self.postings = stored(_tokens(docs, True).join(_small(looked_up), "term"), "postings")

    def candidates(self) -> DataFrame:
        """(k, k2, wid, start, len): starts on which all of a window's rarest terms agree."""
        start = F.col("pos") - F.col("off")
        adjusted = self.postings.join(_small(self.anchors), "term").withColumn("start", start).where("start >= 0")
        agreed = adjusted.groupBy("k", "k2", "wid", "start").agg(F.first("len").alias("len"), F.count_distinct("off").alias("agree"))
        return agreed.where(F.col("agree") >= F.least(F.col("len"), F.lit(self.depth))).drop("agree")

    def phrase_matches(self) -> DataFrame:
        """(k, k2, hits): per document the array of its exact matches (start, len, phrase)."""
        found = stored(self.candidates().join(F.broadcast(self.phrases) if self._phrases_fit() else shuffled(self.phrases), ["wid", "len"])
                       .groupBy("k", "k2").agg(F.collect_list(F.struct("start", "len", "phrase")).alias("cand")), "candidates")
        keys = found.select("k", "k2")
        hit_docs = (self.docs.select(*doc_key(self.docs), self.docs["text"].alias("text"))
                    .join(checked_broadcast(keys, KEY_BYTES), ["k", "k2"], "left_semi").dropDuplicates(["k", "k2"]))
        ws = hit_docs.select("k", "k2", words(F.col("text")).alias("ws")).join(found if fits(found) else shuffled(found), ["k", "k2"])
        same = lambda c: F.array_join(F.slice(F.col("ws"), c["start"] + 1, c["len"]), " ") == c["phrase"]
        return ws.select("k", "k2", F.filter("cand", same).alias("hits")).where("size(hits) > 0")

    def _phrases_fit(self) -> bool:
        return (self.phrases.agg(F.sum(F.octet_length("phrase") + 64)).first()[0] or 0) <= BROADCAST_BYTES

    def proximity_matches(self) -> DataFrame:
        """(k, k2, item_id, end, width): the rarest distinct terms of one of the item's stretches, all within ``span`` words, in any order.

        Along a document's positions, the last position of each term so far; the stretch ending at a position
        runs back to the oldest of them.  One pass over each (document, item, stretch) list, no pairs.
        """
        hits = self.postings.join(_small(self.item_anchors), "term").select("k", "k2", "item_id", "sid", "pos", "rank").distinct()
        needed = self.item_anchors.groupBy("item_id", "sid").agg(F.max("rank").alias("needed"))
        along = Window.partitionBy("k", "k2", "item_id", "sid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        last = [F.max(F.when(F.col("rank") == r, F.col("pos"))).over(along) for r in range(1, self.near + 1)]
        seen = hits.select("k", "k2", "item_id", "sid", "pos", F.array(*last).alias("last")).join(broadcast_if_small(needed), ["item_id", "sid"])
        width = F.col("pos") - F.array_min(F.filter("last", lambda p: p.isNotNull())) + 1
        full = F.size(F.filter("last", lambda p: p.isNotNull())) >= F.col("needed")
        return seen.where(full).select("k", "k2", "item_id", F.col("pos").alias("end"), width.alias("width")).where(F.col("width") <= self.span)


def covered(hits: Column) -> Column:
    """Number of words inside any of the matches, by one sweep over them in order of start."""
    spans = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("a"), (h["start"] + h["len"]).alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    step = lambda acc, h: F.struct(
        (acc["n"] + F.greatest(F.lit(0), h["b"] - F.greatest(h["a"].cast("long"), acc["upto"]))).alias("n"),
        F.greatest(acc["upto"], h["b"].cast("long")).alias("upto"))
    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, span: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near and the key of every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = Index(docs, items, window, span=span)
    matches = stored(index.phrase_matches(), "matches")
    by_item = (matches.select("k", "k2", F.explode(F.array_distinct(F.transform("hits", lambda h: h["phrase"]))).alias("phrase"))
               .join(index.window_items.select("phrase", "item_id").where("item_id is not null"), "phrase")
               .groupBy("k", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    near = index.proximity_matches().groupBy("k", "k2").agg(F.count_distinct("item_id").alias("n_near"))
    hit = matches.select("k", "k2", covered(F.col("hits")).alias("n_hit"))
    found = hit.join(by_item, ["k", "k2"], "left").join(near, ["k", "k2"], "full")
    parts = docs.select("doc_id", *doc_key(docs), F.split(F.coalesce("text", F.lit("")), ANY_CASE_GAP).alias("parts"))
    edges = F.when(F.col("parts")[0] == "", 1).otherwise(0) + F.when((F.size("parts") > 1) & (F.element_at("parts", -1) == ""), 1).otherwise(0)
    rows = parts.select("doc_id", "k", "k2", (F.size("parts") - edges).cast("long").alias("n_words"))
    items_col = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(found, ["k", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_col).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_col, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "k", "k2")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without those in which any benchmark window occurs."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bad = stored(Index(slim, items, window).phrase_matches().select("k", "k2"), "contaminated").alias("bad")
    d = docs.alias("d")
    here = ((F.xxhash64(F.col("d.doc_id").cast("long"), F.col("d.text")) == F.col("bad.k")) & (F.hash(F.col("d.text")) == F.col("bad.k2")))
    return d.join(checked_broadcast(bad, KEY_BYTES), here, "left_anti")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words, items and contamination of every document against the whole benchmark, windows of 10 words."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k", "k2")


ORACLE_OP9 = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS phrase
  FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS s FROM b WHERE len(ws) > 0)
), lens AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT r, n, s, array_to_string(ws[s:s + n - 1], ' ') AS phrase
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, lens WHERE len(ws) >= n)
), m AS (SELECT r, s, dw.n AS n, item_id FROM dw JOIN bw ON dw.phrase = bw.phrase AND dw.n = bw.n
), hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r
), it AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM m WHERE item_id IS NOT NULL) GROUP BY r
), stretch AS (
  SELECT DISTINCT item_id::VARCHAR AS item_id, ws[s:s + 19] AS st
  FROM (SELECT item_id, ws, least(unnest(range(1, len(ws) + 1, 20)), greatest(len(ws) - 19, 1)) AS s FROM b WHERE len(ws) > 0)
), terms AS (SELECT DISTINCT item_id, st, unnest(st) AS term FROM stretch
), tok AS (SELECT r, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM d
), cnt AS (SELECT term, count(*) AS n FROM tok GROUP BY term
), rare AS (
  SELECT item_id, st, term, row_number() OVER (PARTITION BY item_id, st ORDER BY n, term) AS k FROM terms JOIN cnt USING (term)
  QUALIFY k <= 3
), need AS (SELECT item_id, st, max(k) AS need FROM rare GROUP BY item_id, st
), occ AS (SELECT DISTINCT r, item_id, st, pos, k FROM tok JOIN rare USING (term)
), seen AS (
  SELECT r, item_id, st, pos,
    [x FOR x IN [max(CASE WHEN k = 1 THEN pos END) OVER w, max(CASE WHEN k = 2 THEN pos END) OVER w,
                 max(CASE WHEN k = 3 THEN pos END) OVER w] IF x IS NOT NULL] AS last
  FROM occ WINDOW w AS (PARTITION BY r, item_id, st ORDER BY pos ROWS UNBOUNDED PRECEDING)
), near AS (
  SELECT r, count(DISTINCT item_id) AS n_near FROM seen JOIN need USING (item_id, st)
  WHERE len(last) >= need AND pos - list_min(last) + 1 <= 20 GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r) LEFT JOIN near USING (r)
"""
