"""Merkle manifest of a dataset: a tree per group, a tree over the groups' subroots, proofs for every row.

A tree is built level by level with a slot pivot: the nodes of a level are grouped by parent
(position div fanout), conditional aggregates spread each parent's children into ``fanout`` columns,
and the hash of the concatenated columns is the parent.  The same columns without a node's own slot are
its siblings, so no second look at the tree is needed: going down, a parent hands every child the
text left and right of it at each level up to the root.  The last step down meets the rows themselves,
because the first level keeps its children's ids and second hashes beside their hashes.

Scale: the rows are read once and hashed to 64 characters; only ids and hashes are shuffled.  Positions
come from a range-partitioned index (``ordered_index``), never from a window over a group, so a group with
a third of all rows is spread like the rest.  Every later exchange groups at most ``fanout`` rows under a
key, and a level has 1/fanout of the rows of the one below.  Group sizes are joined by ``spread_join``
(hot keys apart).  Levels are stored tables: a lost executor repeats one level.  The driver sees one
number, the largest group's size.

Defined cases: null columns hash as ``-``; null ids come first, rows of one id are ordered by their leaf
hash and rows alike in both are interchangeable; a null group is a group of its own, before all others; a
lone row is its own subroot, a lone subroot the root; an empty table gives no rows; columns not
asked for are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.functions.broadcasting import spread_join
from sifter.functions.ordering import ordered_index
from sifter.llm.common import prepare, stored, table

FANOUT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def field(c: Column) -> Column:
    """A value as ``bytes:value``, null as ``-``."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(columns: Sequence[Column]) -> Column:
    return sha256(F.concat(*[field(c) for c in columns]))


def level_up(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes (grp, pos, size, h, and whatever else) -> parents (grp, pos, size, h, c0.., d0..).

    ``size`` is the number of nodes of the group on that level; a group with one node is finished
    and keeps its hash.  ``c``s are the children's hashes, ``d``s their other columns.
    """
    rest = [c for c in nodes.columns if c not in ("grp", "pos", "size", "h")]
    slot = F.pmod("pos", F.lit(fanout))
    spread = [F.max(F.when(slot == s, F.col("h"))).alias(f"c{s}") for s in range(fanout)]
    if rest:
        spread += [F.max(F.when(slot == s, F.struct(*rest))).alias(f"d{s}") for s in range(fanout)]
    up = nodes.groupBy("grp", F.floor(F.col("pos") / fanout).cast("long").alias("up")).agg(F.max("size").alias("below"), *spread)
    children = F.concat(*[F.coalesce(f"c{s}", F.lit("")) for s in range(fanout)])
    return up.select("grp", F.col("up").alias("pos"), F.ceil(F.col("below") / fanout).cast("long").alias("size"), "below",
                     F.when(F.col("below") == 1, F.col("c0")).otherwise(sha256(children)).alias("h"), *up.columns[3:])


def build(nodes: DataFrame, largest: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Every level above ``nodes``, the first one first; the last has one node a group."""
    levels, left = [], largest
    while not levels or left > 1:
        levels.append(stored(level_up(nodes, fanout), f"level{len(levels)}"))
        nodes = levels[-1].select("grp", "pos", "size", "h")
        left = -(-left // fanout)
    return levels


def children(parents: DataFrame, fanout: int, payload: bool) -> DataFrame:
    """Parents with a ``path`` -> one row a child: grp, pos, h, its path, the parent's other columns, and its own.

    A path holds, level by level up to the root, the siblings left and right of the way.
    """
    def side(slots: range) -> Column:
        return F.concat(F.lit(""), *[F.coalesce(f"c{s}", F.lit("")) for s in slots])

    slots = [F.struct((F.col("pos") * fanout + s).alias("pos"), F.col(f"c{s}").alias("h"), side(range(s)).alias("left"),
                      side(range(s + 1, fanout)).alias("right"), *([F.col(f"d{s}").alias("d")] if payload else [])) for s in range(fanout)]
    kept = [c for c in parents.columns if c not in ("pos", "h", "path", "size", "below") and c[1:] not in map(str, range(fanout))]
    each = parents.select(*kept, "path", "below", F.explode(F.filter(F.array(*slots), lambda c: c["h"].isNotNull())).alias("k"))
    step = F.array(F.struct(F.col("k.left").alias("left"), F.col("k.right").alias("right")))
    return each.select(*kept, F.col("k.pos").alias("pos"), F.col("k.h").alias("h"), *([F.col("k.d.*")] if payload else []),
                       F.when(F.col("below") == 1, F.col("path")).otherwise(F.concat(step, F.col("path"))).alias("path"))


def descend(top: DataFrame, levels: list[DataFrame], fanout: int, payload: bool) -> DataFrame:
    """``top`` has the last level's columns and a ``path``; down to the nodes the levels were built from."""
    at = top
    for below in reversed(levels[:-1]):
        given = children(at, fanout, False).drop("h")
        at = below.join(given, ["grp", "pos"])
    return children(at, fanout, payload)


def fold(start: Column, path: str = "path") -> Column:
    """The root that ``start`` and a path's siblings lead to."""
    return F.aggregate(path, start, lambda h, step: sha256(F.concat(step["left"], h, step["right"])))


def manifest(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """leaves (grp string not null, id, leaf, other) -> id, leaf, other, subroot, root, path.

    Groups are ordered by ``grp``, leaves by id (nulls first) and leaf.
    """
    leaves = stored(leaves.select("grp", "id", "leaf", "other"), "leaves")
    sizes = stored(leaves.groupBy("grp").agg(F.count("*").alias("size")), "sizes")
    total = sizes.agg(F.max("size").alias("most"), F.count("*").alias("groups")).first()
    placed = spread_join(ordered_index(leaves, ["id", "leaf"], name="pos", group_cols=["grp"]), sizes, ["grp"])
    levels = build(placed.withColumnRenamed("leaf", "h"), total["most"] or 0, fanout)

    subroots = levels[-1].select(F.col("grp").alias("name"), F.col("h"))
    placed_roots = ordered_index(subroots, ["name"], name="pos").select(F.lit("").alias("grp"), "pos", F.lit(total["groups"]).cast("long").alias("size"), "h", "name")
    upper = build(placed_roots, total["groups"], fanout)

    empty = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    top = upper[-1].withColumn("root", F.col("h")).withColumn("path", empty)
    way = descend(top, upper, fanout, True).select(F.col("name").alias("grp"), F.col("h").alias("subroot"), "root", "path")
    return descend(levels[-1].join(stored(way, "subroots"), "grp"), levels, fanout, True).withColumnRenamed("h", "leaf")


def document_manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether a tampered copy still verifies."""
    prepare(docs.sparkSession)
    doc_id, low = F.col("doc_id").cast("long"), F.translate("text", UPPER, LOWER)

    def leaf(text: Column) -> Column:
        return leaf_hash([doc_id, F.col("source"), F.col("lang"), F.col("n_chars"), text])

    leaves = docs.select(F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("grp"), doc_id.alias("id"),
                         leaf(F.col("text")).alias("leaf"), F.when(F.crc32(doc_id.cast("string")) % 3 == 0, leaf(low)).alias("other"))
    proven = manifest(leaves, fanout)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return proven.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", sha256(siblings).alias("proof_sha256"),
                         fold(F.coalesce("other", "leaf")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of the documents table, one row per document."""
    return document_manifest(table(spark, sf_dir, "documents"))


def _oracle(levels: int, root_levels: int) -> str:
    """DuckDB: the same trees by window positions and string_agg; crc32 by its polynomial's table."""
    def part(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join([part('doc_id'), part('source'), part('lang'), part('n_chars'), part(text)])})"

    sql = f"""
WITH RECURSIVE poly(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM poly WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8
), crc AS (
  SELECT *, translate(text, '{UPPER}', '{LOWER}') AS low,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]))) AS z FROM documents, tab
), leaves AS (
  SELECT coalesce('=' || lang, '') AS g, doc_id, {leaf('text')} AS leaf, CASE WHEN z % 3 = 0 THEN {leaf('low')} END AS other FROM crc
), a0 AS (
  SELECT *, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS m FROM leaves
)"""
    steps, joins = [], ""

    def tree(t: str, n: int, pos: str) -> None:
        """Levels t1..tn over t0, and per node of t0..t(n-1) its siblings left and right (s<t>0..)."""
        nonlocal sql, joins
        for i in range(n):
            sql += f""", {t}{i + 1} AS (
  SELECT g, pos // 8 AS pos, (max(m) + 7) // 8 AS m, CASE WHEN max(m) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
  FROM {t}{i} GROUP BY g, pos // 8
), s{t}{i} AS (
  SELECT x.g, x.pos, max(x.m) AS m, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS l,
    coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS r
  FROM {t}{i} x JOIN {t}{i} y ON x.g = y.g AND x.pos // 8 = y.pos // 8 GROUP BY x.g, x.pos)"""
            steps.append(f"{t}{i}")
            joins += f" JOIN s{t}{i} ON s{t}{i}.g = {pos}.g AND s{t}{i}.pos = {pos}.pos // {8 ** i}"

    tree("a", levels, "d")
    sql += f""", r0 AS (SELECT '' AS g, g AS name, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS m FROM a{levels})"""
    tree("r", root_levels, "q")
    columns = ", ".join(f"s{t}.{c} AS {c}_{t}" for t in steps for c in "lrm")
    sql += f""", f0 AS (SELECT d.doc_id, d.leaf, q.h AS subroot, (SELECT h FROM r{root_levels}) AS root, coalesce(d.other, d.leaf) AS f0, {columns}
  FROM a0 d JOIN r0 q ON q.name = d.g{joins})"""
    for k, t in enumerate(steps):
        sql += f""", f{k + 1} AS (SELECT *, CASE WHEN m_{t} = 1 THEN f{k} ELSE sha256(l_{t} || f{k} || r_{t}) END AS f{k + 1} FROM f{k})"""
    proof, n = " || ".join(f"l_{t} || r_{t}" for t in steps), len(steps)
    return sql + f"""
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, f{n} AS folded_root, f{n} = root AS verified FROM f{n}"""


#: enough levels for 2,097,152 documents of a language and 64 languages
ORACLE_OP13 = _oracle(7, 2)
