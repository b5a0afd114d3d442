"""Merkle manifest of a dataset: a tree of hashes per group, a root over the groups, and a proof per row.

Nodes are cut into aligned blocks. A block keeps each of its levels as one string of hex digests, so a
parent is the hash of a fixed-width substring and a sibling is the substring beside one's own. The tops of
the blocks are the nodes of the next round, until one block is left. Proofs are put together
from the top down, per block, and spread over the members of the blocks at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import Scratch, check_columns

BITS = 9
#: Nodes of a block. A block of 512 holds 64 KB of digests over all its levels.
BLOCK = 1 << BITS
HEX = 64


def field(name: str) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def positions(frame: DataFrame, group: list[str], order: list[str], scratch: Scratch) -> DataFrame:
    """``frame`` with ``pos`` (from 0 in its group, by ``order``, nulls first) and ``size`` (rows of the group).

    Rows are dealt in ranges of the sorted order and stored; a range knows its rows' places, and one row per
    (range, group) carries the counts across. So no group has to fit a task. Ties are in any order.
    """
    dealt = frame.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    made = F.monotonically_increasing_id()
    stored = scratch.save(dealt.withColumns({"range": F.shiftright(made, 33), "at": made.bitwiseAND((1 << 33) - 1)}))
    counts = stored.groupBy("range", *group).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    per_range = scratch.save(counts)
    inside = _within(group)
    before = per_range.select(
        "*",
        F.expr(f"coalesce(sum(n) OVER ({inside} ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("before"),
        F.expr(f"sum(n) OVER ({inside})").alias("size"),
    )
    renamed = before.select(F.col("range").alias("_range"), *[F.col(g).alias(f"_{g}") for g in group], "first", "before", "size")
    same = F.col("range") == F.col("_range")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    joined = stored.join(renamed, same)
    return joined.select(*frame.columns, (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "size")


def _within(group: list[str]) -> str:
    return f"PARTITION BY {', '.join(group)}" if group else "PARTITION BY 1"


def _next_level(level: Column) -> Column:
    """The parents of the digests in ``level`` (hex text as binary); a last single one is hashed alone."""
    pairs = F.ceil(F.octet_length(level) / (2 * HEX)).cast("int")
    one = lambda i: F.sha2(F.substring(level, i * (2 * HEX) + 1, F.lit(2 * HEX)), 256)
    return F.array_join(F.transform(F.sequence(F.lit(0), pairs - 1), one), "").cast("binary")


def _bits(n: Column) -> Column:
    """Levels above n nodes."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


@dataclass(frozen=True)
class Layer:
    """Blocks ``(grp, block, size, members, levels)``; ``levels`` from the members' digests to the block's top."""

    blocks: DataFrame
    several: bool


def _layer(nodes: DataFrame, scratch: Scratch) -> Layer:
    """Blocks of ``nodes (grp, pos, size, digest, data)``."""
    member = F.struct(F.col("pos"), F.col("digest"), F.col("data"))
    blocks = nodes.groupBy("grp", F.shiftright("pos", BITS).alias("block")).agg(F.max("size").alias("size"), F.sort_array(F.collect_list(member)).alias("members"))
    depth = F.when(F.col("size") <= BLOCK, _bits(F.col("size"))).otherwise(BITS)
    digests = F.array_join(F.transform("members", lambda m: m["digest"]), "").cast("binary")
    climb = F.aggregate(
        F.slice(F.sequence(F.lit(0), F.lit(BITS)), F.lit(2), depth),
        F.array(digests),
        lambda levels, _: F.concat(levels, F.array(_next_level(F.element_at(levels, -1)))),
    )
    stored = scratch.save(blocks.select("*", climb.alias("levels")))
    return Layer(stored, stored.where(F.col("size") > BLOCK).limit(1).count() > 0)


def _spread(blocks: DataFrame) -> DataFrame:
    """``(grp, pos, size, digest, data, path, root)`` per member of ``blocks`` with ``above`` and ``root``."""

    def path(m: Column) -> Column:
        at = m["pos"].bitwiseAND(BLOCK - 1).cast("int")
        inside = F.transform(
            F.slice("levels", 1, F.size("levels") - 1),
            lambda level, t: F.struct(
                F.substring(level, F.call_function("shiftright", at, t).bitwiseXOR(F.lit(1)) * HEX + 1, F.lit(HEX)).cast("string").alias("sibling"),
                (F.call_function("shiftright", at, t).bitwiseAND(F.lit(1)) == 1).alias("before"),
            ),
        )
        return F.concat(inside, F.col("above"))

    rows = F.transform("members", lambda m: F.struct(m["pos"].alias("pos"), m["digest"].alias("digest"), m["data"].alias("data"), path(m).alias("path")))
    return blocks.select("grp", "size", "root", F.inline(rows))


_PATH = "array<struct<sibling:string,before:boolean>>"


def _above(layer: Layer, scratch: Scratch) -> DataFrame:
    """``(grp, block, above, root)``: for every block the path from its top to the root of its group."""
    tops = layer.blocks.select("grp", "block", "size", F.element_at("levels", -1).cast("string").alias("top"))
    none = F.array().cast(_PATH)
    alone = tops.where(F.col("size") <= BLOCK).select("grp", "block", none.alias("above"), F.col("top").alias("root"))
    if not layer.several:
        return alone
    nodes = tops.where(F.col("size") > BLOCK).select(
        "grp", F.col("block").alias("pos"), F.ceil(F.col("size") / BLOCK).alias("size"), F.col("top").alias("digest"), F.lit(0).alias("data")
    )
    upper = _layer(nodes, scratch)
    found = _spread(_joined(upper, scratch))
    return scratch.save(alone.unionByName(found.select("grp", F.col("pos").alias("block"), F.col("path").alias("above"), "root")))


def _joined(layer: Layer, scratch: Scratch) -> DataFrame:
    above = _above(layer, scratch).select(F.col("grp").alias("_grp"), F.col("block").alias("_block"), "above", "root")
    same = F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("_block"))
    return layer.blocks.join(above, same).drop("_grp", "_block")


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, digest, lambda acc, s: F.sha2(F.when(s["before"], F.concat(s["sibling"], acc)).otherwise(F.concat(acc, s["sibling"])), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: s["sibling"]), ""), 256)


def manifest(rows: DataFrame) -> DataFrame:
    """``(grp, key, leaf, data, subroot, root, path)`` per row of ``rows (grp, key, leaf, data)``.

    In a group, leaves ascend by ``key``, nulls first; rows of equal key by ``leaf``, so the
    order of the rows does not matter. Groups ascend, the null group first. Two consecutive nodes become their
    hash, a last single one its own, until one is left; the groups' roots likewise give ``root``. ``path`` lists the
    sibling (empty if there is none) of each level up to the root, and whether it comes before. Hashes are SHA-256 of
    digests as hex text. An empty table gives no rows.

    No group has to fit a task: a block holds 512 nodes, and each round leaves one row a block.
    """
    check_columns(rows, "grp", "key", "leaf", "data")
    scratch = Scratch(rows.sparkSession)
    stored = scratch.save(rows.select("grp", "key", "leaf", "data"))  # dealing rows in ranges reads them twice
    placed = positions(stored, ["grp"], ["key", "leaf"], scratch)
    leaves = _layer(placed.select("grp", "pos", "size", F.col("leaf").alias("digest"), F.struct("key", "data").alias("data")), scratch)
    joined = scratch.save(_joined(leaves, scratch))
    subroots = joined.where("block = 0").select(F.col("grp").alias("of"), F.col("root").alias("digest"))
    ranked = positions(subroots, [], ["of"], scratch)
    groups = _layer(ranked.select(F.lit(0).alias("grp"), "pos", "size", "digest", F.col("of").alias("data")), scratch)
    tops = scratch.save(_spread(_joined(groups, scratch)).select(F.col("data").alias("of"), "digest", F.col("path").alias("over"), F.col("root").alias("whole")))
    whole = joined.join(tops, F.col("grp").eqNullSafe(F.col("of"))).withColumn("above", F.concat("above", "over"))
    members = _spread(whole.select("grp", "size", F.struct("root", "whole").alias("root"), "members", "levels", "above"))
    return members.select("grp", "data.key", F.col("digest").alias("leaf"), "data.data", F.col("root.root").alias("subroot"), F.col("root.whole").alias("root"), "path")


def document_leaf(tampered: bool = False) -> Column:
    """The leaf of a row of documents; the tampered one has one more in ``n_chars``, unless that is null."""
    n = F.col("n_chars") + F.lit(1).cast("bigint") if tampered else F.col("n_chars")
    count = F.coalesce(F.concat(F.octet_length(n.cast("string")).cast("string"), F.lit(":"), n.cast("string")), F.lit("-"))
    return leaf(field("doc_id"), field("source"), field("lang"), count, field("text"))


def document_manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """``manifest`` of documents by language; ``data`` is the leaf after tampering where that column is true, else null."""
    check_columns(docs, "doc_id", "source", "lang", "n_chars", "text")
    changed = F.when(tampered, document_leaf(tampered=True))
    return manifest(docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"), document_leaf().alias("leaf"), changed.alias("data")))


ORACLE_SQL = r"""
WITH RECURSIVE table_step AS (
  SELECT range AS b, 0 AS step, range AS c FROM range(256)
  UNION ALL
  SELECT b, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM table_step WHERE step < 8
), crc_table AS (
  SELECT list(c ORDER BY b) AS crc FROM table_step WHERE step = 8
), doc AS (
  SELECT doc_id, lang, n_chars,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
      || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
    coalesce(xor(list_reduce(list_prepend(4294967295, [ord(x) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
      lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % 7 = 0, false) AS tampered
  FROM documents, crc_table
), leaf AS (
  SELECT doc_id, lang, tampered,
    sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || tail) AS h,
    sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) END || tail) AS changed
  FROM doc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaf
), low AS (
  SELECT lang, 0 AS lvl, pos, n, h FROM placed
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY lang, lvl, pos // 2, n
), subroot AS (
  SELECT lang, h, lvl AS depth, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS lvl, rank AS pos, n, h FROM subroot
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // 2, n
), node AS (
  SELECT 'l' || coalesce(lang, '') || (lang IS NULL) AS tree, lvl, pos, h FROM low WHERE n > 1
  UNION ALL SELECT 'h', lvl, pos, h FROM high WHERE n > 1
), step AS (
  SELECT p.lang, p.pos AS leaf_pos, t.lvl, 'l' || coalesce(p.lang, '') || (p.lang IS NULL) AS tree, t.lvl AS tree_lvl, p.pos >> t.lvl AS at
  FROM placed p JOIN subroot s ON p.lang IS NOT DISTINCT FROM s.lang, LATERAL (SELECT unnest(range(s.depth)) AS lvl) t
  UNION ALL
  SELECT p.lang, p.pos, s.depth + t.lvl, 'h', t.lvl, s.rank >> t.lvl
  FROM placed p JOIN subroot s ON p.lang IS NOT DISTINCT FROM s.lang, LATERAL (SELECT unnest(range((SELECT max(lvl) FROM high))) AS lvl) t
), sibling AS (
  SELECT s.lang, s.leaf_pos, list({'h': coalesce(n.h, ''), 'before': s.at & 1 = 1} ORDER BY s.lvl) AS path
  FROM step s LEFT JOIN node n ON n.tree = s.tree AND n.lvl = s.tree_lvl AND n.pos = xor(s.at, 1) GROUP BY ALL
), whole AS (
  SELECT p.*, s.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root, coalesce(b.path, []) AS path
  FROM placed p JOIN subroot s ON p.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN sibling b ON p.lang IS NOT DISTINCT FROM b.lang AND p.pos = b.leaf_pos
), folded AS (
  SELECT *, list_reduce(list_prepend({'h': CASE WHEN tampered THEN changed ELSE h END, 'before': false}, path),
    lambda acc, x: {'h': sha256(CASE WHEN x.before THEN x.h || acc.h ELSE acc.h || x.h END), 'before': false}).h AS folded_root
  FROM whole
)
SELECT doc_id, h AS leaf, subroot, root, sha256(array_to_string([x.h FOR x IN path], '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded
"""
