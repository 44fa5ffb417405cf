"""Merkle manifest of a dataset, with a proof for every row.

A row's leaf is the digest of its columns. The leaves of a group (``lang``) form a tree by id, the
groups' roots another one. Both are cut into superblocks of ``2 ** LEVELS`` consecutive nodes: a
superblock is reduced to one node, those nodes to one for each larger superblock, and so on, so that
the number of passes is the logarithm of the rows. On the way back every superblock is cogrouped with
the few outer nodes that lead from it to the root, and finishes alone: it reduces its part once more,
joins inner and outer siblings to proofs, and folds each claimed leaf up to the root. Texts are read
once; after that only digests move, and no task holds more than a superblock.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowtide.llm.common import keep, same, table

#: Levels of a superblock; it has 2 ** LEVELS nodes. Any value gives the same result.
LEVELS = 9

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def _h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _part(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    """Digest of a row: for each column its byte count, a colon and its text, or ``-`` for null."""
    return F.sha2(F.concat(*[_part(c) for c in columns.values()]), 256)


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos``, the place within ``tree`` by ``order``, and ``n``, the tree's size.

    One range sort numbers all trees at once, so a tree with most rows is as spread as any. Nothing
    but a row for each tree and sort partition is aggregated beyond it.
    """
    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col(c).asc_nulls_first() for c in ["tree", *order]]
    laid = nodes.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    laid = keep(laid.withColumn("part", F.shiftright("at", 33)), "sorted")
    sums = laid.groupBy("tree", "part").agg(F.min("at").alias("start"), F.count("*").alias("rows"))
    whole = Window.partitionBy("tree")
    upto = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("tree", "part", "start", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n"))
    placed = laid.join(sums, ["tree", "part"]).withColumn("pos", F.col("at") - F.col("start") + F.col("before"))
    return placed.drop("at", "part", "start", "before")


def reduce_block(digests: list[str], n: int, levels: int) -> list[list[str]]:
    """The nodes of a superblock, level by level, up to ``levels`` or to the root of a tree that has
    ``n`` nodes on the first level. Two neighbours make a node, a last one without neighbour alone."""
    out = [digests]
    while n > 1 and len(out) <= levels:
        d = out[-1]
        out.append([_h("".join(d[i : i + 2])) for i in range(0, len(d), 2)])
        n = (n + 1) // 2
    return out


def siblings(levels: list[list[str]], at: int) -> list[str]:
    """What a node of the first level meets on its way up: ``L`` or ``R`` and the digest of the node
    to its left or right, ``-`` where there is none."""
    out = []
    for nodes in levels[:-1]:
        other = at ^ 1
        out.append(("R" if other > at else "L") + nodes[other] if other < len(nodes) else "-")
        at >>= 1
    return out


def fold(digest: str, path: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for step in path:
        side, other = step[:1], step[1:]
        digest = _h(other + digest if side == "L" else digest + other)
    return digest


def _upwards(nodes: DataFrame, levels: int) -> DataFrame:
    """One node for each superblock of ``nodes(tree, pos, n, digest)``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        n, pos = int(rows["n"].iat[0]), int(rows["pos"].iat[0])
        top = reduce_block(rows["digest"].tolist(), n, levels)[-1]
        return pd.DataFrame({"tree": [rows["tree"].iat[0]], "pos": [pos >> levels], "n": [-(-n >> levels)], "digest": top})

    dealt = nodes.select("tree", F.shiftright("pos", levels).alias("block"), "pos", "n", "digest")
    return dealt.groupBy("tree", "block").applyInPandas(run, "tree string, pos long, n long, digest string")


def _downwards(nodes: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """``(tree, pos, top, path)`` of every node, from its superblock and that one's outer nodes."""

    def run(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        inner = reduce_block(rows["digest"].tolist(), int(rows["n"].iat[0]), levels)
        beyond = list(above["path"].iat[0])
        paths = [siblings(inner, i) + beyond for i in range(len(rows))]
        return pd.DataFrame({"tree": rows["tree"], "pos": rows["pos"], "top": above["top"].iat[0], "path": paths})

    dealt = nodes.select("tree", F.shiftright("pos", levels).alias("block"), "pos", "n", "digest")
    over = outer.select("tree", F.col("pos").alias("block"), "top", "path")
    return dealt.groupBy("tree", "block").cogroup(over.groupBy("tree", "block")).applyInPandas(run, "tree string, pos long, top string, path array<string>")


def outer_nodes(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``(tree, pos, top, path)`` of every superblock of ``nodes(tree, pos, n, digest)``: the root of
    its tree and what the superblock's own node meets on the way there."""
    up = keep(_upwards(nodes, levels), "superblocks")
    if up.where("n > 1").isEmpty():
        return up.select("tree", "pos", F.col("digest").alias("top"), F.array().cast("array<string>").alias("path"))
    return keep(_downwards(up, outer_nodes(up, levels), levels), "outer")


def manifest(rows: DataFrame, group: str, order: list[str], digest: str, claimed: str, levels: int = LEVELS) -> DataFrame:
    """Roots, proofs and verification of every row.

    ``rows`` holds a digest and a claimed digest for each leaf; leaves are ordered by ``order``
    within ``group``, groups by name, both with null first and strings by their bytes. Adds
    ``subroot`` (of the group), ``root``, ``proof`` (the siblings from leaf to root, as in
    ``siblings``), ``folded_root`` (from the claimed digest and the proof) and ``verified``. Rows
    that are alike in ``order`` come by digest, and equal ones each have a leaf. A group of one leaf
    has that leaf for its root; no rows give no rows. Columns other than those named are dropped.
    """
    named = rows.select(F.col(digest).alias("digest"), F.col(claimed).alias("claim"), F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)]).alias("own"), F.coalesce(F.concat(F.lit("1"), F.col(group)), F.lit("0")).alias("tree"))
    leaves = keep(numbered(keep(named, "leaves"), ["own", "digest"]), "numbered")
    inner = outer_nodes(leaves, levels)
    subroots = inner.groupBy("tree").agg(F.min("top").alias("digest"))
    groups = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    groups = keep(groups, "groups")
    whole = _downwards(groups, outer_nodes(groups, levels), levels).select("pos", F.col("top").alias("root"), F.col("path").alias("beyond"))
    roots = groups.join(whole, "pos").select(F.col("name").alias("tree"), "root", "beyond")
    above = inner.join(roots, "tree").select("tree", F.col("pos").alias("block"), F.col("top").alias("subroot"), "root", F.concat("path", "beyond").alias("path"))

    def run(rows: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        local = reduce_block(rows["digest"].tolist(), int(rows["n"].iat[0]), levels)
        beyond = list(over["path"].iat[0])
        proofs = [siblings(local, i) + beyond for i in range(len(rows))]
        root = over["root"].iat[0]
        folded = [fold(c, p) for c, p in zip(rows["claim"], proofs)]
        out = rows[names].assign(leaf=rows["digest"], subroot=over["subroot"].iat[0], root=root, proof=proofs, folded_root=folded)
        return out.assign(verified=out["folded_root"] == root)

    dealt = leaves.select("tree", F.shiftright("pos", levels).alias("block"), "pos", "n", "digest", "claim", "own.*")
    names = [f"_{i}" for i in range(len(order))]
    kinds = ", ".join(f"{c} {dealt.schema[c].dataType.simpleString()}" for c in names)
    schema = f"{kinds}, leaf string, subroot string, root string, proof array<string>, folded_root string, verified boolean"
    out = dealt.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(run, schema)
    return out.withColumnsRenamed(dict(zip(names, order)))


def document_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of ``docs(doc_id, source, lang, n_chars, text)`` with trees by ``lang``, where the
    claim of every row whose decimal doc_id has a CRC-32 divisible by 7 counts one more character.

    Nulls in any column are told apart from empty values; a null doc_id comes first in its tree and
    is never tampered with, nor is a null n_chars. Whole texts are read, however long; other columns
    are ignored.
    """
    rows = same(docs, COLUMNS)
    own = {c: F.col(c).cast("string") if c in ("source", "lang", "text") else F.col(c).cast("long") for c in COLUMNS}
    more = F.when(F.crc32(F.col("doc_id").cast("long").cast("string")) % 7 == 0, 1).otherwise(0)
    told = {**own, "n_chars": F.col("n_chars").cast("decimal(20,0)") + more}
    made = rows.select(own["doc_id"].alias("doc_id"), own["lang"].alias("lang"), leaf(own).alias("digest"), leaf(told).alias("claim"))
    return manifest(made, "lang", ["doc_id"], "digest", "claim", levels)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = document_manifest(table(spark, sf_dir, "documents"))
    met = F.array_join(F.transform("proof", lambda s: F.regexp_replace(s, "^[LR-]", "")), "")
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(met, 256).alias("proof_sha256"), "folded_root", "verified")


_LEAF = "sha256({})".format(
    " || ".join(f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')" for c in COLUMNS)
)

SQL = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars::hugeint AS n_chars, text FROM documents
), bits AS (
  SELECT r, doc_id::varchar AS s, 0 AS i, 4294967295::bigint AS c FROM docs WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT r, s, i + 1, xor(c >> 1, 3988292384 * (c & 1))
  FROM (SELECT r, s, i, CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(s, i // 8 + 1, 1))) ELSE c END AS c FROM bits WHERE i < 8 * length(s))
), hit AS (
  SELECT r FROM bits WHERE i = 8 * length(s) AND xor(c, 4294967295) % 7 = 0
), leaves AS (
  SELECT r, doc_id, lang, {_LEAF} AS leaf,
    CASE WHEN r IN (SELECT r FROM hit) THEN {_LEAF.replace("n_chars::varchar", "(n_chars + 1)::varchar")} ELSE {_LEAF} END AS claim FROM docs
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), nodes AS (
  SELECT coalesce('1' || lang, '0') AS tree, 0 AS lev, pos, n, leaf AS d FROM placed
  UNION ALL
  SELECT tree, lev + 1, pos // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, lev, pos // 2, n
), subroots AS (
  SELECT tree, d AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS lev, pos, n, subroot AS d FROM subroots
  UNION ALL
  SELECT lev + 1, pos // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lev, pos // 2, n
), every AS (
  SELECT tree, lev, pos, n, d FROM nodes
  UNION ALL
  SELECT 'top', lev, pos, n, d FROM tops
), walk AS (
  SELECT r, coalesce('1' || lang, '0') AS tree, 0 AS lev, pos, n, claim AS d, '' AS met FROM placed
  UNION ALL
  SELECT w.r, CASE WHEN w.n > 1 THEN w.tree ELSE 'top' END, CASE WHEN w.n > 1 THEN w.lev + 1 ELSE 0 END,
    CASE WHEN w.n > 1 THEN w.pos // 2 ELSE u.pos END, CASE WHEN w.n > 1 THEN (w.n + 1) // 2 ELSE u.n END,
    CASE WHEN w.n = 1 THEN w.d WHEN w.pos % 2 = 0 THEN sha256(w.d || coalesce(e.d, '')) ELSE sha256(e.d || w.d) END,
    CASE WHEN w.n > 1 THEN w.met || coalesce(e.d, '') ELSE w.met END
  FROM walk w LEFT JOIN every e ON w.n > 1 AND e.tree = w.tree AND e.lev = w.lev AND e.pos = xor(w.pos, 1)
  LEFT JOIN subroots u ON u.tree = w.tree
  WHERE NOT (w.tree = 'top' AND w.n = 1)
)
SELECT p.doc_id, p.leaf, s.subroot, t.d AS root, sha256(w.met) AS proof_sha256, w.d AS folded_root, w.d = t.d AS verified
FROM placed p JOIN walk w ON w.r = p.r AND w.tree = 'top' AND w.n = 1
JOIN subroots s ON s.tree = coalesce('1' || p.lang, '0') CROSS JOIN (SELECT d FROM tops WHERE n = 1) t
"""
