"""Merkle manifest of a dataset: subtree per source, one root, a proof per row (operator 11).

Nodes are rows (tree, place, hash). At every level a node equijoins the nodes at the
computed places of its siblings: the place with its lowest bit flipped (XOR) for binary
trees, else the place shifted by 1, 2, ... slots within its run of ``arity`` nodes. The
rows in slot zero then hold the whole run and emit the parent. A node keeps the joined
digests left and right of it; these pairs, from its own level up to the root, are its
proof, handed down by joining each level to the one above.

Places come from one sort by range of hashes, not of texts: every task numbers its rows,
and the counts per task, a small table, give what comes before. So no tree, however many
of the rows it holds, is ever in one task. Every level is a written table, a third of the
one below, so a lost executor recomputes one level at most.

Defined results: a null value is hashed as ``-`` and a null source is a tree of its own,
before all others; rows of equal key follow one another by their hash, so repeated rows
have the same leaf but places and proofs of their own; an empty table has no rows and no
root; a lone leaf is the root of its tree and its proof is that of the tree; null doc_ids
come first and are never tampered with; texts are hashed whole, whatever their length;
columns that are not hashed are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.llm import tables as T

ARITY = 3
#: Nodes of a level, of 100 bytes each, up to which its siblings are broadcast instead of shuffled.
FEW_NODES = 20_000
PROOF = "array<struct<left:string,right:string>>"
#: Names that ``manifest`` gives; columns of these names are replaced.
ADDED = ("place", "nodes", "tree", "slot", "left", "right", "proof", "subroot", "height", "_at", "_part", "_n", "_first", "_before", "_group")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the value's length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda node, level: digest(level["left"], node, level["right"]))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda level: F.concat(level["left"], level["right"])), ""))


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add ``place``, from 0 by ``order`` within ``group`` (nulls first), and ``nodes``, the rows of the group."""
    keys = [*group, *order]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = T.written(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                     .withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    every = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))    # a row a task and group
    runs = (rows.groupBy(*group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
            .withColumn("_before", F.coalesce(F.sum("_n").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("nodes", F.sum("_n").over(every)))
    runs = runs.select(*[F.col(g).alias(f"_of_{g}") for g in group], F.col("_part"), "_first", "_before", "nodes")
    same = part == F.col("_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return rows.join(runs, same).select(
        *[c for c in rows.columns if c != "_at"], (F.col("_at") - F.col("_first") + F.col("_before")).alias("place"), "nodes")


def with_siblings(nodes: DataFrame, arity: int, few: bool = False) -> DataFrame:
    """Add slot, and left and right: the digests of a node's siblings on either side, joined at their computed places.

    ``few`` says that there are no more than FEW_NODES.
    """
    slot, place = F.col("slot"), F.col("place")
    out = nodes.withColumn("slot", place % arity)
    left, right = [F.lit("")], [F.lit("")]
    for shift in range(1, arity):
        others = nodes.select(F.col("tree").alias(f"_tree{shift}"), F.col("place").alias(f"_place{shift}"), F.col("hash").alias(f"_hash{shift}"))
        others = F.broadcast(others) if few else others
        sibling = place.bitwiseXOR(F.lit(1)) if arity == 2 else place - slot + (slot + shift) % arity
        out = out.join(others, (F.col("tree") == F.col(f"_tree{shift}")) & (sibling == F.col(f"_place{shift}")), "left")
        found, wraps = F.coalesce(f"_hash{shift}", F.lit("")), slot + shift >= arity
        left.append(F.when(wraps, found).otherwise(""))
        right.append(F.when(wraps, "").otherwise(found))
    return out.select(*nodes.columns, "slot", F.concat(*left).alias("left"), F.concat(*right).alias("right"))


def climb(leaves: DataFrame, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels of all trees of ``leaves`` (tree, place, nodes, hash, ...), and their roots (tree, height, root).

    A level holds the nodes of trees that have more than one there. The loop runs a
    round a level: the logarithm of the largest tree.
    """
    levels, nodes = [], leaves
    size = leaves.agg(F.max("nodes").alias("widest"), F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("place") == 0).alias("trees")).first()
    widest, most = size["widest"] or 0, size["nodes"]        # most: nodes of the level, at the most
    roots = []
    while True:
        roots.append(nodes.where("nodes = 1").select("tree", F.lit(len(levels)).alias("height"), F.col("hash").alias("root")))
        if widest <= 1:
            break
        level = T.written(with_siblings(nodes.where("nodes > 1"), arity, most <= FEW_NODES), f"{name}-{len(levels)}")
        levels.append(level)
        nodes = level.where("slot = 0").select(
            "tree", F.expr(f"place div {arity}").alias("place"), F.expr(f"(nodes + {arity - 1}) div {arity}").alias("nodes"),
            digest(F.col("hash"), F.col("right")).alias("hash"))
        widest, most = -(-widest // arity), most // arity + size["trees"]
    all_roots = roots[0]
    for r in roots[1:]:
        all_roots = all_roots.unionByName(r)
    return levels, T.written(all_roots, f"{name}-roots")


def descend(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, arity: int, name: str) -> DataFrame:
    """``leaves`` with their proofs: ``tops`` (tree, height, proof, ...) continued downwards through ``levels``."""
    extra = [c for c in tops.columns if c not in ("tree", "height", "proof")]

    def below(rows: DataFrame, above: DataFrame, keep: Sequence[str]) -> DataFrame:
        up = above.select(F.col("tree").alias("_tree"), F.col("place").alias("_place"), F.col("proof").alias("_above"), *extra)
        return (rows.join(up, (F.col("tree") == F.col("_tree")) & (F.expr(f"place div {arity}") == F.col("_place")))
                .select(*keep, F.concat(F.array(F.struct("left", "right")), "_above").alias("proof"), *extra))

    def ending(height: int) -> DataFrame:
        return tops.where(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("place"), "proof", *extra)

    kept = [c for c in leaves.columns if c != "nodes"]
    lone = leaves.where("nodes = 1").join(ending(0).drop("place"), "tree").select(*kept, "proof", *extra)
    if not levels:
        return lone
    above = ending(len(levels))
    for height in range(len(levels) - 1, 0, -1):
        above = T.written(below(levels[height], above, ["tree", "place"]).unionByName(ending(height)), f"{name}-{height}")
    return below(levels[0], above, kept).unionByName(lone)


@dataclass
class Manifest:
    """What a dataset hashes to: its root, a subroot a group, and a row a leaf with its proof."""

    root: str | None
    subroots: DataFrame       # the group's columns, rows, subroot
    proofs: DataFrame         # the columns given, hash, place, subroot, proof


def manifest(rows: DataFrame, group: str, order: Sequence[str], arity: int = ARITY) -> Manifest:
    """Manifest of ``rows``, whose column ``hash`` holds the leaves: a tree of leaves by ``order`` for each
    value of ``group``, and a tree of their subroots by ``group``."""
    rows = rows.drop(*set(ADDED) - {group, *order})
    placed = ranked(rows, [group], [*order, "hash"], "merkle-leaves")
    groups = ranked(placed.where("place = 0").select(group, F.col("nodes").alias("rows")), [], [group], "merkle-groups")
    trees = T.written(groups.select(F.col(group).alias("_group"), "rows", F.col("place").alias("tree"), F.col("nodes").alias("_trees")), "merkle-trees")
    leaves = T.written(placed.join(trees.select("_group", "tree"), F.col(group).eqNullSafe(F.col("_group"))).drop("_group"), "merkle-placed")
    levels, subroots = climb(leaves, arity, "merkle-level")

    named = trees.join(subroots, "tree")
    heads = named.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("_trees").alias("nodes"),
                         F.col("root").alias("hash"), F.col("height").alias("_height"))
    over, tops = climb(heads, arity, "merkle-top")
    [root] = [r.root for r in tops.select("root").collect()] or [None]      # the one root
    closed = tops.select("tree", "height", F.array().cast(PROOF).alias("proof"))
    handed = descend(heads, over, closed, arity, "merkle-top-proof")
    ends = T.written(handed.select(F.col("place").alias("tree"), F.col("_height").alias("height"), "proof", F.col("hash").alias("subroot")), "merkle-ends")
    proofs = descend(leaves, levels, ends, arity, "merkle-proof")
    return Manifest(root, named.select(F.col("_group").alias(group), "rows", F.col("root").alias("subroot")), proofs.drop("tree"))


def tampered(doc_id: Column) -> Column:
    """Rows of which the query folds a changed text: 2 divides crc32(decimal doc_id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and what a partly tampered copy folds to."""
    docs = T.read(spark, sf_dir, "documents").select(*T.DOCUMENT_COLUMNS)
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(tampered(F.col("doc_id")) & F.contains("text", F.lit("\n")), leaf(*columns, F.translate("text", "\n", "")))
    hashed = T.written(docs.select("doc_id", "source", leaf(*columns, F.col("text")).alias("hash"), changed.alias("changed")), "merkle-hashed")
    made = manifest(hashed, "source", ["doc_id"])
    folded = made.proofs.select("doc_id", F.col("hash").alias("leaf"), "subroot", F.lit(made.root).cast("string").alias("root"),
                                proof_digest(F.col("proof")).alias("proof_sha256"),
                                fold(F.coalesce("changed", "hash"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0} END"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
# crc32: xor each byte in, then shift eight times, with the reversed polynomial where a 1 falls out
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
  string_split({0}, ''), lambda d: list_prepend(ord(d)::BIGINT, [-1 for _ in range(8)])))), lambda c, x:
  CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""

OP11_SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, source, sha256({_LEAF} || {_FIELD.format("text")}) AS leaf,
         CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 2 = 0
              THEN sha256({_LEAF} || {_FIELD.format("replace(text, chr(10), '')")}) END AS changed
  FROM documents),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, count(*) OVER (PARTITION BY source) AS nodes,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed),
up AS (
  SELECT tree, 0 AS level, place, nodes, leaf AS h FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 3, any_value(nodes + 2) // 3, sha256(string_agg(h, '' ORDER BY place))
  FROM up WHERE nodes > 1 GROUP BY tree, level, place // 3),
subroots AS (SELECT tree, level, h FROM up WHERE nodes = 1),
top AS (
  SELECT 0 AS level, tree - 1 AS place, count(*) OVER () AS nodes, h FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, any_value(nodes + 2) // 3, sha256(string_agg(h, '' ORDER BY place))
  FROM top WHERE nodes > 1 GROUP BY level, place // 3),
steps AS (
  SELECT a.tree, a.level, a.place, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
  FROM up a JOIN up b ON a.tree = b.tree AND a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.nodes > 1 GROUP BY 1, 2, 3
  UNION ALL
  SELECT 0, a.level, a.place, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), ''),
         coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '')
  FROM top a JOIN top b ON a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.nodes > 1 GROUP BY 2, 3),
folds AS (
  SELECT doc_id, leaf, tree AS source_tree, tree, place, 0 AS level, coalesce(changed, leaf) AS h, '' AS proof FROM placed
  UNION ALL
  SELECT f.doc_id, f.leaf, f.source_tree, CASE WHEN s.place IS NULL THEN 0 ELSE f.tree END,
         CASE WHEN s.place IS NULL THEN f.tree - 1 ELSE f.place // 3 END, CASE WHEN s.place IS NULL THEN 0 ELSE f.level + 1 END,
         CASE WHEN s.place IS NULL THEN f.h ELSE sha256(s.l || f.h || s.r) END, f.proof || coalesce(s.l || s.r, '')
  FROM folds f LEFT JOIN steps s ON s.tree = f.tree AND s.level = f.level AND s.place = f.place
  WHERE s.place IS NOT NULL OR f.tree > 0)
SELECT f.doc_id, f.leaf, r.h AS subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM folds f JOIN subroots r ON r.tree = f.source_tree, (SELECT h FROM top WHERE nodes = 1) t
WHERE f.tree = 0 AND NOT EXISTS (SELECT 1 FROM steps s WHERE s.tree = 0 AND s.level = f.level AND s.place = f.place)"""
