"""Operator 13: a manifest of a dataset as a Merkle tree, with a proof for each document.

A leaf is the digest of a row.  The leaves of a source, by document id, are the lowest nodes of its tree; every ``FAN``
consecutive nodes of a level have one digest on the next, until one is left, and the roots of the sources are the lowest
nodes of a tree of their own.

Trees are cut into aligned blocks of ``BLOCK`` nodes.  A task goes through a block by recursion in postorder: a call
gives back the digest of its subtree, and on the way out each child's siblings are appended to the leaves it holds.  The
blocks' roots are the nodes of the next round, which Spark deals out again, so that a round is ``BLOCK`` times smaller
than the one before and no task holds more than a block.  Proofs go down the other way: each block gets the siblings
above it and appends them to those of its own nodes.  Places come from sorted ranges, saved once; a source with any
share of the rows is cut like the others.

Defined cases: null fields are ``-`` in a leaf; an empty text counts as no bytes; a null source is a tree of its own,
before all others; a null doc_id comes before all others of its source and is never tampered with; rows of one doc_id
are ordered by their leaves, and equal rows are leaves of their own with the same digest (which of them has which place
is open, so that the two may swap proofs); a lone leaf is its source's root with no siblings, and a lone source's root
is the root; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

FAN = 3
LEVELS = 6  # of a block
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_BITS = 33  # monotonically_increasing_id: the partition stands above so many bits, the place in it below


def digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of fields: ``-`` for null, else the bytes of its text form, ``:`` and that form."""
    forms = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in forms)), 256)


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def traverse(nodes: list[str], start: int, end: int, height: int, trails: list[list[str]]) -> str:
    """Digest of the subtree over nodes [start, end); each of them gets its siblings of each level, ``left,right;``."""
    if height == 0:
        return nodes[start]
    width = FAN ** (height - 1)
    children = [(a, min(a + width, end)) for a in range(start, end, width)]
    digests = [traverse(nodes, a, b, height - 1, trails) for a, b in children]
    for k, (a, b) in enumerate(children):
        link = f"{''.join(digests[:k])},{''.join(digests[k + 1 :])};"
        for leaf in range(a, b):
            trails[leaf].append(link)
    return hashed("".join(digests))


def block_height(size: int) -> int:
    """Levels above the lowest of a block in a tree of so many nodes: all, or those that lead to one node."""
    height = 0
    while height < LEVELS and FAN**height < size:
        height += 1
    return height


def folded(leaf: str, proof: str) -> str:
    """The root that a leaf and its siblings lead to."""
    for link in proof.split(";")[:-1]:
        left, right = link.split(",")
        leaf = hashed(left + leaf + right)
    return leaf


def _walked(block: pa.Table) -> tuple[pa.Table, str, list[str]]:
    """A block's nodes in order, its root, and the siblings of each node."""
    block = block.sort_by("pos")
    nodes, trails = block.column("digest").to_pylist(), [[] for _ in range(block.num_rows)]
    root = traverse(nodes, 0, len(nodes), block_height(block.column("size")[0].as_py()), trails)
    return block, root, ["".join(t) for t in trails]


def _raised(block: pa.Table) -> pa.Table:
    block, root, _ = _walked(block)
    size = -(-block.column("size")[0].as_py() // BLOCK)
    return pa.table({"tree": block.column("tree").slice(0, 1), "size": pa.array([size]), "pos": block.column("block").slice(0, 1), "digest": pa.array([root])})


def _lowered(block: pa.Table, above: pa.Table) -> pa.Table:
    block, _, trails = _walked(block)
    rest = above.column("proof")[0].as_py()
    return pa.table({"tree": block.column("tree"), "pos": block.column("pos"), "proof": pa.array([t + rest for t in trails])})


def blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))


def placed(nodes: DataFrame, *order: Column) -> DataFrame:
    """Adds ``pos``, the place from 0 of a node among those of its ``tree`` in the order, and ``size``, their number."""
    rows = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_id", F.monotonically_increasing_id())
    ranged = written(rows.withColumns({"_range": F.shiftright("_id", _BITS), "_at": F.col("_id").bitwiseAND(F.lit((1 << _BITS) - 1))}).drop("_id"))
    sizes = ranged.groupBy("tree", "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))  # a row a range and tree
    of_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(of_tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("tree", "_range", (before - F.col("_first")).alias("_offset"), F.sum("_n").over(of_tree).alias("size"))
    return ranged.join(offsets, ["tree", "_range"]).withColumn("pos", F.col("_at") + F.col("_offset")).drop("_range", "_at", "_offset")


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """From (tree, size, pos, digest): the nodes of each round; in the last one, the second or a later one, a tree has one node."""
    found = [nodes.select("tree", "size", "pos", "digest")]
    while len(found) < 2 or (found[-1].agg(F.max("size")).first()[0] or 0) > 1:
        found.append(written(blocked(found[-1]).groupBy("tree", "block").applyInArrow(_raised, "tree string, size long, pos long, digest string")))
    return found


def lowered(found: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, pos, proof) of the first round's nodes from those of the last round's."""
    for nodes in reversed(found[:-1]):
        blocks = above.withColumnRenamed("pos", "block").groupBy("tree", "block")
        above = written(blocked(nodes).groupBy("tree", "block").cogroup(blocks).applyInArrow(_lowered, "tree string, pos long, proof string"))
    return above


def _proven(block: pa.Table, above: pa.Table) -> pa.Table:
    block, _, trails = _walked(block)
    rest, subroot, root = (above.column(c)[0].as_py() for c in ("proof", "subroot", "root"))
    whole = [t + rest for t in trails]
    changed = [folded(b or a, p) for a, b, p in zip(block.column("digest").to_pylist(), block.column("tampered").to_pylist(), whole)]
    same = lambda value: pa.array([value] * block.num_rows, pa.string())
    siblings = pa.array([hashed(p.replace(",", "").replace(";", "")) for p in whole], pa.string())
    return pa.table(
        {
            "doc_id": block.column("doc_id"), "leaf": block.column("digest"), "subroot": same(subroot), "root": same(root), "proof_sha256": siblings,
            "folded_root": pa.array(changed, pa.string()), "verified": pa.array([c == root for c in changed]),
        }
    )


def manifest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root (of the tampered text), verified."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    without = F.replace("text", F.lit("\n"), F.lit(""))
    as_stored = [F.col(f) for f in FIELDS]
    leaves = written(
        docs.select(
            F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("tree"),  # a null source sorts before all others
            F.col("doc_id").cast("long").alias("doc_id"),
            digest(*as_stored).alias("digest"),
            F.when(tampered & F.contains("text", F.lit("\n")), digest(*as_stored[:-1], without)).alias("tampered"),
            (F.monotonically_increasing_id() % 1009).alias("deal"),  # equal rows, however many, fall into several ranges
        )
    )
    leaves = written(placed(leaves, F.col("doc_id"), F.col("digest"), F.col("deal")).drop("deal"))
    own = rounds(leaves)
    subroots = written(placed(own[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), F.col("source")))
    top = rounds(subroots)
    root = top[-1].select(F.col("digest").alias("root"))  # one row
    over = lowered(top, top[-1].select("tree", "pos", F.lit("").alias("proof"))).select("pos", "proof")
    known = subroots.select("pos", F.col("source").alias("tree"), F.col("digest").alias("subroot")).join(over, "pos").crossJoin(F.broadcast(root))
    above = lowered(own[1:], known.select("tree", F.lit(0).cast("long").alias("pos"), "proof"))
    above = above.withColumnRenamed("pos", "block").join(known.select("tree", "subroot", "root"), "tree")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return blocked(leaves).groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(_proven, schema)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))
