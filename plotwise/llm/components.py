"""Connected components of an edge table, by alternating large and small stars.

No neighbour list is ever built: a round takes the least neighbour of each node, by an aggregate that combines on the
map side, and joins it back to the edges, so that a node with a third of all edges can be split over tasks.  Rounds
grow with the logarithm of the longest path.  Each round is cut off from its lineage in the shared folder.  Joins are sorted
merges by hint: the files of a round are compressed, and by their size a million edges would go through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, written


def apart(column: str) -> Column:
    """The same value under a new partitioning, so that a join deals out both its sides and can split a hot key."""
    return F.col(column).bitwiseXOR(F.lit(0).cast("long"))


def _with_least(edges: DataFrame) -> DataFrame:
    """(a, b, least): each edge with the least neighbour of ``a``."""
    least = edges.groupBy("a").agg(F.min("b").alias("least")).select(apart("a").alias("a"), "least")
    return edges.join(least.hint("merge"), "a")


def _held(root: dict[int, int], node: int) -> int:
    root.setdefault(node, node)
    return node


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From all edges, few: (node, component)."""
    root: dict[int, int] = {}

    def find(n: int) -> int:
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(_held(root, a)), find(_held(root, b))
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())], ["node", "component"])


def components(edges: DataFrame, few: int = 0) -> DataFrame:
    """From edges (a long, b long): (node, component) for every node that has an edge to another; component: its least node.

    Null ends and loops are ignored, repeated edges count once, an empty table gives an empty one.
    At most ``few`` edges, which are counted first, are settled by one task instead of rounds of small shuffles.
    """
    stars = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if few and stars.count() <= few:
        return stars.coalesce(1).mapInArrow(_settled, "node long, component long")
    mark = None
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()
        small = _with_least(large)
        small = small.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a != b").union(small.select("a", F.col("least").alias("b"))).distinct()
        stars = cut(small)
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
