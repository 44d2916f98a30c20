"""Operator 9: SimHash near-duplicates by deletion-variant signatures.

Fingerprints within ``radius`` bits are found by cutting them into so few segments that in one of them at most one
bit differs.  Each fingerprint is filed under every segment as it is, and under every segment with one bit blanked.
Two that share a filing place, and lie on opposite sides of a blanked bit, are compared exactly.  Filing places of two
are settled by an aggregate.  In larger ones all members are first compared with a few of them; places whose members
are then in one component need no more.  The rest are compared block against block, and only links that join
components are given out, so that no place, however many fingerprints it holds, costs one task or all its pairs.

Equal fingerprints are one point from the start: copies are never paired.  Links are exact: none within the radius is
lost, none beyond it is made (every comparison is the number of differing bits).

Defined cases: null and empty texts, and texts of blanks, have fingerprint zero and link like any other; texts of
fewer words than a shingle are one shingle; repeated rows each get their row; a row without an id has the component of
its fingerprint, and a null one if no row with an id has this fingerprint (it then links nothing); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, cut, spread, table
from .components import apart, components

WORDS, SEED, RADIUS, BLOCK, PORTION = 4, 42, 4, 512, 65_536
FILED = 50_000  # fingerprints that one task files under some 67 places each


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """As a signed 64-bit number; a bit is 1 if it is set in over half the hashes of the shingles."""
    parts = (text or "").encode("utf-8", "replace").lower().split()  # both know ASCII letters and blanks only
    if not parts:
        return 0
    if len(parts) <= words:
        hashes: Iterator[list[int]] = iter([[xxhash.xxh64_intdigest(b" ".join(parts), SEED)]])
        n = 1
    else:
        joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        starts = (np.concatenate(([0], ends[: -words]))).tolist()
        stops = (ends[words - 1 :] - 1).tolist()
        n = len(stops)
        hashes = ([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + PORTION], stops[at : at + PORTION])] for at in range(0, n, PORTION))
    counts = np.zeros(64, np.int64)
    for portion in hashes:
        bits = np.unpackbits(np.array(portion, dtype="<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp)."""
    return arrow_map(docs.select("doc_id", "text"), "doc_id long, fp long", lambda doc_id, text: (doc_id, fingerprint(text)))


def segments(radius: int) -> list[tuple[int, int]]:
    """(offset, width) of the fewest segments of which one differs by at most one bit."""
    n = radius // 2 + 1
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def filed(points: DataFrame, radius: int) -> DataFrame:
    """(place, side, fp, id): side 0 and 1 of a blanked bit, 2 for a whole segment."""
    rows, number = [], 0
    for offset, width in segments(radius):
        value = F.shiftrightunsigned("fp", offset).bitwiseAND(F.lit((1 << width) - 1))
        rows.append(F.struct((value + F.lit(number << 34)).alias("place"), F.lit(2).alias("side")))
        number += 1
        for bit in range(width):
            rest = value.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)))
            side = F.shiftrightunsigned("fp", offset + bit).bitwiseAND(F.lit(1)).cast("int")
            rows.append(F.struct((rest + F.lit(number << 34)).alias("place"), side.alias("side")))
            number += 1
    return points.select("fp", "id", F.explode(F.array(*rows)).alias("at")).select("at.place", "at.side", "fp", "id")


def near(a: Column, b: Column, radius: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def _cross(radius: int):
    """Compares one block with another; gives a forest of the links between components."""

    def run(part: pa.Table) -> pa.Table:
        fp = part["fp"].to_numpy().view(np.uint64)
        node, side = part["component"].to_numpy(), part["side"].to_numpy()
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if (side < 2).any() else (np.arange(len(fp)),) * 2
        close = np.bitwise_count(fp[left][:, None] ^ fp[right][None, :]) <= radius
        close &= node[left][:, None] != node[right][None, :]
        x, y = np.nonzero(close)
        root: dict[int, int] = {}

        def find(n: int) -> int:
            while root.get(n, n) != n:
                root[n] = root.get(root[n], root[n])
                n = root[n]
            return n

        out = []
        for a, b in set(zip(node[left[x]].tolist(), node[right[y]].tolist())):
            if find(a) != find(b):
                root[find(a)] = find(b)
                out.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def linked(points: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """From (id, fp) of distinct fingerprints: (node, component) of those that link with another."""
    places = filed(spread(points, "fp", FILED), radius)
    kept = F.struct("fp", "id")
    sums = places.groupBy("place").agg(
        *(F.count_if(F.col("side") == s).alias(f"n{s}") for s in (0, 1, 2)),
        *(F.min(F.when(F.col("side") == s, kept)).alias(f"low{s}") for s in (0, 1, 2)),
        F.max(F.when(F.col("side") == 2, kept)).alias("high2"),
    )
    live = cut(sums.where("(n0 > 0 and n1 > 0) or n2 > 1"))
    link = lambda a, b: (a + ".id", b + ".id", near(F.col(a + ".fp"), F.col(b + ".fp"), radius))
    edge = lambda frame, a, b, close: frame.where(close).select(F.col(a).alias("a"), F.col(b).alias("b"))
    edges = edge(live.where("n2 = 0"), *link("low0", "low1")).union(edge(live.where("n2 > 1"), *link("low2", "high2")))
    large = live.where("n0 > 1 or n1 > 1 or n2 > 2").select(apart("place").alias("place"), "n0", "n1", "n2", "low0", "low1", "low2", "high2")
    members = cut(places.join(large.hint("merge"), "place").select("*", kept.alias("own")))
    for centre, side in (("low1", 0), ("low0", 1), ("low2", 2), ("high2", 2)):
        edges = edges.union(edge(members.where(F.col("side") == side), *link("own", centre)))
    first = cut(components(edges))
    known = members.select("place", "side", "fp", "id", "n0", "n1", "n2").join(first.withColumnRenamed("node", "id").hint("merge"), "id", "left")
    known = known.withColumn("component", F.coalesce("component", "id"))
    split = known.groupBy("place").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select(apart("place").alias("place"))
    # Blocks: a member goes to one block of its side, and meets every block of the other (of its own, for whole segments).
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("side") == 0, blocks("n0")).when(F.col("side") == 1, blocks("n1")).otherwise(blocks("n2"))).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("side") == 0, blocks("n1")).when(F.col("side") == 1, blocks("n0")).otherwise(blocks("n2")) - 1)
    dealt = (
        known.join(split.hint("merge"), "place")
        .select("place", "side", "fp", "component", own.alias("own"), F.explode(other).alias("other"))
        .withColumn("x", F.when(F.col("side") == 0, F.col("own")).when(F.col("side") == 1, F.col("other")).otherwise(F.least("own", "other")))
        .withColumn("y", F.when(F.col("side") == 0, F.col("other")).when(F.col("side") == 1, F.col("own")).otherwise(F.greatest("own", "other")))
    )
    more = dealt.select("place", "x", "y", "side", "fp", "component").groupBy("place", "x", "y").applyInArrow(_cross(radius), "a long, b long")
    return components(first.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def grouped(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """From (doc_id, fp): doc_id, fp, component_id, the least doc_id that links lead to."""
    points = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("id")))
    found = linked(points.where("id is not null"), radius)
    roots = cut(points.join(found.withColumnRenamed("node", "id").hint("merge"), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id")))
    return marked.join(roots.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = cut(fingerprints(table(spark, sf_dir, "documents")))
    return grouped(marked).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
