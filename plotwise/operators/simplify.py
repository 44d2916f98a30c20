"""Simpler outlines for a whole map of polygons: borders that two polygons share stay shared, and no ring crosses itself.

Rings are cut into arcs at the vertices where more than two outlines' edges meet; these stay.  An arc is thinned in one
direction whichever way a ring goes through it, so that both its polygons drop the same vertices.  A ring that would
cross itself or collapse gets its arcs back whole, and so do the other polygons that have them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import saved

_POINTS = "array<array<double>>"
_ARCS = f"array<struct<key:string,turned:boolean,whole:{_POINTS},thin:{_POINTS}>>"


def thinned(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """The ends of a line and the vertices farther than the tolerance from the line through those kept before."""
    keep, open_ = np.zeros(len(xy), bool), [(0, len(xy) - 1)]
    keep[[0, -1]] = True
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        way, off = xy[b] - xy[a], xy[a + 1 : b] - xy[a]
        part = np.clip(off @ way / (way @ way), 0, 1) if way.any() else np.zeros(len(off))
        away = np.hypot(*(off - part[:, None] * way).T)
        k = int(away.argmax())
        if away[k] > tolerance:
            keep[a + 1 + k] = True
            open_ += [(a, a + 1 + k), (a + 1 + k, b)]
    return xy[keep]


def arcs_of(xy: np.ndarray, fixed: np.ndarray, tolerance: float) -> list[dict]:
    """The arcs of an open ring, in order, between fixed vertices; of a ring without any, between its least vertex and the one farthest from it."""
    cuts = np.flatnonzero(fixed)
    if len(cuts) < 2:
        start = int(cuts[0]) if len(cuts) else int(np.lexsort((xy[:, 1], xy[:, 0]))[0])
        far = np.hypot(*(xy - xy[start]).T)
        order = np.lexsort((xy[:, 1], xy[:, 0], -far))
        cuts = np.unique([start, int(order[0])])
    out = []
    for a, b in zip(cuts, [*cuts[1:], cuts[0] + len(xy)]):
        line = xy[np.arange(a, b + 1) % len(xy)]
        turned = line.tolist() > line[::-1].tolist()
        line = line[::-1] if turned else line
        out.append({"key": hashlib.sha256(line.tobytes()).hexdigest(), "turned": bool(turned), "whole": line.tolist(), "thin": thinned(line, tolerance).tolist()})
    return out


def ring_of(arcs: list[dict], whole: set[str]) -> np.ndarray:
    """The open ring that the arcs make, those of the given keys whole."""
    points: list = []
    for arc in arcs:
        line = arc["whole" if arc["key"] in whole else "thin"]
        points += (line[::-1] if arc["turned"] else line)[:-1]
    return np.array(points, float).reshape(-1, 2)


def crosses_itself(xy: np.ndarray, rows: int = 512) -> bool:
    """Whether a ring has fewer than three vertices, a vertex twice, or edges that meet other than at their common end."""
    n = len(xy)
    if n < 3 or len(np.unique(xy, axis=0)) < n:
        return True
    a, b = xy, np.roll(xy, -1, axis=0)
    side = lambda p, q, r: np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))
    low, high = np.minimum(a, b), np.maximum(a, b)
    for at in range(0, n, rows):  # a stretch of edges against all
        i = np.arange(at, min(at + rows, n))[:, None]
        j = np.arange(n)[None, :]
        boxes = (low[i] <= high[j]).all(-1) & (low[j] <= high[i]).all(-1) & (j != i) & (j != (i + 1) % n) & (i != (j + 1) % n)
        x, y = np.nonzero(boxes)
        p, q = x + at, y
        if ((side(a[p], b[p], a[q]) * side(a[p], b[p], b[q]) <= 0) & (side(a[q], b[q], a[p]) * side(a[q], b[q], b[p]) <= 0)).any():
            return True
    flat = side(a, b, np.roll(xy, -2, axis=0)) == 0
    back = ((b - a) * (np.roll(xy, -2, axis=0) - b)).sum(1) < 0
    return bool((flat & back).any())


def _cut_rings(tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for corners in batch.column("corners").to_pylist():
                corners = sorted(corners, key=lambda c: c["at"])
                xy = np.array([(c["x"], c["y"]) for c in corners], float)
                made.append(arcs_of(xy, np.array([c["fixed"] for c in corners], bool), tolerance))
            point = pa.list_(pa.list_(pa.float64()))
            kind = pa.list_(pa.struct([("key", pa.string()), ("turned", pa.bool_()), ("whole", point), ("thin", point)]))
            yield pa.RecordBatch.from_arrays([batch.column("polygon_id"), batch.column("ring"), pa.array(made, kind)], ["polygon_id", "ring", "arcs"])

    return run


def _made_rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(polygon_id, ring, points, bad): rings with their whole arcs, and the keys of arcs that a bad ring has not whole yet."""
    for batch in batches:
        points, bad = [], []
        for arcs, whole in zip(batch.column("arcs").to_pylist(), batch.column("kept").to_pylist()):
            whole = set(whole or ())
            xy = ring_of(arcs, whole)
            left = [arc["key"] for arc in arcs if arc["key"] not in whole and len(arc["thin"]) < len(arc["whole"])]
            points.append([{"x": x, "y": y} for x, y in xy.tolist()])
            bad.append(left if left and crosses_itself(xy) else [])
        kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        yield pa.RecordBatch.from_arrays([batch.column("polygon_id"), batch.column("ring"), pa.array(points, kind), pa.array(bad, pa.list_(pa.string()))], ["polygon_id", "ring", "points", "bad"])


def simplified_map(polygons: DataFrame, tolerance: float) -> DataFrame:
    """(polygon_id, rings) with fewer vertices; rings come closed or open, and open they are given back.

    A polygon without rings has none; rings that cross themselves from the start keep all their vertices.
    """
    kind = polygons.schema["polygon_id"].dataType.simpleString()
    rings = polygons.select("polygon_id", F.posexplode("rings").alias("ring", "points")).where(F.size("points") > 0)
    closed = (F.size("points") > 1) & (F.get("points", F.lit(0)) == F.element_at("points", -1))
    rings = rings.withColumn("points", F.when(closed, F.slice("points", F.lit(1), F.size("points") - 1)).otherwise(F.col("points")))
    around = lambda k: F.element_at("points", F.pmod(F.col("at") + k, F.size("points")) + 1)
    corners = rings.select("polygon_id", "ring", "points", F.posexplode("points").alias("at", "p"))
    corners = saved(corners.select("polygon_id", "ring", "at", "p.x", "p.y", around(-1).alias("before"), around(1).alias("after")))
    met = corners.select("x", "y", F.explode(F.array("before", "after")).alias("other")).distinct().groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    fixed = met.where("n > 2").select("x", "y", F.lit(True).alias("fixed"))
    marked = corners.select("polygon_id", "ring", "at", "x", "y").join(fixed, ["x", "y"], "left")
    whole = marked.groupBy("polygon_id", "ring").agg(F.collect_list(F.struct("at", "x", "y", F.coalesce("fixed", F.lit(False)).alias("fixed"))).alias("corners"))  # a ring
    cut = saved(whole.mapInArrow(_cut_rings(tolerance), f"polygon_id {kind}, ring int, arcs {_ARCS}"))
    kept = None
    while True:
        given = cut.withColumn("kept", F.lit(None).cast("array<string>"))
        if kept is not None:
            named = cut.select("polygon_id", "ring", F.explode("arcs.key").alias("key")).join(kept, "key")
            given = cut.join(named.groupBy("polygon_id", "ring").agg(F.collect_set("key").alias("kept")), ["polygon_id", "ring"], "left")
        made = saved(given.mapInArrow(_made_rings, f"polygon_id {kind}, ring int, points array<struct<x:double,y:double>>, bad array<string>"))
        more = made.select(F.explode("bad").alias("key")).distinct()
        if more.isEmpty():
            break
        kept = saved(more if kept is None else kept.union(more).distinct())
    rings = made.groupBy("polygon_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda r: r["points"]).alias("rings"))
    return polygons.select("polygon_id").join(rings, "polygon_id", "left")
