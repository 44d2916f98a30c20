"""Operator 1: near-duplicate embeddings by tiles of Int8 products with error bounds.

Vectors of a label are dealt to blocks, and each pair of blocks is a tile.  In a tile, unit vectors are quantised to
Int8 with a scale of their own; the norm of what rounding left over is known exactly, so that

    |cos - scale_a * scale_b * (qa . qb)| <= (1 + error_a) * error_b + error_a.

Only pairs that may reach the threshold within that bound are computed again in double precision.  A tile gives a link
count per vector and a forest of its links, never its pairs.  Equal vectors are one point with a weight.  Vectors travel
in the type that they come in, once for each block of their label; a product is cut into stripes whose links are counted
and forgotten one after the other, so that the size of a tile, and not its square, is what a task holds.

Defined cases: rows without an id link with nothing, have no component and are not kept; null labels, and vectors that are null, empty, zero or hold null or non-finite numbers, link with
nothing; vectors of different lengths do not link; repeated rows each count as a vector; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .components import components

THRESHOLD, TILE, STRIPE = 0.98, 4_096, 512


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scales and the norm of the rounding error of each row of unit vectors."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest number to about one: exact, and no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the rows of ``x`` and ``y`` whose cosine reaches the threshold, by ``x``; a stripe of its rows at a time."""
    norm_x, norm_y = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    qx, sx, ex = quantised(x / norm_x[:, None])
    qy, sy, ey = quantised(y / norm_y[:, None])
    kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64  # both hold the integer sums exactly
    turned = qy.astype(kind).T
    for at in range(0, len(x), STRIPE):
        part = slice(at, at + STRIPE)
        about = (qx[part].astype(kind) @ turned).astype(np.float64) * sx[part, None] * sy[None, :]
        bound = (1 + ex[part])[:, None] * ey[None, :] + ex[part, None] + 1e-9
        a, b = np.nonzero(about + bound >= threshold)
        a += at
        sure = np.empty(len(a), bool)
        for first in range(0, len(a), 65_536):
            some = slice(first, first + 65_536)
            sure[some] = (x[a[some]] * y[b[some]]).sum(1) / (norm_x[a[some]] * norm_y[b[some]]) >= threshold
        yield a[sure], b[sure]


def _tile(threshold: float):
    def run(part: pa.Table) -> pa.Table:
        ids, weight, side = (part[c].to_numpy() for c in ("id", "n", "side"))
        x = scaled(part["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1))
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(two)
        links, forest, component = np.zeros(len(ids), np.int64), [], np.arange(len(ids))
        for a, b in close_pairs(x[one], x[one] if same else x[two], threshold):
            if same:
                a, b = a[a < b], b[a < b]
            a, b = one[a], (one if same else two)[b]
            links += (np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))).astype(np.int64)
            starts = np.flatnonzero(np.diff(a, prepend=-1))
            for start, end in zip(starts, np.append(starts[1:], len(a))):
                k, linked = a[start], b[start:end]
                others, first = np.unique(component[linked], return_index=True)
                for other, at in zip(others.tolist(), first.tolist()):
                    if other != component[k]:
                        component[component == other] = component[k]
                        forest.append((ids[k], ids[linked[at]], 0))
        rows = [(ids[k], None, int(links[k])) for k in np.flatnonzero(links)] + forest
        return pa.table({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(("a", "b", "n"))})

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """From (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    embedding = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", embedding.alias("embedding"), "label")
    sound = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    points = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & sound).groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))
    points = cut(points.withColumn("length", F.size("embedding")))
    blocks = points.groupBy("label", "length").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("blocks"))
    dealt = (
        points.join(blocks, ["label", "length"])
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("label", "length", "id", "n", "embedding", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    )
    found = cut(dealt.groupBy("label", "length", "x", "y").applyInArrow(_tile(threshold), "a long, b long, n long"))
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "id")
    groups = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "id")
    known = cut(
        points.join(links, "id", "left").join(groups, "id", "left")
        .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    out = rows.join(known, ["label", "embedding"], "left")
    named = F.col("vec_id").isNotNull()
    component = F.when(named, F.coalesce("component_id", "vec_id"))
    links = F.coalesce(F.when(named, F.col("n_links")), F.lit(0).cast("long"))
    return out.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN least ON least.a = e.vec_id
"""
