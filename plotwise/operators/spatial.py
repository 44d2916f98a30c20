"""Points and polygons by grid cells: an equality join finds candidates, an expression decides.

A polygon is an array of rings, a ring an array of (x, y); even-odd over all rings, so that holes count.

Joins of tables that grow with the input are sorted merges by hint: Spark's size estimates follow the compressed files, not
rows and rings, and a million points in a file of some MB would go through the driver as a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import saved

RINGS = "array<array<struct<x:double,y:double>>>"


def rings_of(geojson: Column) -> Column:
    """Rings of a GeoJSON polygon or multipolygon as text; null if it cannot be read."""
    kind = F.get_json_object(geojson, "$.type")
    polygon = F.from_json(F.get_json_object(geojson, "$.coordinates"), "array<array<array<double>>>")
    multi = F.flatten(F.from_json(F.get_json_object(geojson, "$.coordinates"), "array<array<array<array<double>>>>"))
    points = F.when(kind == "Polygon", polygon).when(kind == "MultiPolygon", multi)
    rings = F.transform(points, lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    return F.when(F.size(rings) > 0, rings)


def edges_of(rings: Column) -> Column:
    def of(ring: Column) -> Column:
        following = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1))
        return F.zip_with(ring, following, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))

    return F.flatten(F.transform(rings, of))


def on_edge(edges: Column, x: Column, y: Column) -> Column:
    return F.exists(
        edges,
        lambda e: ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"]))
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])),
    )


def inside(edges: Column, x: Column, y: Column, boundary: bool = True) -> Column:
    """Even-odd test; points on an edge count as the caller says."""
    crossed = F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    touching = on_edge(edges, x, y)
    return (touching | (F.size(crossed) % 2 == 1)) if boundary else (~touching & (F.size(crossed) % 2 == 1))


def bounds(rings: Column) -> tuple[Column, Column, Column, Column]:
    flat = F.flatten(rings)
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def with_cells(polygons: DataFrame, size: float) -> DataFrame:
    """A row for each grid cell that the polygon's bounds touch."""
    x1, y1, x2, y2 = bounds(F.col("rings"))
    cell = lambda v: F.floor(v / size)
    return (
        polygons.withColumns({"edges": edges_of(F.col("rings")), "_x1": x1, "_y1": y1, "_x2": x2, "_y2": y2})
        .withColumn("_cx", F.explode(F.sequence(cell(x1), cell(x2))))
        .withColumn("_cy", F.explode(F.sequence(cell(y1), cell(y2))))
    )


def candidates(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    placed = points.withColumns({"_cx": F.floor(F.col("x") / size), "_cy": F.floor(F.col("y") / size)})
    cells = with_cells(polygons, size).select("polygon_id", "edges", "_cx", "_cy", "_x1", "_y1", "_x2", "_y2").hint("merge")
    met = placed.join(cells, ["_cx", "_cy"]).where("x between _x1 and _x2 and y between _y1 and _y2")
    return met.drop("_x1", "_y1", "_x2", "_y2")


def assigned(points: DataFrame, polygons: DataFrame, size: float, boundary: bool = True) -> DataFrame:
    """Adds the smallest polygon_id that holds the point; points: (point_id, x, y)."""
    hits = candidates(points, polygons, size).where(inside(F.col("edges"), F.col("x"), F.col("y"), boundary))
    return points.join(hits.groupBy("point_id").agg(F.min("polygon_id").alias("polygon_id")).hint("merge"), "point_id", "left")


def flagged(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """Points that some polygon holds."""
    hits = candidates(points, polygons, size).where(inside(F.col("edges"), F.col("x"), F.col("y"))).select("point_id").distinct()
    return points.join(hits.withColumn("inside", F.lit(True)).hint("merge"), "point_id", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def _cross(a: Column, b: Column) -> Column:
    side = lambda e, x, y: F.signum((e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]))
    apart_b = side(a, b["x1"], b["y1"]) * side(a, b["x2"], b["y2"]) <= 0
    apart_a = side(b, a["x1"], a["y1"]) * side(b, a["x2"], a["y2"]) <= 0
    boxes = (F.least(a["x1"], a["x2"]) <= F.greatest(b["x1"], b["x2"])) & (F.least(b["x1"], b["x2"]) <= F.greatest(a["x1"], a["x2"]))
    boxes = boxes & (F.least(a["y1"], a["y2"]) <= F.greatest(b["y1"], b["y2"])) & (F.least(b["y1"], b["y2"]) <= F.greatest(a["y1"], a["y2"]))
    return apart_a & apart_b & boxes


def intersecting(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """polygon_id of the left polygons that share a point with a right one."""
    a = with_cells(left, size).select(F.col("polygon_id"), F.col("edges").alias("ea"), "_cx", "_cy")
    b = with_cells(right, size).select(F.col("polygon_id").alias("other"), F.col("edges").alias("eb"), "_cx", "_cy")
    pairs = a.join(b, ["_cx", "_cy"])
    corner = lambda edges, other: inside(edges, F.get(other, F.lit(0))["x1"], F.get(other, F.lit(0))["y1"])
    meet = F.exists("ea", lambda x: F.exists("eb", lambda y: _cross(x, y))) | corner(F.col("ea"), F.col("eb")) | corner(F.col("eb"), F.col("ea"))
    return pairs.where(meet).select("polygon_id").distinct()


RINGS_FIRST = (1, 8)  # cells are so many times as wide in the two rounds before the quad cells
QUAD, DEEPEST = 64, 40  # targets of a quad cell that is not split further; levels
FEW_CELLS = 20_000  # cells of a level that are broadcast, counted first; more are joined by sorting


def _few(cells: DataFrame) -> DataFrame:
    """Saved cells with the hint that their number asks for."""
    return F.broadcast(cells) if cells.count() <= FEW_CELLS else cells.hint("merge")


def _quad_levels(targets: DataFrame, limit: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels of quad cells that hold targets, and the targets with the undivided cell they are in.

    A cell has its bounds, one of its targets, and the cell above it; it is split where it has more than ``limit`` targets.
    Of targets in one place the least stands for all, so that any crowd is split.  Each level is saved.
    """
    going = saved(targets.where("tx is not null and ty is not null and target_id is not null").groupBy("tx", "ty").agg(F.min("target_id").alias("target_id")))
    x0, y0, wide = going.agg(F.min("tx"), F.min("ty"), F.greatest(F.max("tx") - F.min("tx"), F.max("ty") - F.min("ty"))).first()
    levels, homes = [], None
    for level in range(DEEPEST + 1):
        cell = lambda c, low: F.least(F.floor((F.col(c) - low) / (wide or 1.0) * (1 << level)), F.lit((1 << level) - 1)).cast("bigint")  # noqa: B023, E731
        placed = going.withColumns({"qx": cell("tx", x0), "qy": cell("ty", y0)})
        cells = placed.groupBy("qx", "qy").agg(
            F.count(F.lit(1)).alias("n"), F.min("tx").alias("x1"), F.max("tx").alias("x2"), F.min("ty").alias("y1"), F.max("ty").alias("y2"), F.min(F.struct("target_id", "tx", "ty")).alias("one")
        )
        split = (F.col("n") > limit) & F.lit(level < DEEPEST)
        cells = saved(cells.withColumns({"split": split, "px": F.shiftright("qx", 1), "py": F.shiftright("qy", 1)}))
        levels.append(cells)
        told = saved(placed.join(_few(cells.select("qx", "qy", "split")), ["qx", "qy"]))
        home = told.where("not split").select(F.lit(level).alias("level"), "qx", "qy", "target_id", "tx", "ty")
        homes = home if homes is None else homes.unionByName(home)
        going = told.where("split").select("target_id", "tx", "ty")
        if going.isEmpty():
            return levels, homes
    return levels, homes


def descended(points: DataFrame, targets: DataFrame, limit: int = QUAD) -> DataFrame:
    """(point_id, target_id): the nearest target of each point, ties the smallest, by going down quad cells.

    Each cell tells of one target, and has one on every side of its bounds, so that a point knows a distance that suffices,
    and leaves cells that are farther.  However the targets crowd, a point meets those of few cells.
    """
    levels, homes = _quad_levels(targets, limit)
    zero = F.lit(0).cast("bigint")
    asking = points.select("point_id", "x", "y", F.lit(float("inf")).alias("enough"), zero.alias("px"), zero.alias("py"))
    square = lambda x, y: F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2)
    beyond = lambda c, low, high: F.greatest(F.col(low) - F.col(c), F.lit(0.0), F.col(c) - F.col(high))
    nearer = lambda c, low, high: F.least(F.abs(F.col(c) - F.col(low)), F.abs(F.col(c) - F.col(high)))
    farther = lambda c, low, high: F.greatest(F.abs(F.col(c) - F.col(low)), F.abs(F.col(c) - F.col(high)))
    bx, by = ("x", "x1", "x2"), ("y", "y1", "y2")
    reach = F.least(F.pow(nearer(*bx), 2) + F.pow(farther(*by), 2), F.pow(farther(*bx), 2) + F.pow(nearer(*by), 2))  # to some target on the nearer side
    own, ends = Window.partitionBy("point_id"), None  # the few cells of a point
    for level, cells in enumerate(levels):
        met = asking.join(_few(cells), ["px", "py"]).withColumn("far", F.pow(beyond("x", "x1", "x2"), 2) + F.pow(beyond("y", "y1", "y2"), 2)).where("far <= enough")
        met = met.withColumn("enough", F.least("enough", F.min(F.least(square(F.col("one.tx"), F.col("one.ty")), reach)).over(own))).where("far <= enough")
        met = saved(met.select("point_id", "x", "y", "enough", "split", "qx", "qy"))
        end = met.where("not split").select("point_id", "x", "y", F.lit(level).alias("level"), "qx", "qy")
        ends = end if ends is None else ends.unionByName(end)
        asking = met.where("split").select("point_id", "x", "y", "enough", F.col("qx").alias("px"), F.col("qy").alias("py"))
    best = F.min(F.struct(square(F.col("tx"), F.col("ty")).alias("d"), F.col("target_id").alias("t")))
    return ends.join(homes.hint("merge"), ["level", "qx", "qy"]).groupBy("point_id").agg(best.alias("hit")).select("point_id", F.col("hit.t").alias("target_id"))


def nearest(points: DataFrame, targets: DataFrame, size: float) -> DataFrame:
    """Adds the target_id nearest to each point, ties the smallest.

    Cells around a point are searched, and then wider ones, for points with an answer near by; a hit is sure when it is no
    farther than the searched ring reaches.  The other points go down quad cells.  Each round's answers, and the points
    that it leaves, are saved, so that no round is computed again.  Points without an id or a place have no target.
    """
    todo, answers = points.select("point_id", "x", "y").dropna(), None
    targets = targets.select("target_id", "tx", "ty").dropna()
    if targets.isEmpty():
        return points.withColumn("target_id", F.lit(None).cast(targets.schema["target_id"].dataType))
    for reach in RINGS_FIRST:
        cell = size * reach
        placed = targets.withColumns({"_cx": F.floor(F.col("tx") / cell), "_cy": F.floor(F.col("ty") / cell)})
        around = todo.withColumn("_dx", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("_dy", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
        around = around.withColumns({"_cx": F.floor(F.col("x") / cell) + F.col("_dx"), "_cy": F.floor(F.col("y") / cell) + F.col("_dy")})
        distance = F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2)
        best = around.join(placed.hint("merge"), ["_cx", "_cy"]).groupBy("point_id").agg(F.min(F.struct(distance.alias("d"), F.col("target_id").alias("t"))).alias("hit"))
        found = saved(best.where(F.col("hit.d") <= cell * cell).select("point_id", F.col("hit.t").alias("target_id")))
        answers = found if answers is None else answers.unionByName(found)
        todo = saved(todo.join(found.hint("merge"), "point_id", "left_anti"))
        if todo.isEmpty():
            return points.join(answers.hint("merge"), "point_id", "left")
    return points.join(answers.unionByName(descended(todo, targets)).hint("merge"), "point_id", "left")


def centroid(ring: Column) -> tuple[Column, Column]:
    """Of a polygon's outer ring, by the shoelace formula; of its points' mean where it has no area."""
    edges = edges_of(F.array(ring))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    add = lambda s, e: F.struct(
        (s["a"] + e["x1"] * e["y2"] - e["x2"] * e["y1"]).alias("a"),
        (s["x"] + (e["x1"] + e["x2"]) * (e["x1"] * e["y2"] - e["x2"] * e["y1"])).alias("x"),
        (s["y"] + (e["y1"] + e["y2"]) * (e["x1"] * e["y2"] - e["x2"] * e["y1"])).alias("y"),
    )
    total = F.aggregate(edges, zero, add)
    mean = lambda c: F.aggregate(F.transform(ring, lambda p: p[c]), F.lit(0.0), lambda s, v: s + v) / F.size(ring)
    return F.when(total["a"] == 0, mean("x")).otherwise(total["x"] / (3 * total["a"])), F.when(total["a"] == 0, mean("y")).otherwise(total["y"] / (3 * total["a"]))


def area_labels(blocks: DataFrame) -> DataFrame:
    """``area-NN`` from north to south and then west to east, those without a centroid last; blocks: (block_id, area, cx, cy)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("area").orderBy(F.desc_nulls_last("cy"), F.asc_nulls_last("cx"), "block_id")
    n = F.row_number().over(w).cast("string")
    return blocks.withColumn("label", F.concat_ws("-", "area", F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)))
