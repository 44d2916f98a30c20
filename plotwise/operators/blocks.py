"""City blocks with the buildings in them; an empty block takes its area from points that name areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spatial
from .graph import saved

UNKNOWN = "(Unknown)"


def counted(blocks: DataFrame, buildings: DataFrame, size: float) -> DataFrame:
    """Per block: buildings, total_units, median_year, building_ids in order, and area, the commonest (ties: the first).

    blocks: (polygon_id, rings); buildings: (point_id, x, y, units, year, area).  A building belongs to the block of the
    least id that holds it.  Blocks without buildings count none, and have no median and no area.
    """
    placed = spatial.assigned(buildings, blocks, size).where("polygon_id is not null")
    totals = placed.groupBy("polygon_id").agg(
        F.count(F.lit(1)).alias("buildings"), F.sum("units").alias("total_units"), F.median("year").alias("median_year"), F.array_sort(F.collect_list("point_id")).alias("building_ids"), F.mode("area", True).alias("area")
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)
    none = F.array().cast(totals.schema["building_ids"].dataType)
    return blocks.join(totals.hint("merge"), "polygon_id", "left").select("polygon_id", "rings", zero("buildings"), zero("total_units"), "median_year", F.coalesce("building_ids", none).alias("building_ids"), "area")


def with_areas(blocks: DataFrame, named: DataFrame, size: float) -> DataFrame:
    """Fills in ``area`` where it is null: from the named points that the block holds, else from the one nearest to its centroid.

    named: (point_id, x, y, area).  A point belongs to the block of the least id that holds it; of the areas of a
    block's points the commonest counts, ties by name; of points equally near, that of the least id.  Without named points
    the area is ``(Unknown)``.
    """
    named = named.where("area is not null and x is not null and y is not null")
    held = spatial.assigned(named, blocks.select("polygon_id", "rings"), size).where("polygon_id is not null")
    inside = held.groupBy("polygon_id").agg(F.mode("area", True).alias("_inside"))
    told = saved(blocks.join(inside.hint("merge"), "polygon_id", "left"))  # else each round of the nearest would count the blocks again
    x, y = spatial.centroid(F.get("rings", F.lit(0)))
    asking = told.where("area is null and _inside is null").select(F.col("polygon_id").alias("point_id"), x.alias("x"), y.alias("y"))
    near = spatial.nearest(asking, named.select(F.col("point_id").alias("target_id"), F.col("x").alias("tx"), F.col("y").alias("ty")), size)
    near = near.join(named.select(F.col("point_id").alias("target_id"), F.col("area").alias("_near")).hint("merge"), "target_id").select(F.col("point_id").alias("polygon_id"), "_near")
    return told.join(near.hint("merge"), "polygon_id", "left").withColumn("area", F.coalesce("area", "_inside", "_near", F.lit(UNKNOWN))).drop("_inside", "_near")
