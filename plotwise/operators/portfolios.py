"""What a group of owners reaches: by registered titles, by parcel points, by names on licences and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TITLE, POINT, NAME = "building", "point", "name"


def reached(members: DataFrame, titles: DataFrame, buildings: DataFrame, points: DataFrame, named: DataFrame) -> DataFrame:
    """(component, addr, routes, n_pids, counted, held): each address that a component reaches, and how.

    members: (component, entity); titles: (entity, pid); buildings, points: (pid, addr), of the building records and of
    the parcel map; named: (entity, addr), of licences and inventories.  An address reached by a parcel point alone is
    counted only if the parcel has no building record, which is the same building under another address.  An address that
    several components reach is held by the one with the most of its parcels, then the one with more addresses, then
    the least by name.
    """
    parcels = members.join(titles.dropna(), "entity").select("component", "pid").distinct()
    buildings, points = buildings.dropna().distinct(), points.dropna().distinct()
    by_title = parcels.join(buildings, "pid").select("component", "addr", "pid", F.lit(TITLE).alias("route"), F.lit(True).alias("counts"))
    recorded = buildings.select("pid").distinct().withColumn("recorded", F.lit(True))
    by_point = parcels.join(points, "pid").join(recorded, "pid", "left").select("component", "addr", "pid", F.lit(POINT).alias("route"), "recorded")
    covered = F.max(F.coalesce("recorded", F.lit(False)))
    by_name = members.join(named.dropna(), "entity").select("component", "addr", F.lit(None).cast(parcels.schema["pid"].dataType).alias("pid"), F.lit(NAME).alias("route"), F.lit(True).alias("counts"))
    point_counts = by_point.groupBy("component", "addr").agg((~covered).alias("point_counts"))
    rows = by_title.union(by_name).union(by_point.select("component", "addr", "pid", "route", F.lit(False).alias("counts")))
    found = rows.groupBy("component", "addr").agg(F.array_sort(F.collect_set("route")).alias("routes"), F.count_distinct("pid").alias("n_pids"), F.max("counts").alias("counts"))  # three routes
    found = found.join(point_counts, ["component", "addr"], "left")
    found = found.select("component", "addr", "routes", "n_pids", (F.col("counts") | F.coalesce("point_counts", F.lit(False))).alias("counted"))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n_addr"))
    order = F.struct(-F.col("n_pids"), -F.col("n_addr"), F.col("component"))
    winner = found.join(sizes, "component").groupBy("addr").agg(F.min_by("component", order).alias("winner"))
    return found.join(winner, "addr").select("component", "addr", "routes", "n_pids", "counted", (F.col("component") == F.col("winner")).alias("held"))


def sizes(reach: DataFrame) -> DataFrame:
    """(component, addresses, buildings, held): all addresses, those that are buildings of their own, and those it holds."""
    return reach.groupBy("component").agg(F.count(F.lit(1)).alias("addresses"), F.count_if("counted").alias("buildings"), F.count_if("held").alias("held"))
