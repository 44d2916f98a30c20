"""What companies list: one entry a company and building, and buildings that only a listing knows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.functions.names import owner_key
from plotwise.operators.matcher import matched

SOURCE, UNKNOWN = "listing", "(Unknown)"


def alias_names(managers: DataFrame, ascii_only: bool = False) -> DataFrame:
    """From (name, listing_names array): (alias, name), each name and each of its spellings by key; ties the least name."""
    spelled = managers.select("name", F.explode(F.array_append(F.coalesce("listing_names", F.array().cast("array<string>")), F.col("name"))).alias("spelling"))
    return spelled.groupBy(owner_key(F.col("spelling"), ascii_only).alias("alias")).agg(F.min("name").alias("name"))


def per_building(listings: DataFrame, aliases: DataFrame, ascii_only: bool = False) -> DataFrame:
    """From (building, pos, manager, url, seen): building, listings array of (by, url, seen), the first of each company.

    A manager that the configuration knows goes by its name there.  Entries stand in the order of their first listing.
    """
    keyed = listings.withColumn("alias", owner_key(F.col("manager"), ascii_only)).join(aliases, "alias", "left")
    named = keyed.withColumn("by", F.coalesce("name", "manager"))
    first = named.groupBy("building", "by").agg(F.min(F.struct("pos", "url", "seen")).alias("x"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("x.pos").alias("pos"), "by", F.col("x.url").alias("url"), F.col("x.seen").alias("seen"))))
    return first.groupBy("building").agg(F.transform(entries, lambda e: F.struct(e["by"].alias("by"), e["url"].alias("url"), e["seen"].alias("seen"))).alias("listings"))


def added_buildings(listings: DataFrame, known: DataFrame, points: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Buildings of listings that match no building but an address point: one a point.

    listings: (id, address, units), known: (key), points: (key, pos, lat, lon, area), aliases: (alias, key).  Points
    without coordinates do not count; of several with one key the first does.
    """
    asked = listings.where("address is not null and address != ''")
    strangers = matched(asked, known, "address", "key", aliases).where("match is null").drop("match", "tier")
    places = points.where("key is not null and lat is not null and lon is not null").groupBy("key").agg(F.min(F.struct("pos", "lat", "lon", "area")).alias("at"))
    hits = matched(strangers, places.select("key"), "address", "key").where("match is not null")
    units = F.max(F.when(F.col("units") != 0, F.col("units"))).cast("double")
    found = hits.groupBy(F.col("match").alias("key")).agg(units.alias("units"), F.array_sort(F.collect_list("id")).alias("ids"))
    area = F.coalesce(F.nullif(F.trim("at.area"), F.lit("")), F.lit(UNKNOWN))
    return found.join(places, "key").select("key", "at.lat", "at.lon", "units", area.alias("local_area"), F.lit(SOURCE).alias("building_source"), "ids")


def added_by(buildings: DataFrame, listings: DataFrame) -> DataFrame:
    """(manager, address) of every building that a listing added; buildings: (building, address, building_source)."""
    added = buildings.where(F.col("building_source") == SOURCE).select("building", "address")
    return listings.select("building", "manager").join(added, "building").select("manager", "address").distinct()
