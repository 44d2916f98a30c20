"""Networks of owners: their totals, and their entities with the spellings that are one and the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spelling_key(name: Column) -> Column:
    """What spellings have in common that differ in case and signs only."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def totals(buildings: DataFrame, network: str = "network") -> DataFrame:
    """Per network: buildings, units, assessed_value (null if no building has a value), open_issues; combined on the map side.

    buildings: (network, units, value_land, value_building, n_issues).  A value is whole if one of its parts is known.
    """
    known = F.col("value_land").isNotNull() | F.col("value_building").isNotNull()
    value = F.when(known, F.coalesce("value_land", F.lit(0)) + F.coalesce("value_building", F.lit(0)))
    whole = lambda c: F.sum(F.coalesce(F.col(c).cast("bigint"), F.lit(0)))
    return buildings.where(F.col(network).isNotNull()).groupBy(network).agg(
        F.count(F.lit(1)).alias("buildings"), whole("units").alias("units"), F.bround(F.sum(value), 0).cast("bigint").alias("assessed_value"), whole("n_issues").alias("open_issues")
    )


def entities(spellings: DataFrame, buildings: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(network, name, also_named, kind, buildings): the entities of each network, and how many of its buildings they own.

    spellings: (network, name, registered, kind); buildings: (network, building, owner), a row an owner; clusters: (name,
    cluster) of names that a confirmed claim links.  Names of a cluster, and spellings that differ in case and signs
    only, are one entity; of its names the first registered one is shown, else the first.  An unknown kind is null.
    """
    named = spellings.where(F.trim("name") != "").groupBy("network", "name").agg(F.max("registered").alias("registered"), F.min("kind").alias("kind"))
    named = named.withColumn("spelling", spelling_key(F.col("name")))
    if clusters is None:
        named = named.withColumn("entity", F.col("spelling"))
    else:
        known = clusters.dropna().groupBy("name").agg(F.min("cluster").alias("cluster"))
        # A cluster's key may look like a spelling; the mark keeps them apart.
        named = named.join(known, "name", "left").withColumn("entity", F.coalesce(F.concat(F.lit("="), F.col("cluster").cast("string")), "spelling"))
    entity_of = named.groupBy("network", "spelling").agg(F.min("entity").alias("entity"))
    owned = buildings.select("network", "building", spelling_key(F.col("owner")).alias("spelling")).distinct().join(entity_of, ["network", "spelling"])
    owned = owned.groupBy("network", "entity").agg(F.count_distinct("building").alias("buildings"))
    best = F.min(F.struct((~F.col("registered")).alias("not_registered"), F.col("name"), F.col("kind")))
    shown = named.groupBy("network", "entity").agg(best.alias("best"), F.array_sort(F.collect_set("name")).alias("names"))
    kind = F.col("best.kind")
    return shown.join(owned, ["network", "entity"], "left").select(
        "network", F.col("best.name").alias("name"), F.array_remove("names", F.col("best.name")).alias("also_named"), F.when(kind != "unknown", kind).alias("kind"), F.coalesce("buildings", F.lit(0)).alias("buildings")
    )


def listed(found: DataFrame) -> DataFrame:
    """(network, entities): each network's entities as a list, people first, then by buildings and name."""
    order = F.struct((~F.coalesce(F.col("kind") == "individual", F.lit(False))).alias("a"), (-F.col("buildings")).alias("b"), F.col("name").alias("name"), "also_named", "kind", "buildings")
    rows = F.array_sort(F.collect_list(order))
    return found.groupBy("network").agg(F.transform(rows, lambda e: F.struct(e["name"].alias("name"), e["also_named"].alias("also_named"), e["kind"].alias("kind"), e["buildings"].alias("buildings"))).alias("entities"))
