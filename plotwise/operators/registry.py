"""What the land registry says about a building: owners, searches, parcels, plans; and what listings add."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.functions.address import address_key
from plotwise.functions.text import dashed
from plotwise.operators.dedupe import commonest


def shown(filings: DataFrame) -> DataFrame:
    """Filings that may be shown: fetched, not withheld, with a name."""
    fetched = F.coalesce(F.lower("status"), F.lit("success")) == "success"
    return filings.where(fetched & ~F.coalesce(F.lower("withheld"), F.lit("0")).isin("1", "true", "yes") & (F.trim("name") != ""))


def owners(filings: DataFrame, bridge: DataFrame) -> DataFrame:
    """Per building its registry bodies, those with the most parcels first; filings: (pid, key, name, filed_on), bridge: (pid, building)."""
    per_body = filings.join(bridge, "pid").groupBy("building", "key").agg(F.count_distinct("pid").alias("pids"), commonest("name").alias("name"), F.max("filed_on").alias("filed_on"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("pids")).alias("order"), "name", "key", "pids", "filed_on")))
    out = per_body.groupBy("building").agg(ranked.alias("x"), F.max("filed_on").alias("retrieved"))
    return out.select("building", F.transform("x", lambda b: F.struct(b["key"].alias("key"), b["name"].alias("name"), b["pids"].alias("pids"))).alias("bodies"), "retrieved")


def no_filings(searches: DataFrame, bridge: DataFrame) -> DataFrame:
    """Per building the last day on which its last searches found nothing; buildings with a filing are left out."""
    last = searches.groupBy("pid").agg(F.max_by("result", F.struct("searched_on", "result")).alias("result"), F.max("searched_on").alias("searched_on"))
    at = last.join(bridge, "pid")
    filed = at.where("result = 'filed'").select("building").distinct()
    return at.where("result = 'no_filing'").join(filed, "building", "left_anti").groupBy("building").agg(F.max("searched_on").alias("searched_on"))


def parcels(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("building").agg(F.array_sort(F.collect_set(dashed(F.col("pid")))).alias("pids"))


def clientele(rows: DataFrame) -> DataFrame:
    """Per building: units by clientele, operators in order of appearance, and whether at least 80 % are for seniors; rows: (building, pos, operator, families, seniors, other)."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    ordered = F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pos", "operator"))), lambda x: x["operator"]), lambda x: x.isNotNull()))
    out = rows.groupBy("building").agg(n("families").alias("families"), n("seniors").alias("seniors"), n("other").alias("other"), ordered.alias("operators"))
    total = F.col("families") + F.col("seniors") + F.col("other")
    return out.withColumn("for_seniors", (total > 0) & (F.col("seniors") >= 0.8 * total))


def picked_names(names: DataFrame) -> DataFrame:
    """Per building the name of the best source and the other spellings; names: (building, rank, pos, name)."""
    known = names.where("trim(name) != ''").withColumn("key", F.regexp_replace(F.lower("name"), "[^a-z0-9]", ""))
    first = known.groupBy("building", "key").agg(F.min(F.struct("rank", "pos", "name")).alias("x"))
    out = first.groupBy("building").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["name"]).alias("all"))
    return out.select("building", F.get("all", F.lit(0)).alias("name"), F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0))).alias("alternates"))


def merged_extras(rows: DataFrame) -> DataFrame:
    """Unmatched overlay records of one key as one: flags together, first name, lineage; without coordinates they go."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    out = rows.groupBy("key").agg(first("name").alias("name"), F.bool_or("is_coop").alias("is_coop"), F.bool_or("is_sro").alias("is_sro"), first("lat").alias("lat"), first("lon").alias("lon"), F.array_sort(F.collect_list(F.struct("source", "id"))).alias("lineage"))
    return out.where("lat is not null and lon is not null")


def unmatched_records(rows: DataFrame, known: DataFrame, source: str) -> DataFrame:
    """Records that no building has, each under an id of its own; rows: (id, pos, key, name, status, lat, lon), known: (key).

    A source's own ids need not tell its rows apart, so the place in the file goes into the id.
    """
    alone = rows.join(known.select("key").distinct(), "key", "left_anti")
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")).alias(c)
    own = F.concat_ws("-", F.lit(source), F.coalesce(F.col("id").cast("string"), F.lit("None")), F.col("pos").cast("string"))
    return alone.select(own.alias("synthetic_id"), F.lit(source).alias("source"), clean("name"), clean("status"), "lat", "lon")


def plan_numbers(rows: DataFrame) -> DataFrame:
    """(plan, key) of sites that carry a plan number, which has a letter, rather than a parcel; rows: (site_id, civic, street)."""
    held = rows.where(F.col("site_id").rlike("[A-Za-z]") & F.col("civic").isNotNull() & F.col("street").isNotNull())
    civic = F.regexp_replace(F.trim(F.col("civic").cast("string")), r"\.0$", "")
    return held.select(F.upper(F.trim("site_id")).alias("plan"), address_key(F.concat_ws(" ", civic, "street")).alias("key")).distinct()


def provenance(rows: DataFrame, group: str, source: str, labels: list[tuple[str, str]]) -> DataFrame:
    """(group, provenance): the label of the one source there is, else every label with its number, in the order given."""
    counts = rows.groupBy(group).agg(*(F.count_if(F.col(source) == name).alias(f"_n{k}") for k, (name, _) in enumerate(labels)))
    said = [F.struct(F.lit(label).alias("label"), F.col(f"_n{k}").alias("n")) for k, (_, label) in enumerate(labels)]
    found = F.filter(F.array(*said), lambda x: x["n"] > 0)
    many = F.transform(found, lambda x: F.concat(x["label"], F.lit(" ("), x["n"].cast("string"), F.when(x["n"] == 1, " building)").otherwise(" buildings)")))
    return counts.select(group, F.when(F.size(found) == 1, F.get(found, F.lit(0))["label"]).otherwise(F.array_join(many, "; ")).alias("provenance"))


def most_common(rows: DataFrame, name: str, n: int = 50) -> DataFrame:
    """The n commonest names; the limit is what the report asks for."""
    return rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(n)


def deep_link(buildings: DataFrame, asked: DataFrame) -> DataFrame:
    """The building of an address, else of a parcel that only one building has; buildings: (id, address, pids), asked: (ask, address, pid)."""
    by_address = asked.join(buildings.select("address", F.col("id").alias("by_address")), "address", "left")
    single = buildings.select("id", F.explode("pids").alias("pid")).groupBy("pid").agg(F.min("id").alias("by_pid"), F.count_distinct("id").alias("n")).where("n = 1").drop("n")
    return by_address.join(single, "pid", "left").select("ask", F.coalesce("by_address", "by_pid").alias("id"))


def suggestions(rows: DataFrame) -> DataFrame:
    """(kind, key, label, n): owners, networks and managers with their commonest label."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("key"), F.col(f"{k}_label").alias("label")) for k in ("owner", "network", "manager")))
    return rows.select(F.explode(kinds).alias("x")).select("x.*").where("key is not null").groupBy("kind", "key").agg(commonest("label").alias("label"), F.count(F.lit(1)).alias("n"))


def in_view(rows: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    return rows.where(F.col("lat").between(south, north) & F.col("lon").between(west, east)).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("units"), F.lit(0)).alias("units"))
