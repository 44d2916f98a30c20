"""Who stands behind a building: owners, interest holders, managers and the licensee, and what kind the operator is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.functions.names import match_key, owner_key
from plotwise.functions.text import dashed, digits

# How the registry's types of interest start, and the public label of each.
INTERESTS = (("INTEREST_HOLDER", "interest holder"), ("RB_TRUSTEE_", "trustee"), ("RB_TRUST_SETTLOR_", "settlor"), ("RB_PARTNER_", "partner"))
# The type of owner that a kind of body is.
OWNER_TYPES = {
    "government": "government", "non_profit": "non_profit", "coop": "coop", "individual": "private", "company": "private",
    "numbered_company": "private", "trust": "private", "partnership": "private",
}
ROLES = ("owner", "interest_holder", "manager", "licensee")
_SOURCE = "struct<type:string,as_of:string,url:string>"


def interest(kind: Column) -> Column:
    """The public label of a type of interest; null for the body itself and anything else."""
    out = F.lit(None).cast("string")
    for start, label in reversed(INTERESTS):
        out = F.when(kind.startswith(start), label).otherwise(out)
    return out


def interest_holders(filings: DataFrame, bridge: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Per building who stands behind the reporting bodies, those on the most parcels first.

    filings: (pid, body, interest_type, holder, status, withheld, obscured), bridge: (pid, building), parcels in any
    spelling.  Failed and withheld filings, and rows that name the body itself, do not count.  A holder goes by its
    commonest spelling, ties the least; building, holders array of (name, interest, pids).
    """
    said = filings.where((F.trim("holder") != "") & F.col("pid").isNotNull() & F.coalesce(F.col("status") == "SUCCESS", F.lit(True)))
    said = said.where(~F.coalesce(F.lower("withheld"), F.lit("0")).isin("1", "true") & (F.coalesce(F.trim("obscured"), F.lit("")) == ""))
    said = said.select(
        digits(F.col("pid")).alias("bare"), F.trim("holder").alias("holder"), interest(F.col("interest_type")).alias("interest"),
        owner_key(F.trim("holder"), ascii_only).alias("key"), owner_key(F.col("body"), ascii_only).alias("body_key"),
    ).where("interest is not null and key != body_key")
    shown = said.groupBy("key").agg(F.mode("holder", True).alias("name"))
    at = said.join(bridge.select(digits(F.col("pid")).alias("bare"), "building").distinct(), "bare")
    each = at.groupBy("building", "key", "interest").agg(F.array_sort(F.collect_set(dashed(F.col("bare")))).alias("pids")).join(shown, "key")
    order = F.struct((-F.size("pids")).alias("order"), "name", "interest", "pids")
    listed = F.transform(F.array_sort(F.collect_list(order)), lambda h: F.struct(h["name"].alias("name"), h["interest"].alias("interest"), h["pids"].alias("pids")))
    return each.groupBy("building").agg(listed.alias("holders"))


def housing_facts(rows: DataFrame, licences: DataFrame, non_market: DataFrame, release: str) -> DataFrame:
    """Per building: purpose_built (any row of the release), zoning (first that is known), licence_types (sorted), non_market.

    rows: (building, pos, release, zoning), licences: (building, type), non_market: (building, fact).
    """
    first = F.min_by("zoning", F.when(F.coalesce("zoning", F.lit("")) != "", F.col("pos")))
    own = rows.groupBy("building").agg(F.coalesce(F.bool_or(F.col("release") == release), F.lit(False)).alias("purpose_built"), first.alias("zoning"))
    types = licences.where("type is not null").groupBy("building").agg(F.array_sort(F.collect_set("type")).alias("licence_types"))
    fact = non_market.groupBy("building").agg(F.min("fact").alias("non_market"))
    out = own.join(types, "building", "left").join(fact, "building", "left")
    return out.withColumn("licence_types", F.coalesce("licence_types", F.array().cast("array<string>")))


def _said(rows: DataFrame, role: str, pos: Column, name: Column, kind: Column, as_of: Column | None = None, url: Column | None = None, pids: Column | None = None, label: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    source = F.struct(kind.alias("type"), (none if as_of is None else as_of).alias("as_of"), (none if url is None else url).alias("url"))
    return rows.select(
        "building", F.lit(role).alias("role"), pos.cast("int").alias("pos"), F.trim(name).alias("name"), source.cast(_SOURCE).alias("source"),
        (F.lit(None) if pids is None else pids).cast("array<string>").alias("pids"), (none if label is None else label).alias("interest"),
    ).where("name != ''")


def parties(buildings: DataFrame, clusters: DataFrame) -> DataFrame:
    """(building, role, pos, name, sources, pids, interest, same_as): everyone a record names, in roles.

    buildings: (building, registry_owners array of (name, pids), retrieved, owner_name, owner_source, joint array,
    holders array of (name, interest, pids), managed_by, managed_by_source, listings array of (by, url, seen), operator,
    licence_holder); clusters: (name, cluster).  Names are the same if their match keys are equal, or lie in one
    cluster.  Managers of one name are one party with all its sources: the licence, the manager's own listing, other
    listings, the inventory.  A licensee who is an owner, else a manager, says so and becomes a source of that party.
    """
    registry = buildings.where(F.size("registry_owners") > 0).select("building", "retrieved", F.posexplode("registry_owners").alias("pos", "x"))
    owners = _said(registry, "owner", F.col("pos"), F.col("x.name"), F.lit("registry"), F.col("retrieved"), pids=F.col("x.pids"))
    bare = buildings.where(F.coalesce(F.size("registry_owners"), F.lit(0)) <= 0).where("owner_name is not null and owner_source is not null")
    several = F.when((F.col("owner_source") == "inventory") & (F.size("joint") > 1), F.col("joint")).otherwise(F.array("owner_name"))
    single = bare.select("building", "owner_source", F.posexplode(several).alias("pos", "x"))
    owners = owners.unionByName(_said(single, "owner", F.col("pos"), F.col("x"), F.col("owner_source")))
    behind = buildings.select("building", "retrieved", F.posexplode("holders").alias("pos", "x"))
    holders = _said(behind, "interest_holder", F.col("pos"), F.col("x.name"), F.lit("registry"), F.col("retrieved"), pids=F.col("x.pids"), label=F.col("x.interest"))
    listed = buildings.select("building", "managed_by", F.posexplode("listings").alias("pos", "x"))
    managers = (
        _said(buildings.where("managed_by_source = 'licence'"), "manager", F.lit(0), F.col("managed_by"), F.lit("licence"))
        .unionByName(_said(listed, "manager", F.col("pos") + 1, F.col("x.by"), F.lit("listing"), F.col("x.seen"), F.col("x.url")))
        .unionByName(_said(buildings, "manager", F.lit(1 << 20), F.col("operator"), F.lit("inventory")))
    )
    licensee = _said(buildings, "licensee", F.lit(0), F.col("licence_holder"), F.lit("licence"))
    by_key = clusters.groupBy(match_key(F.col("name")).alias("key")).agg(F.min("cluster").alias("cluster"))
    said = owners.unionByName(holders).unionByName(managers).unionByName(licensee).withColumn("key", match_key(F.col("name")))
    said = said.join(by_key, "key", "left").withColumn("same", F.coalesce(F.concat(F.lit("c:"), "cluster"), F.concat(F.lit("k:"), "key")))
    own = buildings.select("building", match_key(F.col("managed_by")).alias("key")).join(by_key, "key", "left")
    own = own.select("building", F.coalesce(F.concat(F.lit("c:"), "cluster"), F.concat(F.lit("k:"), "key")).alias("manager"))
    said = said.join(own, "building", "left")
    rank = F.when(F.col("role") != "manager", 0).when(F.col("source.type") == "licence", 0).when(F.col("source.type") == "inventory", 3)
    said = said.withColumn("rank", rank.when(F.col("same") == F.col("manager"), 1).otherwise(2))
    one = F.when(F.col("role") == "manager", F.col("same")).otherwise(F.col("pos").cast("string"))
    each = said.withColumn("one", one).groupBy("building", "role", "one").agg(
        F.min(F.struct("rank", "pos", "name", "same")).alias("x"), F.array_sort(F.collect_list(F.struct("rank", "pos", "source"))).alias("sources"),
        F.first("pids", True).alias("pids"), F.min("interest").alias("interest"),
    )
    each = each.select("building", "role", "x.*", F.transform("sources", lambda s: s["source"]).alias("sources"), "pids", "interest")
    return _with_licensee(each)


def _with_licensee(each: DataFrame) -> DataFrame:
    """Adds ``same_as`` to the licensee, and the licence to the sources of the party that it is."""
    place = F.struct((F.col("role") == "manager").cast("int").alias("late"), "rank", "pos", "name", "role")
    others = each.where("role in ('owner', 'manager')").groupBy("building", "same").agg(F.min(place).alias("first"))
    links = each.where("role = 'licensee'").select("building", "same").distinct().join(others, ["building", "same"]).select("building", "same", "first")
    out = each.join(links, ["building", "same"], "left")
    met = F.col("first").isNotNull() & (F.col("role") == F.col("first.role")) & (F.col("rank") == F.col("first.rank")) & (F.col("pos") == F.col("first.pos")) & (F.col("name") == F.col("first.name"))
    licence = F.struct(F.lit("licence").alias("type"), F.lit(None).cast("string").alias("as_of"), F.lit(None).cast("string").alias("url")).cast(_SOURCE)
    new = F.coalesce(met, F.lit(False)) & ~F.exists("sources", lambda s: s["type"] == "licence")
    return out.select(
        "building", "role", "rank", "pos", "name", F.when(new, F.array_append("sources", licence)).otherwise(F.col("sources")).alias("sources"), "pids", "interest",
        F.when(F.col("role") == "licensee", F.col("first.role")).alias("same_as"),
    )


def operator_axis(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """Per building (value, basis): the manager's type, else that of a licensee who is neither owner nor manager.

    rows: as ``parties`` gives them, kinds: (name, kind).  A building whose operator's kind is unknown has no row.
    """
    able = rows.where("role = 'manager' or (role = 'licensee' and same_as is null)")
    order = F.struct((F.col("role") != "manager").cast("int").alias("late"), "rank", "pos", "name")
    one = able.groupBy("building").agg(F.min_by(F.struct("name", "sources"), order).alias("x")).select("building", "x.*")
    types = F.create_map(*(F.lit(v) for pair in OWNER_TYPES.items() for v in pair))
    out = one.join(kinds.select("name", "kind").distinct(), "name").withColumn("value", F.try_element_at(types, F.col("kind")))
    return out.where("value is not null").select("building", "value", F.array_distinct(F.transform("sources", lambda s: s["type"])).alias("basis"))


def nested(rows: DataFrame) -> DataFrame:
    """Per building its parties as one list: by role, then as they were named."""
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).alias("order")
    fields = ("role", "name", "sources", "pids", "interest", "same_as")
    listed = F.array_sort(F.collect_list(F.struct(role, "rank", "pos", *fields)))
    return rows.groupBy("building").agg(F.transform(listed, lambda p: F.struct(*(p[f].alias(f) for f in fields))).alias("parties"))
