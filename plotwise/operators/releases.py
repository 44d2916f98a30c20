"""Further sources brought onto the buildings: releases, licences, housing projects, overlays, imported claims, and a report.

Every join is one of equal keys; what comes together under a key is an aggregate that combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.functions.address import address_key, split_name
from plotwise.functions.names import owner_key
from plotwise.operators import claims, registry
from plotwise.operators.lookup import applied
from plotwise.operators.ranks import numbered

REQUIRED = ("claim_key", "entity_a", "entity_b", "relationship", "source_type")
OPTIONAL = ("source_note", "reported_by", "date_reported", "confidence", "status", "retracted_at", "retracted_reason")
VALUES = ("network_label", "entity_kind", "institutional")  # relations whose second name is a value, not an entity


def merged_releases(rows: DataFrame) -> DataFrame:
    """One row per address over several releases, numbered from 0 by address key, the null key first.

    rows: (rank, pos, address, name, ...), rank 0 for the newest release, which wins.  A building's name after the
    street moves to ``name`` unless that is known, so that an address has one key with its name and without.
    """
    parts = split_name(F.col("address"))
    rows = rows.withColumn("_parts", parts).withColumns({"address": F.col("_parts.address"), "name": F.coalesce("name", "_parts.name")}).drop("_parts")
    keyed = rows.withColumn("key", address_key(F.col("address")))
    kept = keyed.groupBy("key").agg(F.min_by(F.struct(*rows.columns), F.struct("rank", "pos")).alias("row")).select("key", "row.*")
    return numbered(kept, [F.col("key").asc_nulls_first()], "id").withColumn("id", F.col("id") - 1).drop("pos")


def address_index(rows: DataFrame) -> DataFrame:
    """(key, building): the first building of each address that a building goes by.

    rows: (building, addr_key, address, secondary), the last a list with semicolons.
    """
    said = F.concat(F.array("addr_key", "address"), F.split(F.coalesce("secondary", F.lit("")), ";"))
    each = rows.select("building", F.explode(said).alias("said")).where("trim(said) != ''")
    return each.groupBy(address_key(F.col("said")).alias("key")).agg(F.min("building").alias("building"))


def licence_types(licences: DataFrame, index: DataFrame, labels: dict[str, str], dropped: tuple[str, ...]) -> DataFrame:
    """(building, type): kinds of licences at an address, by their labels; licences: (house, street, kind, status)."""
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    live = licences.where(~F.coalesce(F.col("status").isin(*dropped), F.lit(False)) & F.col("house").isNotNull())
    keyed = live.select(address_key(F.concat_ws(" ", "house", "street")).alias("key"), F.try_element_at(table, "kind").alias("type")).where("type is not null")
    return keyed.distinct().join(index, "key").select("building", "type").distinct()


def non_market(projects: DataFrame, index: DataFrame) -> DataFrame:
    """Units by clientele and operators of the completed projects at a building's addresses.

    projects: (pos, address, operator, status, families, seniors, other).
    """
    done = projects.where("status = 'Completed' and address is not null")
    at = done.withColumn("key", address_key(F.col("address"))).join(index, "key")
    return registry.clientele(at.withColumn("operator", F.nullif(F.trim("operator"), F.lit(""))))


def with_overlays(buildings: DataFrame, matched: DataFrame, flags: list[str]) -> DataFrame:
    """Buildings with the flags of their matched record, as a whole; a rooming house's units fill those that are not known.

    buildings: (building, units, ...), matched: (building, units, *flags) with ``is_sro`` among the flags.
    """
    out = applied(buildings, matched, "building", flags)
    units = matched.where("is_sro").select("building", F.col("units").alias("_units"))
    return out.join(units, "building", "left").withColumn("units", F.coalesce("units", "_units")).drop("_units")


def overlay_rows(unmatched: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Records without a building under the columns of their table: flags that are absent are false, others null."""
    empty = lambda kind: F.lit(False if kind == "boolean" else None).cast(kind)
    known = lambda c, kind: F.col(c).cast(kind) if c in unmatched.columns else empty(kind)
    return unmatched.select(*(known(c, kind).alias(c) for c, kind in columns.items()))


def registry_on_points(points: DataFrame, owners: DataFrame, networks: DataFrame, holders: DataFrame, no_filings: DataFrame) -> DataFrame:
    """Registry layers for points without a building; rows with the source ``building`` keep what they have.

    points: (key, source, owner, owner_source, retrieved, no_filing, network, network_source, holders, ...);
    owners: (key, owners array, retrieved), networks: (key, portfolio), holders: (key, holders), no_filings: (key, searched_on),
    a row a key each.  A filing takes the owner; only without one the day of a search counts; points that a registry
    does not know keep their owner, and lose holders.
    """
    name = lambda df, **new: df.select("key", *(F.col(old).alias(c) for c, old in new.items()))
    out = (
        points.join(name(owners, _owners="owners", _retrieved="retrieved"), "key", "left").join(name(networks, _portfolio="portfolio"), "key", "left")
        .join(name(holders, _holders="holders"), "key", "left").join(name(no_filings, _searched="searched_on"), "key", "left")
    )
    point = F.coalesce(F.col("source") != "building", F.lit(True))
    filed, group = point & F.col("_owners").isNotNull(), point & F.col("_portfolio").isNotNull()
    put = lambda when, value, c: F.when(when, value).otherwise(F.col(c))
    return out.withColumns({
        "owner": put(filed, F.get("_owners", F.lit(0)), "owner"),
        "owner_source": put(filed, F.lit("registry"), "owner_source"),
        "retrieved": put(filed, F.col("_retrieved"), "retrieved"),
        "no_filing": put(point & F.col("_owners").isNull(), F.col("_searched"), "no_filing"),
        "network": put(group, F.concat(F.lit("net:"), F.col("_portfolio")), "network"),
        "network_source": put(group, F.lit("claims"), "network_source"),
        "holders": put(point, F.coalesce("_holders", F.array().cast(points.schema["holders"].dataType)), "holders"),
    }).drop("_owners", "_retrieved", "_portfolio", "_holders", "_searched")


def imported_claims(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """The claim log after an import; stored: (claim_id, *REQUIRED, *OPTIONAL), rows: (pos, ...) with columns of those.

    Columns that are not allowed or lack fail at once, a row without a key when it is read.  Blank cells are null.  Of
    rows of one key the last counts.  A name whose key is known takes the spelling that is known longest; what is not
    said keeps nothing of the old claim, but for its number.
    """
    given = set(rows.columns) - {"pos"}
    if wrong := sorted(given - {*REQUIRED, *OPTIONAL}):
        raise ValueError(f"columns that are not allowed: {wrong}")
    if lacking := sorted(set(REQUIRED) - given):
        raise ValueError(f"columns that lack: {lacking}")
    cell = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in given else F.lit(None).cast("string")
    new = rows.select("pos", *(cell(c).alias(c) for c in (*REQUIRED, *OPTIONAL)))
    new = new.withColumn("claim_key", F.coalesce("claim_key", F.raise_error(F.concat(F.lit("no claim_key in row "), F.col("pos").cast("string"))).cast("string")))
    is_name = ~F.coalesce(F.col("relationship").isin(*VALUES), F.lit(False))
    said = lambda df, age, at: df.select(F.explode(F.array(F.struct(F.col("entity_a").alias("name"), F.lit(0).alias("side")), F.struct(F.when(is_name, F.col("entity_b")).alias("name"), F.lit(1).alias("side")))).alias("x"), F.lit(age).alias("age"), F.col(at).cast("bigint").alias("at")).select("x.*", "age", "at")
    known = said(stored, 0, "claim_id").union(said(new, 1, "pos")).where("name is not null").withColumn("key", owner_key(F.col("name")))
    shown = known.groupBy("key").agg(F.min_by("name", F.struct("age", "at", "side")).alias("shown"))
    for side in ("entity_a", "entity_b"):
        spelled = shown.select(F.col("key").alias("_key"), F.col("shown").alias("_shown"))
        mine = F.lit(True) if side == "entity_a" else is_name
        new = new.withColumn("_key", F.when(mine, owner_key(F.col(side)))).join(spelled, "_key", "left")
        new = new.withColumn(side, F.when(mine & F.col(side).isNotNull(), F.coalesce("_shown", side)).otherwise(F.col(side))).drop("_key", "_shown")
    last = claims.latest(new, "claim_key", "pos").withColumn("claim_id", F.lit(None).cast("bigint"))
    return claims.upserted(stored, last.drop("pos"), kept=("claim_id",))


def axis_report(records: DataFrame, axes: list[str], units: str = "units") -> DataFrame:
    """(axis, value, buildings, units): counts by each value of each axis, null ones too, in one pass over the records."""
    pairs = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes))
    each = records.select(F.explode(pairs).alias("x"), F.col(units).alias("_units")).select("x.*", "_units")
    return each.groupBy("axis", "value").agg(F.count(F.lit(1)).alias("buildings"), F.sum("_units").alias("units"))


def entity_counts(parties: DataFrame) -> DataFrame:
    """(name, key, role, kind, institutional, buildings) of everyone that the records name."""
    return parties.groupBy("name", "key", "role", "kind", "institutional").agg(F.count(F.lit(1)).alias("buildings"))


def kind_disagreements(parties: DataFrame) -> DataFrame:
    """(building, owners, licensee, kind): buildings whose licence holder is of a kind that none of their owners is.

    parties: (building, pos, name, role, kind, same_as).  The first licence holder that is nobody else counts.
    """
    holder = (F.col("role") == "licensee") & F.col("same_as").isNull()
    kind_of: Column = F.when(F.col("role") == "owner", F.nullif("kind", F.lit("")))
    each = parties.groupBy("building").agg(
        F.array_sort(F.collect_set(kind_of)).alias("owners"), F.min_by(F.struct("name", "kind"), F.when(holder, F.col("pos"))).alias("_holder")
    )
    out = each.select("building", "owners", F.col("_holder.name").alias("licensee"), F.nullif("_holder.kind", F.lit("")).alias("kind"))
    return out.where((F.size("owners") > 0) & F.col("kind").isNotNull() & ~F.array_contains("owners", F.col("kind")))
