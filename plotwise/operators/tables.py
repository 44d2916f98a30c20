"""What the tables beside the map show: groups with those not on record last, totals, what filters read, corrected names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.functions.names import owner_key, sector
from plotwise.functions.numeric import area_keys
from plotwise.operators.ownership import assign_where
from plotwise.operators.ranks import numbered

SEARCHED, UNSEARCHED = "unknown-searched", "unknown"  # fixed values: the groups of buildings without a known landlord

#: What a building's source, and each of its flags, is called in the list of sources.
LISTED_IN = {"rental inventory": "rental_inventory", "non-market housing list": "non_market_list", "rental licence": "licence", "manager listing": "listing"}
LISTED_BY_FLAG = (("is_sro", "sro_inventory"), ("is_coop", "chf_bc"), ("is_rezoning", "rezoning"))


def group_key(key: Column, searched: Column) -> Column:
    """The key, or one of two groups for those not on record: searched without a filing, and not yet searched."""
    return F.coalesce(key.cast("string"), F.when(F.coalesce(searched, F.lit("")) != "", SEARCHED).otherwise(UNSEARCHED))


def grouped(rows: DataFrame, key: Column, label: Column, landlord: Column | None = None) -> DataFrame:
    """(group, label, buildings, units, average, landlords, place): a row a group, those not on record last.

    rows: (address, units, ...).  Buildings are those with an address; the label is the commonest, of equally common
    ones the first; places go by units, buildings, label and group.  Counts are combined by group, label and landlord
    first, so that no group's rows or names meet in one task.
    """
    each = rows.select(key.alias("group"), label.alias("label"), (F.lit(None).cast("string") if landlord is None else landlord).alias("landlord"), "address", "units")
    parts = each.groupBy("group", "label", "landlord").agg(F.count(F.lit(1)).alias("n"), F.count("address").alias("buildings"), F.sum("units").alias("units"))
    named = parts.groupBy("group", "label").agg(F.sum("n").alias("n")).groupBy("group").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))
    totals = parts.groupBy("group").agg(F.sum("buildings").alias("buildings"), F.coalesce(F.sum("units"), F.lit(0)).alias("units"), F.count_distinct("landlord").alias("landlords"))
    average = F.when(F.col("buildings") > 0, F.col("units") / F.col("buildings")).otherwise(0.0)
    out = totals.join(named, "group").withColumns({"average": average, "_pin": F.when(F.col("group") == SEARCHED, 1).when(F.col("group") == UNSEARCHED, 2).otherwise(0)})
    return numbered(out, ["_pin", F.desc("units"), F.desc("buildings"), "label", "group"], "place").drop("_pin")


def by_owner(records: DataFrame) -> DataFrame:
    """The table of owners; records: (address, units, owner_key, owner_name, no_filing)."""
    known = F.col("owner_key").isNotNull()
    return grouped(records, group_key(F.col("owner_key"), F.col("no_filing")), F.when(known, F.coalesce("owner_name", F.lit(""))).otherwise("")).drop("landlords")


def by_network(records: DataFrame) -> DataFrame:
    """The table of networks, with how many landlords each has; records as for owners, with network_key and network_name."""
    known = F.col("network_key").isNotNull()
    return grouped(records, group_key(F.col("network_key"), F.col("no_filing")), F.when(known, F.coalesce("network_name", F.lit(""))).otherwise(""), F.col("owner_key"))


def by_area(records: DataFrame) -> DataFrame:
    area = F.coalesce("local_area", F.lit("(Unknown)"))
    return grouped(records, area, area).drop("landlords")


def totals_shown(rows: DataFrame) -> DataFrame:
    """One row: totals of the selected rows of a table, of the visible ones where none is selected.

    rows: (buildings, units, selected, visible).
    """
    on = lambda c: F.coalesce(c, F.lit(False))
    sums = lambda c, name: [F.count_if(on(c)).alias(f"{name}_rows"), *(F.coalesce(F.sum(F.when(on(c), F.col(v))), F.lit(0)).alias(f"{name}_{v}") for v in ("buildings", "units"))]
    both = rows.agg(*sums(F.col("selected"), "selected"), *sums(F.col("visible"), "visible"))
    chosen = F.col("selected_rows") > 0
    out = both.select(F.when(chosen, "selected").otherwise("visible").alias("of"), *(F.when(chosen, F.col(f"selected_{v}")).otherwise(F.col(f"visible_{v}")).alias(v) for v in ("rows", "buildings", "units")))
    return out.withColumn("average", F.when(F.col("buildings") > 0, F.col("units") / F.col("buildings")).otherwise(0.0))


def filter_fields(records: DataFrame) -> DataFrame:
    """What filters read about a building: keys, lists, flags, and metrics cut or rounded half-even to what is shown.

    NaN and infinite numbers are null.  Halves are told by a number's shortest decimal form.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")), F.col(c).cast("double"))
    whole = lambda c: finite(c).cast("bigint")
    rounded = lambda c, places=0: F.bround(finite(c), places)
    listed = F.filter(F.transform(F.split(text("housing_type"), ","), lambda x: F.trim(x)), lambda x: x != "")
    kinds = F.when(F.col("owner_type") == "mixed", area_keys(F.col("owner_parts"))).when(text("owner_type") != "", F.array("owner_type")).otherwise(F.array().cast("array<string>"))
    return records.select(
        whole("b_id").cast("string").alias("bid"), F.trim(F.lower(text("local_area"))).alias("area"), area_keys(F.col("areas")).alias("areas"),
        group_key(F.col("owner_key"), F.col("no_filing")).alias("owner"), group_key(F.col("network_key"), F.col("no_filing")).alias("network"), F.lower(text("managed_by")).alias("manager"),
        listed.alias("housing_types"), whole("n_issues").alias("n_issues"), F.col("owner_key").isNotNull().alias("has_owner"), kinds.alias("owner_types"), area_keys(F.col("owner_legal_forms")).alias("legal_forms"),
        F.coalesce("owner_inferred", F.lit(False)).alias("owner_inferred"), text("market").alias("market"), whole("units").alias("units"), whole("year_built").alias("year_built"),
        rounded("value_land").alias("value_land"), rounded("value_bldg").alias("value_bldg"), rounded("bldg_land_ratio", 3).alias("value_ratio"),
    )


def units_basis(units: Column, source: Column, is_sro: Column) -> Column:
    """Where a number of units comes from; null without one."""
    licence = F.coalesce(source == "rental licence", F.lit(False))
    return F.when(units.isNotNull(), F.when(licence & F.coalesce(is_sro, F.lit(False)), "sro_rooms").when(licence, "licence_fee").otherwise("inventory"))


def listed_in(source: str = "building_source") -> Column:
    """The sources that list a building: its own first, then one for each flag that is set, none twice."""
    own = F.try_element_at(F.create_map(*(F.lit(x) for pair in LISTED_IN.items() for x in pair)), F.coalesce(source, F.lit("")))
    return F.array_distinct(F.array_compact(F.array(own, *(F.when(F.col(flag), F.lit(name)) for flag, name in LISTED_BY_FLAG))))


def corrected_inventory(df: DataFrame, corrections: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Inventory names as corrected, and the owner that they give where no registry names one.

    df: (inventory_owner, inventory_operator, owner_name, owner_key, owner_source, network_key, network_name, network_source, ...);
    corrections: (published, owners, manager arrays), a row a name.  A sector's label is no name.  Of joint owners the
    first becomes the owner, ``inventory_owners`` has all.  Without an operator, the corrected owner's manager is it.
    An owner replaces one that is unknown or a licence's, and likewise the network.
    """
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)) if aliases else F.create_map().cast("map<string,string>")
    trimmed = lambda c: F.nullif(F.trim(c), F.lit(""))
    shown = lambda c: F.when(sector(trimmed(c)).isNull(), F.coalesce(F.try_element_at(table, F.coalesce(trimmed(c), F.lit(""))), trimmed(c)))
    df = df.withColumns({"inventory_owner": shown("inventory_owner"), "inventory_operator": shown("inventory_operator")})
    for side in ("owner", "operator"):
        named = corrections.select(F.col("published").alias(f"inventory_{side}"), F.struct("owners", "manager").alias(f"_{side}"))
        df = df.join(named, f"inventory_{side}", "left")
    first = lambda items: F.get(items, F.lit(0))
    plain = F.when(F.col("inventory_owner").isNotNull(), F.array("inventory_owner")).otherwise(F.array().cast("array<string>"))
    df = df.withColumns({
        "inventory_owners": F.coalesce("_owner.owners", plain), "inventory_owner": F.coalesce(first("_owner.owners"), "inventory_owner"),
        "inventory_operator": F.coalesce(first("_operator.owners"), "inventory_operator", first("_owner.manager")),
    }).drop("_owner", "_operator")
    weak = lambda what: F.coalesce(F.col(f"{what}_key") == "unknown", F.lit(False)) | F.coalesce(F.col(f"{what}_source") == "licence", F.lit(False))
    fill = F.col("inventory_owner").isNotNull() & weak("owner")
    df = df.withColumns({"_fill": fill, "_group": fill & weak("network"), "_key": owner_key(F.col("inventory_owner"))})
    df = assign_where(df, F.col("_fill"), owner_name=F.col("inventory_owner"), owner_key=F.col("_key"), owner_source=F.lit("sro_list"))
    df = assign_where(df, F.col("_group"), network_key=F.col("_key"), network_name=F.col("inventory_owner"), network_source=F.lit("sro_list"))
    return df.drop("_fill", "_group", "_key")


def strata_lots(rows: DataFrame, label: str = "strata lots") -> DataFrame:
    """(pid, strata_plan, note): lots with dashed parcel numbers and plans in capitals; rows: (line, pid, strata_plan, note).

    A number without nine digits, or a plan that is not two to four letters and digits, fails with its line when it is read.
    """
    if lacking := sorted({"pid", "strata_plan"} - set(rows.columns)):
        raise ValueError(f"{label} lack the columns {lacking}")
    bad = lambda c: F.raise_error(F.concat(F.lit(f"{label}, line "), F.col("line").cast("string"), F.lit(f": bad {c} "), F.coalesce(c, F.lit("null")))).cast("string")
    digits = F.regexp_replace(F.coalesce("pid", F.lit("")), r"\D", "")
    plan = F.upper(F.regexp_replace(F.coalesce("strata_plan", F.lit("")), r"(?U)\s", ""))
    note = F.nullif(F.trim("note"), F.lit("")) if "note" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        F.when(F.length(digits) == 9, F.regexp_replace(digits, r"^(...)(...)(...)$", "$1-$2-$3")).otherwise(bad("pid")).alias("pid"),
        F.when(plan.rlike(r"^[A-Z]{2,4}[0-9]+$"), plan).otherwise(bad("strata_plan")).alias("strata_plan"), note.alias("note"),
    )
