"""Who owns, runs and groups a building: passes in a fixed order, each seeing the result of the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.functions.names import match_key

UNKNOWN = ("unknown", "(unknown)", "")


def assign_where(df: DataFrame, mask: Column, **values: Column) -> DataFrame:
    """Changes all columns at once where the mask is true; every value sees the frame as it was."""
    sure = F.coalesce(mask, F.lit(False))
    return df.withColumns({c: F.when(sure, v).otherwise(F.col(c) if c in df.columns else F.lit(None)) for c, v in values.items()})


def known(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.lower(c).isin(*UNKNOWN)


def assign_layers(df: DataFrame) -> DataFrame:
    """Owner: the registry's, else the licence's; network: from claims, else the licence's group."""
    return df.withColumns({
        "owner": F.coalesce("registry_owner", "licence_owner", F.lit("unknown")),
        "owner_source": F.when(F.col("registry_owner").isNotNull(), "registry").when(F.col("licence_owner").isNotNull(), "licence"),
        "network": F.coalesce(F.concat(F.lit("net:"), F.col("claimed_network")), "licence_owner", F.lit("unknown")),
        "network_source": F.when(F.col("claimed_network").isNotNull(), "claims").when(F.col("licence_owner").isNotNull(), "licence"),
        "managed_by": F.lit(None).cast("string"),
    })


def apply_managers(df: DataFrame) -> DataFrame:
    """A licence held by a known manager does not make it the owner; else a known manager's listing fills in."""
    by_licence = F.col("is_manager")
    df = assign_where(df, by_licence, managed_by=F.col("licence_owner"))
    df = assign_where(df, by_licence & (F.col("network_source") == "licence"), network=F.when(F.col("owner_source") == "licence", "unknown").otherwise(F.col("owner")), network_source=F.lit(None))
    df = assign_where(df, by_licence & (F.col("owner_source") == "licence"), owner=F.lit("unknown"), owner_source=F.lit(None))
    return assign_where(df, F.col("managed_by").isNull() & F.col("listing_manager").isNotNull(), managed_by=F.col("listing_manager"))


def fill_from_inventory(df: DataFrame) -> DataFrame:
    """The inventory's owner replaces an unknown or licensed one, and likewise its group."""
    has = F.col("inventory_owner").isNotNull()
    weak_owner, weak_network = ~known("owner") | (F.col("owner_source") == "licence"), ~known("network") | (F.col("network_source") == "licence")
    return assign_where(
        df, has & (F.coalesce(weak_owner, F.lit(False)) | F.coalesce(weak_network, F.lit(False))),
        owner=F.when(weak_owner, F.col("inventory_owner")).otherwise(F.col("owner")), owner_source=F.when(weak_owner, "inventory").otherwise(F.col("owner_source")),
        network=F.when(weak_network, F.col("inventory_owner")).otherwise(F.col("network")), network_source=F.when(weak_network, "inventory").otherwise(F.col("network_source")),
    )


def regroup(df: DataFrame) -> DataFrame:
    """A registry owner in a group that a licence of another name made is its own group."""
    other = (F.col("owner_source") == "registry") & (F.col("network_source") == "licence") & (match_key(F.col("owner")) != match_key(F.col("licence_owner")))
    return assign_where(df, other, network=F.col("owner"), network_source=F.lit("owner"))


def group_of_one(df: DataFrame) -> DataFrame:
    return assign_where(df, known("owner") & ~known("network"), network=F.col("owner"), network_source=F.lit("owner"))


def passes(df: DataFrame) -> DataFrame:
    for step in (assign_layers, apply_managers, fill_from_inventory, regroup, group_of_one):
        df = step(df)
    return df


def owner_axis(title_types: Column, city_land: Column, coop: Column, inventory_kind: Column, listed: Column, operator_kind: Column, licence_kind: Column) -> Column:
    """struct(value, detail, inferred): the first rule that says something."""
    private = ("company", "numbered_company", "trust", "partnership", "individual")
    kind = lambda c: F.when(c.isin(*private), "private").when(c.isin("non_profit", "coop", "government"), c)
    say = lambda value, detail, inferred: F.struct(value.alias("value"), F.lit(detail).cast("string").alias("detail"), F.lit(inferred).alias("inferred"))
    types = F.array_distinct(F.filter(F.transform(title_types, kind), lambda x: x.isNotNull()))
    not_government = F.exists(types, lambda x: x != "government")
    by_licence = kind(licence_kind)
    return (
        F.when(city_land & not_government, say(F.lit("mixed"), "public_land_leasehold", False))
        .when(F.size(types) > 1, say(F.lit("mixed"), "owners_differ", False))
        .when(F.size(types) == 1, say(F.get(types, F.lit(0)), None, False))
        .when(city_land, say(F.lit("government"), "city_land", False))
        .when(coop, say(F.lit("coop"), None, True))
        .when(kind(inventory_kind).isNotNull(), say(kind(inventory_kind), None, True))
        .when(listed & operator_kind.isin("non_profit", "coop", "government"), say(operator_kind, None, True))
        .when(by_licence.isNotNull() & ~(listed & (by_licence == "private")), say(by_licence, None, True))
    )


def market_axis(listed: Column, coop: Column, equity_coop: Column, owner: Column, inventory_kind: Column) -> Column:
    return (
        F.when(listed | coop, "non_market")
        .when((owner["value"] == "government") & ~owner["inferred"], "non_market")
        .when(inventory_kind.isin("non_profit", "government"), "non_market")
        .when(equity_coop | (owner["value"] == "private"), "market")
    )
