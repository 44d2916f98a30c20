"""Joins with fallbacks, nearest rows and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotwise.functions.address import address_key


def _renamed(dim: DataFrame, key: str, on: str, tag: str) -> DataFrame:
    return dim.select(F.col(key).alias(on), *(F.col(c).alias(f"_{tag}_{c}") for c in dim.columns if c != key))


def block_fallback(df: DataFrame, dim: DataFrame, key: str, own: str, primary: str) -> DataFrame:
    """Values of the own key if any of them is there, as a block; else those of the primary key."""
    values = [c for c in dim.columns if c != key]
    out = df.join(_renamed(dim, key, own, "own"), own, "left").join(_renamed(dim, key, primary, "primary"), primary, "left")
    has_own = F.coalesce(*(F.col(f"_own_{c}").cast("string") for c in values)).isNotNull()
    return out.select(*df.columns, *(F.when(has_own, F.col(f"_own_{c}")).otherwise(F.col(f"_primary_{c}")).alias(c) for c in values))


def cell_fallback(df: DataFrame, dim: DataFrame, key: str, own: str, primary: str) -> DataFrame:
    """Each value from the own key, else from the primary key."""
    values = [c for c in dim.columns if c != key]
    out = df.join(_renamed(dim, key, own, "own"), own, "left").join(_renamed(dim, key, primary, "primary"), primary, "left")
    return out.select(*df.columns, *(F.coalesce(f"_own_{c}", f"_primary_{c}").alias(c) for c in values))


def own_or_fallback(df: DataFrame, records: DataFrame, key: str, primary: str) -> DataFrame:
    """Records of the own key; for rows that have none, those of the primary key."""
    own = df.join(records, key)
    rest = df.join(records, key, "left_anti").join(records.withColumnRenamed(key, primary), primary, "left")
    return own.unionByName(rest.select(*own.columns)).distinct()


def nearest_in_group(left: DataFrame, right: DataFrame, group: str, at: str, other_at: str, ordinal: str) -> DataFrame:
    """For each left row the right row of its group whose place is nearest, ties the first; null if the group has none.

    Places are merged in one sort per group: the nearest is the last one at or below or the first one above, so that
    no pair of rows is ever made.
    """
    places = right.groupBy(group, other_at).agg(F.min(ordinal).alias("_ordinal"))
    both = left.select(group, F.col(at).alias("_at"), F.lit(1).alias("_left")).distinct().unionByName(
        places.select(group, F.col(other_at).alias("_at"), F.lit(0).alias("_left"), F.struct(F.col(other_at).alias("place"), F.col("_ordinal").alias("ordinal")).alias("_hit")), allowMissingColumns=True
    )
    w = Window.partitionBy(group).orderBy("_at", "_left")
    down = F.last("_hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    up = F.first("_hit", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumns({"_down": down, "_up": up}).where("_left = 1")
    far_down, far_up = F.abs(F.col("_at") - F.col("_down.place")), F.abs(F.col("_at") - F.col("_up.place"))
    pick = (
        F.when(F.col("_down").isNull(), F.col("_up")).when(F.col("_up").isNull(), F.col("_down"))
        .when((far_down < far_up) | ((far_down == far_up) & (F.col("_down.ordinal") <= F.col("_up.ordinal"))), F.col("_down")).otherwise(F.col("_up"))
    )
    hits = found.select(F.col(group), F.col("_at").alias(at), pick.alias("nearest"))
    return left.join(hits, [group, at], "left")


def in_band(left: DataFrame, right: DataFrame, equal: list[str], at: str, width: int, how: str = "left_semi", same: str | None = None) -> DataFrame:
    """Left rows with (or, ``left_anti``, without) a right row of equal keys within ``width``, other than themselves by ``same``.

    Places are cut into cells of the band's width, and each right row stands in its own and both neighbouring cells: an
    equality join with a residual test instead of a range join.
    """
    cells = right.select(*equal, F.col(at).alias("_place"), *([F.col(same).alias("_same")] if same else []), F.explode(F.array(*(F.floor(F.col(at) / (width + 1)) + k for k in (-1, 0, 1)))).alias("_cell"))
    left = left.withColumn("_cell", F.floor(F.col(at) / (width + 1)))
    hit = F.abs(F.col(at) - F.col("_place")) <= width
    if same:
        hit = hit & (F.col(same) != F.col("_same"))
    on = [left[c] == cells[c] for c in [*equal, "_cell"]]
    test = on[0]
    for x in [*on[1:], hit]:
        test = test & x
    return left.join(cells, test, how).drop("_cell")


def unique_owner(pairs: DataFrame, alias: str, owner: str) -> DataFrame:
    """Aliases that one owner only has."""
    return pairs.groupBy(alias).agg(F.min(owner).alias(owner), F.max(owner).alias("_other")).where(F.col(owner) == F.col("_other")).drop("_other")


def applied(df: DataFrame, hits: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Changes the values of the rows that have a hit, and no others."""
    marked = hits.select(key, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_new_{c}") for c in values))
    out = df.join(marked, key, "left")
    return out.withColumns({c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in values}).drop("_hit", *(f"_new_{c}" for c in values))


def primary_addresses(df: DataFrame) -> DataFrame:
    """Adds ``address`` and ``primary_address``, both keys: the recorded primary one if it is whole, else the own one.

    df: (civic_number, std_street, civic_number_primary, std_street_primary, ...).  The recorded primary counts for every
    type of address.
    """
    own = address_key(F.concat("civic_number", F.lit(" "), "std_street"))
    recorded = address_key(F.concat("civic_number_primary", F.lit(" "), "std_street_primary"))
    whole = F.col("civic_number_primary").isNotNull() & F.col("std_street_primary").isNotNull()
    return df.withColumns({"address": own, "_recorded": F.when(whole, recorded)}).withColumn("primary_address", F.coalesce("_recorded", "address")).drop("_recorded")
