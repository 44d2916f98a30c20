"""Row numbers, ranks and quantiles over a whole table without sending all rows to one task.

Rows are dealt to sorted ranges; the sizes of the ranges, one row each, give every range its offset.  The ranges are
saved once: planned twice, a range partitioning may draw other bounds, or be coalesced otherwise, for the sizes than
for the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotwise.operators.graph import saved

_BITS = 33  # monotonically_increasing_id: the partition stands above so many bits, the place in it below


def _ranged(df: DataFrame, *order) -> DataFrame:
    """Saved sorted ranges, with ``_range`` and the place ``_at`` (from 0) of each row in its range."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = rows.withColumns({"_range": F.shiftright("_id", _BITS), "_at": F.col("_id").bitwiseAND(F.lit((1 << _BITS) - 1))})
    return saved(rows.drop("_id"))


def numbered(df: DataFrame, order: list, name: str = "row") -> DataFrame:
    """Adds the number, from 1, of each row in the order, which must tell rows apart."""
    ranged = _ranged(df, *order)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    out = ranged.join(F.broadcast(offsets), "_range")
    return out.withColumn(name, (F.col("_at") + F.col("_offset") + 1).cast("bigint")).drop("_range", "_at", "_offset")


def counts_below(df: DataFrame, value: str) -> DataFrame:
    """(value, below, total): for each distinct value how many rows are strictly smaller."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    ranged = _ranged(counts, value)
    sizes = ranged.groupBy("_range").agg(F.sum("_n").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"), F.sum("_size").over(all_rows).alias("total"))
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("_sum", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(offsets), "_range")
    return out.select(value, (F.col("_sum") + F.col("_offset")).alias("below"), "total")


def percent_below(df: DataFrame, value: str, name: str = "percent") -> DataFrame:
    """Adds the percent of rows strictly below, half-even to an integer; null for null."""
    below = counts_below(df, value).select(value, F.bround(100.0 * F.col("below") / F.col("total"), 0).alias(name))
    return df.join(below, value, "left")


def quantiles(df: DataFrame, group: str, value: str, **shares: float) -> DataFrame:
    """Per group the exact quantiles of the value, interpolated between neighbours, one column each.

    Distinct values and their counts are ranged and summed up; a quantile lies at the value whose run of rows holds its
    place, so that no group's values are ever gathered in one buffer.  Null values do not count; a group of nulls has
    no row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = _ranged(counts, "_g", "_v")
    sizes = ranged.groupBy("_g", "_range").agg(F.sum("_n").alias("_size"))  # a row a group and range
    before = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_g", "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    asked = sizes.groupBy("_g").agg(F.sum("_size").alias("_total"))
    inside = Window.partitionBy("_g", "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_sum", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    same = lambda a, b, *names: [a[n].eqNullSafe(b[n]) for n in names]
    placed = placed.join(offsets, same(placed, offsets, "_g", "_range")).select(placed["_g"], "_v", "_n", (F.col("_sum") + F.col("_offset")).alias("_first"))
    placed = placed.join(asked, same(placed, asked, "_g")).select(placed["_g"], "_v", "_first", (F.col("_first") + F.col("_n")).alias("_end"), "_total")
    at = {name: (F.col("_total") - 1) * F.lit(float(share)) for name, share in shares.items()}
    held = lambda place: F.max(F.when((F.col("_first") <= place) & (place < F.col("_end")), F.col("_v")))
    found = placed.groupBy("_g").agg(
        F.first("_total").alias("_total"), *(held(F.floor(p)).alias(f"_low_{n}") for n, p in at.items()), *(held(F.ceil(p)).alias(f"_high_{n}") for n, p in at.items())
    )
    between = lambda n, p: F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * (p - F.floor(p))
    return found.select(F.col("_g").alias(group), *(between(n, p).alias(n) for n, p in at.items()))
