"""Deterministic choice of one row or value per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order, which must tell rows apart."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row")


def first_by(value: str | Column, *order: str | Column) -> Column:
    """Aggregate: first non-null value in the given order; combines on the map side, unlike a window."""
    value = F.col(value) if isinstance(value, str) else value
    return F.min_by(value, F.when(value.isNotNull(), F.struct(*order)))


def last_by(value: str | Column, *order: str | Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))


def commonest(value: str | Column) -> Column:
    """Aggregate: most frequent value, ties the smallest."""
    return F.mode(value, True)


def distinct_joined(value: str | Column, sep: str = ";") -> Column:
    return F.array_join(F.array_sort(F.collect_set(value)), sep)


def merged(df: DataFrame, key: str, ordinal: str, *, modes=(), medians=(), maxima=(), firsts=(), companions=()) -> DataFrame:
    """One row per key; companions are (value, measure): the value of the row with the largest measure, the first on ties."""
    out = [commonest(c).alias(c) for c in modes] + [F.median(c).alias(c) for c in medians] + [F.max(c).alias(c) for c in maxima]
    out += [first_by(c, ordinal).alias(c) for c in firsts]
    out += [F.max_by(v, F.when(F.col(m).isNotNull(), F.struct(F.col(m), -F.col(ordinal)))).alias(v) for v, m in companions]
    return df.groupBy(key).agg(*out)


def order_of_appearance(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """(key, first): where each key first appears."""
    return df.groupBy(key).agg(F.min(ordinal).alias("first"))
