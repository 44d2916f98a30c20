"""Surrogate keys that stay as they are when a table is built again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.sources.files import optional

from .ranks import numbered


def with_keys(df: DataFrame, key: str, position: str, register: str, name: str = "id") -> DataFrame:
    """Adds the key's number from the register, a folder of (key, number).

    Keys that the register does not know get the numbers above its largest, in order of their first position, and are
    added to it; those it knows keep theirs, so that a rebuild with more rows changes no number, and one that is run
    again adds nothing.  Numbers are counted over sorted ranges, not by one task.  A null key has no number.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    known = optional(spark, register, df.select(key, F.lit(0).cast("bigint").alias(name)).schema, spark.read.parquet)
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(position).alias("_first"))
    unseen = first.join(known, key, "left_anti")
    last = known.agg(F.max(name)).first()[0] or 0
    new = numbered(unseen, ["_first", key], name).select(F.col(key).cast(kind).alias(key), (F.col(name) + last).alias(name))
    new.write.mode("append").parquet(register)
    return df.join(spark.read.parquet(register), key, "left")
