"""Tiered matching of source addresses to known keys: the first tier that gives one answer wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.functions import address as A
from plotwise.operators.graph import saved


def matched(sources: DataFrame, known: DataFrame, source: str, key: str, aliases: DataFrame | None = None) -> DataFrame:
    """Adds ``match`` and ``tier`` (M1 to M4) to each source; ``aliases`` has (alias, key).

    M1: a variant is a known key or alias; M2: the same after cutting a building name; M3: equal but for the street
    type, if one known key fits; M4: the one known civic number inside a range, on its side of the street.
    """
    keys = known.select(F.col(key).alias("key")).where("key is not null").distinct()
    exact = keys.select(F.col("key").alias("look"), "key")
    if aliases is not None:
        exact = exact.unionByName(aliases.select(F.col("alias").alias("look"), "key").join(keys.select(F.col("key").alias("look")), "look", "left_anti"))
    loose = keys.groupBy(A.loose_key(F.col("key")).alias("look")).agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    asked = sources.select(F.col(source).alias("source")).where(F.trim(F.col(source)) != "").distinct()
    tried = A.with_variants(asked, "source").groupBy("source", "key").agg(F.min("at").alias("at"), *(F.first(c).alias(c) for c in ("kind", "low", "high")))
    tried = saved(tried.withColumn("cut", A.without_name(F.col("key"))))  # three tiers read it
    looks = (
        tried.select("source", "at", F.explode(F.array(F.struct(F.lit(1).alias("tier"), F.lit(0).alias("later"), F.col("key").alias("look")), F.struct(F.lit(2).alias("tier"), F.lit(1).alias("later"), F.col("cut").alias("look")))).alias("x"))
        .select("source", "at", "x.tier", "x.later", "x.look").where("look is not null")
    )
    loosely = looks.select("source", (F.col("at") + 100 * F.col("later")).alias("at"), F.lit(3).alias("tier"), A.loose_key(F.col("look")).alias("look"))
    direct = looks.join(exact, "look").select("source", "key", "tier", "at").unionByName(loosely.join(loose, "look").select("source", "key", "tier", "at"))
    civics = keys.where(F.col("key").rlike(r"^\d+ .+")).withColumn("civic", F.regexp_extract("key", r"^(\d+) ", 1).cast("bigint")).withColumn("street", F.regexp_replace("key", r"^\d+ ", ""))
    ranges = tried.where("kind = 'range' and at >= 2").where(F.regexp_extract("key", r"^(\d+) ", 1) == F.col("low").cast("string"))
    ranges = ranges.select("source", "low", "high", F.regexp_replace("key", r"^\d+ ", "").alias("street")).distinct()
    inside = (
        ranges.join(civics, "street").where("low < civic and civic < high and civic % 2 = low % 2")
        .groupBy("source").agg(F.min("key").alias("key"), F.count_distinct("civic").alias("n")).where("n = 1")
        .select("source", "key", F.lit(4).alias("tier"), F.lit(0).alias("at"))
    )
    best = direct.unionByName(inside).groupBy("source").agg(F.min_by(F.struct("key", "tier"), F.struct("tier", "at", "key")).alias("hit"))
    return sources.join(best.select(F.col("source").alias(source), F.col("hit.key").alias("match"), F.concat(F.lit("M"), F.col("hit.tier")).alias("tier")), source, "left")


def split_matches(sources: DataFrame, key: str, ordinal: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first source row of each known key, rows whose key is not known)."""
    from plotwise.operators.dedupe import keep_first

    return keep_first(sources.join(known.select(key), key, "left_semi"), [key], ordinal), sources.join(known.select(key), key, "left_anti")
