"""A log of claims: the latest state per key, validation and spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotwise.functions.names import owner_key

RELATIONS = ("common_owner", "same_entity", "managed_by", "network_label", "entity_kind", "institutional")
STATES = ("proposed", "confirmed", "retracted")
BASIS = {"public_registry": "claim_registry", "city_record": "claim_city_records"}


def latest(claims: DataFrame, key: str = "claim_key", *order: str) -> DataFrame:
    """The last state of each claim; the first creation time stays."""
    order = order or ("updated_at", "claim_id")
    rest = [c for c in claims.columns if c != key]
    return claims.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, "row.*")


def upserted(stored: DataFrame, incoming: DataFrame, key: str = "claim_key", kept: tuple[str, ...] = ("claim_id", "created_at")) -> DataFrame:
    """Incoming rows replace stored ones of their key, but for the columns that are kept."""
    old = stored.select(key, F.lit(True).alias("_old"), *(F.col(c).alias(f"_old_{c}") for c in stored.columns if c != key))
    new = incoming.select(key, F.lit(True).alias("_new"), *(c for c in stored.columns if c != key))
    out = new.join(old, key, "full")
    pick = lambda c: F.coalesce(f"_old_{c}", c) if c in kept else F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_old_{c}"))
    return out.select(key, *(pick(c).alias(c) for c in stored.columns if c != key))


def problems(claims: DataFrame) -> DataFrame:
    """Rows that break a rule, with its name."""
    checks = {
        "entity_a is blank": F.coalesce(F.trim("entity_a"), F.lit("")) == "",
        "entity_b is blank": F.coalesce(F.trim("entity_b"), F.lit("")) == "",
        "relationship is not known": ~F.coalesce(F.col("relationship").isin(*RELATIONS), F.lit(False)),
        "status is not known": ~F.coalesce(F.col("status").isin(*STATES), F.lit(False)),
    }
    return claims.select("*", F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks.items())))).alias("problem"))


def spellings(names: DataFrame, name: str, key: str, ordinal: str) -> DataFrame:
    """(key, spelling): the earliest spelling of each key."""
    return names.groupBy(key).agg(F.min_by(name, ordinal).alias("spelling"))


def basis(source):
    table = F.create_map(*(F.lit(x) for pair in BASIS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, source), F.lit("research"))


def crossed(rows: DataFrame, owners: str, people: str) -> DataFrame:
    """A claim for each company and person of a row."""
    return rows.select("*", F.explode(owners).alias("entity_a")).select("*", F.explode(people).alias("entity_b")).drop(owners, people)


def derived(filings: DataFrame, examples: int = 3) -> DataFrame:
    """Claims of common ownership from registry filings, one for each pair of a body and a holder.

    filings: (ordinal, pid, body, holder, interest, dated).  Rows with a blank name, or whose two names are one, are left
    out; names that differ in case and signs only are one, shown as they first come.  Parcels are counted once; the
    least ones are examples, of which each task passes on only so many; the date is the latest.
    """
    rows = filings.withColumns({"body": F.trim("body"), "holder": F.trim("holder")}).where("body != '' and holder != ''")
    rows = rows.withColumns({"key_a": owner_key(F.col("body")), "key_b": owner_key(F.col("holder"))}).where("key_a != key_b")
    pair = ["key_a", "key_b"]
    shown = rows.groupBy(*pair).agg(
        F.min_by("body", "ordinal").alias("entity_a"), F.min_by("holder", "ordinal").alias("entity_b"), F.array_sort(F.collect_set(F.nullif("interest", F.lit("")))).alias("interests"),
        F.substring_index(F.max(F.nullif("dated", F.lit(""))), " ", 1).alias("date_reported"),
    )
    parcels = rows.where("pid != ''").select(*pair, "pid").distinct()
    counts = parcels.groupBy(*pair).agg(F.count(F.lit(1)).alias("n_pids"))
    first = parcels.withColumn("_n", F.row_number().over(Window.partitionBy(*pair).orderBy("pid"))).where(F.col("_n") <= examples)
    first = first.groupBy(*pair).agg(F.array_sort(F.collect_list("pid")).alias("example_pids"))
    out = shown.join(counts, pair, "left").join(first, pair, "left")
    key = F.concat(F.lit("registry-"), "key_a", F.lit("--"), "key_b").alias("claim_key")
    none = F.array().cast(first.schema["example_pids"].dataType)
    return out.select(key, "entity_a", "entity_b", F.coalesce("n_pids", F.lit(0)).alias("n_pids"), F.coalesce("example_pids", none).alias("example_pids"), "interests", "date_reported")
