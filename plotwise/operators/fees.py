"""Licence fees read back as the numbers of units that explain them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Yearly rates in dollars, and the fee of one dwelling in arrears: fixed values.
DWELLING, HOUSEKEEPING, SLEEPING, NON_PROFIT, POOL, APPLICATION, ARREARS = 98, 71, 47, 277, 1108, 77, 237
YEAR, SLACK = 2026, 0.6
SCHEMA = "reading string, dwellings int, housekeeping int, sleeping int, pool int, certain boolean"


def _readings(fee: float, months: int, application: bool, rooms: bool, non_profit: bool) -> Iterator[tuple]:
    """(rank, reading): every way to split the fee over whole units, with what makes it simple in front."""
    part = months / 12
    for pool in (0, 1):
        left = fee - APPLICATION * application - POOL * part * pool
        if non_profit and abs(left - NON_PROFIT * part) < SLACK:
            yield (0, 0, pool), ("non-profit", 0, 0, 0, pool)
        most_sleeping = int(left // (SLEEPING * part)) if rooms and left > 0 else 0
        for sleeping in range(most_sleeping + 1):
            after = left - SLEEPING * part * sleeping
            most_housekeeping = int(after // (HOUSEKEEPING * part)) if rooms and after > 0 else 0
            for housekeeping in range(most_housekeeping + 1):
                dwellings = (after - HOUSEKEEPING * part * housekeeping) / (DWELLING * part)
                n = round(dwellings)
                if n >= 0 and n + housekeeping + sleeping > 0 and abs(dwellings - n) * DWELLING * part < SLACK:
                    yield (1, housekeeping + sleeping, pool), ("rate", n, housekeeping, sleeping, pool)


@lru_cache(100_000)
def decoded(fee: float | None, year: int | None, month: int | None, non_profit: bool) -> tuple:
    """(reading, dwellings, housekeeping, sleeping, pool, certain)."""
    if fee is None or fee != fee:
        return ("no fee", 0, 0, 0, 0, False)
    if fee == APPLICATION:
        return ("application only", 0, 0, 0, 0, True)
    if fee == ARREARS:
        return ("arrears", 1, 0, 0, 0, True)
    attempts = [(12, False)]
    if year == YEAR and month is not None and month >= 2:
        attempts += [(13 - m, True) for m in (month, month - 1) if 2 <= m <= 12]
    attempts.append((12, True))
    for rooms in (False, True):
        for months, application in attempts:
            if best := min(_readings(fee, months, application, rooms, non_profit), default=None):
                return (*best[1], not rooms)
    return ("unexplained", 0, 0, 0, 0, False)


def decode_fees(licences: DataFrame) -> DataFrame:
    """Adds the reading of (fee, issued, non_profit); each distinct combination is decoded once."""
    keyed = licences.withColumns({"_year": F.year("issued"), "_month": F.month("issued")})
    keys = ["fee", "_year", "_month", "non_profit"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            none = lambda v: None if pd.isna(v) else v
            rows = [decoded(none(f), none(y), none(m), bool(p)) for f, y, m, p in zip(*(batch[k] for k in keys))]
            yield pd.concat([batch, pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")], index=batch.index)], axis=1)

    distinct = keyed.select(*keys).distinct()
    read = distinct.mapInPandas(run, "fee double, _year int, _month int, non_profit boolean, " + SCHEMA)
    test = None
    for k in keys:
        same = keyed[k].eqNullSafe(read[k])
        test = same if test is None else test & same
    return keyed.join(read.select(*(read[k] for k in keys), *(x.split()[0] for x in SCHEMA.split(", "))), test).select(*(licences[c] for c in licences.columns), *(read[x.split()[0]] for x in SCHEMA.split(", ")))


def licence_only(readings: DataFrame) -> DataFrame:
    """Addresses with at least five certain dwellings together, or a non-profit licence."""
    out = readings.groupBy("address").agg(F.sum(F.when(F.col("certain"), F.col("dwellings")).otherwise(0)).alias("dwellings"), F.bool_or(F.col("reading") == "non-profit").alias("non_profit"))
    return out.where("dwellings >= 5 or non_profit")
