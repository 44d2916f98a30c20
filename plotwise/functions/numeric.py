"""Numbers, shares, years and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def land_share(land: Column, building: Column) -> Column:
    return F.when(land + building > 0, land / (land + building))


def building_ratio(stored: Column, land: Column, building: Column) -> Column:
    return F.coalesce(stored, F.when(land != 0, building / land))


def marker_radius(units: Column, most: int = 600) -> Column:
    return F.log1p(F.least(F.greatest(units.cast("double"), F.lit(0.0)), F.lit(float(most))))


def full_year(y: Column) -> Column:
    return F.when(y < 1000, y + 2000).otherwise(y)


def utc_time(c: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))


def date_part(c: Column) -> Column:
    return F.regexp_extract(c, r"^([^ T]*)", 1)


def slider(value: Column, low: float, high: float, log: bool) -> Column:
    """Place of a value on a slider from 0 to 1."""
    if high <= low:
        return F.lit(0.0)
    if log:
        return (F.ln(F.greatest(value, F.lit(low))) - F.ln(F.lit(low))) / (F.ln(F.lit(high)) - F.ln(F.lit(low)))
    return (value - low) / (high - low)


def slider_value(place: Column, low: float, high: float, log: bool) -> Column:
    if log:
        return F.exp(F.ln(F.lit(low)) + place * (F.ln(F.lit(high)) - F.ln(F.lit(low))))
    return F.lit(low) + place * (high - low)


def bucket(share: Column, limits: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 1.0)) -> Column:
    out = None
    for k, limit in enumerate(limits):
        out = F.when(share <= limit, k) if out is None else out.when(share <= limit, k)
    return out.otherwise(len(limits))


def scale(n: Column) -> Column:
    return F.when(n >= 10, "large").when(n >= 2, "small").when(n >= 1, "single")


def true_keys(flags: dict[str, Column]) -> Column:
    """Names of the flags that are true, in order."""
    return F.array_compact(F.array(*(F.when(flag, F.lit(name)) for name, flag in flags.items())))


def without(items: Column, own: Column) -> Column:
    return F.array_remove(items, own)


def first_that(items: Column, test) -> Column:
    return F.try_element_at(F.filter(items, test), F.lit(1))


def rounded_coordinates(rings: Column, places: int = 6) -> Column:
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: F.transform(p, lambda v: F.round(v, places))))


def total(*columns: str) -> Column:
    """The sum across columns; nulls count as nothing."""
    out = F.lit(0.0)
    for c in columns:
        out = out + F.coalesce(F.col(c), F.lit(0.0))
    return out


def any_of(*columns: str) -> Column:
    """Whether any of the columns is true; nulls are not."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c), F.lit(False))
    return out


def area_keys(c: Column) -> Column:
    """The items of a text between semicolons, without blanks and empty ones; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
