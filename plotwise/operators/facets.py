"""Filters with several facets, and the bars that each facet shows under all the others."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Filters:
    """Ticked values; an empty facet lets everything pass."""

    areas: list[str] = field(default_factory=list)
    special_areas: list[str] = field(default_factory=list)
    owners: list[str] = field(default_factory=list)
    networks: list[str] = field(default_factory=list)
    managers: list[str] = field(default_factory=list)
    housing: list[str] = field(default_factory=list)
    owner_types: list[str] = field(default_factory=list)
    legal_forms: list[str] = field(default_factory=list)
    markets: list[str] = field(default_factory=list)
    with_inferred: bool = True
    only_issues: bool = False
    only_units: bool = False
    only_owned: bool = False
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)


def _any(c: str, wanted: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.col(c), F.array(*map(F.lit, wanted))), F.lit(False))


def _in(c: str, wanted: list[str]) -> Column:
    return F.coalesce(F.col(c).isin(wanted), F.lit(False))


def passes(f: Filters) -> Column:
    """All facets but the metrics' ranges; columns: area, areas, owner, network, manager, housing, owner_types, legal_forms, inferred, market, n_issues, units, has_owner."""
    test = F.lit(True)
    if f.areas or f.special_areas:
        test = test & (_in("area", f.areas) | _any("areas", f.special_areas))
    if f.owners or f.networks or f.managers:
        test = test & (_in("owner", f.owners) | _in("network", f.networks) | _in("manager", f.managers))
    if f.only_issues:
        test = test & (F.coalesce("n_issues", F.lit(0)) > 0)
    if f.only_units:
        test = test & (F.coalesce("units", F.lit(0)) > 0)
    if f.only_owned:
        test = test & F.col("has_owner")
    if f.housing:
        test = test & _any("housing", f.housing)
    if f.owner_types:
        narrowed = _any("owner_types", f.owner_types)
        if f.legal_forms and "private" in f.owner_types:
            rest = [x for x in f.owner_types if x != "private"]
            narrowed = _any("owner_types", rest) | (F.array_contains("owner_types", "private") & _any("legal_forms", f.legal_forms))
        if not f.with_inferred:
            narrowed = narrowed & ~F.col("inferred")
        test = test & narrowed
    if f.markets:
        test = test & _in("market", f.markets)
    return test


def in_range(metric: str, low: float | None, high: float | None) -> Column:
    """Missing values pass."""
    test = F.lit(True)
    if low is not None:
        test = test & (F.col(metric) >= low)
    if high is not None:
        test = test & (F.col(metric) <= high)
    return F.col(metric).isNull() | test


def faceted_bars(rows: DataFrame, f: Filters, bins: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """(metric, bin, count): rows that pass everything but the metric's own range, by bin; one pass over the rows."""
    tests = {m: in_range(m, *f.ranges.get(m, (None, None))) for m in bins}
    marked = rows.withColumn("_base", passes(f)).withColumns({f"_ok_{m}": test for m, test in tests.items()})
    parts = []
    for m, edges in bins.items():
        rest = F.col("_base")
        for other in bins:
            if other != m:
                rest = rest & F.col(f"_ok_{other}")
        place = None
        for k, (low, high) in enumerate(edges):
            hit = (F.col(m) >= low) & ((F.col(m) <= high) if k == len(edges) - 1 else (F.col(m) < high))
            place = F.when(hit, k) if place is None else place.when(hit, k)
        parts.append(F.struct(F.lit(m).alias("metric"), place.alias("bin"), rest.alias("_ok")))
    seen = marked.select(F.explode(F.array(*parts)).alias("x")).select("x.*").where("bin is not null")
    return seen.groupBy("metric", "bin").agg(F.count_if("_ok").alias("count"))


def visible(rows: DataFrame, f: Filters) -> DataFrame:
    test = passes(f)
    for m, (low, high) in f.ranges.items():
        test = test & in_range(m, low, high)
    return rows.where(test)


def visible_blocks(blocks: DataFrame, members: DataFrame, shown: DataFrame, areas: list[str], with_empty: bool) -> DataFrame:
    """Blocks of the areas with a visible member, and empty ones if asked; members: (block, member)."""
    own = blocks.where(F.col("area").isin(areas)) if areas else blocks
    hit = own.join(members.join(shown.select("member"), "member", "left_semi").select("block").distinct(), "block", "left_semi")
    return hit.unionByName(own.join(members, "block", "left_anti")) if with_empty else hit
