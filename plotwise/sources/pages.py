"""Rows from web pages: cards, embedded JSON and JSON-LD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"<title>([^<]*)</title>", 1)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1)


def cards(html: Column, marker: str) -> Column:
    """Pieces of the page from each marker to the next."""
    parts = F.split(html, marker)
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def reconciled(pages: DataFrame, marker: str, stated: str, needed: tuple[str, ...] = (), **fields: str) -> tuple[DataFrame, DataFrame]:
    """(page_id, card, fields...) of sound pages, and (page_id, problem) of the others; pages: (page_id, html).

    ``stated`` finds the number of cards that the page itself tells, each field the first group of its pattern in a card,
    unescaped and trimmed.  A page is left out whole, and the job goes on, if it has another number of cards than it
    tells, tells none, or a card lacks a needed field.
    """
    told = F.regexp_extract("html", stated, 1).try_cast("int")
    read = lambda card, pattern: F.nullif(F.trim(unescaped(F.regexp_extract(card, pattern, 1))), F.lit(""))
    made = F.transform(cards(F.coalesce("html", F.lit("")), marker), lambda card: F.struct(*(read(card, p).alias(name) for name, p in fields.items())))
    rows = pages.select("page_id", told.alias("told"), made.alias("cards"))
    count = F.size("cards").cast("string")
    lacking = [F.when(F.exists("cards", lambda c: c[name].isNull()), F.lit(f"a card lacks {name}")) for name in needed]  # noqa: B023
    off = F.when(F.col("told").isNull(), "tells no number").when(F.col("told") != F.size("cards"), F.concat(F.lit("tells "), F.col("told").cast("string"), F.lit(" cards, has "), count))
    rows = rows.withColumn("problem", F.coalesce(off, *lacking))
    good = rows.where("problem is null").select("page_id", F.posexplode("cards").alias("card", "_c")).select("page_id", "card", "_c.*")
    return good, rows.where("problem is not null").select("page_id", "problem")


def unescaped(c: Column) -> Column:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def text_of(html: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescaped(bare), r"\s+", " "))


def json_ld(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), 1)


def property_of(html: Column) -> Column:
    """struct(street, lat, lon, units): the first of each in the page's JSON-LD."""
    blocks = json_ld(html)
    first = lambda path: F.try_element_at(F.filter(F.transform(blocks, lambda b: F.get_json_object(b, path)), lambda x: x.isNotNull()), F.lit(1))
    return F.struct(
        first("$.address.streetAddress").alias("street"), first("$.geo.latitude").try_cast("double").alias("lat"),
        first("$.geo.longitude").try_cast("double").alias("lon"), first("$.numberOfAccommodationUnits").try_cast("int").alias("units"),
    )


def embedded(html: Column, variable: str, schema: str) -> Column:
    """Rows of a JSON list that a script assigns to a variable."""
    return F.from_json(F.regexp_extract(html, rf"(?s)\b{variable}\s*=\s*(\[.*?\]);", 1), f"array<{schema}>")


def bedrooms(units: Column) -> Column:
    """struct(fewest, most, kinds) of an array of bedroom counts."""
    return F.struct(F.array_min(units).alias("fewest"), F.array_max(units).alias("most"), F.array_join(F.transform(F.array_sort(F.array_distinct(units)), lambda n: n.cast("string")), ";").alias("kinds"))
