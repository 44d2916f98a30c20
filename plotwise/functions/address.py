"""Street and address keys, as chains of regular expressions that the JVM runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Street words and their short forms: fixed values, applied in this order.
TYPE_ABBREVIATIONS = (
    ("street", "st"), ("avenue", "ave"), ("road", "rd"), ("drive", "dr"), ("boulevard", "blvd"), ("place", "pl"), ("court", "ct"), ("highway", "hwy"),
    ("av", "ave"), ("crescent", "cres"), ("cr", "cres"), ("crt", "ct"), ("southwest", "sw"), ("southeast", "se"), ("northwest", "nw"), ("northeast", "ne"),
)
DIRECTIONS = "e|w|n|nw|ne|s|sw|se"
DIRECTION_WORDS = (("north", "n"), ("south", "s"), ("east", "e"), ("west", "w"))
STREET_TYPES = "st|ave|rd|dr|blvd|pl|ct|hwy|cres"
DASHES = "â€“|â€”|–|—"
MAX_RANGE = 200
_PAIR = r"^(#)?\s*([a-z]*\d+[a-z]?)\s*(-|&|and)\s*(\d+)\s+(.+)$"


def street(c: Column) -> Column:
    """Lower case, short types, ordinals, and the direction in front."""
    c = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\.", ""), r"(?U)\s+", " ")
    for word, short in TYPE_ABBREVIATIONS:
        c = F.regexp_replace(c, rf"(?U)\b{word}\b", short)
    c = F.regexp_replace(c, r"\b([nsew])(\d+(?:st|nd|rd|th)?)\b", "$1 $2")
    for last, suffix in ((r"1[1-3]", "th"), ("1", "st"), ("2", "nd"), ("3", "rd"), ("[04-9]", "th")):
        c = F.regexp_replace(c, rf"\b(\d*{last})(?=\s+(?:ave|st)\b)", rf"$1{suffix}")
    for word, short in DIRECTION_WORDS:
        c = F.regexp_replace(c, rf"(^| ){word}$", f"$1{short}")
    c = F.regexp_replace(c, rf"^(.+ (?:{STREET_TYPES})) (?:{STREET_TYPES})$", "$1")
    words = "|".join(w for w, _ in DIRECTION_WORDS)
    return F.regexp_replace(c, rf"^(?!(?:{DIRECTIONS}|{words})(?: |$))(.+) ({DIRECTIONS})$", "$2 $1")


def address_key(c: Column) -> Column:
    """Civic number and street; null stays null."""
    own = F.trim(F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, DASHES, "-"))), r"\*+$", ""))
    civic = F.regexp_extract(own, r"^(\d+)\s+.+$", 1)
    return F.concat(F.when(civic != "", F.concat(civic, F.lit(" "))).otherwise(""), street(F.regexp_replace(own, r"^\d+\s+(?=.)", "")))


def direction_first(c: Column) -> Column:
    return F.when(F.lower(c).rlike(rf" ({DIRECTIONS})$"), F.regexp_replace(F.lower(c), rf"^(.+) ({DIRECTIONS})$", "$2 $1")).otherwise(c)


def base(c: Column) -> Column:
    collapsed = F.regexp_replace(F.regexp_replace(c, DASHES, "-"), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(F.lower(F.trim(collapsed)), r"\*+$", ""))


def directions_short(c: Column) -> Column:
    """A spelled-out direction right after the civic number in short form."""
    for word, short in DIRECTION_WORDS:
        c = F.regexp_replace(c, rf"^(\d+)\s+{word}\b", f"$1 {short}")
    return c


def first_address(c: Column) -> Column:
    """The first of several addresses in one field; the field itself if it starts with the separator."""
    first = F.regexp_extract(c, r"^(.*?)(?:\s*[/;]\s*|$)", 1)
    return F.when(first != "", first).otherwise(c)


def with_variants(df: DataFrame, source: str) -> DataFrame:
    """Candidate keys of a source address: a row for each, with its place ``at``, the most literal first.

    Step by step in columns of their own, so that no expression is repeated within another.
    """
    steps = df.withColumn("_base", base(F.col(source))).withColumn("_first", first_address(F.col("_base")))
    steps = steps.withColumns({f"_m{k}": F.regexp_extract("_first", _PAIR, k) for k in range(6)})
    steps = steps.withColumns({"_a": F.col("_m2").try_cast("bigint"), "_b": F.col("_m4").try_cast("bigint"), "_whole": F.when(F.length("_m4") < F.length("_m2"), F.concat(F.substr("_m2", F.lit(1), F.length("_m2") - F.length("_m4")), "_m4")).otherwise(F.col("_m4")).try_cast("bigint")})
    unit = (F.col("_m1") != "") | F.col("_a").isNull()
    spans = (F.col("_whole") > F.col("_a")) & ((F.col("_whole") - F.col("_a")) % 2 == 0) & (F.col("_whole") - F.col("_a") <= MAX_RANGE)
    steps = steps.withColumn("kind", F.when(F.col("_m0") == "", None).when(unit, F.when(F.col("_m3") == "-", "unit")).when((F.col("_m3") != "-") | spans, "range").otherwise("unit"))
    steps = steps.withColumns({"low": F.when(F.col("kind") == "range", F.col("_a")), "high": F.when(F.col("kind") == "range", F.col("_whole")).when(F.col("kind") == "unit", F.col("_b")), "street": F.col("_m5")})
    low = F.when(F.col("kind") == "range", F.concat_ws(" ", F.col("low").cast("string"), "street"))
    high = F.when(F.col("kind").isNotNull(), F.concat_ws(" ", F.col("high").cast("string"), "street"))
    rows = steps.select(*df.columns, "kind", "low", "high", "street", F.posexplode(F.array_compact(F.array("_base", "_first", low, high))).alias("at", "_raw"))
    return rows.withColumn("_raw", directions_short(F.col("_raw"))).withColumn("key", address_key(F.col("_raw"))).drop("_raw")


def loose_key(c: Column) -> Column:
    """The key without its final street type."""
    return F.when(c.rlike(r"^\d+ .+"), F.regexp_replace(c, rf"^(\d+ .+?) (?:{STREET_TYPES})$", "$1")).otherwise(c)


def _cut_pattern(types: str, ignored: str) -> str:
    """Civic number and street up to the first token that ends a street, where something else follows.

    A type ends a street that has a name before it, so that "St" as "Saint" does not; Broadway and Kingsway end themselves.
    """
    own = "broadway|kingsway"
    named = rf"(?!(?:{DIRECTIONS}) )(?!(?:{own}) )\S+ (?:.*? )??(?:{own}|{types})"  # no group repeats within: a long text must not fill the stack
    return rf"^(\d\S* (?:(?:{DIRECTIONS}) )*+(?:(?:{own})|{named}))(?! (?:{ignored})(?: (?:{ignored}))*+$) (.+)$"


_CUT = _cut_pattern(f"{STREET_TYPES}|way|sq", DIRECTIONS)
_LONG_TYPES = "|".join(dict.fromkeys([*(w for w, _ in TYPE_ABBREVIATIONS if not w.endswith(("west", "east"))), *STREET_TYPES.split("|")]))
_SPLIT = "(?i)" + _cut_pattern(rf"(?:{_LONG_TYPES}|way|sq)\.?", rf"{DIRECTIONS}|(?:{_LONG_TYPES})\.?")


def without_name(key: Column) -> Column:
    """The key cut after its street where a building name follows; null if nothing is to be cut."""
    return F.nullif(F.regexp_extract(key, _CUT, 1), F.lit(""))


def split_name(address: Column) -> Column:
    """struct(address, name): a building name after the street, in its own spelling."""
    raw = F.regexp_replace(F.trim(address), r"(?U)\s+", " ")
    return F.struct(F.coalesce(F.nullif(F.regexp_extract(raw, _SPLIT, 1), F.lit("")), raw).alias("address"), F.nullif(F.regexp_extract(raw, _SPLIT, 2), F.lit("")).alias("name"))


def civic_and_street(key: Column) -> tuple[Column, Column]:
    return F.regexp_extract(key, r"^(\d+) ", 1).try_cast("bigint"), F.regexp_replace(key, r"^\d+ ", "")


def lat_lon(c: Column) -> tuple[Column, Column]:
    """Two numbers from "lat, lon"; null where they cannot be read."""
    parts = [F.regexp_extract(c, r"^\s*([\-0-9.]+)\s*,\s*([\-0-9.]+)\s*$", k).try_cast("double") for k in (1, 2)]
    return parts[0], parts[1]


def _capital(word: Column) -> Column:
    mc = F.concat(F.lit("Mc"), F.upper(F.substring(word, 3, 1)), F.substring(word, 4, 1_000_000))
    return F.when(word.rlike("^mc[a-z]"), mc).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1_000_000)))


def display(c: Column) -> Column:
    """An address key as it is shown; null is empty, and what has a capital letter is shown as it is.

    Directions, and words with digits, are in capitals, but for ordinals; a part after a dash has a capital unless the
    one before has at most two letters.
    """
    raw = F.trim(c)
    parts = lambda w: F.split(w, "-")
    plain = lambda w: F.array_join(F.transform(parts(w), lambda p, k: F.when((k > 0) & (F.length(F.get(parts(w), k - 1)) <= 2), p).otherwise(_capital(p))), "-")
    shown = lambda w: F.when(w.rlike(rf"^({DIRECTIONS})$"), F.upper(w)).when(w.rlike(r"^[0-9]+(st|nd|rd|th)$"), w).when(w.rlike("[0-9#]"), F.upper(w)).otherwise(plain(w))
    return F.coalesce(F.when(raw != F.lower(raw), raw).otherwise(F.array_join(F.transform(F.split(raw, r"(?U)\s+"), shown), " ")), F.lit(""))
