"""Links into the map: what a location's hash asks for, and the short address key that both spellings share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a link may hold.
LATITUDES, LONGITUDES, LONGEST = (49.0, 49.5), (-123.5, -122.8), 200
# Words of the city's addresses and the map's.
SHORT_WORDS = {
    "avenue": "ave", "av": "ave", "street": "st", "road": "rd", "drive": "dr", "boulevard": "blvd", "place": "pl", "court": "ct", "crt": "ct",
    "crescent": "cres", "cr": "cres", "highway": "hwy", "east": "e", "west": "w", "north": "n", "south": "s",
}


def _parameter(location: Column, name: str) -> Column:
    """The first value of a parameter, decoded; null if it is absent or cannot be decoded."""
    pairs = F.split(F.regexp_replace(location, "^#", ""), "&")
    value = F.get(F.filter(pairs, lambda p: F.substring_index(p, "=", 1) == name), F.lit(0))
    return F.try_url_decode(F.when(F.instr(value, "=") > 0, F.substr(value, F.instr(value, "=") + 1)).otherwise(""))


def _degrees(text: Column, bounds: tuple[float, float]) -> Column:
    number = F.trim(text).try_cast("double")
    return F.when(number.between(*bounds), number)


def deep_link(location: Column) -> Column:
    """struct(pid, lat, lon, address) of a hash, or null if it asks for nothing; what is not valid reads as absent."""
    bare = F.trim(F.regexp_replace(_parameter(location, "pid"), "-", ""))
    pid = F.when(bare.rlike("^[0-9]{9}$"), bare)
    lat, lon = _degrees(_parameter(location, "lat"), LATITUDES), _degrees(_parameter(location, "lon"), LONGITUDES)
    both = lat.isNotNull() & lon.isNotNull()
    address = F.nullif(F.substring(F.trim(_parameter(location, "address")), 1, LONGEST), F.lit(""))
    link = F.struct(pid.alias("pid"), F.when(both, lat).alias("lat"), F.when(both, lon).alias("lon"), address.alias("address"))
    return F.when(pid.isNotNull() | address.isNotNull() | both, link)


def short_key(address: Column) -> Column:
    """Lower case without points and commas, each word in its short form."""
    words = F.filter(F.split(F.regexp_replace(F.lower(address), "[.,]", " "), r"\s+"), lambda w: w != "")
    short = F.create_map(*(F.lit(v) for pair in SHORT_WORDS.items() for v in pair))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(short, w), w)), " ")
