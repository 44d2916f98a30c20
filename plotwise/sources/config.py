"""Configuration and small correction files, read on the driver."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession

REQUIRED = ("database", "buildings", "addresses")


def load_config(text: str) -> dict:
    """Flat options from TOML: ``paths`` and ``options`` come to the top, area layers stay a list; required keys must be there."""
    raw = tomllib.loads(text)
    flat = {k: v for k, v in raw.items() if not isinstance(v, dict)} | raw.get("paths", {}) | raw.get("options", {})
    if absent := [k for k in REQUIRED if not flat.get(k)]:
        raise ValueError(f"the configuration lacks {absent}")
    flat["overlay_areas"] = list(raw.get("overlay_areas", []))
    return flat


def load_managers(spark: SparkSession, text: str) -> DataFrame:
    """(manager, alias) from TOML: each manager with itself and its aliases."""
    raw = tomllib.loads(text).get("managers", {})
    rows = [(name, alias) for name, aliases in raw.items() for alias in [name, *aliases]]
    return spark.createDataFrame(rows, "manager string, alias string")


def parse_corrections(spark: SparkSession, text: str) -> DataFrame:
    """Lines like ``published => owners: a; b | behind: x | manager: y``; an unknown field is an error."""
    rows = []
    for number, line in enumerate(text.splitlines(), 1):
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        published, arrow, rest = line.partition("=>")
        if not arrow:
            raise ValueError(f"line {number} has no =>")
        fields: dict[str, list[str]] = {"owners": [], "behind": [], "manager": []}
        for part in filter(None, map(str.strip, rest.split("|"))):
            name, _, values = part.partition(":")
            if name.strip() not in fields:
                raise ValueError(f"line {number} has an unknown field {name.strip()!r}")
            fields[name.strip()] = [v.strip() for v in values.split(";") if v.strip()]
        rows.append((published.strip(), fields["owners"], fields["behind"], fields["manager"]))
    return spark.createDataFrame(rows, "published string, owners array<string>, behind array<string>, manager array<string>")
