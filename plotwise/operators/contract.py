"""Nested public records: a closed schema, checks that count violations, and JSON."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 6


def when_any(flag: Column, **fields: Column) -> Column:
    """A struct of the fields, or null where the flag is not true."""
    return F.when(F.coalesce(flag, F.lit(False)), F.struct(*(c.alias(name) for name, c in fields.items())))


def violations(df: DataFrame, *, required=(), enums: dict[str, tuple] | None = None, ranges: dict[str, tuple] | None = None, banned=("(unknown)", "unknown", "nan")) -> DataFrame:
    """(rule, n): how many rows break each rule; one pass."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    rules = {f"{c} is null": F.col(c).isNull() for c in required}
    rules |= {f"{c} is not one of its values": F.col(c).isNotNull() & ~F.col(c).isin(*values) for c, values in (enums or {}).items()}
    rules |= {f"{c} is out of range": (F.col(c) < low) | (F.col(c) > high) for c, (low, high) in (ranges or {}).items()}
    rules |= {f"{c} is a placeholder": F.lower(F.trim(c)).isin(*banned) for c in text}
    counts = df.agg(*(F.count_if(F.coalesce(test, F.lit(False))).alias(f"r{k}") for k, test in enumerate(rules.values())))
    pairs = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"r{k}").alias("n")) for k, name in enumerate(rules)))
    return counts.select(F.explode(pairs).alias("x")).select("x.*").where("n > 0")


def closed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame with exactly the schema's columns; an unknown column is an error, a missing one null."""
    unknown = set(df.columns) - set(schema.names)
    if unknown:
        raise ValueError(f"columns not in the contract: {sorted(unknown)}")
    return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def json_schema(schema: T.StructType) -> str:
    return json.dumps(schema.jsonValue(), separators=(",", ":"), sort_keys=True)


def records(df: DataFrame) -> DataFrame:
    """One compact JSON text per row."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def feature(geometry: Column, **properties: Column) -> Column:
    """A GeoJSON feature as text; geometry: rings of (x, y)."""
    rings = F.transform(geometry, lambda ring: F.transform(ring, lambda p: F.array(F.round(p["x"], 6), F.round(p["y"], 6))))
    shape = F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*(c.alias(k) for k, c in properties.items())).alias("properties")))


def require_version(df: DataFrame, version: int = VERSION) -> DataFrame:
    """Fails when a row of another version is read."""
    wrong = F.raise_error(F.concat(F.lit("schema_version is "), F.coalesce(F.col("schema_version").cast("string"), F.lit("missing"))))
    return df.withColumn("schema_version", F.when(F.col("schema_version") == version, F.col("schema_version")).otherwise(wrong))


@dataclass(frozen=True)
class Value:
    """A value of a nested contract: its type, and what must hold of it."""

    kind: str
    optional: bool = False
    tests: dict[str, Callable[[Column], Column]] = field(default_factory=dict)


@dataclass(frozen=True)
class Group:
    fields: dict[str, Value | Group | Items]
    optional: bool = False


@dataclass(frozen=True)
class Items:
    item: Value | Group | Items
    optional: bool = False


def text(optional: bool = False, banned: tuple = ("(unknown)", "unknown")) -> Value:
    """Text that is neither blank nor a word for a missing value."""
    return Value("string", optional, {"is blank or a placeholder": lambda c: (F.trim(c) != "") & ~F.lower(F.trim(c)).isin(*banned)})


def matching(pattern: str, optional: bool = False) -> Value:
    return Value("string", optional, {"has another form": lambda c: c.rlike(pattern)})


def one_of(*values: str, optional: bool = False) -> Value:
    return Value("string", optional, {"is not one of its values": lambda c: c.isin(*values)})


def within(kind: str, low: float | None = None, high: float | None = None, optional: bool = False) -> Value:
    inside = lambda c: (F.lit(True) if low is None else c >= low) & (F.lit(True) if high is None else c <= high)
    return Value(kind, optional, {"is out of range": inside} if low is not None or high is not None else {})


def broken_rules(value: Column, spec: Value | Group | Items, path: str) -> Column:
    """Array of ``<path> <what is wrong>``, a text for each place where a rule is broken; ``[]`` stands for the items of a list."""
    none = F.array().cast("array<string>")
    missing = none if spec.optional else F.array(F.lit(f"{path} is null"))
    if isinstance(spec, Group):
        held = F.concat(*(broken_rules(value.getField(name), f, f"{path}.{name}" if path else name) for name, f in spec.fields.items()))
        return F.when(value.isNull(), missing).otherwise(held)
    if isinstance(spec, Items):
        return F.when(value.isNull(), missing).otherwise(F.flatten(F.transform(value, lambda x: broken_rules(x, spec.item, f"{path}[]"))))
    failed = [F.when(~F.coalesce(test(value), F.lit(False)), F.lit(f"{path} {name}")) for name, test in spec.tests.items()]
    return F.when(value.isNull(), missing).otherwise(F.array_compact(F.array(*failed)) if failed else none)


def type_of(spec: Value | Group | Items) -> T.DataType:
    if isinstance(spec, Group):
        return T.StructType([T.StructField(name, type_of(f)) for name, f in spec.fields.items()])
    return T.ArrayType(type_of(spec.item)) if isinstance(spec, Items) else T.DataType.fromDDL(spec.kind)


def misfits(kind: T.DataType, spec: Value | Group | Items, path: str = "") -> list[str]:
    """What of a type is not as the contract says: fields that it does not know or that lack, and other types."""
    at = path or "the record"
    if isinstance(spec, Group):
        if not isinstance(kind, T.StructType):
            return [f"{at} is no struct"]
        out = [f"{at} has the unknown field {n}" for n in kind.names if n not in spec.fields] + [f"{at} lacks {n}" for n in spec.fields if n not in kind.names]
        return out + [m for n, f in spec.fields.items() if n in kind.names for m in misfits(kind[n].dataType, f, f"{path}.{n}" if path else n)]
    if isinstance(spec, Items):
        return misfits(kind.elementType, spec.item, f"{path}[]") if isinstance(kind, T.ArrayType) else [f"{at} is no list"]
    same = kind.simpleString() == spec.kind or (spec.kind == "bigint" and isinstance(kind, T.IntegerType))
    return [] if same else [f"{at} is {kind.simpleString()}, not {spec.kind}"]


def nested_violations(df: DataFrame, spec: Group) -> DataFrame:
    """(rule, n): how often each rule of the nested contract is broken, in one pass; types and fields are compared first."""
    if wrong := misfits(df.schema, spec):
        raise ValueError("; ".join(wrong))
    found = df.select(F.explode(broken_rules(F.struct(*(F.col(f"`{n}`") for n in spec.fields)), spec, "")).alias("rule"))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def valid_or_fail(df: DataFrame, spec: Group) -> DataFrame:
    """The frame, which fails while it is read on the first row that breaks a rule."""
    if wrong := misfits(df.schema, spec):
        raise ValueError("; ".join(wrong))
    broken = broken_rules(F.struct(*(F.col(f"`{n}`") for n in spec.fields)), spec, "")
    return df.where(F.when(F.size(broken) == 0, True).otherwise(F.raise_error(F.array_join(broken, "; ")).cast("boolean")))
