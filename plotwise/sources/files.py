"""Delimited, JSON and GeoJSON sources with declared schemas.  Paths go through Spark's readers only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def header_of(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """(separator, names) from the first line: the one of comma, semicolon and tab that cuts it most; comma if none does."""
    line = (spark.read.text(path).limit(1).first() or [""])[0].lstrip("﻿")
    sep = max(",;\t", key=lambda s: (line.count(s), s == ","))
    return sep, [name.strip().strip('"') for name in line.split(sep)]


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Columns by header name; texts unless the schema says otherwise; empty fields are null, "NA" stays text."""
    sep, names = header_of(spark, path)
    raw = spark.read.csv(path, sep=sep, header=True, schema=T.StructType([T.StructField(n, T.StringType()) for n in names]), nullValue="", emptyValue="", quote='"', escape='"', multiLine=True, encoding="UTF-8", enforceSchema=True)
    kinds = {f.name: f.dataType for f in schema} if schema else {}
    return raw.select(*(F.col(f"`{n}`").try_cast(kinds[n]).alias(n) if n in kinds and kinds[n] != T.StringType() else F.col(f"`{n}`") for n in names))


_WHOLE, _NUMBER, _TRUTH = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", r"^(?i:true|false)$"


def inferred_kinds(raw: DataFrame) -> dict[str, T.DataType]:
    """The narrowest type of each text column that all its values have, by one aggregate over all rows and columns.

    Whole numbers of 64 bits, else numbers, or truth values, else texts; a column without values is text.
    """
    tests = []
    for k, c in enumerate(raw.columns):
        v = F.col(f"`{c}`")
        tests += [F.bool_and(F.when(v.isNotNull(), v.rlike(_WHOLE) & v.try_cast("bigint").isNotNull())).alias(f"w{k}"), F.bool_and(v.rlike(_NUMBER)).alias(f"n{k}"), F.bool_and(v.rlike(_TRUTH)).alias(f"t{k}")]
    told = raw.agg(*tests).first()
    kinds = (("w", T.LongType()), ("n", T.DoubleType()), ("t", T.BooleanType()))
    return {c: next((kind for letter, kind in kinds if told[f"{letter}{k}"]), T.StringType()) for k, c in enumerate(raw.columns)}


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file, or a folder of them, with types inferred from all rows: it is read once for the types, once for the rows."""
    kinds = inferred_kinds(read_delimited(spark, path))
    return read_delimited(spark, path, T.StructType([T.StructField(c, kind) for c, kind in kinds.items()]))


def normalised_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.lstrip("﻿").strip().lower().replace(" ", "_") for c in df.columns))


def require(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    if absent := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{label} lacks the columns {absent}")
    return df


def conform(df: DataFrame, schema: T.StructType, *, rename: dict[str, str] | None = None, ignored: Sequence[str] = (), label: str = "source") -> DataFrame:
    """The schema's columns in order: renamed, missing ones null; a column that is in neither list is an error."""
    df = df.drop(*ignored).withColumnsRenamed(rename or {})
    if unknown := [c for c in df.columns if c not in schema.names]:
        raise ValueError(f"{label} has columns that are not mapped: {unknown}")
    return df.select(*((F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def read_features(spark: SparkSession, path: str, properties: T.StructType | None = None, geometry: bool = False) -> DataFrame:
    """Properties of a GeoJSON FeatureCollection, one row a feature; the geometry, if asked for, as text."""
    if properties is None:
        inferred = spark.read.json(path, multiLine=True)
        properties = next(f for f in inferred.schema["features"].dataType.elementType if f.name == "properties").dataType
    feature = T.StructType([T.StructField("properties", properties), T.StructField("geometry", T.StringType())])
    rows = spark.read.schema(T.StructType([T.StructField("features", T.ArrayType(feature))])).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return rows.select("f.properties.*", *([F.col("f.geometry").alias("geometry")] if geometry else []))


def named_polygons(features: DataFrame, name: str = "name") -> DataFrame:
    """(polygon_id, rings) of the features that have a name and a geometry that can be read."""
    from plotwise.operators.spatial import rings_of

    out = features.select(F.col(name).alias("polygon_id"), rings_of(F.col("geometry")).alias("rings"))
    return out.where("polygon_id is not null and rings is not null")


def optional(spark: SparkSession, path: str, schema: T.StructType, read) -> DataFrame:
    """What is at the path; an empty frame if nothing is there.  Looks with the file system that Spark uses for it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return read(path) if there else spark.createDataFrame([], schema)


def checked(df: DataFrame, rules: dict[str, F.Column] | dict, label: str) -> DataFrame:
    """Fails while reading, with the file's name, on a row for which a rule is not true."""
    problem = F.coalesce(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()))
    message = F.concat(F.lit(f"{label}: "), problem, F.lit(" in "), F.coalesce(F.col("file"), F.lit("?")))
    first = df.columns[0]
    return df.withColumn(first, F.when(problem.isNull(), F.col(first)).otherwise(F.raise_error(message).cast(df.schema[first].dataType)))


def read_search_log(spark: SparkSession, folder: str) -> DataFrame:
    """All search logs of a folder; identifiers, dates, results and counts are checked row by row."""
    schema = "pid string, searched_on string, result string, note string, result_count string, searched_at string"
    raw = spark.read.csv(folder, header=True, schema=schema, enforceSchema=False, nullValue="", pathGlobFilter="*.csv").withColumn("file", F.col("_metadata.file_name"))
    counted = F.col("result_count").isNull() | ((F.col("result") == "filed") == (F.col("result_count").try_cast("int") > 0))
    rules = {
        "pid": F.col("pid").rlike(r"^(\d{9}|\d{3}-\d{3}-\d{3})$"), "searched_on": F.col("searched_on").rlike(r"^\d{4}-\d{2}-\d{2}$"),
        "result": F.col("result").isin("no_filing", "filed"), "result_count": counted,
    }
    return checked(raw, rules, "search log")
