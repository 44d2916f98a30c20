"""The public files: one JSON document each, written by many tasks.

A document is a folder of ordered parts; put together in order of their names they are the document, which the file
system does (by joining files where it can, else by copying streams), so that no process holds more than a row.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .contract import VERSION
from .simplify import simplified_map

MISSING = ("unknown", "(unknown)", "")
TOLERANCE = 2e-6  # degrees, some 20 cm


def written_document(rows: DataFrame, order: list[str], text: str, head: str, tail: str, path: str) -> None:
    """Writes the file ``head`` + texts in order, with commas between them + ``tail``; the order must tell rows apart."""
    spark = rows.sparkSession
    body = rows.select(F.lit(1).alias("_part"), F.struct(*order).alias("_order"), F.col(text).alias("value"))
    first = body.agg(F.min("_order").alias("_first"))  # one row
    body = body.crossJoin(F.broadcast(first)).withColumn("value", F.when(F.col("_order") == F.col("_first"), F.col("value")).otherwise(F.concat(F.lit(","), "value"))).drop("_first")
    edges = spark.createDataFrame([(0, head), (2, tail)], "_part int, value string").select("_part", F.lit(None).cast(body.schema["_order"].dataType).alias("_order"), "value")
    parts = f"{path}-parts-{uuid.uuid4().hex}"
    edges.union(body).repartitionByRange("_part", "_order").sortWithinPartitions("_part", "_order").select("value").write.text(parts)
    joined_files(spark, parts, path)


def joined_files(spark: SparkSession, folder: str, path: str) -> None:
    """Moves the parts of a folder, by name, into one file."""
    hadoop = spark._jvm.org.apache.hadoop
    conf, goal = spark._jsc.hadoopConfiguration(), hadoop.fs.Path(path)
    files = goal.getFileSystem(conf)
    names = sorted(f.getPath().toString() for f in files.listStatus(hadoop.fs.Path(folder)) if f.getPath().getName().startswith("part-") and f.getLen() > 0)
    out = files.create(goal, True)
    try:
        for name in names:
            source = files.open(hadoop.fs.Path(name))
            try:
                hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            finally:
                source.close()
    finally:
        out.close()
    files.delete(hadoop.fs.Path(folder), True)


def as_json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def coordinate(value: Column) -> Column:
    return F.bround(value, 6)


def marker(points: DataFrame) -> DataFrame:
    """(id, json): a record a building; whole numbers are cut off, words for a missing value are null."""
    key = lambda c: F.when(~F.lower(F.trim(c)).isin(*MISSING), F.col(c)).alias(c)
    whole = lambda c: F.col(c).cast("bigint").alias(c)
    area = F.when(F.trim("local_area") != "", F.col("local_area")).alias("local_area")
    text = as_json(
        whole("b_id"), coordinate(F.col("lat")).alias("lat"), coordinate(F.col("lon")).alias("lon"), key("owner_key"), key("network_key"), whole("units"), whole("year_built"), area,
        F.coalesce("housing_type", F.lit("")).alias("housing_type"), whole("n_issues"), F.coalesce("source", F.lit("building")).alias("source"),
    )
    return points.select(F.col("b_id").alias("id"), text.alias("json"))


def outline(rings: Column) -> Column:
    """GeoJSON coordinates of open or closed rings, closed and rounded."""
    point = lambda p: F.array(coordinate(p["x"]), coordinate(p["y"]))

    def closed(ring: Column) -> Column:
        return F.transform(F.when(F.get(ring, F.lit(0)) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1))), point)

    return F.transform(rings, closed)


def features(polygons: DataFrame, properties: list[str], tolerance: float | None = TOLERANCE) -> DataFrame:
    """(id, json): a GeoJSON feature a polygon with rings; simplified with shared borders unless the tolerance is null."""
    if tolerance is not None:
        polygons = polygons.drop("rings").join(simplified_map(polygons.select("polygon_id", "rings"), tolerance), "polygon_id")
    shape = F.struct(F.lit("Polygon").alias("type"), outline(F.col("rings")).alias("coordinates")).alias("geometry")
    text = as_json(F.lit("Feature").alias("type"), shape, F.struct(*properties).alias("properties"))
    return polygons.where("rings is not null").select(F.col("polygon_id").alias("id"), text.alias("json"))


def keyed(records: DataFrame, key: str, *fields: str) -> DataFrame:
    """(id, json): ``"key":{fields}`` for a document whose records stand under their keys."""
    name = F.to_json(F.struct(F.col(key).cast("string").alias("k")))  # quoted as JSON quotes it
    return records.select(F.col(key).alias("id"), F.concat(F.substring(name, F.lit(6), F.length(name) - 6), F.lit(":"), as_json(*map(F.col, fields))).alias("json"))


def export(folder: str, *, markers: DataFrame, blocks: DataFrame, overlays: DataFrame, records: DataFrame, networks: DataFrame, config: dict, boundary: DataFrame | None = None) -> list[str]:
    """Writes the set of files and names them.

    markers: points; blocks, overlays, boundary: (polygon_id, rings, properties...); records, networks: (id, fields...);
    config: the values of the filters, which are few.
    """
    rest = lambda df: [c for c in df.columns if c not in ("polygon_id", "rings")]
    start = '{"schema_version":%d,' % VERSION
    collection = '{"type":"FeatureCollection",'
    documents = {
        "marker_metadata.json": (marker(markers), start + '"markers":[', "]}"),
        "building_records.json": (keyed(records, "id", *records.columns), start + '"records":{', "}}"),
        "networks.json": (keyed(networks, "id", *networks.columns), start + '"networks":{', "}}"),
        "blocks.geojson": (features(blocks, rest(blocks)), collection + f'"schema_version":{VERSION},"features":[', "]}"),
        "overlay_areas.geojson": (features(overlays, rest(overlays), None), collection + '"features":[', "]}"),
        "filter_config.json": (markers.sparkSession.createDataFrame([(1, json.dumps(config, separators=(",", ":"))[1:-1])], "id int, json string"), start, "}"),
    }
    if boundary is not None:
        documents["local-area-boundary.geojson"] = (features(boundary, rest(boundary), None), collection + '"features":[', "]}")
    for name, (rows, head, tail) in documents.items():
        written_document(rows, ["id", "json"], "json", head, tail, f"{folder}/{name}")
    return list(documents)
