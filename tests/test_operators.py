"""Ties, nulls, order and idempotence of the operators on small frames."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plotwise.operators import claims, contract, dedupe, fees, graph, histogram, lookup, matcher, ownership, ranks, spatial
from plotwise.sources import config, files, sinks
from plotwise.streaming import snapshots


def test_merge_rules(spark):
    rows = [("k", 0, "B", 1950.0, 10, 1, "u1"), ("k", 1, "A", 1961.0, 12, 4, "u2"), ("k", 2, None, None, None, 4, "u3"), ("n", 3, None, None, None, None, "u4")]
    df = spark.createDataFrame(rows, "key string, pos int, owner string, year double, units int, issues int, url string")
    for frame in (df, df.orderBy(F.desc("pos"))):
        out = {r.key: r for r in dedupe.merged(frame, "key", "pos", modes=["owner"], medians=["year"], maxima=["units"], companions=[("url", "issues")]).collect()}
        assert (out["k"].owner, out["k"].year, out["k"].units, out["k"].url) == ("A", 1955.5, 12, "u2")
        assert out["n"].owner is None and out["n"].url is None


def test_numbered_and_percent(spark):
    df = spark.range(0, 100).withColumn("v", (F.col("id") / 10).cast("int"))
    rows = ranks.numbered(df.repartition(7), [F.desc("v"), "id"], "n").collect()
    assert {r.n: r.id for r in rows} == {k + 1: x for k, x in enumerate(sorted(range(100), key=lambda i: (-(i // 10), i)))}
    assert {r.v: r.percent for r in ranks.percent_below(df, "v").collect()} == {v: 10.0 * v for v in range(10)}


def test_fallbacks_and_nearest(spark):
    left = spark.createDataFrame([(1, "s", 10), (2, "s", 15), (3, "t", 1)], "id int, street string, civic int")
    right = spark.createDataFrame([("s", 12, 0), ("s", 18, 1), ("s", 8, 2)], "street string, civic int, pos int")
    got = {r.id: r.nearest and r.nearest.ordinal for r in lookup.nearest_in_group(left, right, "street", "civic", "civic", "pos").collect()}
    assert got == {1: 0, 2: 0, 3: None}
    dim = spark.createDataFrame([("a", 1, None), ("b", 2, 3)], "k string, x int, y int")
    rows = spark.createDataFrame([("a", "b"), ("z", "b"), ("z", "q")], "own string, prim string")
    assert sorted(map(tuple, lookup.block_fallback(rows, dim, "k", "own", "prim").collect()), key=str) == sorted([("a", "b", 1, None), ("z", "b", 2, 3), ("z", "q", None, None)], key=str)
    assert sorted(map(tuple, lookup.cell_fallback(rows, dim, "k", "own", "prim").collect()), key=str) == sorted([("a", "b", 1, 3), ("z", "b", 2, 3), ("z", "q", None, None)], key=str)


def test_matcher_tiers_and_refusals(spark):
    known = spark.createDataFrame([("100 main st",), ("404 hawks ave",), ("500 oak st",), ("500 oak ave",), ("12 elm st",), ("20 fir st",), ("22 fir st",)], "key string")
    asked = {"100 Main Street": ("100 main st", "M1"), "100 Main St Maple House": ("100 main st", "M2"), "404 Hawks St": ("404 hawks ave", "M3"), "500 Oak Rd": (None, None), "10 - 14 Elm St": ("12 elm st", "M4"), "18 - 24 Fir St": (None, None), "": (None, None)}
    out = matcher.matched(spark.createDataFrame([(a,) for a in asked], "src string"), known, "src", "key").collect()
    assert {r.src: (r.match, r.tier) for r in out} == asked


def test_components(spark):
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("x", "y"), ("c", "d"), (None, "q")], "a string, b string")
    assert {r.node: r.component for r in graph.components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    assert graph.components(edges.limit(0)).count() == 0


def test_claims(spark):
    schema = "claim_key string, claim_id int, status string"
    old, new = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x")], schema), spark.createDataFrame([("b", 9, "y"), ("c", 3, "y")], schema)
    once = claims.upserted(old, new)
    assert sorted(map(tuple, once.collect())) == [("a", 1, "x"), ("b", 2, "y"), ("c", 3, "y")]
    assert sorted(map(tuple, claims.upserted(once, new).collect())) == sorted(map(tuple, once.collect()))
    bad = spark.createDataFrame([("", "b", "common_owner", "confirmed"), ("a", "b", "cousin", "confirmed")], "entity_a string, entity_b string, relationship string, status string")
    assert sorted(r.problem for r in claims.problems(bad).collect()) == ["entity_a is blank", "relationship is not known"]


def test_fees():
    assert fees.decoded(98.0 * 7, 2025, 3, False)[:2] == ("rate", 7)
    assert fees.decoded(277.0, 2025, 3, True)[0] == "non-profit"
    assert fees.decoded(77.0, 2025, 3, False)[0] == "application only" and fees.decoded(237.0, None, None, False)[:2] == ("arrears", 1) and fees.decoded(None, None, None, False)[0] == "no fee"
    assert fees.decoded(98.0 * 3 * 6 / 12 + 77, 2026, 7, False)[:2] == ("rate", 3)


def test_histogram_edges(spark):
    flat = spark.createDataFrame([("m", 5.0)] * 3, "metric string, value double")
    rows = histogram.histogram(flat, [histogram.Metric("m", 4, log=False)]).collect()
    assert sum(r["count"] for r in rows) == 3 and min(r.lower for r in rows) == 4.5 and max(r.upper for r in rows) == 5.5
    wide = spark.createDataFrame([("m", float(v)) for v in (0, 1, 2, 10, 100, 1000)] + [("m", None)], "metric string, value double")
    rows = sorted(histogram.histogram(wide, [histogram.Metric("m", 4, 2.5, log=True)]).collect(), key=lambda r: r.bin)
    assert rows[0]["count"] == 3 and sum(r["count"] for r in rows) == 6 and rows[-1]["count"] == 2 - 0 or rows[-1]["count"] >= 1


def test_spatial(spark):
    square = spark.createDataFrame([(1, [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)]])], f"polygon_id int, rings {spatial.RINGS}")
    points = spark.createDataFrame([(1, 0.2, 0.2), (2, 1.0, 1.0), (3, 2.0, 1.0), (4, 3.0, 3.0)], "point_id int, x double, y double")
    assert {r.point_id: r.polygon_id for r in spatial.assigned(points, square, 0.7).collect()} == {1: 1, 2: None, 3: 1, 4: None}
    assert {r.point_id: r.polygon_id for r in spatial.assigned(points, square, 0.7, boundary=False).collect()} == {1: 1, 2: None, 3: None, 4: None}
    targets = spark.createDataFrame([(7, 0.0, 0.0), (8, 50.0, 50.0), (9, 3.0, 3.0)], "target_id int, tx double, ty double")
    far = points.union(spark.createDataFrame([(5, 1000.0, 1000.0)], points.schema))
    assert {r.point_id: r.target_id for r in spatial.nearest(far, targets, 0.5).collect()} == {1: 7, 2: 7, 3: 7, 4: 9, 5: 8}  # 3 has two as near: the smaller


def test_nearest_is_the_least_distance(spark):
    rng = random.Random(5)
    place = lambda reach: (rng.randint(-reach, reach) / 4, rng.randint(-reach, reach) / 4)
    targets = [(k, *place(40)) for k in range(60)] + [(100, 900.0, 900.0), (101, None, 1.0)]
    points = [(k, *place(60)) for k in range(150)] + [(200 + k, *place(8000)) for k in range(20)] + [(300, None, 2.0), (None, 1.0, 1.0)]
    found = spatial.nearest(
        spark.createDataFrame(points, "point_id int, x double, y double"), spark.createDataFrame(targets, "target_id int, tx double, ty double"), 0.3
    ).collect()
    placed = [t for t in targets if t[1] is not None]
    least = {p: min(((x - tx) ** 2 + (y - ty) ** 2, t) for t, tx, ty in placed)[1] if p is not None and x is not None else None for p, x, y in points}
    assert len(found) == len(points) and {r.point_id: r.target_id for r in found} == least


def test_masked_assignment_sees_the_input(spark):
    df = spark.createDataFrame([(1, 2), (None, 3)], "a int, b int")
    assert [tuple(r) for r in ownership.assign_where(df, F.col("a") == 1, a=F.col("b"), b=F.col("a")).collect()] == [(2, 1), (None, 3)]


def test_snapshot_fold_in_any_order_and_twice(spark, tmp_path):
    rows = [("a", "2024-01-02", 1, "new"), ("a", "2024-01-01", 0, "old"), ("b", "2024-01-01", 0, "x")]
    df = spark.createDataFrame(rows, "id string, seen string, seq int, name string")
    whole = sorted(map(tuple, snapshots.fold(df, ["id"], "seen", "seq", ["name"]).collect()))
    part = snapshots.fold(df.where("seq = 1"), ["id"], "seen", "seq", ["name"])
    for _ in range(2):
        part = snapshots.merge(part, snapshots.fold(df.where("seq = 0"), ["id"], "seen", "seq", ["name"]), ["id"], "seq", ["name"])
    assert sorted(map(tuple, part.collect())) == whole == [("a", "new", "2024-01-01", "2024-01-02", 1), ("b", "x", "2024-01-01", "2024-01-01", 0)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Name;Land Coord;n\nx;00012;1\ny;;bad\n", encoding="utf-8")
    from pyspark.sql import types as T

    df = files.normalised_names(files.read_delimited(spark, str(tmp_path / "a.csv"), T.StructType([T.StructField("n", T.IntegerType())])))
    assert [tuple(r) for r in df.collect()] == [("x", "00012", 1), ("y", None, None)] and df.columns == ["name", "land_coord", "n"]
    with pytest.raises(ValueError):
        files.conform(df, T.StructType([T.StructField("name", T.StringType())]))
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "one.csv").write_text("pid,searched_on,result,note,result_count,searched_at\n012-345-678,2024-01-01,filed,,0,\n")
    with pytest.raises(PySparkException, match="result_count"):
        files.read_search_log(spark, str(tmp_path / "log")).collect()
    (tmp_path / "f.geojson").write_text('{"type":"FeatureCollection","features":[{"properties":{"name":"A"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}},{"properties":{"name":null},"geometry":null}]}')
    polygons = files.named_polygons(files.read_features(spark, str(tmp_path / "f.geojson"), geometry=True)).collect()
    assert [p.polygon_id for p in polygons] == ["A"] and len(polygons[0].rings[0]) == 3
    assert config.parse_corrections(spark, "P => owners: a; b | manager: m # note").first().owners == ["a", "b"]
    with pytest.raises(ValueError):
        config.parse_corrections(spark, "P => landlord: a")
    assert [r.line for r in sinks.csv_lines(spark.createDataFrame([('a "b"', 1, None)], "x string, y int, z string")).collect()] == ['"a ""b""",1,']


def test_contract(spark):
    df = spark.createDataFrame([(1, "unknown"), (2, None)], "n int, name string")
    assert {r.rule: r.n for r in contract.violations(df, required=["name"], ranges={"n": (0, 1)}).collect()} == {"name is null": 1, "n is out of range": 1, "name is a placeholder": 1}
    with pytest.raises(PySparkException):
        contract.require_version(spark.createDataFrame([(5,)], "schema_version int")).collect()


def test_numbers_of_many_rows(spark):
    """Numbers, ranks and quantiles over more rows than one range holds, with wide columns."""
    from plotwise.operators import ranks

    rows = spark.range(1_000_000).select(F.xxhash64("id").alias("k"), (F.col("id") % 7919).alias("v"), F.repeat(F.lit("x"), 50).alias("wide"))
    out = ranks.numbered(rows, ["k"], "n")
    assert tuple(out.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first()) == (1_000_000, 1, 1_000_000)
    late = out.select("k", "n").alias("a").join(out.select((F.col("n") - 1).alias("n"), F.col("k").alias("next")).alias("b"), "n").where("k >= next")
    assert late.isEmpty()
    below = ranks.counts_below(rows, "v").where("v in (0, 1, 7918)").select("v", "below", "total").orderBy("v").collect()
    at = lambda v: 1_000_000 // 7919 + (v < 1_000_000 % 7919)
    assert [tuple(r) for r in below] == [(0, 0, 1_000_000), (1, at(0), 1_000_000), (7918, 1_000_000 - at(7918), 1_000_000)]


def test_quantiles_with_nulls_and_ties(spark):
    from plotwise.operators import ranks

    rows = [("a", v) for v in (5.0, 1.0, 1.0, 9.0)] + [("b", 2.0), (None, 3.0), (None, 4.0), ("c", None)]
    got = {r.g: (r.low, r.mid) for r in ranks.quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", low=0.25, mid=0.5).collect()}
    assert got == {"a": (1.0, 3.0), "b": (2.0, 2.0), None: (3.25, 3.5)}


def test_added_buildings(spark):
    from plotwise.operators import listings

    rows = [(1, "10 Main Street", 4), (2, "#3 - 10 Main St", 9), (3, "99 Oak Ave", 2), (4, None, 1), (5, "20 Elm Road", 0), (6, "7 Nowhere St", 3)]
    known = spark.createDataFrame([("99 oak ave",)], "key string")
    points = spark.createDataFrame([("10 main st", 2, 1.0, 2.0, "East"), ("10 main st", 1, 3.0, 4.0, " "), ("20 elm rd", 1, 5.0, 6.0, "North"), ("7 nowhere st", 1, None, 1.0, "x")], "key string, pos int, lat double, lon double, area string")
    out = listings.added_buildings(spark.createDataFrame(rows, "id int, address string, units int"), known, points).orderBy("key").collect()
    assert [(r.key, r.lat, r.units, r.local_area, r.ids) for r in out] == [("10 main st", 3.0, 9.0, "(Unknown)", [1, 2]), ("20 elm rd", 5.0, None, "North", [5])]
