"""Sources with inferred types, nested contracts, stable keys, folded tables and nearest targets, on small and odd cases."""

import random

import pytest
from pyspark.sql import functions as F

from plotwise.operators import blocks, contract, keys, spatial
from plotwise.sources import files
from plotwise.streaming import snapshots


def read(spark, tmp_path, text, name="source.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return files.read_inferred(spark, str(path))


@pytest.mark.parametrize(
    ("text", "kinds", "rows"),
    [
        ("civic_number;geo_point_2d\n100;49.28, -123.13\n", ["bigint", "string"], [(100, "49.28, -123.13")]),
        ('id,address,rooms\n1,"210 Main St., Town",63\n', ["bigint", "string", "bigint"], [(1, "210 Main St., Town", 63)]),
        ('a,b,c\nx,,""\n', ["string", "string", "string"], [("x", None, None)]),
        ("geom\nPOINT (1 2)\n", ["string"], [("POINT (1 2)",)]),
        ("﻿a\tb\n1\t1.5\n2\t3\n", ["bigint", "double"], [(1, 1.5), (2, 3.0)]),
        ("n,t,m\n-7,TRUE,NA\n9223372036854775807,false,1\n", ["bigint", "boolean", "string"], [(-7, True, "NA"), (2**63 - 1, False, "1")]),
        ("n,m\n9223372036854775808,1e3\n,.5\n", ["double", "double"], [(float(2**63), 1000.0), (None, 0.5)]),
        ("a,b\n", ["string", "string"], []),
        ('a,b\n"two\nlines",1\n" 2",01\n', ["string", "bigint"], [("two\nlines", 1), (" 2", 1)]),
    ],
)
def test_inferred(spark, tmp_path, text, kinds, rows):
    out = read(spark, tmp_path, text)
    assert [k for _, k in out.dtypes] == kinds
    assert sorted(map(tuple, out.collect()), key=str) == sorted(rows, key=str)


def test_types_come_from_all_rows_and_files(spark, tmp_path):
    for k, last in enumerate(("", "BCS1010\n")):
        (tmp_path / f"{k}.csv").write_text("site id\n" + "".join(f"{i}\n" for i in range(150)) + last, encoding="utf-8")
    out = files.normalised_names(files.read_inferred(spark, str(tmp_path)))
    assert out.dtypes == [("site_id", "string")] and out.count() == 301


SPEC = contract.Group(
    {
        "id": contract.within("bigint", 1), "name": contract.text(), "day": contract.matching(r"^\d{4}-\d{2}-\d{2}$", optional=True),
        "value": contract.Group({"share": contract.within("double", 0, 1)}, optional=True),
        "parties": contract.Items(contract.Group({"role": contract.one_of("owner", "manager"), "pids": contract.Items(contract.text(), optional=True)})),
    }
)
SCHEMA = "id bigint, name string, day string, value struct<share:double>, parties array<struct<role:string,pids:array<string>>>"


def test_nested_rules(spark):
    rows = [
        (1, "A", None, None, []),
        (2, "B", "2024-01-02", (0.5,), [("owner", ["p1", "p2"]), ("manager", None)]),
        (0, " Unknown ", "2024-1-2", (1.5,), [("owner", [None, "", "(unknown)"]), ("tenant", []), (None, None), None]),
        (None, None, "", (None,), None),
    ]
    got = {r.rule: r.n for r in contract.nested_violations(spark.createDataFrame(rows, SCHEMA), SPEC).collect()}
    assert got == {
        "id is out of range": 1, "id is null": 1, "name is blank or a placeholder": 1, "name is null": 1, "day has another form": 2, "value.share is out of range": 1, "value.share is null": 1,
        "parties[].pids[] is null": 1, "parties[].pids[] is blank or a placeholder": 2, "parties[].role is not one of its values": 1, "parties[].role is null": 1, "parties[] is null": 1, "parties is null": 1,
    }
    assert contract.valid_or_fail(spark.createDataFrame(rows[:2], SCHEMA), SPEC).count() == 2
    with pytest.raises(Exception, match="parties is null"):
        contract.valid_or_fail(spark.createDataFrame(rows[3:], SCHEMA), SPEC).collect()
    assert spark.createDataFrame([], contract.type_of(SPEC)).dtypes == spark.createDataFrame([], SCHEMA).dtypes


@pytest.mark.parametrize(
    ("schema", "message"),
    [
        (SCHEMA + ", owner_phone string", "the record has the unknown field owner_phone"),
        (SCHEMA.replace("role:string", "role:string,phone:string"), r"parties\[\] has the unknown field phone"),
        (SCHEMA.replace("share:double", "part:double"), "value lacks share"),
        (SCHEMA.replace("id bigint", "id double"), "id is double, not bigint"),
        (SCHEMA.replace("pids:array<string>", "pids:string"), r"parties\[\].pids is no list"),
    ],
)
def test_closed_contract(spark, schema, message):
    with pytest.raises(ValueError, match=message):
        contract.nested_violations(spark.createDataFrame([], schema), SPEC)


def test_keys_stay(spark, tmp_path):
    register, schema = str(tmp_path / "register"), "key string, place long"
    first = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 0), ("c", 3)], schema)
    numbers = lambda df: {r.key: r.id for r in keys.with_keys(df, "key", "place", register).collect()}
    assert numbers(first) == {"b": 1, "a": 2, "c": 3, None: None}
    more = first.union(spark.createDataFrame([("z", 0), ("y", 0), ("d", 5)], schema))
    assert numbers(more) == {"b": 1, "a": 2, "c": 3, "y": 4, "z": 5, "d": 6, None: None}
    assert numbers(more) == numbers(more.orderBy(F.desc("place"))) and numbers(first.limit(0)) == {}
    assert spark.read.parquet(register).count() == 6


def test_folded_table_writes_touched_buckets(spark, tmp_path):
    table = snapshots.Folded(spark, str(tmp_path / "folded"), 16)
    rows = lambda data: snapshots.fold(spark.createDataFrame(data, "k long, seen string, at long, v string"), ["k"], "seen", "at", ["v"])
    add = lambda n, data: table.add(rows(data), n, ["k"], "at", ["v"])
    seen = lambda: {r.k: (r.v, r.first_seen, r.last_seen) for r in table.latest().collect()}
    add(0, [(k, "2024-01-01", k, "old") for k in range(200)])
    assert len(table.state(0)) == 16 and len(seen()) == 200
    add(1, [(7, "2024-01-05", 1, "new"), (7, "2023-01-01", 2, "older")])
    assert sorted(set(table.state(1).values())) == [0, 1] and list(table.state(1).values()).count(1) == 1
    assert seen()[7] == ("new", "2023-01-01", "2024-01-05") and seen()[8] == ("old", "2024-01-01", "2024-01-01")
    add(1, [(7, "2024-01-05", 1, "new"), (7, "2023-01-01", 2, "older")])  # the same batch again
    assert seen()[7] == ("new", "2023-01-01", "2024-01-05") and len(seen()) == 200
    for n in (2, 3, 4):
        add(n, [(7, f"2024-02-0{n}", 1, f"v{n}"), (1000 + n, "2024-03-01", 1, "x")])
    assert seen()[7] == ("v4", "2023-01-01", "2024-02-04") and len(seen()) == 203
    kept = {p.name for p in (tmp_path / "folded" / "state").iterdir() if p.is_dir()}
    assert kept == {"3", "4"} and table.batches() == [3, 4]
    assert not (tmp_path / "folded" / "data" / "v=1" / f"b={next(b for b, v in table.state(3).items() if v == 3)}").exists()
    table.add(rows([]), 5, ["k"], "at", ["v"])
    assert len(seen()) == 203


@pytest.mark.parametrize("limit", [16, 64])
def test_descended(spark, limit):
    """Targets in tight crowds, many in one place, and points far from all, against all pairs."""
    rng = random.Random(3)
    targets = [(k, rng.gauss(5, 0.001), rng.gauss(5, 0.001)) for k in range(300)] + [(1000 + k, 9.0, 1.0) for k in range(200)] + [(2000 + k, rng.uniform(0, 10), rng.uniform(0, 10)) for k in range(50)]
    points = [(k, rng.uniform(-3, 13), rng.uniform(-3, 13)) for k in range(150)] + [(500, 1e6, -1e6), (501, 9.0, 1.0), (502, 5.0, 5.0), (503, -1e-9, 7.5)]
    p, t = spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(targets, "target_id long, tx double, ty double")
    want = {i: min(((x - a) ** 2 + (y - b) ** 2, k) for k, a, b in targets)[1] for i, x, y in points}
    assert {r.point_id: r.target_id for r in spatial.descended(p, t, limit).collect()} == want
    odd = p.union(spark.createDataFrame([(900, None, 1.0)], p.schema))
    near = {r.point_id: r.target_id for r in spatial.nearest(odd, t.union(spark.createDataFrame([(1, None, None)], t.schema)), 0.05).collect()}
    assert near == want | {900: None}
    one = {r.target_id for r in spatial.nearest(p, t.where("target_id = 1007"), 0.05).collect()}
    assert one == {1007} and {r.target_id for r in spatial.nearest(p, t.limit(0), 0.05).collect()} == {None}


def test_blocks_without_points(spark):
    ring = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]
    boxes = spark.createDataFrame([(1, ring), (2, [[(x + 5, y) for x, y in ring[0]]])], f"polygon_id long, rings {spatial.RINGS}")
    houses = spark.createDataFrame([(1, 0.5, 0.5, 3, 1990, "b"), (2, 0.2, 0.5, None, 1991, "a"), (3, 9.0, 9.0, 1, 1, "z"), (4, 0.5, 0.2, 4, None, None)], "point_id long, x double, y double, units int, year int, area string")
    none = spark.createDataFrame([], "point_id long, x double, y double, area string")
    out = {r.polygon_id: tuple(r)[2:] for r in blocks.with_areas(blocks.counted(boxes, houses, 1.0), none, 1.0).collect()}
    assert out == {1: (3, 7, 1990.5, [1, 2, 4], "a"), 2: (0, 0, None, [], "(Unknown)")}
    named = spark.createDataFrame([(1, 5.5, 0.5, "w"), (2, 5.1, 0.5, "v"), (3, 5.9, 0.5, "w"), (4, 0.5, 0.5, "q")], none.schema)
    assert {r.polygon_id: r.area for r in blocks.with_areas(blocks.counted(boxes, houses, 1.0), named, 1.0).collect()} == {1: "a", 2: "w"}


def test_points_and_blocks_never_go_through_the_driver(spark):
    """Tables whose files are small may hold millions of rows: none of them is broadcast by its estimated size."""
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    boxes = spark.range(3).select(F.col("id").alias("polygon_id"), F.array(F.array(corner(0.0, 0.0), corner(9.0, 0.0), corner(9.0, 9.0))).cast(spatial.RINGS).alias("rings"))
    points = spark.range(20).select(F.col("id").alias("point_id"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(2).alias("units"), F.lit(1900).alias("year"), F.lit("a").alias("area"))
    held = blocks.counted(boxes, points, 5.0)
    near = spatial.nearest(points.withColumn("x", F.col("x") * 1000), points.limit(1).select(F.col("point_id").alias("target_id"), F.col("x").alias("tx"), F.col("y").alias("ty")), 5.0)
    for frame in (held, near, spatial.flagged(points, boxes, 5.0)):
        assert "BroadcastHashJoin" not in frame._jdf.queryExecution().executedPlan().toString()
    assert [r.buildings for r in held.orderBy("polygon_id").collect()] == [9, 0, 0] and near.where("target_id = 0").count() == 20
