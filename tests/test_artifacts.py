"""Simplified maps, written documents, updated components, reach and stores, against plain Python."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwise.operators import artifacts, graph, portfolios, simplify, spatial
from plotwise.sources import sinks

POLYGONS = f"polygon_id long, rings {spatial.RINGS}"


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def edges(ring):
    return {frozenset((a, b)) for a, b in zip(ring, ring[1:] + ring[:1])}


def wavy_tiles(rng, size=4, steps=12):
    """A map of tiles with wavy common borders."""
    lines = {}

    def line(a, b):
        if (b, a) in lines:
            return lines[(b, a)][::-1]
        if (a, b) not in lines:
            shift = lambda k: rng.uniform(-0.05, 0.05) if 0 < k < steps else 0.0
            out = []
            for k in range(steps + 1):
                s, (x, y) = shift(k), (a[0] + (b[0] - a[0]) * k / steps, a[1] + (b[1] - a[1]) * k / steps)
                out.append((x + s * (a[0] == b[0]), y + s * (a[1] == b[1])))
            lines[(a, b)] = out
        return lines[(a, b)]

    tiles = []
    for i in range(size):
        for j in range(size):
            c = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
            ring = [p for a, b in zip(c, c[1:] + c[:1]) for p in line(a, b)[:-1]]
            tiles.append((i * size + j, [ring + ring[:1] if (i + j) % 2 else ring]))
    return tiles


@pytest.mark.parametrize("tolerance", [0.0, 0.03, 3.0])
def test_shared_borders_stay_shared(spark, tolerance):
    tiles = wavy_tiles(random.Random(6))
    before = {k: [p for n, p in enumerate(r[0]) if n == 0 or p != r[0][0]] for k, r in tiles}
    out = {r.polygon_id: [(p.x, p.y) for p in r.rings[0]] for r in simplify.simplified_map(spark.createDataFrame(tiles, POLYGONS), tolerance).collect()}
    assert all(not simplify.crosses_itself(np.array(ring)) and set(ring) <= set(before[k]) for k, ring in out.items())
    for k, ring in out.items():
        if tolerance:
            assert len(ring) < len(before[k])
        for other, theirs in out.items():
            if k < other:
                shared = lambda rings: {p for e in edges(rings[k]) & edges(rings[other]) for p in e}
                assert bool(shared(before)) == bool(shared(out))
    assert abs(sum(map(area, out.values())) - area([p for p in outer(out)])) < 1e-9  # no gaps and no overlaps between tiles


def outer(rings):
    """The outline of all rings together."""
    count = {}
    for ring in rings.values():
        for e in edges(ring):
            count[e] = count.get(e, 0) + 1
    near = {}
    for e in (e for e, n in count.items() if n == 1):
        a, b = e
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    start = min(near)
    out, last = [start], None
    while True:
        step = next(p for p in near[out[-1]] if p != last)
        if step == start:
            return out
        last = out[-1]
        out.append(step)


def test_spiky_rings_do_not_cross(spark):
    rng, rows = random.Random(2), []
    for k in range(60):
        n = rng.randrange(3, 60)
        rows.append((k, [[(math.cos(2 * math.pi * i / n) * (r := rng.uniform(0.2, 1)), math.sin(2 * math.pi * i / n) * r) for i in range(n)]]))
    rows += [(100, None), (101, []), (102, [[(0.0, 0.0)]]), (103, [[(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]])]
    out = {r.polygon_id: r.rings for r in simplify.simplified_map(spark.createDataFrame(rows, POLYGONS), 0.3).collect()}
    assert all(not simplify.crosses_itself(np.array([(p.x, p.y) for p in out[k][0]])) for k in range(60))
    assert sum(len(out[k][0]) for k in range(60)) < 0.7 * sum(len(r[0]) for _, r in rows[:60])
    assert out[100] is None and out[101] is None and len(out[102][0]) == 1 and len(out[103][0]) == 4


def test_crosses_itself():
    bow, square = np.array([(0, 0), (1, 1), (1, 0), (0, 1)], float), np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float)
    assert simplify.crosses_itself(bow) and simplify.crosses_itself(square[:2]) and simplify.crosses_itself(np.array([(0, 0), (2, 0), (1, 0), (1, 1)], float))
    assert not simplify.crosses_itself(square) and not simplify.crosses_itself(square, rows=1)


def test_documents(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, rng.choice(['plain "quoted"', "ä\n", "\\", "", None])) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, name string").repartition(5)
    text = artifacts.as_json(F.col("id"), F.col("name"))
    artifacts.written_document(df.select("id", text.alias("json")), ["id"], "json", '{"rows":[', "]}", str(tmp_path / "list.json"))
    assert json.loads((tmp_path / "list.json").read_text()) == {"rows": [{"id": i, "name": n} for i, n in rows]}
    named = df.select(F.concat("name", F.lit("-"), "id").alias("key"), "id").where("key is not null")
    artifacts.written_document(artifacts.keyed(named, "key", "id"), ["id"], "json", '{"records":{', "}}", str(tmp_path / "map.json"))
    assert json.loads((tmp_path / "map.json").read_text()) == {"records": {f"{n}-{i}": {"id": i} for i, n in rows if n is not None}}
    artifacts.written_document(df.limit(0).select("id", text.alias("json")), ["id"], "json", '{"rows":[', "]}", str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == {"rows": []}
    assert {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")} == {"list.json", "map.json", "none.json"}


def test_set_of_files(spark, tmp_path):
    square = lambda x: [[(x, 0.0), (x + 1.0, 0.0), (x + 1.0, 1.0000004), (x, 1.0)]]
    markers = spark.createDataFrame(
        [(1, 49.28123456, None, "acme", "Unknown", 3.9, None, " ", None, 0, None), (2, None, -123.1, "unknown", "net", None, 1965.0, "North", "sro", None, "overlay")],
        "b_id long, lat double, lon double, owner_key string, network_key string, units double, year_built double, local_area string, housing_type string, n_issues int, source string",
    )
    blocks = spark.createDataFrame([(7, square(0.0), 2, ["a"]), (8, square(1.0), 0, []), (9, None, 1, [])], f"{POLYGONS}, buildings int, areas array<string>")
    areas = spark.createDataFrame([(1, square(0.5), "Chinatown")], f"{POLYGONS}, name string")
    records = spark.createDataFrame([(1, "A", None), (10, None, ["p"])], "id long, name string, pids array<string>")
    networks = spark.createDataFrame([("net:a", 2)], "id string, buildings int")
    names = artifacts.export(str(tmp_path), markers=markers, blocks=blocks, overlays=areas, records=records, networks=networks, config={"step": 5, "bins": [{"start": 1.5}]}, boundary=areas)
    got = {n: json.loads((tmp_path / n).read_text()) for n in names}
    assert len(names) == 7 and got["filter_config.json"] == {"schema_version": 6, "step": 5, "bins": [{"start": 1.5}]}
    assert got["marker_metadata.json"] == {
        "schema_version": 6,
        "markers": [
            {"b_id": 1, "lat": 49.281235, "lon": None, "owner_key": "acme", "network_key": None, "units": 3, "year_built": None, "local_area": None, "housing_type": "", "n_issues": 0, "source": "building"},
            {"b_id": 2, "lat": None, "lon": -123.1, "owner_key": None, "network_key": "net", "units": None, "year_built": 1965, "local_area": "North", "housing_type": "sro", "n_issues": None, "source": "overlay"},
        ],
    }
    assert got["building_records.json"] == {"schema_version": 6, "records": {"1": {"id": 1, "name": "A", "pids": None}, "10": {"id": 10, "name": None, "pids": ["p"]}}}
    assert got["networks.json"] == {"schema_version": 6, "networks": {"net:a": {"id": "net:a", "buildings": 2}}}
    tiles = got["blocks.geojson"]
    assert tiles["type"] == "FeatureCollection" and tiles["schema_version"] == 6 and [f["properties"] for f in tiles["features"]] == [{"buildings": 2, "areas": ["a"]}, {"buildings": 0, "areas": []}]
    assert all(f["type"] == "Feature" and f["geometry"]["type"] == "Polygon" and f["geometry"]["coordinates"][0][0] == f["geometry"]["coordinates"][0][-1] for f in tiles["features"])
    assert sorted(map(tuple, tiles["features"][0]["geometry"]["coordinates"][0][:-1])) == [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0)]
    assert got["overlay_areas.geojson"] == got["local-area-boundary.geojson"] and got["overlay_areas.geojson"]["features"][0]["properties"] == {"name": "Chinatown"}


def test_components_of_hub_and_path_and_their_changes(spark):
    rng = random.Random(5)
    frame = lambda pairs: spark.createDataFrame(pairs or [("", "")], "a string, b string").where("a != ''")
    pairs = [("n0", f"n{k}") for k in range(1, 1500)] + [(f"p{k:03}", f"p{k + 1:03}") for k in range(60)] + [(f"x{rng.randrange(60)}", f"y{rng.randrange(60)}") for _ in range(50)]
    labels = lambda df: {r.node: r.component for r in df.collect()}
    found = graph.components(frame(pairs))
    got = labels(found)
    assert all(got[f"n{k}"] == "n0" for k in range(1500)) and all(got[f"p{k:03}"] == "p000" for k in range(61))
    gone, new = pairs[1500:1560:7] + pairs[1600:1610] + [pairs[3]], [("p000", "n0"), ("q1", "q2"), (None, "q3")]
    left = [p for p in pairs if p not in gone] + new
    now = graph.updated(found, frame(left), frame(gone + new))
    assert labels(now) == labels(graph.components(frame(left)))
    assert labels(graph.updated(found, frame(pairs), frame([]))) == got
    assert labels(graph.updated(found, frame([]), frame(pairs))) == {}


def test_reach(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    members = make([("A", "a1"), ("A", "a2"), ("B", "b1")], "component string, entity string")
    titles = make([("a1", "1"), ("a1", "1"), ("a2", "2"), ("b1", "2"), ("b1", "3"), (None, "4")], "entity string, pid string")
    buildings = make([("1", "x"), ("2", "y"), ("9", "z"), (None, "w")], "pid string, addr string")
    points = make([("1", "x side"), ("3", "v"), ("2", "y")], "pid string, addr string")
    named = make([("a2", "u"), ("b1", "x"), ("b1", None)], "entity string, addr string")
    got = {(r.component, r.addr): (r.routes, r.n_pids, r.counted, r.held) for r in portfolios.reached(members, titles, buildings, points, named).collect()}
    assert got == {
        ("A", "x"): (["building"], 1, True, True), ("A", "x side"): (["point"], 1, False, True), ("A", "y"): (["building", "point"], 1, True, True), ("A", "u"): (["name"], 0, True, True),
        ("B", "y"): (["building", "point"], 1, True, False), ("B", "v"): (["point"], 1, True, True), ("B", "x"): (["name"], 0, True, False),
    }
    sized = {r.component: tuple(r)[1:] for r in portfolios.sizes(portfolios.reached(members, titles, buildings, points, named)).collect()}
    assert sized == {"A": (4, 3, 4), "B": (3, 3, 1)}


def test_store_survives_a_failed_rebuild(spark, tmp_path):
    store, log = sinks.Store(spark, str(tmp_path)), spark.createDataFrame([], "id long").schema
    store.rebuild({"a": lambda: spark.range(3), "b": lambda: spark.range(2)}, {"log": log})
    spark.range(5).write.mode("append").parquet(store.tables()["log"])

    def broken():
        raise ValueError("no source")

    with pytest.raises(ValueError, match="no source"):
        store.rebuild({"a": lambda: spark.range(30), "b": broken}, {"log": log})
    assert (store.read("a").count(), store.read("b").count(), store.read("log").count(), store.builds()) == (3, 2, 5, [1])
    wide = spark.createDataFrame([], "id long, note string, at date").schema
    store.rebuild({"a": lambda: spark.range(30)}, {"log": wide, "claims": wide})
    assert store.read("a").count() == 30 and store.read("log").dtypes == [("id", "bigint"), ("note", "string"), ("at", "date")] and store.read("claims").count() == 0
    assert set(store.tables()) == {"a", "log", "claims"} and store.read("log").where("note is null").count() == 5
    store.rebuild({"a": lambda: spark.range(1)}, {"log": log, "claims": wide})
    assert store.read("log").columns == ["id", "note", "at"] and store.read("log", log).columns == ["id"]
