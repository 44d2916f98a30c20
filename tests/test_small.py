"""Functions that no query of the catalogue reaches, each on its plain and odd cases."""

import json

import pytest
from pyspark.sql import functions as F

from plotwise.functions import address, names, numeric, text
from plotwise.operators import claims, contract, networks
from plotwise.sources import config, files, pages, sinks
from plotwise.streaming import snapshots


def values(spark, expression, *rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(expression.alias("y")).collect()]


def test_texts(spark):
    x = F.col("x")
    assert values(spark, text.blank_to_null(x), " a ", "  ", "", None) == ["a", None, None, None]
    assert values(spark, text.money_text(x), 3.0, 2.5, None, schema="x double") == ["3", "2.5", None]
    assert values(spark, address.display(x), "100 w 2nd ave", "100 w 2ND AVE", "main st", None) == ["100 W 2nd Ave", "100 w 2ND AVE", "Main St", ""]
    assert values(spark, names.same_entity(x, F.lit("Acme Holdings Ltd."), F.lit("1"), F.lit("2")), "ACME HOLDINGS", "Other", None) == [True, False, False]
    assert values(spark, names.same_entity(x, F.lit("B"), F.lit("1"), F.lit("1")), "A") == [True]


def test_numbers_and_lists(spark):
    x = F.col("x")
    assert values(spark, numeric.first_that(x, lambda v: v > 2), [1, 3, 5], [1], [], None, schema="x array<int>") == [3, None, None, None]
    rounded = values(spark, numeric.rounded_coordinates(x), [[[1.23456789, 2.0], [3.0, 4.00000049]]], None, schema="x array<array<array<double>>>")
    assert rounded == [[[[1.234568, 2.0], [3.0, 4.0]]], None]
    assert values(spark, pages.bedrooms(x), [2, 1, 2, 3], [], None, schema="x array<int>") == [(1, 3, "1;2;3"), (None, None, ""), (None, None, None)]


def test_pages(spark):
    html = '<ul><li class="card"><h3>One &amp; Only</h3><b>1</b></li><li class="card"><h3>Two</h3></li></ul><p>2 homes</p><script>var homes = [{"name":"A","beds":2},{"name":"B"}];</script>'
    assert [len(v) for v in values(spark, pages.cards(F.col("x"), '<li class="card">'), html, "none", "")] == [2, 0, 0]
    assert values(spark, pages.embedded(F.col("x"), "homes", "struct<name:string,beds:int>"), html, "none") == [[("A", 2), ("B", None)], None]
    rows = [(1, html), (2, html.replace("2 homes", "3 homes")), (3, "2 homes"), (4, "nothing"), (5, None), (6, html.replace("<h3>Two</h3>", "<h3> </h3>")), (7, "0 homes")]
    good, bad = pages.reconciled(spark.createDataFrame(rows, "page_id int, html string"), '<li class="card">', r"(\d+) homes", ("name",), name=r"<h3>([^<]*)</h3>", beds=r"<b>(\d+)</b>")
    assert sorted(map(tuple, good.collect())) == [(1, 0, "One & Only", "1"), (1, 1, "Two", None)]
    assert dict(map(tuple, bad.collect())) == {2: "tells 3 cards, has 2", 3: "tells 2 cards, has 0", 4: "tells no number", 5: "tells no number", 6: "a card lacks name"}


def test_configuration(spark):
    source = 'database = "db"\n[paths]\nbuildings = "b.csv"\naddresses = "a.csv"\n[options]\nyear = 2024\n[[overlay_areas]]\nkey = "k"\n'
    assert config.load_config(source) == {"database": "db", "buildings": "b.csv", "addresses": "a.csv", "year": 2024, "overlay_areas": [{"key": "k"}]}
    with pytest.raises(ValueError, match="addresses"):
        config.load_config('database = "db"\n[paths]\nbuildings = "b.csv"\n')
    managers = config.load_managers(spark, '[managers]\n"Acme" = ["ACME Rentals"]\nSolo = []\n')
    assert sorted(map(tuple, managers.collect())) == [("Acme", "ACME Rentals"), ("Acme", "Acme"), ("Solo", "Solo")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 'say "hi"', [1, 2]), (1, None, None), (3, "a,b\nc", [])], "id int, name string, ids array<int>")
    for run in ("one", "two"):
        sinks.write_csv(df if run == "one" else df.orderBy(F.desc("id")), str(tmp_path / run), "id")
    read = lambda run: b"".join(p.read_bytes() for p in sorted((tmp_path / run).glob("part-*")))
    assert read("one") == read("two") and read("one").startswith(b"id,name,ids\n1,,\n2,")
    back = spark.read.csv(str(tmp_path / "one"), header=True, quote='"', escape='"', multiLine=True).collect()
    assert {r.id: (r.name, r.ids) for r in back} == {"1": (None, None), "2": ('say "hi"', "[1,2]"), "3": ("a,b\nc", "[]")}
    assert sinks.unique_or_fail(df, "id").count() == 3
    with pytest.raises(Exception, match="id occurs twice: 2"):
        sinks.unique_or_fail(df.union(df.where("id = 2")), "id").collect()
    log = str(tmp_path / "log")
    assert sinks.run_source(spark, "good", "r1", log, lambda: df).count() == 3

    def broken():
        raise OSError("gone")

    with pytest.raises(OSError, match="gone"):
        sinks.run_source(spark, "bad", "r1", log, broken)
    assert sorted((r.source, r.status, r.n_rows, r.error) for r in spark.read.parquet(log).collect()) == [("bad", "failed", None, "gone"), ("good", "done", 3, None)]
    missing = files.optional(spark, str(tmp_path / "nothing"), df.schema, spark.read.parquet)
    assert missing.schema == df.schema and missing.isEmpty() and not files.optional(spark, log, df.schema, spark.read.parquet).isEmpty()


def test_snapshots(spark, tmp_path):
    for name, day, rows in (("acme", "2024-01-02", [{"id": 1, "status": "open", "phone": "x", "address": {"city": "Town"}}]), ("acme", "2024-02-02", [{"id": 1, "status": "Coming Soon", "address": {"city": "TOWN"}}, {"id": 2, "status": None, "address": {"city": "Town"}}]), ("solo", "latest", [{"id": 9}])):
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / f"{day}.json").write_text(json.dumps(rows))
    out = snapshots.read_snapshots(spark, str(tmp_path), "id int, status string, address struct<city:string>", "town")
    assert "phone" not in out.columns and sorted((r.manager, r.seen, r.id) for r in out.collect()) == [("acme", "2024-01-02", 1), ("acme", "2024-02-02", 1), ("acme", "2024-02-02", 2)]
    rows = [("acme", "2024-02-02", "coming soon ", 1), ("acme", "2024-02-02", None, 2), ("acme", "2024-01-02", "open", 3), ("solo", "2023-01-01", "open", 4)]
    listings = spark.createDataFrame(rows, "manager string, last_seen string, status string, id int")
    assert sorted(r.id for r in snapshots.usable(listings).collect()) == [2, 4]


def test_contract_texts(spark):
    schema = spark.createDataFrame([], "id int, name string").schema
    assert json.loads(contract.json_schema(schema))["fields"][1]["name"] == "name"
    ring = F.lit(None).cast("array<array<struct<x:double,y:double>>>")
    square = F.expr("array(array(struct(0.0D as x, 1.23456789D as y)))")
    got = [json.loads(r[0]) for r in spark.range(1).select(contract.feature(square, name=F.lit("a"))).collect()]
    assert got == [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0.0, 1.234568]]]}, "properties": {"name": "a"}}]
    assert "geometry" in json.loads(spark.range(1).select(contract.feature(ring, name=F.lit("a"))).first()[0])


def test_claims(spark):
    rows = spark.createDataFrame([(1, ["A", "B"], ["p", "q"]), (2, [], ["r"])], "id int, owners array<string>, people array<string>")
    assert sorted(map(tuple, claims.crossed(rows, "owners", "people").collect())) == [(1, a, b) for a in "AB" for b in "pq"]
    filings = [
        (1, "p3", " Acme Ltd ", "Jo Doe", "fee", "2024-01-02 00:00"), (2, "p1", "ACME LTD.", "JO DOE", None, "2024-03-01"), (3, "p1", "Acme Ltd", "Jo Doe", "lease", ""), (4, "p2", "Acme Ltd", "Jo Doe", "fee", None),
        (5, "p0", "Acme Ltd", "Jo Doe", "fee", None), (6, "p9", "Acme Ltd", "ACME, LTD", "fee", None), (7, "p9", " ", "Jo Doe", "fee", None), (8, None, "Acme Ltd", "Al", None, None), (9, "p9", None, "Al", "fee", None),
    ]
    out = claims.derived(spark.createDataFrame(filings, "ordinal int, pid string, body string, holder string, interest string, dated string")).collect()
    assert sorted(map(tuple, out), key=str) == [
        ("registry-acme-ltd--al", "Acme Ltd", "Al", 0, [], [], None), ("registry-acme-ltd--jo-doe", "Acme Ltd", "Jo Doe", 4, ["p0", "p1", "p2"], ["fee", "lease"], "2024-03-01"),
    ]


def test_networks(spark):
    named = spark.createDataFrame([("n", "Acme B.C. Ltd.", False, "company"), ("n", "ACME BC LTD", True, "company"), ("n", "Jo", False, "individual"), ("n", "Old Co", False, "unknown"), ("n", " ", True, None), ("m", "Jo", None, None)], "network string, name string, registered boolean, kind string")
    owners = spark.createDataFrame([("n", 1, "acme bc ltd"), ("n", 1, "Acme B.C. Ltd."), ("n", 2, "Old Co"), ("n", 3, "nobody"), ("m", 1, "acme bc ltd")], "network string, building int, owner string")
    linked = spark.createDataFrame([("Old Co", "c"), ("ACME BC LTD", "c"), ("Acme B.C. Ltd.", "c"), (None, "d")], "name string, cluster string")
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert plain(networks.entities(named, owners)) == sorted([("n", "ACME BC LTD", ["Acme B.C. Ltd."], "company", 1), ("n", "Jo", [], "individual", 0), ("n", "Old Co", [], None, 1), ("m", "Jo", [], None, 0)], key=str)
    found = networks.entities(named, owners, linked)
    assert ("n", "ACME BC LTD", ["Acme B.C. Ltd.", "Old Co"], "company", 2) in plain(found)
    lists = {r.network: [e.name for e in r.entities] for r in networks.listed(found).collect()}
    assert lists == {"n": ["Jo", "ACME BC LTD"], "m": ["Jo"]}
    sums = networks.totals(spark.createDataFrame([("n", 3, 1.5, None, 2), ("n", None, None, 1.0, None), ("m", 1, None, None, 0), (None, 9, 9.0, 9.0, 9)], "network string, units int, value_land double, value_building double, n_issues int"))
    assert plain(sums) == [("m", 1, 1, None, 0), ("n", 2, 3, 2, 2)]
