"""Coop names, imports that must fail, releases with odd rows, and reports on empty tables."""

import pytest
from pyspark.sql import functions as F

from plotwise.functions import names
from plotwise.operators import releases

CLAIM = ", ".join(f"{c} string" for c in (*releases.REQUIRED, *releases.OPTIONAL))


def test_kinds_of_coops(spark):
    want = {
        "Maple Co-op": "coop", "Maple Coop": "coop", "MAPLE CO-OPERATIVE": "coop", "Maple Housing Cooperative Association": "coop", "Maple Co Op": "individual", "Maple Co--op": "individual",
        "Co-operators Insurance": "company", "Cooperators Group": "company", "Scoop Holdings Ltd": "company",
    }
    rows = spark.createDataFrame([(n,) for n in want], "name string").select("name", names.kind_of_name(F.col("name")).alias("kind")).collect()
    assert {r.name: r.kind for r in rows} == want


def test_releases_with_odd_rows(spark):
    rows = [
        (0, 1, "1005 JERVIS ST Mathew Court", None), (1, 1, "1005 Jervis Street", "Older"), (1, 2, "12 Oak St", "Kept"), (0, 2, "12 Oak St The Oaks", "Own"), (0, 3, "309 E CORDOVA ST St", None),
        (0, 4, "7 St George St", None), (0, 5, "", None), (0, 6, None, "Nowhere"), (1, 6, None, "Nowhere else"), (0, 7, "1005 jervis st", "Later"),
    ]
    got = [tuple(r) for r in releases.merged_releases(spark.createDataFrame(rows, "rank int, pos int, address string, name string")).orderBy("id").select("id", "key", "address", "name").collect()]
    assert [r[0] for r in got] == list(range(6))
    assert got[0] == (0, None, None, "Nowhere")
    assert {r[1:] for r in got[1:]} == {
        ("", "", None), ("1005 jervis st", "1005 JERVIS ST", "Mathew Court"), ("12 oak st", "12 Oak St", "Own"), ("309 e cordova st", "309 E CORDOVA ST St", None), ("7 st george st", "7 St George St", None),
    }


def test_imports_that_fail(spark):
    stored = spark.createDataFrame([], "claim_id bigint, " + CLAIM)
    good = [(1, "k1", " Acme ", "Bob", "common_owner", "research"), (2, "k1", "ACME", "Ann", "common_owner", "research"), (3, "k2", "acme", None, "entity_kind", " ")]
    rows = spark.createDataFrame(good, "pos int, claim_key string, entity_a string, entity_b string, relationship string, source_type string")
    got = {r.claim_key: r for r in releases.imported_claims(stored, rows).collect()}
    assert (got["k1"].entity_a, got["k1"].entity_b, got["k1"].claim_id) == ("Acme", "Ann", None)
    assert (got["k2"].entity_a, got["k2"].entity_b, got["k2"].source_type) == ("Acme", None, None)
    with pytest.raises(ValueError, match="not allowed.*mood"):
        releases.imported_claims(stored, rows.withColumn("mood", F.lit("x")))
    with pytest.raises(ValueError, match="lack.*source_type"):
        releases.imported_claims(stored, rows.drop("source_type"))
    with pytest.raises(Exception, match="no claim_key in row 3"):
        releases.imported_claims(stored, rows.withColumn("claim_key", F.when(F.col("pos") < 3, F.col("claim_key")).otherwise(" "))).collect()


def test_reports_on_odd_parties(spark):
    rows = [(1, 1, "A", "owner", "company", None), (1, 2, "B", "licensee", "individual", "A"), (1, 3, "C", "licensee", "trust", None), (1, 4, "D", "licensee", "company", None),
            (2, 1, "A", "owner", "", None), (2, 2, "C", "licensee", "trust", None), (3, 1, "A", "owner", "trust", None), (3, 2, "C", "licensee", None, None), (4, 1, "A", "owner", "trust", None)]
    schema = "building int, pos int, name string, role string, kind string, same_as string"
    assert [tuple(r) for r in releases.kind_disagreements(spark.createDataFrame(rows, schema)).collect()] == [(1, ["company"], "C", "trust")]
    assert releases.kind_disagreements(spark.createDataFrame([], schema)).count() == 0
    assert releases.axis_report(spark.createDataFrame([], "a string, b int, units int"), ["a", "b"]).count() == 0
