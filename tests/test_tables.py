"""Tables with odd rows, lots that must fail, and empty tables."""

import pytest
from pyspark.sql import functions as F

from plotwise.functions import address, names
from plotwise.operators import tables

RECORD = "address string, units bigint, owner_key string, owner_name string, network_key string, network_name string, no_filing string, local_area string"


def test_groups_not_on_record_come_last(spark):
    rows = [("1 a st", 5, None, "X", None, None, "2024", None), ("2 a st", 900, None, None, None, None, "", "Mole"), (None, 7, "k", "B ltd", "n", "Net", None, "Mole"), ("3 a st", 1, "k", "B Ltd", "n", "Net", None, "Mole"), ("4 a st", None, "j", None, "n", "Net", None, None)]
    records = spark.createDataFrame(rows, RECORD)
    got = [tuple(r) for r in tables.by_owner(records).orderBy("place").select("group", "label", "buildings", "units", "average").collect()]
    assert got == [("k", "B Ltd", 1, 8, 8.0), ("j", "", 1, 0, 0.0), ("unknown-searched", "", 1, 5, 5.0), ("unknown", "", 1, 900, 900.0)]
    assert [(r.group, r.landlords) for r in tables.by_network(records).orderBy("place").collect()] == [("n", 2), ("unknown-searched", 0), ("unknown", 0)]
    assert [(r.label, r.buildings) for r in tables.by_area(records).orderBy("place").collect()] == [("Mole", 2), ("(Unknown)", 2)]
    none = spark.createDataFrame([], RECORD)
    assert tables.by_owner(none).count() == tables.by_network(none).count() == tables.by_area(none).count() == 0


def test_totals_of_nothing(spark):
    empty = spark.createDataFrame([], "buildings int, units int, selected boolean, visible boolean")
    assert tuple(tables.totals_shown(empty).first()) == ("visible", 0, 0, 0, 0.0)
    some = spark.createDataFrame([(None, 4, True, False), (2, 6, None, True)], empty.schema)
    assert tuple(tables.totals_shown(some).first()) == ("selected", 1, 0, 4, 0.0)


def test_lots_that_fail(spark):
    lot = "line int, pid string, strata_plan string"
    good = spark.createDataFrame([(2, "026 477 394", " bcs 1539 "), (3, "026-477-408", "VAS12")], lot)
    assert [tuple(r) for r in tables.strata_lots(good).collect()] == [("026-477-394", "BCS1539", None), ("026-477-408", "VAS12", None)]
    for row, said in (((4, "12", "VAS1"), "line 4: bad pid 12"), ((5, None, "VAS1"), "line 5: bad pid null"), ((6, "026477394", "1VAS"), "line 6: bad strata_plan 1VAS"), ((7, "026477394", "ABCDE1"), "line 7: bad strata_plan")):
        with pytest.raises(Exception, match=said):
            tables.strata_lots(spark.createDataFrame([row], lot)).collect()
    with pytest.raises(ValueError, match="strata_plan"):
        tables.strata_lots(good.drop("strata_plan"))


def test_filters_of_odd_records(spark):
    names = "b_id local_area areas owner_key network_key no_filing managed_by housing_type n_issues owner_type owner_parts owner_legal_forms owner_inferred market units year_built value_land value_bldg bldg_land_ratio".split()
    record = spark.range(1).select(*(F.lit(None).cast("boolean" if n == "owner_inferred" else "double" if n[:2] in ("va", "un", "ye", "n_", "bl", "b_") else "string").alias(n) for n in names))
    got = tables.filter_fields(record).first().asDict()
    assert got["owner"] == got["network"] == "unknown" and got["owner_types"] == got["areas"] == got["housing_types"] == [] and got["units"] is None and got["has_owner"] is False
    halves = record.withColumns({"value_land": F.lit(2.5), "value_bldg": F.lit(3.5), "units": F.lit(-1.9), "year_built": F.lit(float("inf"))})
    got = tables.filter_fields(halves).first()
    assert (got.value_land, got.value_bldg, got.units, got.year_built) == (2.0, 4.0, -1, None)


def test_labels_of_owners(spark):
    want = {
        None: "(Unknown)", "  ": "(Unknown)", "[]": "(Unknown)", "['A', 'B']": "A, B", '["A Ltd", \'\', 3]': "A Ltd, 3", "('A',)": "A", "('A')": "A", "(1, 2)": "1, 2", "[A]": "A", "[A, B]": "[A, B]", "'A'": "A", '"A\'': "A",
        "A (B)": "A (B)", "['A'": "['A'", "[12]": "12", "(A)": "(A)",
    }
    rows = spark.createDataFrame([(k,) for k in want], "name string").select("name", names.owner_label(F.col("name")).alias("label")).collect()
    assert {r.name: r.label for r in rows} == want


def test_addresses_as_shown(spark):
    want = {None: "", "": "", "350 e 6th ave": "350 E 6th Ave", "1234a mcdonald st": "1234A McDonald St", "#200-581 se marine dr": "#200-581 SE Marine Dr", "7 Already st": "7 Already st", " 5  saint-jean   co-operative ": "5 Saint-Jean Co-operative"}
    rows = spark.createDataFrame([(k,) for k in want], "a string").select("a", address.display(F.col("a")).alias("shown")).collect()
    assert {r.a: r.shown for r in rows} == want
