"""Every query of the catalogue against its SQL, run by DuckDB on the same small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from plotwise.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    return value


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, DIR)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(row[c]) for c in columns) for row in frame.collect()), key=repr)
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    result = duck.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fees_are_read_back(spark):
    rows = catalogue.QUERIES["q_fee_decode"](spark, DIR).selectExpr("fee", "dwellings", "reading", "certain").collect()
    assert sum(r.reading == "rate" and r.certain and r.dwellings * 98 == r.fee for r in rows) > 0.9 * len(rows)
