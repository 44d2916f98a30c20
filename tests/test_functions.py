"""Keys and cleaning, as tables of examples."""

import pytest
from pyspark.sql import functions as F

from plotwise.functions import address as A
from plotwise.functions import names as N
from plotwise.functions import numeric as M
from plotwise.functions import text as X


def applied(spark, expression, values):
    rows = [(k, v) for k, v in enumerate(values)]
    out = spark.createDataFrame(rows, "k int, v string").select("k", expression(F.col("v")).alias("out")).orderBy("k").collect()
    return [r.out for r in out]


@pytest.mark.parametrize(
    "expression, pairs",
    [
        (A.address_key, [("1155 Thurlow Street*", "1155 thurlow st"), ("  2010 East 18 Avenue", "2010 east 18th ave"), ("55 16th Ave E", "55 e 16th ave"), ("3 Kent Avenue North", "3 n kent ave"), ("7 W49th Av.", "7 w 49th ave"), ("9 Cordova St St", "9 cordova st"), ("1 11 Ave", "1 11th ave"), (None, None)]),
        (A.loose_key, [("404 hawks ave", "404 hawks"), ("404 hawks", "404 hawks"), ("hawks st", "hawks st")]),
        (A.without_name, [("1266 w 12th ave appolloni ct", "1266 w 12th ave"), ("3 e kent ave n", None), ("5 st george st", None), ("1265 kingsway ave", "1265 kingsway"), ("8 main st", None)]),
        (A.direction_first, [("Georgia W", "w georgia"), ("Main", "Main"), (None, None)]),
        (X.money, [("$1,234.50", 1234.5), ("n/a", None), (None, None), ("12", 12.0)]),
        (X.sentinel_to_null, [("(Unknown)", None), (" x ", "x"), ("  ", None), (None, None)]),
        (X.date_prefix, [("2024-05-01T00:00", "2024-05-01"), ("May", None)]),
        (X.web_url, [("http://a", "http://a"), ("ftp://a", None), ("javascript:x", None)]),
        (X.dashed, [("12345678", "012-345-678"), ("012-345-678", "012-345-678")]),
        (X.padded, [("123", "00000123"), ("123456789", "123456789")]),
        (X.clean, [(None, ""), (" NaN ", ""), (" a ", "a")]),
        (N.owner_key, [("Société Générale", "socie-te-ge-ne-rale"), ("", "unknown"), (None, "unknown"), ("A & B Ltd.", "a-b-ltd")]),
        (N.match_key, [("Smith Holdings Ltd.", "smithholding"), ("SMITH HOLDING LIMITED", "smithholding")]),
        (N.owner_label, [("['A', 'B']", "A, B"), ("[A]", "A"), ("'A'", "A"), ("", "(Unknown)"), (None, "(Unknown)"), ("A, B", "A, B")]),
        (N.kind_of_name, [("City of Vancouver", "government"), ("Provincial Rental Housing Corporation", "government"), ("Hill Realty Group", "company"), ("Oak Limited Partnership", "partnership"), ("Sun Trust Company", "company"), ("Jane Q Doe", "individual"), ("Oak Manor", "unknown"), ("A. & B. Doe", "unknown"), ("Helper Society Ltd", "non_profit"), ("7654321 British Columbia Inc", "numbered_company"), ("Sunrise Housing Co-op", "coop"), ("1234567 B.C. Ltd.", "numbered_company"), ("Maple Society", "non_profit"), ("Doe, Jane", "individual"), ("Family Trust", "trust"), ("", "unknown"), (None, "unknown")]),
        (N.sector, [("x Private", "private"), ("Non-profit", "nonprofit"), ("something private", None)]),
    ],
)
def test_examples(spark, expression, pairs):
    assert applied(spark, expression, [a for a, _ in pairs]) == [b for _, b in pairs]


def test_split_name(spark):
    got = applied(spark, A.split_name, ["1005 JERVIS ST Mathew Court", "309 E CORDOVA ST St", "8 Main St"])
    assert [tuple(x) for x in got] == [("1005 JERVIS ST", "Mathew Court"), ("309 E CORDOVA ST St", None), ("8 Main St", None)]


def test_variants(spark):
    rows = [("407 Heatley Ave ; 684 E Hastings St",), ("#800 - 1047 Barclay St",), ("429 - 433 W Pender St",), ("3335-45 Main St",), ("7430 & 7460 Heather St",), ("303-1210 Jervis St",)]
    out = A.with_variants(spark.createDataFrame(rows, "s string"), "s").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("at", "key"))).alias("x")).collect()
    keys = {r.s: [y.key for y in r.x][1:] for r in out}
    assert "407 heatley ave" in keys["407 Heatley Ave ; 684 E Hastings St"]
    assert keys["#800 - 1047 Barclay St"][-1] == "1047 barclay st"
    assert keys["429 - 433 W Pender St"][-2:] == ["429 w pender st", "433 w pender st"]
    assert keys["3335-45 Main St"][-2:] == ["3335 main st", "3345 main st"]
    assert keys["7430 & 7460 Heather St"][-2:] == ["7430 heather st", "7460 heather st"]
    assert keys["303-1210 Jervis St"][-1] == "1210 jervis st"


def test_numbers(spark):
    row = spark.range(1).select(
        M.land_share(F.lit(3.0), F.lit(1.0)).alias("a"), M.land_share(F.lit(0.0), F.lit(0.0)).alias("b"), M.building_ratio(F.lit(None), F.lit(2.0), F.lit(1.0)).alias("c"),
        M.full_year(F.lit(26)).alias("d"), M.scale(F.lit(0)).alias("e"), M.scale(F.lit(10)).alias("f"), M.bucket(F.lit(0.3)).alias("g"), M.slider_value(M.slider(F.lit(50.0), 5, 500, True), 5, 500, True).alias("h"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g) == (0.75, None, 0.5, 2026, None, "large", 2) and abs(row.h - 50) < 1e-9


def test_very_long_addresses(spark):
    """Patterns on free text neither fill the stack nor try all ways to cut it."""
    long = ["1 " + "abc " * 20_000 + "st tail", "1 " + "e " * 20_000, "5 " + "w " * 20_000 + "main st west tail", "x" * 200_000, "1 - " * 30_000]
    for key in (A.without_name, A.loose_key, A.address_key, lambda c: A.split_name(c)["address"]):
        assert len(applied(spark, key, long)) == len(long)
    assert applied(spark, A.without_name, ["1 " + "abc " * 20_000 + "st tail"])[0].endswith("abc st")


def test_links(spark):
    from plotwise.functions import links

    got = applied(spark, links.deep_link, ["#pid=012-345-678&pid=9", "lat=49.2&lon=-123.1", "lat=49.2&lon=0", "#address=%31+Main%20St", "address=%zz", "", None])
    assert [x and tuple(x) for x in got] == [("012345678", None, None, None), (None, 49.2, -123.1, None), None, (None, None, None, "1 Main St"), None, None, None]
    assert applied(spark, links.short_key, ["1865 E 10TH AV", "341 East Hastings St."]) == ["1865 e 10th ave", "341 e hastings st"]
