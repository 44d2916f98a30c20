"""Listings, parties, names, links and what is left over, on tables that stand for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotwise.functions import links, names, numeric
from plotwise.operators import listings as L
from plotwise.operators import lookup, parties
from plotwise.operators import registry as R
from plotwise.plans.base import Registry, t

q = Registry()


@q("""WITH l AS (SELECT o_custkey AS building, o_orderkey AS pos,
  CASE WHEN o_orderkey % 4 < 2 THEN concat('Acme ', CAST(o_orderkey % 4 AS VARCHAR))
       WHEN (o_orderkey // 4) % 2 = 0 THEN concat('ACME-', CAST(o_orderkey % 4 AS VARCHAR)) ELSE concat('acme ', CAST(o_orderkey % 4 AS VARCHAR)) END AS who FROM orders),
f AS (SELECT building, who, min(pos) AS pos FROM l GROUP BY 1, 2)
SELECT building, list(concat(who, '@', CAST(pos AS VARCHAR)) ORDER BY pos) AS listings FROM f GROUP BY 1""")
def q_listings(s, d):
    """One listing a company and building; two of four companies go by their configured name in any spelling."""
    k = F.col("o_orderkey") % 4
    spelled = F.when(F.floor(F.col("o_orderkey") / 4) % 2 == 0, F.concat(F.lit("ACME-"), k)).otherwise(F.concat(F.lit("acme "), k))
    rows = t(s, d, "orders").select(F.col("o_custkey").alias("building"), F.col("o_orderkey").alias("pos"), spelled.alias("manager"), F.col("o_orderkey").cast("string").alias("url"), F.lit("2026-01-01").alias("seen"))
    managers = t(s, d, "nation").where("n_nationkey < 2").select(F.concat(F.lit("Acme "), "n_nationkey").alias("name"), F.array(F.lit("x")).alias("listing_names"))
    managers = managers.withColumn("listing_names", F.array(F.concat(F.lit("The "), "name")))
    out = L.per_building(rows, L.alias_names(managers, ascii_only=True), ascii_only=True)
    return out.select("building", F.transform("listings", lambda x: F.concat_ws("@", x["by"], x["url"])).alias("listings"))


@q("""WITH l AS (SELECT s_suppkey AS id, s_suppkey % 40 AS k, s_suppkey % 9 AS units FROM supplier)
SELECT concat(CAST(100 + k AS VARCHAR), ' maple st') AS key, CAST(k AS DOUBLE) AS lat, CAST(max(CASE WHEN units > 0 THEN units END) AS DOUBLE) AS units, CASE WHEN k % 2 = 0 THEN 'West' ELSE '(Unknown)' END AS local_area,
list(id ORDER BY id) AS ids FROM l WHERE k % 3 = 1 GROUP BY k""")
def q_added_buildings(s, d):
    """Listings of suppliers: a third match buildings, a third only address points, a third nothing."""
    rows = t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 40).alias("k"), (F.col("s_suppkey") % 9).alias("units"))
    asked = rows.select("id", F.concat_ws(" ", (F.col("k") + 100).cast("string"), F.lit("Maple Street")).alias("address"), "units")
    key = F.concat_ws(" ", (F.col("k") + 100).cast("string"), F.lit("maple st"))
    places = rows.select("k").distinct().withColumn("key", key)
    points = places.where("k % 3 = 1").select("key", F.lit(1).alias("pos"), F.col("k").cast("double").alias("lat"), F.lit(0.0).alias("lon"), F.when(F.col("k") % 2 == 0, " West ").otherwise(" ").alias("area"))
    return L.added_buildings(asked, places.where("k % 3 = 0").select("key"), points).select("key", "lat", "units", "local_area", "ids")


@q("SELECT DISTINCT o_orderpriority AS manager, c_name AS address FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def q_added_by(s, d):
    buildings = t(s, d, "customer").select(F.col("c_custkey").alias("building"), F.col("c_name").alias("address"), F.when(F.col("c_mktsegment") == "BUILDING", L.SOURCE).otherwise("city").alias("building_source"))
    return L.added_by(buildings, t(s, d, "orders").select(F.col("o_custkey").alias("building"), F.col("o_orderpriority").alias("manager")))


@q("""SELECT c_custkey, concat(CAST(c_custkey AS VARCHAR), ' maple st') AS address, CASE WHEN c_custkey % 6 = 0 THEN concat(CAST(c_custkey + 1 AS VARCHAR), ' oak ave') ELSE concat(CAST(c_custkey AS VARCHAR), ' maple st') END AS primary_address FROM customer""")
def q_primary_address(s, d):
    k = F.col("c_custkey")
    rows = t(s, d, "customer").select(
        "c_custkey", k.cast("string").alias("civic_number"), F.lit("MAPLE STREET").alias("std_street"),
        F.when(k % 3 == 0, (k + 1).cast("string")).alias("civic_number_primary"), F.when(k % 2 == 0, "Oak Avenue").alias("std_street_primary"),
    )
    return lookup.primary_addresses(rows).select("c_custkey", "address", "primary_address")


@q("""WITH f AS (SELECT lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS pid, concat('body-', CAST(l_suppkey % 7 AS VARCHAR)) AS body, l_partkey % 50 AS building,
  CASE l_linenumber % 4 WHEN 0 THEN 'interest holder' WHEN 1 THEN 'trustee' WHEN 3 THEN 'partner' END AS interest,
  CASE WHEN l_quantity > 25 THEN upper(h) ELSE h END AS holder FROM (SELECT *, CASE WHEN l_suppkey % 3 = 0 THEN 'body 3' ELSE concat('holder ', CAST(l_orderkey % 5 AS VARCHAR)) END AS h FROM lineitem)
  WHERE l_discount <> 0.05 AND l_tax <> 0.03),
s AS (SELECT *, lower(replace(holder, ' ', '-')) AS key FROM f WHERE interest IS NOT NULL AND lower(replace(holder, ' ', '-')) <> body),
n AS (SELECT key, holder AS name FROM (SELECT key, holder, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, holder) AS r FROM s GROUP BY 1, 2) WHERE r = 1),
b AS (SELECT DISTINCT lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS pid, l_partkey % 50 AS building FROM lineitem),
e AS (SELECT b.building, s.key, s.interest, count(DISTINCT s.pid) AS n FROM s JOIN b ON b.pid = s.pid GROUP BY 1, 2, 3)
SELECT building, list(concat(name, ':', interest, ':', CAST(n AS VARCHAR)) ORDER BY n DESC, name, interest) AS holders FROM e JOIN n USING (key) GROUP BY 1""")
def q_interest_holders(s, d):
    """Holders made from lines, in two spellings, some the body itself, some withheld."""
    lines, none = t(s, d, "lineitem"), F.lit(None).cast("string")
    h = F.when(F.col("l_suppkey") % 3 == 0, "body 3").otherwise(F.concat(F.lit("holder "), F.col("l_orderkey") % 5))
    part = F.col("l_linenumber") % 4
    filings = lines.select(
        F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("pid"), F.concat(F.lit("Body "), F.col("l_suppkey") % 7).alias("body"),
        F.when(part == 0, "INTEREST_HOLDER_INDIVIDUAL").when(part == 1, "RB_TRUSTEE_CORPORATION").when(part == 3, "RB_PARTNER_INDIVIDUAL").otherwise("RB_CORPORATION").alias("interest_type"),
        F.when(F.col("l_quantity") > 25, F.upper(h)).otherwise(h).alias("holder"), F.when(F.col("l_discount") == 0.05, "FAILED").when(F.col("l_discount") == 0.06, none).otherwise("SUCCESS").alias("status"),
        F.when(F.col("l_tax") == 0.03, "True").alias("withheld"), none.alias("obscured"),
    )
    bridge = lines.select(F.col("l_partkey").cast("string").alias("pid"), (F.col("l_partkey") % 50).alias("building")).distinct()
    out = parties.interest_holders(filings, bridge.withColumn("pid", F.lpad("pid", 9, "0")), ascii_only=True)
    return out.select("building", F.transform("holders", lambda x: F.concat_ws(":", x["name"], x["interest"], F.size(x["pids"]).cast("string"))).alias("holders"))


@q("""WITH o AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS z, CASE WHEN o_orderstatus = 'F' THEN concat('t', CAST(o_orderkey % 4 AS VARCHAR)) END AS l FROM orders)
SELECT o_custkey AS building, bool_or(o_orderstatus = 'P') AS purpose_built, arg_min(z, o_orderkey) FILTER (z IS NOT NULL) AS zoning, coalesce(list(DISTINCT l ORDER BY l) FILTER (l IS NOT NULL), []) AS licence_types,
min(CASE WHEN c_acctbal < 0 THEN c_mktsegment END) AS non_market FROM o JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def q_housing_facts(s, d):
    orders, k = t(s, d, "orders"), F.col("o_orderkey")
    rows = orders.select(F.col("o_custkey").alias("building"), k.alias("pos"), F.col("o_orderstatus").alias("release"), F.when(k % 3 == 0, F.col("o_orderpriority")).alias("zoning"))
    licences = orders.select(F.col("o_custkey").alias("building"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("t"), k % 4)).alias("type"))
    non_market = t(s, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("building"), F.col("c_mktsegment").alias("fact"))
    return parties.housing_facts(rows, licences, non_market, "P")


def _party_rows(s, d):
    """Records whose parties follow from the remainders of the customer's key."""
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    owner = "array<struct<name:string,pids:array<string>>>"
    entry = lambda by: F.struct(F.lit(by).alias("by"), F.lit("https://x").alias("url"), F.lit("2026-01-02").alias("seen"))
    rows = t(s, d, "customer").select(
        k.alias("building"),
        F.when(k % 3 == 0, F.array(F.struct(F.lit("Alpha Ltd").alias("name"), F.array(F.lit("001")).alias("pids")))).otherwise(F.array().cast(owner)).alias("registry_owners"),
        F.lit("2026-01-01").alias("retrieved"), F.lit("Beta Inc").alias("owner_name"), F.when(k % 3 == 1, "inventory").otherwise("licence").alias("owner_source"),
        F.when(k % 2 == 0, F.array(F.lit("Beta Inc"), F.lit("Gamma"))).otherwise(F.array(F.lit("Beta Inc"))).alias("joint"),
        F.when(k % 4 == 0, F.array(F.struct(F.lit("Person").alias("name"), F.lit("trustee").alias("interest"), F.array(F.lit("001")).alias("pids")))).alias("holders"),
        F.lit("Delta Mgmt").alias("managed_by"), F.when(k % 5 == 0, "licence").otherwise(none).alias("managed_by_source"),
        F.when(k % 2 == 1, F.array(entry("Zeta"), entry("Delta Mgmt"))).alias("listings"), F.when(k % 7 == 0, "ZETA Ltd").alias("operator"),
        F.when(k % 6 == 0, "ALPHA").when(k % 6 == 1, "delta mgmt").otherwise("Omega").alias("licence_holder"),
    )
    clusters = t(s, d, "nation").where("n_nationkey < 2").select(F.when(F.col("n_nationkey") == 0, "Omega").otherwise("Gamma").alias("name"), F.lit("one").alias("cluster"))
    return parties.parties(rows, clusters)


_PARTIES = """WITH c AS (SELECT c_custkey AS building, c_custkey AS k, c_custkey % 2 AS odd,
  list_filter([CASE WHEN k % 5 = 0 THEN 'licence' END, CASE WHEN k % 2 = 1 THEN 'listing' END, CASE WHEN k % 6 = 1 AND k % 5 > 0 THEN 'licence' END], lambda x: x IS NOT NULL) AS delta FROM customer)"""


@q(_PARTIES + """ SELECT building, list_filter([CASE WHEN k % 3 = 0 THEN concat('owner:Alpha Ltd:', CASE WHEN k % 6 = 0 THEN '2' ELSE '1' END, ':') ELSE 'owner:Beta Inc:1:' END,
  CASE WHEN k % 3 = 1 AND odd = 0 THEN 'owner:Gamma:2:' END, CASE WHEN k % 4 = 0 THEN 'interest_holder:Person:1:' END,
  CASE WHEN k % 5 = 0 OR odd = 1 THEN concat('manager:Delta Mgmt:', CAST(len(delta) AS VARCHAR), ':') END,
  CASE WHEN odd = 1 THEN concat('manager:Zeta:', CASE WHEN k % 7 = 0 THEN '2' ELSE '1' END, ':') WHEN k % 7 = 0 THEN 'manager:ZETA Ltd:1:' END,
  CASE WHEN k % 6 = 0 THEN 'licensee:ALPHA:1:owner' WHEN k % 6 = 1 THEN 'licensee:delta mgmt:1:manager' WHEN k % 6 = 4 THEN 'licensee:Omega:1:owner' ELSE 'licensee:Omega:1:' END], lambda x: x IS NOT NULL) AS parties FROM c""")
def q_party_roles(s, d):
    """Everyone a record names, in order, with the number of sources and what the licensee also is."""
    text = lambda p: F.concat_ws(":", p["role"], p["name"], F.size(p["sources"]).cast("string"), F.coalesce(p["same_as"], F.lit("")))
    return parties.nested(_party_rows(s, d)).select("building", F.transform("parties", text).alias("parties"))


@q(_PARTIES + """ SELECT building, CASE WHEN k % 5 = 0 OR odd = 1 THEN 'private' WHEN k % 7 = 0 THEN 'non_profit' ELSE 'government' END AS value,
CASE WHEN k % 5 = 0 OR odd = 1 THEN array_to_string(delta, ',') WHEN k % 7 = 0 THEN 'inventory' ELSE 'licence' END AS basis FROM c WHERE k % 5 = 0 OR odd = 1 OR k % 7 = 0 OR k % 6 IN (2, 3, 5)""")
def q_operator_axis(s, d):
    kinds = s.createDataFrame([("Delta Mgmt", "company"), ("Zeta", "non_profit"), ("ZETA Ltd", "non_profit"), ("Omega", "government")], "name string, kind string")
    return parties.operator_axis(_party_rows(s, d), kinds).select("building", "value", F.array_join("basis", ",").alias("basis"))


@q("""WITH c AS (SELECT c_custkey AS k, ['Doe, Jane', 'Maple Society', 'Hill Holdings Ltd', 'City of Vancouver', '5th & Main', 'Family Trust'][c_custkey % 6 + 1] AS name,
['individual', 'non_profit', 'company', 'government', 'unknown', 'trust'][c_custkey % 6 + 1] AS named, CASE c_custkey % 4 WHEN 0 THEN 'INDIVIDUAL' WHEN 1 THEN 'CORPORATION' END AS holder FROM customer),
r AS (SELECT *, k % 5 = 0 AS claimed, coalesce(holder = 'INDIVIDUAL', false) AS person, coalesce(holder = 'CORPORATION' AND named IN ('individual', 'unknown'), false) AS body FROM c)
SELECT k AS c_custkey, name, CASE WHEN claimed THEN 'coop' WHEN person THEN 'individual' WHEN body THEN 'company' ELSE named END AS kind,
CASE WHEN claimed AND k % 2 = 0 THEN 'claim_registry' WHEN claimed THEN 'claim_city_records' WHEN person OR body THEN 'registry' ELSE 'name_rule' END AS basis,
NOT claimed AND NOT person AND NOT body AS inferred, CASE WHEN k % 9 = 0 THEN 'fund' END AS institutional FROM r""")
def q_entity_kinds(s, d):
    """Claims beat the registry, the registry beats the name."""
    k = F.col("c_custkey")
    name = F.get(F.array(*map(F.lit, ("Doe, Jane", "Maple Society", "Hill Holdings Ltd", "City of Vancouver", "5th & Main", "Family Trust"))), (k % 6).cast("int"))
    c = t(s, d, "customer").select("c_custkey", name.alias("name"), F.concat(F.lit("n"), k).alias("key"))
    claims = c.where("c_custkey % 5 = 0").select("key", F.lit("coop").alias("kind"), F.when(k % 2 == 0, "public_registry").otherwise("city_record").alias("source"))
    registry = c.select("key", F.when(k % 4 == 0, "INDIVIDUAL").when(k % 4 == 1, "CORPORATION").alias("holder_type"))
    return names.classified(c, claims, registry, c.where("c_custkey % 9 = 0").select("key", F.lit("fund").alias("label"))).drop("key")


@q("""SELECT concat('rezoning-', CAST(o_custkey AS VARCHAR), '-', CAST(o_orderkey AS VARCHAR)) AS synthetic_id, 'rezoning' AS source, o_orderpriority AS name, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, o_totalprice AS lat, CAST(NULL AS DOUBLE) AS lon
FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def q_unmatched_records(s, d):
    """Records without a building, whose own ids repeat."""
    rows = t(s, d, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("key"), F.concat(F.lit(" "), "o_orderpriority").alias("name"),
        F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_totalprice").alias("lat"), F.lit(None).cast("double").alias("lon"),
    )
    return R.unmatched_records(rows, t(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key")), "rezoning")


@q("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS pid, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 > 0 THEN 49.25 END AS lat,
CASE WHEN c_custkey % 7 > 0 THEN concat(CAST(c_custkey AS VARCHAR), ' Main St.') END AS address, CASE WHEN c_custkey % 7 > 0 THEN concat(CAST(c_custkey AS VARCHAR), ' main st') END AS key
FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 7 > 0 OR (c_custkey % 2 = 0 AND c_custkey % 5 > 0)""")
def q_link_parse(s, d):
    """Hashes with parcels, places outside the bounds, and encoded addresses."""
    k = F.col("c_custkey")
    pid = F.when(k % 3 == 0, F.lpad(k.cast("string"), 9, "0")).otherwise("12")
    pid = F.concat_ws("-", F.substring(pid, 1, 3), F.substring(pid, 4, 3), F.substring(pid, 7, 3))
    address = F.when(k % 7 > 0, F.concat(k.cast("string"), F.lit("%20Main+St."))).otherwise("+")
    link = F.concat(F.lit("#pid="), pid, F.lit("&lat="), F.when(k % 2 == 0, "49.25").otherwise("50.1"), F.lit("&lon="), F.when(k % 5 > 0, "-123.1").otherwise("x"), F.lit("&address="), address)
    rows = t(s, d, "customer").select("c_custkey", links.deep_link(link).alias("link")).where("link is not null")
    return rows.select("c_custkey", "link.pid", "link.lat", "link.address", F.when(F.col("link.address").isNotNull(), links.short_key(F.col("link.address"))).alias("key"))


@q("SELECT DISTINCT concat('VAS', CAST(c_custkey AS VARCHAR)) AS plan, concat(CAST(c_custkey AS VARCHAR), ' main st') AS key FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 > 0")
def q_plan_numbers(s, d):
    k = F.col("c_custkey")
    site = F.when(k % 3 == 0, F.concat(F.lit(" vas"), k)).otherwise(k.cast("string"))
    return R.plan_numbers(t(s, d, "customer").select(site.alias("site_id"), F.concat(k, F.lit(".0")).alias("civic"), F.when(k % 5 > 0, "Main Street").alias("street")))


@q("""SELECT o_custkey, CASE WHEN CAST(f > 0 AS INT) + CAST(o > 0 AS INT) + CAST(p > 0 AS INT) = 1 THEN CASE WHEN f > 0 THEN 'Registry' WHEN o > 0 THEN 'Licence' ELSE 'Inventory' END ELSE
concat_ws('; ', CASE WHEN f > 0 THEN concat('Registry (', f, CASE WHEN f = 1 THEN ' building)' ELSE ' buildings)' END) END, CASE WHEN o > 0 THEN concat('Licence (', o, CASE WHEN o = 1 THEN ' building)' ELSE ' buildings)' END) END,
CASE WHEN p > 0 THEN concat('Inventory (', p, CASE WHEN p = 1 THEN ' building)' ELSE ' buildings)' END) END) END AS provenance
FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1)""")
def q_provenance(s, d):
    return R.provenance(t(s, d, "orders").select("o_custkey", "o_orderstatus"), "o_custkey", "o_orderstatus", [("F", "Registry"), ("O", "Licence"), ("P", "Inventory")])


@q("SELECT concat('n', CAST(o_custkey % 700 AS VARCHAR)) AS name, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, name LIMIT 50")
def q_most_common(s, d):
    """The fifty commonest names."""
    return R.most_common(t(s, d, "orders").select(F.concat(F.lit("n"), F.col("o_custkey") % 700).alias("name")), "name")


@q("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_returnflag = 'R' THEN l_discount ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN l_tax ELSE 0 END AS total, l_returnflag = 'R' OR l_linestatus = 'F' AS either,
list_filter([CASE WHEN l_returnflag = 'R' THEN 'west' END, CASE WHEN l_linestatus = 'F' THEN 'east' END], lambda x: x IS NOT NULL) AS areas FROM lineitem""")
def q_row_totals(s, d):
    """Sums and alternatives across columns, where null counts as nothing; area keys split from one text."""
    returned, final = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    rows = t(s, d, "lineitem").withColumns({"_d": F.when(returned, F.col("l_discount")), "_t": F.when(final, F.col("l_tax")), "_r": F.when(returned, F.lit(True)), "_f": F.when(final, F.lit(True))})
    text = F.concat_ws(";", F.when(returned, "west"), F.lit(""), F.when(final, " east "))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", numeric.total("_d", "_t").alias("total"), numeric.any_of("_r", "_f").alias("either"), numeric.area_keys(text).alias("areas"))
