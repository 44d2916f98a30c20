"""Tables beside the map, their totals, what filters read, corrected names, strata lots."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotwise.functions import address, names, text
from plotwise.operators import tables as X
from plotwise.sources.config import parse_corrections

from .base import Registry, t

q = Registry()
_RECORDS = """r AS (SELECT p_brand AS brand, p_type AS type, CASE WHEN p_size % 11 > 0 THEN p_name END AS address, CASE WHEN p_size % 7 > 0 THEN p_size END AS units,
CASE WHEN p_size % 9 > 1 THEN p_type END AS owner_key, CASE WHEN p_size % 4 > 0 THEN p_brand END AS network_key, p_size % 3 = 0 AS searched, p_size FROM part)"""


def _records(s, d):
    size = F.col("p_size")
    return t(s, d, "part").select(
        F.when(size % 11 > 0, F.col("p_name")).alias("address"), F.when(size % 7 > 0, size).cast("bigint").alias("units"), F.when(size % 9 > 1, F.col("p_type")).alias("owner_key"),
        F.concat("p_type", F.lit(" "), (size % 3).cast("string")).alias("owner_name"), F.when(size % 4 > 0, F.col("p_brand")).alias("network_key"), F.concat(F.lit("N "), "p_brand").alias("network_name"),
        F.when(size % 3 == 0, "2024-01-01").otherwise("").alias("no_filing"), F.when(size % 13 > 0, F.col("p_brand")).alias("local_area"),
    )


def _group_sql(key: str, label: str, landlords: str = "") -> str:
    return f"""WITH {_RECORDS}, k AS (SELECT *, coalesce({key}, CASE WHEN searched THEN 'unknown-searched' ELSE 'unknown' END) AS g, CASE WHEN {key} IS NULL THEN '' ELSE {label} END AS l FROM r),
m AS (SELECT g, l, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, l) AS n FROM k GROUP BY g, l),
a AS (SELECT g, count(address) AS buildings, CAST(coalesce(sum(units), 0) AS BIGINT) AS units, count(DISTINCT owner_key) AS landlords FROM k GROUP BY g)
SELECT a.g AS "group", l AS label, buildings, units, {landlords} CASE WHEN buildings > 0 THEN units / buildings ELSE 0.0 END AS average,
row_number() OVER (ORDER BY CASE a.g WHEN 'unknown-searched' THEN 1 WHEN 'unknown' THEN 2 ELSE 0 END, units DESC, buildings DESC, l, a.g) AS place FROM a JOIN m ON m.g = a.g AND m.n = 1"""


@q(_group_sql("owner_key", "concat(type, ' ', CAST(p_size % 3 AS VARCHAR))"))
def q_owner_table(s, d):
    """Owners under their commonest spelling, those not on record last."""
    return X.by_owner(_records(s, d))


@q(_group_sql("network_key", "concat('N ', brand)", "landlords,"))
def q_network_table(s, d):
    """Networks with the number of their landlords."""
    return X.by_network(_records(s, d))


@q("""WITH a AS (SELECT coalesce(CASE WHEN p_size % 13 > 0 THEN p_brand END, '(Unknown)') AS g, count(CASE WHEN p_size % 11 > 0 THEN p_name END) AS buildings, CAST(coalesce(sum(CASE WHEN p_size % 7 > 0 THEN p_size END), 0) AS BIGINT) AS units FROM part GROUP BY 1)
SELECT g AS "group", g AS label, buildings, units, CASE WHEN buildings > 0 THEN units / buildings ELSE 0.0 END AS average, row_number() OVER (ORDER BY units DESC, buildings DESC, g) AS place FROM a""")
def q_area_table(s, d):
    return X.by_area(_records(s, d))


@q("""SELECT 'selected' AS "of", count(*) AS rows, CAST(sum(c_custkey % 5) AS BIGINT) AS buildings, CAST(sum(c_custkey % 40) AS BIGINT) AS units, sum(c_custkey % 40) / sum(c_custkey % 5) AS average FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'visible', count(*), CAST(sum(c_custkey % 5) AS BIGINT), CAST(sum(c_custkey % 40) AS BIGINT), sum(c_custkey % 40) / sum(c_custkey % 5) FROM customer WHERE c_acctbal > 0""")
def q_shown_totals(s, d):
    """Totals of selected rows, and of visible ones where none is selected."""
    k = F.col("c_custkey")
    rows = t(s, d, "customer").select((k % 5).alias("buildings"), (k % 40).alias("units"), (F.col("c_mktsegment") == "BUILDING").alias("selected"), (F.col("c_acctbal") > 0).alias("visible"))
    return X.totals_shown(rows).union(X.totals_shown(rows.withColumn("selected", F.lit(False))))


@q("""SELECT CAST(p_partkey AS VARCHAR) AS bid, CASE WHEN p_size % 5 > 0 THEN lower(p_brand) ELSE '' END AS area, [p_type, p_brand] AS areas, CASE WHEN p_size % 4 > 0 THEN p_type WHEN p_size % 8 = 0 THEN 'unknown-searched' ELSE 'unknown' END AS owner,
CASE WHEN p_size % 6 > 0 THEN p_brand WHEN p_size % 8 = 0 THEN 'unknown-searched' ELSE 'unknown' END AS network, lower(p_name) AS manager, ['Rental', p_type] AS housing_types, CAST(trunc(p_retailprice / 7) AS BIGINT) AS n_issues, p_size % 4 > 0 AS has_owner,
CASE p_size % 3 WHEN 0 THEN ['private', 'coop'] WHEN 1 THEN [] ELSE ['private'] END AS owner_types, CASE WHEN p_size % 2 = 0 THEN ['trust'] ELSE [] END AS legal_forms, p_size % 7 = 0 AS owner_inferred, CASE WHEN p_size % 10 > 0 THEN 'market' ELSE '' END AS market,
CAST(p_size AS BIGINT) AS units, CASE WHEN p_size % 9 > 0 THEN CAST(1900 + p_size AS BIGINT) END AS year_built, round_even(floor(p_retailprice) / 2, 0) AS value_land, CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS DOUBLE) END AS value_bldg, round(p_size / 7.0, 3) AS value_ratio FROM part""")
def q_filter_fields(s, d):
    """What filters read about each building."""
    size = F.col("p_size")
    return X.filter_fields(t(s, d, "part").select(
        F.col("p_partkey").alias("b_id"), F.when(size % 5 > 0, F.concat(F.lit(" "), "p_brand", F.lit(" "))).alias("local_area"), F.concat("p_type", F.lit("; ;"), "p_brand").alias("areas"), F.when(size % 4 > 0, F.col("p_type")).alias("owner_key"),
        F.when(size % 6 > 0, F.col("p_brand")).alias("network_key"), F.when(size % 8 == 0, "2024-01-01").alias("no_filing"), F.upper("p_name").alias("managed_by"), F.concat(F.lit("Rental, "), "p_type", F.lit(", ")).alias("housing_type"),
        (F.col("p_retailprice") / 7).alias("n_issues"), F.when(size % 3 == 0, "mixed").when(size % 3 == 2, "private").alias("owner_type"), F.lit("private; coop").alias("owner_parts"), F.when(size % 2 == 0, "trust").alias("owner_legal_forms"),
        F.when(size % 7 == 0, True).alias("owner_inferred"), F.when(size % 10 > 0, "market").alias("market"), (size + 0.5).alias("units"), F.when(size % 9 > 0, 1900 + size).alias("year_built"),
        (F.floor("p_retailprice") / 2).alias("value_land"), F.when(size % 3 > 0, size.cast("double")).otherwise(float("nan")).alias("value_bldg"), (size / 7).alias("bldg_land_ratio"),
    ))


@q("""SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 4 = 1 AND c_mktsegment = 'MACHINERY' THEN 'sro_rooms' WHEN c_custkey % 4 = 1 THEN 'licence_fee' ELSE 'inventory' END AS basis,
list_filter([['rental_inventory', 'licence', 'listing', NULL][c_custkey % 4 + 1], CASE WHEN c_mktsegment = 'MACHINERY' THEN 'sro_inventory' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'chf_bc' END, CASE WHEN c_acctbal > 5000 THEN 'rezoning' END], lambda x: x IS NOT NULL) AS listed FROM customer""")
def q_listed_in(s, d):
    """The basis of units and the sources that list a building."""
    k = F.col("c_custkey")
    source = F.get(F.array(*map(F.lit, ("rental inventory", "rental licence", "manager listing", "elsewhere"))), (k % 4).cast("int"))
    rows = t(s, d, "customer").select(k.alias("id"), F.when(k % 6 > 0, k).alias("units"), source.alias("building_source"), (F.col("c_mktsegment") == "MACHINERY").alias("is_sro"), F.when(F.col("c_mktsegment") == "BUILDING", True).alias("is_coop"), (F.col("c_acctbal") > 5000).alias("is_rezoning"))
    return rows.select("id", X.units_basis(F.col("units"), F.col("building_source"), F.col("is_sro")).alias("basis"), X.listed_in().alias("listed"))


_CORRECTIONS = "Alpha Hotel => owners: Alpha One; Alpha Two | manager: Chris\nBeta => owners: Beta Society"


@q("""WITH c AS (SELECT c_custkey AS id, [NULL, 'Alpha Hotel', 'Beta', 'Private', 'Gamma', 'Lookout Society'][c_custkey % 6 + 1] AS o, CASE WHEN c_custkey % 5 = 0 THEN 'Beta' WHEN c_custkey % 5 = 1 THEN 'Zeta' END AS p, c_custkey % 4 AS s FROM customer),
x AS (SELECT id, s, CASE o WHEN 'Alpha Hotel' THEN 'Alpha One' WHEN 'Beta' THEN 'Beta Society' WHEN 'Private' THEN NULL ELSE o END AS owner, CASE WHEN o = 'Alpha Hotel' THEN ['Alpha One', 'Alpha Two'] WHEN o = 'Beta' THEN ['Beta Society'] WHEN o IS NULL OR o = 'Private' THEN [] ELSE [o] END AS owners,
CASE p WHEN 'Beta' THEN 'Beta Society' WHEN 'Zeta' THEN 'Zeta' ELSE CASE WHEN o = 'Alpha Hotel' THEN 'Chris' END END AS operator FROM c)
SELECT id, owner AS inventory_owner, operator AS inventory_operator, array_to_string(owners, ',') AS inventory_owners, CASE WHEN owner IS NOT NULL AND s < 2 THEN replace(lower(owner), ' ', '-') WHEN s = 0 THEN 'unknown' ELSE 'held' END AS owner_key,
CASE WHEN owner IS NOT NULL AND s < 2 THEN 'sro_list' WHEN s = 1 THEN 'licence' WHEN s = 2 THEN 'registry' END AS owner_source, CASE WHEN owner IS NOT NULL AND s = 1 THEN replace(lower(owner), ' ', '-') ELSE 'group' END AS network_key FROM x""")
def q_corrected_inventory(s, d):
    """Published names corrected; owners filled in where no registry names one."""
    k = F.col("c_custkey")
    name = F.get(F.array(F.lit(None).cast("string"), *map(F.lit, ("Alpha Hotel", "Beta", " Private", "Gamma", "Lookout "))), (k % 6).cast("int"))
    rows = t(s, d, "customer").select(
        k.alias("id"), name.alias("inventory_owner"), F.when(k % 5 == 0, "Beta").when(k % 5 == 1, "Zeta").alias("inventory_operator"), F.lit("name").alias("owner_name"), F.when(k % 4 == 0, "unknown").otherwise("held").alias("owner_key"),
        F.when(k % 4 == 1, "licence").when(k % 4 == 2, "registry").alias("owner_source"), F.lit("group").alias("network_key"), F.lit("Group").alias("network_name"), F.when(k % 4 == 1, "licence").otherwise("claims").alias("network_source"),
    )
    out = X.corrected_inventory(rows, parse_corrections(s, _CORRECTIONS), {"Lookout": "Lookout Society"})
    return out.select("id", "inventory_owner", "inventory_operator", F.array_join("inventory_owners", ",").alias("inventory_owners"), "owner_key", "owner_source", "network_key")


@q("""SELECT concat(substr(x, 1, 3), '-', substr(x, 4, 3), '-', substr(x, 7, 3)) AS pid, concat('BCS', CAST(c_nationkey AS VARCHAR)) AS strata_plan, CASE WHEN c_acctbal > 0 THEN c_name END AS note FROM (SELECT *, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS x FROM customer)""")
def q_strata_lots(s, d):
    """Lots with numbers and plans written in any way."""
    pid = F.regexp_replace(F.lpad(F.col("c_custkey").cast("string"), 9, "0"), "^(...)", "PID $1 ")
    return X.strata_lots(t(s, d, "customer").select(F.col("c_custkey").alias("line"), pid.alias("pid"), F.concat(F.lit(" bcs "), F.col("c_nationkey")).alias("strata_plan"), F.when(F.col("c_acctbal") > 0, F.concat(F.lit(" "), "c_name")).otherwise(" ").alias("note")))


@q("""SELECT c_custkey AS id, concat(CAST(c_custkey AS VARCHAR), ['A E 6th Ave', ' McGill St', ' Saint-Jean Co-operative Way'][c_custkey % 3 + 1]) AS address, concat('&lt;', c_name, ' &amp; &quot;Co&#x27;s&quot;&gt;') AS html,
CASE WHEN c_custkey < 1000 THEN CAST(c_custkey AS VARCHAR) ELSE format('{:,}', c_custkey) END AS units,
[concat(c_name, ', B'), c_name, concat(CAST(c_custkey AS VARCHAR), ', 7'), '(Unknown)', concat('[', c_name, ', B]')][c_custkey % 5 + 1] AS owner, c_custkey % 2 = 0 AS same FROM customer""")
def q_displayed(s, d):
    """Addresses, markup, numbers and labels of owners as they are shown."""
    k, name = F.col("c_custkey"), F.col("c_name")
    pick = lambda n, *values: F.get(F.array(*(v if not isinstance(v, str) else F.lit(v) for v in values)), (k % n).cast("int"))
    owner = pick(5, F.concat(F.lit("['"), name, F.lit("', \"B\"]")), F.concat(F.lit("('"), name, F.lit("')")), F.concat(F.lit("("), k.cast("string"), F.lit(", 7)")), "[ ]", F.concat(F.lit("["), name, F.lit(", B]")))
    return t(s, d, "customer").select(
        k.alias("id"), address.display(F.concat(k.cast("string"), pick(3, "a  e 6th ave", " mcgill st", " saint-jean co-operative way"))).alias("address"), text.escaped_html(F.concat(F.lit("<"), name, F.lit(" & \"Co's\">"))).alias("html"),
        text.thousands(k).alias("units"), names.owner_label(owner).alias("owner"), text.same_name(F.upper(name), F.concat(F.lit(" "), F.replace(name, F.lit("#"), F.lit(". ")), F.when(k % 2 == 0, "").otherwise("x"))).alias("same"),
    )
