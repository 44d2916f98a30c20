"""Registry, listings and names, on tables that stand for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotwise.operators import registry as R
from plotwise.plans.base import Registry, t

q = Registry()


@q("""WITH f AS (SELECT l_partkey AS pid, l_suppkey AS key, concat('s', CAST(l_suppkey AS VARCHAR), 'x') AS name, l_orderkey % 500 AS building FROM lineitem),
g AS (SELECT building, key, count(DISTINCT pid) AS pids FROM f GROUP BY 1, 2)
SELECT building, list(concat(CAST(key AS VARCHAR), ':', CAST(pids AS VARCHAR)) ORDER BY pids DESC, concat('s', CAST(key AS VARCHAR), 'x')) AS bodies FROM g GROUP BY 1""")
def q_registry_owners(s, d):
    lines = t(s, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("key"), (F.col("l_orderkey") % 500).alias("building"))
    pid = F.concat_ws("-", "building", "key", "part")  # a parcel of its own for each filing
    filings = lines.select(pid.alias("pid"), "key", F.concat(F.lit("s"), F.col("key"), F.lit("x")).alias("name"), F.lit("2024-01-01").alias("filed_on"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("withheld"))
    out = R.owners(R.shown(filings), lines.select(pid.alias("pid"), "building").distinct())
    return out.select("building", F.transform("bodies", lambda b: F.concat_ws(":", b["key"], b["pids"])).alias("bodies"))


@q("""WITH l AS (SELECT user_id AS pid, user_id % 40 AS building, arg_max(CASE WHEN event_type = 'purchase' THEN 'filed' ELSE 'no_filing' END, (CAST(CAST(ts AS DATE) AS VARCHAR), CASE WHEN event_type = 'purchase' THEN 'filed' ELSE 'no_filing' END)) AS result, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS d FROM events GROUP BY 1, 2)
SELECT building, max(d) AS searched_on FROM l WHERE result = 'no_filing' AND building NOT IN (SELECT building FROM l WHERE result = 'filed') GROUP BY 1""")
def q_no_filings(s, d):
    e = t(s, d, "events")
    searches = e.select(F.col("user_id").alias("pid"), F.when(F.col("event_type") == "purchase", "filed").otherwise("no_filing").alias("result"), F.to_date("ts").cast("string").alias("searched_on"))
    return R.no_filings(searches, e.select(F.col("user_id").alias("pid"), (F.col("user_id") % 40).alias("building")).distinct())


@q("""SELECT c_nationkey AS building, list(concat(substr(x, 1, 3), '-', substr(x, 4, 3), '-', substr(x, 7, 3)) ORDER BY x) AS pids FROM (SELECT DISTINCT c_nationkey, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS x FROM customer) GROUP BY 1""")
def q_parcels(s, d):
    return R.parcels(t(s, d, "customer").select(F.col("c_nationkey").alias("building"), F.col("c_custkey").cast("string").alias("pid")))


@q("""SELECT p_brand AS building, CAST(sum(CASE WHEN p_size % 3 = 0 THEN p_size ELSE 0 END) AS BIGINT) AS families, CAST(sum(CASE WHEN p_size % 3 > 0 THEN p_size ELSE 0 END) AS BIGINT) AS seniors,
sum(CASE WHEN p_size % 3 > 0 THEN p_size ELSE 0 END) >= 0.8 * sum(p_size) AS for_seniors, count(DISTINCT p_type) AS n_operators FROM part GROUP BY 1""")
def q_clientele(s, d):
    size = F.col("p_size")
    rows = t(s, d, "part").select(F.col("p_brand").alias("building"), F.col("p_partkey").alias("pos"), F.col("p_type").alias("operator"), F.when(size % 3 == 0, size).alias("families"), F.when(size % 3 > 0, size).alias("seniors"), F.lit(None).cast("int").alias("other"))
    return R.clientele(rows).select("building", "families", "seniors", "for_seniors", F.size("operators").cast("bigint").alias("n_operators"))


@q("""WITH f AS (SELECT p_brand AS building, regexp_replace(p_name, '[^a-z]', '', 'g') AS k, min((p_size, p_partkey, p_name)) AS x FROM part GROUP BY 1, 2) SELECT building, list(k ORDER BY x)[1] AS name, count(*) - 1 AS n FROM f GROUP BY 1""")
def q_picked_names(s, d):
    rows = t(s, d, "part").select(F.col("p_brand").alias("building"), F.col("p_size").alias("rank"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"))
    return R.picked_names(rows).select("building", F.regexp_replace("name", "[^a-z]", "").alias("name"), F.size("alternates").cast("bigint").alias("n"))


@q("""SELECT c_custkey % 300 AS key, bool_or(c_mktsegment = 'BUILDING') AS is_coop, bool_or(c_mktsegment = 'MACHINERY') AS is_sro, arg_min(c_name, c_custkey) AS name, count(*) AS n FROM customer GROUP BY 1 HAVING max(CASE WHEN c_acctbal > 3000 THEN 1 ELSE 0 END) = 1""")
def q_merged_extras(s, d):
    known = F.when(F.col("c_acctbal") > 3000, F.col("c_acctbal"))
    rows = t(s, d, "customer").select((F.col("c_custkey") % 300).alias("key"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"), (F.col("c_mktsegment") == "BUILDING").alias("is_coop"), (F.col("c_mktsegment") == "MACHINERY").alias("is_sro"), known.alias("lat"), known.alias("lon"), F.lit("customer").alias("source"), F.col("c_custkey").alias("id"))
    return R.merged_extras(rows).select("key", "is_coop", "is_sro", "name", F.size("lineage").cast("bigint").alias("n"))


@q("""WITH b AS (SELECT c_custkey AS id, c_name AS address, c_custkey % 1000 AS pid FROM customer), u AS (SELECT pid, min(id) AS id FROM b GROUP BY 1 HAVING count(*) = 1)
SELECT o_orderkey AS ask, coalesce(b.id, u.id) AS id FROM orders LEFT JOIN b ON b.address = CASE WHEN o_orderkey % 2 = 0 THEN concat('Customer#', lpad(CAST(o_custkey AS VARCHAR), 9, '0')) ELSE 'nowhere' END LEFT JOIN u ON u.pid = o_custkey % 1000""")
def q_deep_link(s, d):
    buildings = t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("address"), F.array(F.col("c_custkey") % 1000).alias("pids"))
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).otherwise("nowhere")
    return R.deep_link(buildings, t(s, d, "orders").select(F.col("o_orderkey").alias("ask"), name.alias("address"), (F.col("o_custkey") % 1000).alias("pid")))


@q("""WITH r AS (SELECT p_brand AS owner, p_type AS l FROM part), n AS (SELECT 'owner' AS kind, p_brand AS key, p_type AS l FROM part UNION ALL SELECT 'network', p_type, p_brand FROM part UNION ALL SELECT 'manager', p_name, p_type FROM part WHERE p_size > 25)
SELECT kind, key, l AS label, n FROM (SELECT kind, key, l, row_number() OVER (PARTITION BY kind, key ORDER BY count(*) DESC, l) AS r, CAST(sum(count(*)) OVER (PARTITION BY kind, key) AS BIGINT) AS n FROM n GROUP BY kind, key, l) WHERE r = 1""")
def q_suggestions(s, d):
    rows = t(s, d, "part").select(F.col("p_brand").alias("owner"), F.col("p_type").alias("owner_label"), F.col("p_type").alias("network"), F.col("p_brand").alias("network_label"), F.when(F.col("p_size") > 25, F.col("p_name")).alias("manager"), F.col("p_type").alias("manager_label"))
    return R.suggestions(rows)


@q("""SELECT count(*) AS n, CAST(coalesce(sum(label), 0) AS BIGINT) AS units FROM embeddings WHERE CAST(embedding[1] AS DOUBLE) BETWEEN -0.1 AND 0.1 AND CAST(embedding[2] AS DOUBLE) BETWEEN 0 AND 0.2""")
def q_in_view(s, d):
    rows = t(s, d, "embeddings").select(F.get("embedding", F.lit(0)).cast("double").alias("lat"), F.get("embedding", F.lit(1)).cast("double").alias("lon"), F.col("label").alias("units"))
    return R.in_view(rows, -0.1, 0.0, 0.1, 0.2)
