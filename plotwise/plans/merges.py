"""Releases, licences, projects, overlays and imported claims brought onto buildings, and the report on kinds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plotwise.operators import releases as X
from plotwise.operators.graph import ready
from plotwise.sources import sinks

from .base import Registry, t

q = Registry()
_txt = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@q("""WITH r AS (SELECT 0 AS rank, c_custkey AS pos, CASE WHEN c_custkey % 500 > 0 THEN concat(CAST(c_custkey % 1200 AS VARCHAR), ' Oak St') END AS address, CASE WHEN c_custkey % 7 = 0 THEN 'Given' WHEN c_custkey % 3 = 0 AND c_custkey % 500 > 0 THEN 'Mathew Court' END AS name, 'new' AS release FROM customer
UNION ALL SELECT 1, p_partkey, concat(CAST(p_partkey % 1900 AS VARCHAR), ' OAK STREET'), NULL, 'old' FROM part),
k AS (SELECT *, replace(lower(address), 'street', 'st') AS key, row_number() OVER (PARTITION BY replace(lower(address), 'street', 'st') ORDER BY rank, pos) AS n FROM r)
SELECT row_number() OVER (ORDER BY key NULLS FIRST) - 1 AS id, key, address, name, release FROM k WHERE n = 1""")
def q_merged_releases(s, d):
    """Two releases: the newer one has names behind some streets, lacks some addresses, and wins."""
    k, p = F.col("c_custkey"), F.col("p_partkey")
    told = F.when(k % 500 > 0, F.concat(_txt(k % 1200, " Oak  St"), F.when(k % 3 == 0, " Mathew Court").otherwise("")))
    new = t(s, d, "customer").select(F.lit(0).alias("rank"), k.alias("pos"), told.alias("address"), F.when(k % 7 == 0, "Given").alias("name"), F.lit("new").alias("release"))
    old = t(s, d, "part").select(F.lit(1).alias("rank"), p.alias("pos"), _txt(p % 1900, " OAK STREET").alias("address"), F.lit(None).cast("string").alias("name"), F.lit("old").alias("release"))
    return X.merged_releases(new.unionByName(old)).drop("rank")


def _index(s, d):
    k = F.col("c_custkey")
    return X.address_index(t(s, d, "customer").select(
        k.alias("building"), _txt(k % 1000, " oak st").alias("addr_key"), F.when(k % 5 > 0, _txt(k % 700, " Elm Avenue")).alias("address"), F.when(k % 2 == 0, _txt(k, " Pine Rd; ", k + 1, " Pine Road; ")).alias("secondary")
    ))


_INDEX = """each AS (SELECT c_custkey AS b, concat(CAST(c_custkey % 1000 AS VARCHAR), ' oak st') AS key FROM customer UNION ALL SELECT c_custkey, concat(CAST(c_custkey % 700 AS VARCHAR), ' elm ave') FROM customer WHERE c_custkey % 5 > 0
UNION ALL SELECT c_custkey, concat(CAST(c_custkey AS VARCHAR), ' pine rd') FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, concat(CAST(c_custkey + 1 AS VARCHAR), ' pine rd') FROM customer WHERE c_custkey % 2 = 0),
i AS (SELECT key, min(b) AS building FROM each GROUP BY key)"""


@q(f"""WITH {_INDEX} SELECT DISTINCT building, CASE o_orderpriority WHEN '1-URGENT' THEN 'Apartment house' ELSE 'Rooming house' END AS type FROM orders
JOIN i ON key = concat(CAST(o_custkey AS VARCHAR), CASE WHEN o_orderkey % 2 = 0 THEN ' elm ave' ELSE ' pine rd' END) WHERE o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT', '5-LOW')""")
def q_licence_types(s, d):
    """Licences of some kinds, unless cancelled, at any address that a building goes by."""
    street = F.when(F.col("o_orderkey") % 2 == 0, "Elm  Ave.").otherwise("PINE ROAD")
    rows = t(s, d, "orders").select(F.col("o_custkey").alias("house"), street.alias("street"), F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderstatus") == "P", "Cancelled").alias("status"))
    return X.licence_types(rows, _index(s, d), {"1-URGENT": "Apartment house", "5-LOW": "Rooming house"}, ("Cancelled",))


@q(f"""WITH {_INDEX}, p AS (SELECT building, p_partkey AS pos, p_brand AS op, CASE WHEN p_size % 3 = 0 THEN p_size ELSE 0 END AS f, CASE WHEN p_size % 3 > 0 THEN p_size ELSE 0 END AS s FROM part JOIN i ON key = concat(CAST(p_partkey % 1500 AS VARCHAR), ' pine rd') WHERE p_size % 4 > 0),
o AS (SELECT building, list(op ORDER BY pos) AS ops FROM (SELECT building, op, min(pos) AS pos FROM p GROUP BY 1, 2) GROUP BY 1)
SELECT p.building, CAST(sum(f) AS BIGINT) AS families, CAST(sum(s) AS BIGINT) AS seniors, sum(s) >= 0.8 * sum(f + s) AND sum(f + s) > 0 AS for_seniors, array_to_string(any_value(ops), ',') AS operators FROM p JOIN o USING (building) GROUP BY p.building""")
def q_non_market(s, d):
    """Completed projects at any address that a building goes by."""
    size, p = F.col("p_size"), F.col("p_partkey")
    rows = t(s, d, "part").select(
        p.alias("pos"), _txt(p % 1500, " Pine Road").alias("address"), _txt(" ", F.col("p_brand"), " ").alias("operator"), F.when(size % 4 > 0, "Completed").otherwise("Planned").alias("status"),
        F.when(size % 3 == 0, size).alias("families"), F.when(size % 3 > 0, size).alias("seniors"), F.lit(None).cast("int").alias("other"),
    )
    return X.non_market(rows, _index(s, d)).select("building", "families", "seniors", "for_seniors", F.array_join("operators", ",").alias("operators"))


@q("""SELECT c_custkey AS building, CAST(coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 40 END, CASE WHEN c_acctbal > 0 AND c_mktsegment = 'MACHINERY' THEN c_custkey % 11 END) AS BIGINT) AS units,
c_acctbal > 0 AND c_mktsegment = 'BUILDING' AS is_coop, c_acctbal > 0 AND c_mktsegment = 'MACHINERY' AS is_sro, CASE WHEN c_acctbal > 0 THEN CASE WHEN c_mktsegment = 'MACHINERY' THEN c_name END ELSE 'old' END AS sro_name FROM customer""")
def q_overlay_flags(s, d):
    """Flags replaced as a whole where a record matches; units only where they are not known."""
    k, c = F.col("c_custkey"), t(s, d, "customer")
    sro = F.col("c_mktsegment") == "MACHINERY"
    buildings = c.select(k.alias("building"), F.when(k % 3 > 0, k % 40).cast("bigint").alias("units"), F.lit(False).alias("is_coop"), F.lit(False).alias("is_sro"), F.lit("old").alias("sro_name"))
    matched = c.where("c_acctbal > 0").select(k.alias("building"), (k % 11).cast("bigint").alias("units"), (F.col("c_mktsegment") == "BUILDING").alias("is_coop"), sro.alias("is_sro"), F.when(sro, F.col("c_name")).alias("sro_name"))
    return X.with_overlays(buildings, matched, ["is_coop", "is_sro", "sro_name"])


@q("""SELECT concat('sro-', CAST(c_custkey AS VARCHAR)) AS synthetic_id, c_name AS name, false AS is_coop, true AS is_sro, CAST(NULL AS DOUBLE) AS lat, true AS dated FROM customer WHERE c_acctbal <= 0""")
def q_overlay_table(s, d):
    """Records without a building, stored twice: the second time replaces the first."""
    ready(s)
    folder = f"{s.sparkContext.getCheckpointDir()}/overlays-{uuid.uuid4().hex}"
    rows = t(s, d, "customer").where("c_acctbal <= 0").select(_txt("sro-", F.col("c_custkey")).alias("synthetic_id"), F.col("c_name").alias("name"), F.lit(True).alias("is_sro"))
    for _ in range(2):
        sinks.insert(X.overlay_rows(rows, {"synthetic_id": "string", "name": "string", "is_coop": "boolean", "is_sro": "boolean", "lat": "double"}), folder, replace=True)
    return s.read.parquet(folder).withColumn("dated", F.col("ingested_at").isNotNull()).drop("ingested_at")


@q("""WITH p AS (SELECT c_custkey AS k, c_custkey % 4 > 0 AS point, c_custkey % 3 = 0 AS filed, c_custkey % 5 = 0 AS grouped, c_custkey % 2 = 0 AS held FROM customer)
SELECT k AS id, CASE WHEN point AND filed THEN concat('T', CAST(k AS VARCHAR)) ELSE 'own' END AS owner, CASE WHEN point AND filed THEN 'registry' ELSE 'licence' END AS owner_source, CASE WHEN point AND filed THEN '2024-05-01' END AS retrieved,
CASE WHEN point AND NOT filed THEN CASE WHEN k % 7 = 0 THEN '2023-01-02' END ELSE 'before' END AS no_filing, CASE WHEN point AND grouped THEN concat('net:P', CAST(k % 9 AS VARCHAR)) ELSE 'own group' END AS network,
CASE WHEN point AND grouped THEN 'claims' ELSE 'licence' END AS network_source, CASE WHEN NOT point THEN 'H' WHEN held THEN concat('h', CAST(k AS VARCHAR)) ELSE '' END AS holders FROM p""")
def q_point_registry(s, d):
    """Registry layers for overlay points; buildings keep theirs."""
    k, c = F.col("c_custkey"), t(s, d, "customer")
    key = _txt(k, " oak st").alias("key")
    points = c.select(k.alias("id"), key, F.when(k % 4 > 0, "sro").otherwise("building").alias("source"), F.lit("own").alias("owner"), F.lit("licence").alias("owner_source"), F.lit(None).cast("string").alias("retrieved"),
                      F.lit("before").alias("no_filing"), F.lit("own group").alias("network"), F.lit("licence").alias("network_source"), F.array(F.lit("H")).alias("holders"))
    owners = c.where("c_custkey % 3 = 0").select(key, F.array(_txt("T", k), F.lit("second")).alias("owners"), F.lit("2024-05-01").alias("retrieved"))
    networks = c.where("c_custkey % 5 = 0").select(key, _txt("P", k % 9).alias("portfolio"))
    holders = c.where("c_custkey % 2 = 0").select(key, F.array(_txt("h", k)).alias("holders"))
    searched = c.where("c_custkey % 7 = 0").select(key, F.lit("2023-01-02").alias("searched_on"))
    return X.registry_on_points(points, owners, networks, holders, searched).drop("key", "source").withColumn("holders", F.array_join("holders", ","))


@q("""WITH s AS (SELECT c_custkey AS claim_id, concat('c', CAST(c_custkey AS VARCHAR)) AS claim_key, concat('Acme ', CAST(c_custkey % 50 AS VARCHAR)) AS a, concat('Owner ', CAST(c_custkey % 40 AS VARCHAR)) AS b FROM customer WHERE c_custkey % 2 = 0),
n AS (SELECT concat('c', CAST(o_custkey AS VARCHAR)) AS claim_key, max(o_orderkey) AS pos FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT claim_key, claim_id,
CASE WHEN pos IS NULL THEN a WHEN pos % 51 < 50 AND pos % 51 % 2 = 0 THEN concat('Acme ', CAST(pos % 51 AS VARCHAR)) ELSE concat('ACME-', CAST(pos % 51 AS VARCHAR)) END AS entity_a,
CASE WHEN pos IS NULL THEN b WHEN pos % 5 = 0 THEN 'owner 2' ELSE 'Owner 2' END AS entity_b, CASE WHEN pos % 5 = 0 THEN 'network_label' ELSE 'common_owner' END AS relationship,
CASE WHEN pos IS NULL THEN 'old note' WHEN pos % 2 = 0 THEN 'said' END AS source_note FROM s FULL JOIN n USING (claim_key)""")
def q_imported_claims(s, d):
    """An import over a stored log: known spellings win, of one key the last row counts, blank cells are null."""
    k, n = F.col("c_custkey"), F.col("o_orderkey")
    none = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
    stored = t(s, d, "customer").where("c_custkey % 2 = 0").select(
        k.cast("bigint").alias("claim_id"), _txt("c", k).alias("claim_key"), _txt("Acme ", k % 50).alias("entity_a"), _txt("Owner ", k % 40).alias("entity_b"), F.lit("common_owner").alias("relationship"), F.lit("research").alias("source_type"),
        F.lit("old note").alias("source_note"), *none(*X.OPTIONAL[1:]),
    )
    rows = t(s, d, "orders").where("o_orderkey % 3 = 0").select(
        n.alias("pos"), _txt(" c", F.col("o_custkey"), " ").alias("claim_key"), _txt("ACME-", n % 51).alias("entity_a"), F.lit("owner 2").alias("entity_b"), F.when(n % 5 == 0, "network_label").otherwise("common_owner").alias("relationship"),
        F.lit("research").alias("source_type"), F.when(n % 2 == 0, "said").otherwise("  ").alias("source_note"),
    )
    return X.imported_claims(stored, rows).select("claim_key", "claim_id", "entity_a", "entity_b", "relationship", "source_note")


@q("""WITH c AS (SELECT CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS a, CAST(c_nationkey AS VARCHAR) AS b, CAST(c_acctbal > 5000 AS VARCHAR) AS i, c_custkey % 40 AS units FROM customer)
SELECT 'owner_type' AS axis, a AS value, count(*) AS buildings, CAST(sum(units) AS BIGINT) AS units FROM c GROUP BY a UNION ALL SELECT 'scale', b, count(*), CAST(sum(units) AS BIGINT) FROM c GROUP BY b UNION ALL SELECT 'owner_inferred', i, count(*), CAST(sum(units) AS BIGINT) FROM c GROUP BY i""")
def q_axis_report(s, d):
    """Buildings and units by each value of three axes."""
    owner = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))
    rows = t(s, d, "customer").select(owner.alias("owner_type"), F.col("c_nationkey").alias("scale"), (F.col("c_acctbal") > 5000).alias("owner_inferred"), (F.col("c_custkey") % 40).cast("bigint").alias("units"))
    return X.axis_report(rows, ["owner_type", "scale", "owner_inferred"])


def _parties(s, d):
    """Lines as parties of an order: odd ones own, even ones hold a licence, some of which are somebody else's."""
    n, number = F.col("l_suppkey"), F.col("l_linenumber")
    kinds = F.get(F.array(*map(F.lit, ("company", "individual", "trust", ""))), (n % 4).cast("int"))
    pos = F.struct(number, "l_partkey", "l_suppkey", "l_extendedprice")
    return t(s, d, "lineitem").select(
        F.col("l_orderkey").alias("building"), pos.alias("pos"), _txt("s", n).alias("name"), _txt("k", n).alias("key"), F.when(number % 2 == 1, "owner").otherwise("licensee").alias("role"), kinds.alias("kind"),
        F.when(F.col("l_returnflag") == "R", "other").alias("same_as"), F.when(n % 10 == 0, "fund").alias("institutional"),
    )


_PARTIES = """p AS (SELECT l_orderkey AS building, (l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, concat('s', CAST(l_suppkey AS VARCHAR)) AS name, concat('k', CAST(l_suppkey AS VARCHAR)) AS key,
CASE WHEN l_linenumber % 2 = 1 THEN 'owner' ELSE 'licensee' END AS role, ['company', 'individual', 'trust', ''][l_suppkey % 4 + 1] AS kind, l_returnflag = 'R' AS same, CASE WHEN l_suppkey % 10 = 0 THEN 'fund' END AS institutional FROM lineitem)"""


@q(f"""WITH {_PARTIES} SELECT name, key, role, kind, institutional, count(*) AS buildings FROM p GROUP BY ALL""")
def q_entity_counts(s, d):
    return X.entity_counts(_parties(s, d))


@q(f"""WITH {_PARTIES}, o AS (SELECT building, list(DISTINCT kind ORDER BY kind) AS owners FROM p WHERE role = 'owner' AND kind <> '' GROUP BY 1),
l AS (SELECT building, arg_min(name, pos) AS licensee, arg_min(kind, pos) AS kind FROM p WHERE role = 'licensee' AND NOT same GROUP BY 1)
SELECT building, owners, licensee, kind FROM o JOIN l USING (building) WHERE kind <> '' AND NOT list_contains(owners, kind)""")
def q_kind_disagreements(s, d):
    return X.kind_disagreements(_parties(s, d))
