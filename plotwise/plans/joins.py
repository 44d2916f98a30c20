"""Joins, matching, graphs, claims and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotwise.functions import address as A
from plotwise.functions import names as N
from plotwise.functions import numeric as M
from plotwise.functions import text as X
from plotwise.operators import claims, contract, dedupe, graph, lookup, matcher, ownership, ranks
from plotwise.plans.base import Registry, t

q = Registry()


@q("""SELECT o_orderkey, o_custkey, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'""")
def q_inner_fanout(s, d):
    orders = t(s, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    return orders.join(t(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity"), "o_orderkey")


@q("""SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0 LEFT JOIN region ON n_regionkey = r_regionkey""")
def q_left_dim(s, d):
    nation = t(s, d, "nation").where("n_nationkey % 2 = 0").join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t(s, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@q("""SELECT DISTINCT l.l_orderkey, l.l_partkey, p.n FROM lineitem l LEFT JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1, 2) p ON p.l_partkey = l.l_partkey AND p.l_suppkey = l.l_suppkey WHERE l.l_returnflag = 'R'""")
def q_composite_left(s, d):
    lines = t(s, d, "lineitem")
    n = lines.where("l_quantity > 40").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return lines.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_suppkey").join(n, ["l_partkey", "l_suppkey"], "left").select("l_orderkey", "l_partkey", "n").distinct()


@q("""WITH r AS (SELECT o_custkey AS k, o_orderkey AS v FROM orders WHERE o_orderstatus = 'P'), c AS (SELECT c_custkey AS k, c_custkey - c_custkey % 10 AS p FROM customer)
SELECT DISTINCT c.k, c.p, r.v FROM c JOIN r ON r.k = c.k UNION SELECT c.k, c.p, r.v FROM c LEFT JOIN r ON r.k = c.p WHERE c.k NOT IN (SELECT k FROM r)""")
def q_anti_fallback(s, d):
    """Own open orders, else those of the group's first customer."""
    rows = t(s, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") - F.col("c_custkey") % 10).alias("p"))
    records = t(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    return lookup.own_or_fallback(rows, records, "k", "p")


@q("""WITH a AS (SELECT c_nationkey AS k, count(*) AS n, max(c_acctbal) AS best FROM customer WHERE c_nationkey < 15 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n, max(s_acctbal) AS best FROM supplier WHERE s_nationkey > 8 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, b.n) AS n, coalesce(a.best, b.best) AS best, b.k IS NOT NULL AS listed FROM a FULL JOIN b ON a.k = b.k""")
def q_full_coalesce(s, d):
    a = t(s, d, "customer").where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("best"))
    b = t(s, d, "supplier").where("s_nationkey > 8").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n2"), F.max("s_acctbal").alias("best2"), F.lit(True).alias("listed"))
    return a.join(b, "k", "full").select("k", F.coalesce("n", "n2").alias("n"), F.coalesce("best", "best2").alias("best"), F.coalesce("listed", F.lit(False)).alias("listed"))


_EVENTS = """WITH g AS (SELECT user_id AS k, max(CASE WHEN event_type = 'click' THEN value END) AS a, max(CASE WHEN event_type = 'purchase' AND value > 90 THEN value END) AS b FROM events WHERE user_id % 3 < 2 GROUP BY 1),
u AS (SELECT DISTINCT user_id AS k, user_id - user_id % 3 AS p FROM events)"""


@q(_EVENTS + """ SELECT u.k, u.p, CASE WHEN coalesce(o.a, o.b) IS NOT NULL THEN o.a ELSE m.a END AS a, CASE WHEN coalesce(o.a, o.b) IS NOT NULL THEN o.b ELSE m.b END AS b FROM u LEFT JOIN g o ON o.k = u.k LEFT JOIN g m ON m.k = u.p""")
def q_block_fallback(s, d):
    rows, dim = _events(s, d)
    return lookup.block_fallback(rows, dim, "k", "k", "p")


@q(_EVENTS + """ SELECT u.k, u.p, coalesce(o.a, m.a) AS a, coalesce(o.b, m.b) AS b FROM u LEFT JOIN g o ON o.k = u.k LEFT JOIN g m ON m.k = u.p""")
def q_cell_fallback(s, d):
    rows, dim = _events(s, d)
    return lookup.cell_fallback(rows, dim, "k", "k", "p")


def _events(s, d):
    e = t(s, d, "events")
    kind, v = F.col("event_type"), F.col("value")
    dim = e.where("user_id % 3 < 2").groupBy(F.col("user_id").alias("k")).agg(F.max(F.when(kind == "click", v)).alias("a"), F.max(F.when((kind == "purchase") & (v > 90), v)).alias("b"))
    return e.select(F.col("user_id").alias("k"), (F.col("user_id") - F.col("user_id") % 3).alias("p")).distinct(), dim


@q("""WITH l AS (SELECT o_orderkey, o_custkey, CAST(round(o_totalprice) AS BIGINT) AS place FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT o_orderkey AS k, o_custkey, CAST(round(o_totalprice) AS BIGINT) AS place FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, k AS nearest FROM (SELECT l.o_orderkey, r.k, row_number() OVER (PARTITION BY l.o_orderkey ORDER BY abs(l.place - r.place), r.k) AS n FROM l LEFT JOIN r ON l.o_custkey = r.o_custkey) WHERE n = 1""")
def q_nearest_in_group(s, d):
    """The customer's open order nearest in price to each filled one."""
    rows = t(s, d, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice").cast("bigint").alias("place"), "o_orderstatus")
    out = lookup.nearest_in_group(rows.where("o_orderstatus = 'F'").drop("o_orderstatus"), rows.where("o_orderstatus = 'O'"), "o_custkey", "place", "place", "o_orderkey")
    return out.select("o_orderkey", F.col("nearest.ordinal").alias("nearest"))


@q("""SELECT p_partkey FROM part a WHERE EXISTS (SELECT 1 FROM part b WHERE a.p_brand = b.p_brand AND a.p_type = b.p_type AND abs(a.p_size - b.p_size) <= 2 AND a.p_partkey <> b.p_partkey)""")
def q_band_semi(s, d):
    part = t(s, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return lookup.in_band(part, part.select(*(F.col(c) for c in part.columns)), ["p_brand", "p_type"], "p_size", 2, same="p_partkey").select("p_partkey")


@q("""SELECT p_partkey FROM part a WHERE p_size > 5 AND NOT EXISTS (SELECT 1 FROM part b WHERE a.p_brand = b.p_brand AND abs(a.p_size - b.p_size) <= 0 AND a.p_partkey <> b.p_partkey)
AND p_partkey IN (SELECT l_partkey FROM lineitem) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)""")
def q_exists_chain(s, d):
    """One semi join and two anti joins in a row."""
    part, lines = t(s, d, "part"), t(s, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    kept = part.where("p_size > 5").join(lines.select("p_partkey"), "p_partkey", "left_semi").join(lines.where("l_quantity >= 50").select("p_partkey"), "p_partkey", "left_anti")
    return lookup.in_band(kept, part.select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size", 0, "left_anti", same="p_partkey").select("p_partkey")


@q("""SELECT c_mktsegment AS alias, min(c_nationkey) AS owner FROM (SELECT concat(c_mktsegment, '-', CAST(c_custkey % 700 AS VARCHAR)) AS c_mktsegment, c_nationkey FROM customer) GROUP BY 1 HAVING count(DISTINCT c_nationkey) = 1""")
def q_unique_alias(s, d):
    pairs = t(s, d, "customer").select(F.concat_ws("-", "c_mktsegment", (F.col("c_custkey") % 700).cast("string")).alias("alias"), F.col("c_nationkey").alias("owner"))
    return lookup.unique_owner(pairs, "alias", "owner")


_KNOWN = "SELECT DISTINCT concat(CAST(100 + p_partkey * 2 AS VARCHAR), ' ', split_part(p_name, ' ', 1), ' ', split_part(p_name, ' ', 2), ' ', CASE p_partkey % 3 WHEN 0 THEN 'st' WHEN 1 THEN 'ave' ELSE 'rd' END) AS key, p_partkey FROM part WHERE p_partkey % 10 < 6"


@q(f"""WITH k AS ({_KNOWN}), src AS (SELECT p_partkey, 100 + p_partkey * 2 AS civic, p_name, p_partkey % 10 AS m FROM part),
loose AS (SELECT regexp_replace(key, ' (st|ave|rd)$', '') AS lk, min(key) AS key FROM k GROUP BY 1 HAVING count(*) = 1)
SELECT s.p_partkey, coalesce(k.key, l.key, low.key, high.key, own.key) AS match, CASE WHEN k.key IS NOT NULL THEN CASE WHEN m = 3 THEN 'M2' ELSE 'M1' END WHEN l.key IS NOT NULL OR low.key IS NOT NULL OR high.key IS NOT NULL THEN 'M3' WHEN own.key IS NOT NULL THEN 'M4' END AS tier
FROM src s LEFT JOIN k ON k.p_partkey = s.p_partkey AND m < 4 LEFT JOIN loose l ON l.lk = concat(CAST(civic AS VARCHAR), ' ', p_name) AND m = 4
LEFT JOIN loose low ON low.lk = concat(CAST(civic - 2 AS VARCHAR), ' ', p_name) AND m = 5 LEFT JOIN loose high ON high.lk = concat(CAST(civic + 2 AS VARCHAR), ' ', p_name) AND m = 5 LEFT JOIN k own ON own.p_partkey = s.p_partkey AND m = 5""")
def q_tier_match(s, d):
    """Noisy spellings of part names as addresses against the keys of six in ten of them."""
    part = t(s, d, "part").select("p_partkey", "p_name", (F.col("p_partkey") * 2 + 100).cast("string").alias("civic"), (F.col("p_partkey") % 3).alias("k"), (F.col("p_partkey") % 10).alias("m"))
    kind = F.when(F.col("k") == 0, "st").when(F.col("k") == 1, "ave").otherwise("rd")
    word = F.when(F.col("k") == 0, "Street").when(F.col("k") == 1, "AVENUE").otherwise("Road")
    key = F.concat_ws(" ", "civic", "p_name", kind)
    noisy = (
        F.when(F.col("m") == 0, key).when(F.col("m") == 1, F.concat_ws("  ", "civic", F.upper("p_name"), word)).when(F.col("m") == 2, F.concat(F.lit("#7 - "), F.concat_ws(" ", "civic", "p_name", word)))
        .when(F.col("m") == 3, F.concat_ws(" ", "civic", "p_name", word, F.lit("Maple House"))).when(F.col("m") == 4, F.concat_ws(" ", "civic", "p_name", F.lit("blvd")))
        .when(F.col("m") == 5, F.concat_ws(" ", F.concat_ws(" - ", (F.col("civic") - 2).cast("bigint").cast("string"), (F.col("civic") + 2).cast("bigint").cast("string")), "p_name", word)).otherwise(F.concat(key, F.lit("*")))
    )
    out = matcher.matched(part.withColumn("source", noisy), part.where("m < 6").withColumn("key", key), "source", "key")
    return out.select("p_partkey", "match", "tier")


@q("""WITH c AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') SELECT o_custkey AS k, min(o_orderkey) AS v, 'matched' AS side FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c) GROUP BY 1 UNION ALL SELECT o_custkey, o_orderkey, 'unmatched' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM c)""")
def q_match_split(s, d):
    rows = t(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    hit, rest = matcher.split_matches(rows, "k", "v", t(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k")))
    return hit.withColumn("side", F.lit("matched")).unionByName(rest.withColumn("side", F.lit("unmatched")))


@q("""SELECT c_custkey, CASE WHEN v IS NOT NULL THEN v ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey""")
def q_apply_match(s, d):
    hits = t(s, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_mktsegment"))
    return lookup.applied(t(s, d, "customer").select("c_custkey", "c_mktsegment"), hits, "c_custkey", ["c_mktsegment"])


@q("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, concat('[', CAST(event_id AS VARCHAR), ',', CAST(user_id AS VARCHAR), ']') AS lineage, unnest([event_id, user_id]) AS item FROM events""")
def q_json_lineage(s, d):
    """JSON read, written, and exploded again."""
    rows = t(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.to_json(F.array("event_id", "user_id")).alias("lineage"))
    return rows.withColumn("item", F.explode(F.from_json("lineage", "array<bigint>")))


@q("""SELECT DISTINCT o_orderkey FROM orders WHERE substr(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), 1, 6) IN (SELECT substr(lpad(CAST(c_custkey AS VARCHAR), 8, '0'), 1, 6) FROM customer WHERE c_acctbal < -900)""")
def q_prefix_semi(s, d):
    prefix = lambda c: F.substring(X.padded(F.col(c).cast("string")), 1, 6)
    keys = t(s, d, "customer").where("c_acctbal < -900").select(F.explode(F.split(prefix("c_custkey"), ";")).alias("prefix")).distinct()
    return t(s, d, "orders").select("o_orderkey", prefix("o_custkey").alias("prefix")).join(keys, "prefix", "left_semi").select("o_orderkey").distinct()


@q("""SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_quantity > 45 UNION SELECT p_partkey, p_partkey % 100 FROM part WHERE p_size > 40 UNION SELECT l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'""")
def q_bridge(s, d):
    """Pairs reached by any of three routes."""
    lines = t(s, d, "lineitem")
    one = lines.where("l_quantity > 45").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    two = t(s, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") % 100).alias("b"))
    three = lines.join(t(s, d, "orders").where("o_orderstatus = 'P'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return one.union(two).union(three).distinct()


_FOLD = """SELECT user_id, event_type, value, CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen FROM
(SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC, event_id DESC) AS r, min(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS first_seen, max(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS last_seen FROM events) WHERE r = 1"""


@q(_FOLD)
def q_latest_snapshot(s, d):
    from plotwise.streaming.snapshots import fold

    rows = t(s, d, "events").withColumn("seen", F.to_date("ts").cast("string"))
    return fold(rows, ["user_id"], "seen", "event_id", ["event_type", "value"]).drop("event_id")


@q(_FOLD)
def q_stream_snapshot(s, d):
    """The same fold as a stream over files, which ends when all files are read."""
    import uuid

    from plotwise.operators.graph import ready
    from plotwise.streaming.snapshots import latest_version, stream_into

    ready(s)
    base = f"{s.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    batch = t(s, d, "events")
    stream = s.readStream.schema(batch.schema).format("parquet").option("pathGlobFilter", "events.parquet").load(d).withColumn("seen", F.to_date("ts").cast("string"))
    stream_into(stream, f"{base}/table", f"{base}/state", ["user_id"], "seen", "event_id", ["event_type", "value"]).awaitTermination()
    return latest_version(s, f"{base}/table").select("user_id", "event_type", "value", "first_seen", "last_seen")


@q("""SELECT user_id, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS latest FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type = 'purchase') GROUP BY 1""")
def q_unmatched_latest(s, d):
    """Latest view of users whose last event is no purchase."""
    e = t(s, d, "events")
    last = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind")).where("kind = 'purchase'")
    return e.where("event_type = 'view'").join(last, "user_id", "left_anti").groupBy("user_id").agg(F.to_date(F.max("ts")).cast("string").alias("latest"))


_EDGES = """SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS a, concat('g', CAST(c_custkey // 7 AS VARCHAR)) AS b FROM customer UNION SELECT concat('s', CAST(s_suppkey AS VARCHAR)), concat('g', CAST(s_suppkey * 3 // 4 AS VARCHAR)) FROM supplier"""
_LABELS = f"""WITH RECURSIVE e AS ({_EDGES}), two AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, seen) AS (SELECT a, a FROM two UNION SELECT r.node, two.b FROM r JOIN two ON two.a = r.seen),
labels AS (SELECT node, min(seen) AS component FROM r GROUP BY 1)"""


def _edges(s, d):
    """All customers and suppliers with the groups that they belong to."""
    customers = t(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("g"), F.floor(F.col("c_custkey") / 7)).alias("b"))
    suppliers = t(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat(F.lit("g"), F.floor(F.col("s_suppkey") * 3 / 4)).alias("b"))
    return customers.union(suppliers)


@q(_LABELS + " SELECT node, component FROM labels")
def q_components(s, d):
    return graph.components(_edges(s, d))


@q(_LABELS + " SELECT component, string_agg(node, ' / ' ORDER BY node) AS display FROM labels GROUP BY 1")
def q_shown_names(s, d):
    return graph.shown_names(graph.components(_edges(s, d)))


@q(_LABELS + " SELECT a.node, list(b.node ORDER BY b.node) AS others FROM labels a JOIN labels b ON a.component = b.component AND a.node <> b.node GROUP BY 1")
def q_group_others(s, d):
    return graph.others(graph.components(_edges(s, d)))


@q(_LABELS + """ SELECT component, count(DISTINCT l_orderkey) AS orders, round(sum(l_extendedprice), 2) AS value, count(DISTINCT node) AS suppliers FROM labels JOIN lineitem ON node = concat('s', CAST(l_suppkey AS VARCHAR)) GROUP BY 1""")
def q_portfolio_reach(s, d):
    """What the suppliers of each component reach."""
    labels = graph.components(_edges(s, d))
    lines = t(s, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("node"), "l_orderkey", "l_extendedprice")
    return labels.join(lines, "node").groupBy("component").agg(F.count_distinct("l_orderkey").alias("orders"), F.round(F.sum("l_extendedprice"), 2).alias("value"), F.count_distinct("node").alias("suppliers"))


@q("""SELECT key, role, turns, words, spelling FROM (SELECT conv_id AS key, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS r FROM conversations) JOIN
(SELECT conv_id AS k2, count(*) AS turns, CAST(max(length(text)) AS INTEGER) AS words FROM conversations GROUP BY 1) ON k2 = key JOIN (SELECT conv_id AS k3, role AS spelling, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r3 FROM conversations) ON k3 = key AND r3 = 1 WHERE r = 1""")
def q_claims_latest(s, d):
    """The last state of each key, with counts and the first spelling."""
    rows = t(s, d, "conversations").select(F.col("conv_id").alias("claim_key"), "role", F.col("turn").alias("updated_at"), F.col("text").alias("claim_id"))
    last = claims.latest(rows).select(F.col("claim_key").alias("key"), "role")
    counts = rows.groupBy(F.col("claim_key").alias("key")).agg(F.count(F.lit(1)).alias("turns"), F.max(F.length("claim_id")).alias("words"))
    first = claims.spellings(rows.withColumn("seq", F.struct("updated_at", "claim_id")), "role", "claim_key", "seq").withColumnRenamed("claim_key", "key")
    return last.join(counts, "key").join(first, "key")


@q("""WITH old AS (SELECT c_custkey AS claim_key, c_custkey AS claim_id, 'old' AS status, c_nationkey AS v FROM customer WHERE c_custkey % 2 = 0), new AS (SELECT c_custkey AS claim_key, -1 AS claim_id, 'new' AS status, c_nationkey + 100 AS v FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(o.claim_key, n.claim_key) AS claim_key, CAST(coalesce(o.claim_id, n.claim_id) AS BIGINT) AS claim_id, coalesce(n.status, o.status) AS status, coalesce(n.v, o.v) AS v FROM old o FULL JOIN new n USING (claim_key)""")
def q_claim_upsert(s, d):
    c = t(s, d, "customer")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("claim_key"), F.col("c_custkey").alias("claim_id"), F.lit("old").alias("status"), F.col("c_nationkey").alias("v"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("claim_key"), F.lit(-1).cast("bigint").alias("claim_id"), F.lit("new").alias("status"), (F.col("c_nationkey") + 100).alias("v"))
    return claims.upserted(old, new)


_FIRST, _LAST = ["Harbour", "Maple", "City of Vancouver", "Jane", "Hill", "123456"], ["Holdings Ltd", "Housing Society", "Trust", "Doe", "Co-op", "B.C. Ltd"]


@q("""WITH n AS (SELECT p_partkey, concat(['Harbour','Maple','City of Vancouver','Jane','Hill','123456'][p_partkey % 6 + 1], ' ', ['Holdings Ltd','Housing Society','Trust','Doe','Co-op','B.C. Ltd'][p_size % 6 + 1]) AS name FROM part)
SELECT p_partkey, name, CASE WHEN name LIKE 'City of%' THEN 'government' WHEN name LIKE '%Co-op' THEN 'coop' WHEN name LIKE '123456 B.C. Ltd' THEN 'numbered_company' WHEN name LIKE '%Ltd' THEN 'company' WHEN name LIKE '%Society' THEN 'non_profit'
WHEN name LIKE '%Trust' THEN 'trust' WHEN name LIKE '123456%' THEN 'unknown' ELSE 'individual' END AS kind, CASE WHEN n >= 10 THEN 'large' WHEN n >= 2 THEN 'small' ELSE 'single' END AS scale FROM n JOIN (SELECT name AS nm, count(*) AS n FROM n GROUP BY 1) ON nm = name""")
def q_rule_classify(s, d):
    pick = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (k % 6 + 1).cast("int"))
    n = t(s, d, "part").select("p_partkey", F.concat_ws(" ", pick(_FIRST, F.col("p_partkey")), pick(_LAST, F.col("p_size"))).alias("name"))
    counts = n.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return n.join(counts, "name").select("p_partkey", "name", N.kind_of_name(F.col("name")).alias("kind"), M.scale(F.col("n")).alias("scale"))


@q("""WITH b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN concat('reg ', CAST(o_custkey % 7 AS VARCHAR)) END AS reg, CASE WHEN o_orderkey % 3 > 0 THEN concat('lic ', CAST(o_custkey % 4 AS VARCHAR)) END AS lic,
CASE WHEN o_orderkey % 11 = 0 THEN concat('c', CAST(o_custkey % 3 AS VARCHAR)) END AS net, coalesce(o_custkey % 4 = 1 AND o_orderkey % 3 > 0, false) AS mgr, CASE WHEN o_orderkey % 2 = 0 THEN 'lister' END AS lst, CASE WHEN o_orderkey % 13 = 0 THEN 'inv' END AS inv FROM orders),
p1 AS (SELECT *, coalesce(reg, lic, 'unknown') AS o, CASE WHEN reg IS NOT NULL THEN 'registry' WHEN lic IS NOT NULL THEN 'licence' END AS os, coalesce(concat_ws('', 'net:', net), lic, 'unknown') AS w0, CASE WHEN net IS NOT NULL THEN concat('net:', net) ELSE coalesce(lic, 'unknown') END AS w, CASE WHEN net IS NOT NULL THEN 'claims' WHEN lic IS NOT NULL THEN 'licence' END AS ws FROM b),
p2 AS (SELECT * EXCLUDE (o, os, w, ws), CASE WHEN mgr AND os = 'licence' THEN 'unknown' ELSE o END AS o, CASE WHEN mgr AND os = 'licence' THEN NULL ELSE os END AS os, CASE WHEN mgr AND ws = 'licence' THEN CASE WHEN os = 'licence' THEN 'unknown' ELSE o END ELSE w END AS w, CASE WHEN mgr AND ws = 'licence' THEN NULL ELSE ws END AS ws, CASE WHEN mgr THEN lic ELSE lst END AS m FROM p1),
p3 AS (SELECT * EXCLUDE (o, os, w, ws), CASE WHEN inv IS NOT NULL AND (o = 'unknown' OR os = 'licence') THEN inv ELSE o END AS o, CASE WHEN inv IS NOT NULL AND (o = 'unknown' OR os = 'licence') THEN 'inventory' ELSE os END AS os, CASE WHEN inv IS NOT NULL AND (w = 'unknown' OR ws = 'licence') THEN inv ELSE w END AS w, CASE WHEN inv IS NOT NULL AND (w = 'unknown' OR ws = 'licence') THEN 'inventory' ELSE ws END AS ws FROM p2),
p4 AS (SELECT * EXCLUDE (w), CASE WHEN os = 'registry' AND ws = 'licence' THEN o ELSE w END AS w FROM p3)
SELECT id, o AS owner, os AS owner_source, CASE WHEN o <> 'unknown' AND w = 'unknown' THEN o ELSE w END AS network, m AS managed_by FROM p4""")
def q_pass_pipeline(s, d):
    """Ownership passes over orders that stand for buildings."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = t(s, d, "orders").select(
        k.alias("id"), F.when(k % 5 == 0, F.concat(F.lit("reg "), c % 7)).alias("registry_owner"), F.when(k % 3 > 0, F.concat(F.lit("lic "), c % 4)).alias("licence_owner"), F.when(k % 11 == 0, F.concat(F.lit("c"), c % 3)).alias("claimed_network"),
        ((c % 4 == 1) & (k % 3 > 0)).alias("is_manager"), F.when(k % 2 == 0, "lister").alias("listing_manager"), F.when(k % 13 == 0, "inv").alias("inventory_owner"),
    )
    return ownership.passes(rows).select("id", "owner", "owner_source", "network", "managed_by")


@q("""SELECT l_orderkey, list(concat(role, ':', CAST(name AS VARCHAR)) ORDER BY role, name) AS parties, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT l_orderkey, 'owner' AS role, l_suppkey AS name FROM lineitem UNION SELECT DISTINCT l_orderkey, 'tenant', l_partkey FROM lineitem WHERE l_quantity > 30) GROUP BY 1""")
def q_parties(s, d):
    """Roles of several sources in one sorted list without repeats."""
    lines = t(s, d, "lineitem")
    owners = lines.select("l_orderkey", F.lit("owner").alias("role"), F.col("l_suppkey").alias("name"))
    tenants = lines.where("l_quantity > 30").select("l_orderkey", F.lit("tenant").alias("role"), F.col("l_partkey").alias("name"))
    sets = owners.unionByName(tenants).groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct("role", "name"))).alias("x"))
    return sets.select("l_orderkey", F.transform("x", lambda p: F.concat_ws(":", p["role"], p["name"].cast("string"))).alias("parties"), F.size("x").cast("bigint").alias("n"))


@q("""SELECT s_suppkey, n, companions FROM (SELECT l_suppkey AS s_suppkey, count(*) AS n, list(DISTINCT l_partkey ORDER BY l_partkey) AS companions FROM lineitem GROUP BY 1)""")
def q_network_totals(s, d):
    return t(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("l_partkey")).alias("companions"))
