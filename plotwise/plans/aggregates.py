"""Aggregations, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotwise.functions import text as X
from plotwise.operators import dedupe, ranks
from plotwise.operators.histogram import Metric, histogram
from plotwise.plans.base import Registry, t

q = Registry()
LAST = "9223372036854775807"


@q("""
WITH j AS (SELECT o_custkey, o_orderpriority, o_totalprice, o_orderstatus, o_orderkey, max(l_quantity) AS qty
           FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
m AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM j GROUP BY o_custkey, o_orderpriority),
b AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM j)
SELECT j.o_custkey, any_value(m.o_orderpriority) AS priority, round(median(o_totalprice), 3) AS median_price, max(qty) AS max_qty,
       any_value(b.o_orderstatus) AS top_status, min(o_orderkey) AS first_order
FROM j JOIN m ON m.o_custkey = j.o_custkey AND m.r = 1 JOIN b ON b.o_custkey = j.o_custkey AND b.r = 1 GROUP BY j.o_custkey""")
def q_dedupe_merge(s, d):
    """One row a customer: commonest priority, median price, largest quantity, status of the dearest order."""
    items = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").alias("max_qty"))
    rows = t(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("top_status")).join(items, "o_orderkey")
    rows = rows.withColumns({"median_price": F.col("o_totalprice"), "first_order": F.col("o_orderkey")})
    out = dedupe.merged(rows, "o_custkey", "o_orderkey", modes=["priority"], medians=["median_price"], maxima=["max_qty"], firsts=["first_order"], companions=[("top_status", "o_totalprice")])
    return out.withColumn("median_price", F.round("median_price", 3))


@q("""SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance, row_number() OVER (ORDER BY count(*) DESC, min(c_custkey)) AS place
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def q_area_totals(s, d):
    """Customers and balance by nation; the most first, ties by first appearance."""
    out = t(s, d, "customer").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.min("c_custkey").alias("seen"))
    return ranks.numbered(out, [F.desc("n"), "seen"], "place").drop("seen")


@q("""SELECT p_brand, p_type AS commonest FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY p_brand, p_type) WHERE r = 1""")
def q_mode_tie(s, d):
    return t(s, d, "part").groupBy("p_brand").agg(dedupe.commonest("p_type").alias("commonest"))


@q("""SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem) GROUP BY l_orderkey""")
def q_distinct_sum(s, d):
    return t(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice").distinct().groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))


@q("""SELECT l_orderkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS ship, l_linenumber AS line FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1""")
def q_first_by_value(s, d):
    order = F.struct(-F.col("l_extendedprice"), "l_linenumber", "l_partkey")
    return t(s, d, "lineitem").groupBy("l_orderkey").agg(F.min_by(F.to_date("l_shipdate").cast("string"), order).alias("ship"), F.min_by("l_linenumber", order).alias("line"))


@q("""SELECT p_brand, string_agg(p_type, ';' ORDER BY p_type) AS types FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY p_brand""")
def q_string_agg(s, d):
    return t(s, d, "part").groupBy("p_brand").agg(dedupe.distinct_joined("p_type").alias("types"))


@q("""SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_f, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING bool_or(o_orderstatus = 'F') AND sum(o_totalprice) > 500000""")
def q_bool_having(s, d):
    out = t(s, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("any_f"), F.sum("o_totalprice").alias("total"))
    return out.where("any_f and total > 500000").withColumn("total", F.round("total", 2))


@q("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS paid FROM orders GROUP BY o_orderpriority""")
def q_conditional_counts(s, d):
    st = F.col("o_orderstatus")
    return t(s, d, "orders").groupBy("o_orderpriority").agg(*(F.count_if(st == x).alias(f"n_{x.lower()}") for x in "FOP"), F.round(F.sum(F.when(st == "F", F.col("o_totalprice")).otherwise(0.0)), 2).alias("paid"))


@q("""SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n_orders, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS spent,
CASE WHEN bool_or(o_orderstatus = 'F') OVER (PARTITION BY o_custkey) THEN round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) OVER (PARTITION BY o_custkey), 2) END AS paid FROM orders""")
def q_partition_totals(s, d):
    """Totals of the customer on each order; guarded ones are null where no order counts."""
    orders, f = t(s, d, "orders"), F.col("o_orderstatus") == "F"
    totals = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"), F.when(F.bool_or(f), F.round(F.sum(F.when(f, F.col("o_totalprice"))), 2)).alias("paid"))
    return orders.select("o_orderkey", "o_custkey").join(totals, F.col("o_custkey") == F.col("k"), "left").drop("k")


@q("""SELECT o_orderkey, CAST(round_even(100.0 * (rank() OVER (ORDER BY o_totalprice) - 1) / count(*) OVER (), 0) AS DOUBLE) AS percent FROM orders""")
def q_percent_below(s, d):
    return ranks.percent_below(t(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", F.col("percent").cast("double").alias("percent"))


@q("""SELECT l_partkey, l_suppkey AS supplier FROM (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, max(l_quantity) DESC, count(DISTINCT l_orderkey) DESC, l_suppkey) AS r FROM lineitem GROUP BY l_partkey, l_suppkey) WHERE r = 1""")
def q_contested(s, d):
    """The supplier that a part goes to: most lines, then quantity, then orders, then the smaller key."""
    from plotwise.operators.graph import contested

    reach = t(s, d, "lineitem").groupBy("l_partkey", F.col("l_suppkey").alias("supplier")).agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("qty"), F.count_distinct("l_orderkey").alias("orders"))
    return contested(reach, "l_partkey", "supplier", ["n", "qty", "orders"])


@q("""SELECT c_custkey, concat(n_name, '-', lpad(CAST(r AS VARCHAR), CAST(greatest(2, length(CAST(r AS VARCHAR))) AS INTEGER), '0')) AS label
FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) JOIN nation ON c_nationkey = n_nationkey""")
def q_ordinal_label(s, d):
    from plotwise.operators.spatial import area_labels

    blocks = t(s, d, "customer").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("block_id"), F.col("n_name").alias("area"), F.col("c_acctbal").alias("cy"), F.lit(0.0).alias("cx"))
    return area_labels(blocks).select(F.col("block_id").alias("c_custkey"), "label")


@q("""SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def q_keep_priority(s, d):
    st = F.col("o_orderstatus")
    rank = F.when(st == "P", 0).when(st == "O", 1).otherwise(2)
    return dedupe.keep_first(t(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], rank, F.desc("o_orderdate"), "o_orderkey").select("o_custkey", "o_orderkey")


@q("""SELECT p_partkey, p_name, p_size FROM part WHERE lower(p_name) LIKE '%r%' AND lower(p_name) LIKE '%bolt%' ORDER BY starts_with(lower(p_name), 'r') DESC, p_size DESC, p_name, p_partkey LIMIT 8""")
def q_topk_suggest(s, d):
    """Suggestions: all terms occur, prefixes first, the largest first, eight of them."""
    name = F.lower("p_name")
    return t(s, d, "part").where(X.holds_all(F.col("p_name"), "r bolt")).orderBy(name.startswith("r").desc(), F.desc("p_size"), "p_name", "p_partkey").select("p_partkey", "p_name", "p_size").limit(8)


@q("""SELECT c_custkey, v, row_number() OVER (ORDER BY v DESC NULLS LAST, c_name, c_custkey) AS place FROM (SELECT *, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v FROM customer)""")
def q_sort_nulls(s, d):
    rows = t(s, d, "customer").withColumn("v", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return ranks.numbered(rows.select("c_custkey", "c_name", "v"), [F.desc_nulls_last("v"), "c_name", "c_custkey"], "place").select("c_custkey", "v", "place")


@q("""SELECT c_mktsegment, n, row_number() OVER (ORDER BY c_mktsegment = 'MACHINERY', n DESC, c_mktsegment) AS place FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)""")
def q_pin_last(s, d):
    rows = t(s, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return ranks.numbered(rows.withColumn("pin", (F.col("c_mktsegment") == "MACHINERY").cast("int")), ["pin", F.desc("n"), "c_mktsegment"], "place").drop("pin")


@q("""SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment, 'customer' AS source FROM customer UNION ALL
SELECT s_suppkey + (SELECT max(c_custkey) FROM customer), s_nationkey, NULL, 'supplier' FROM supplier""")
def q_diag_union(s, d):
    """Suppliers below the customers: ids go on, missing columns are null."""
    customers = t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("source"))
    last = customers.agg(F.max("id").alias("last"))
    extra = t(s, d, "supplier").crossJoin(F.broadcast(last)).select((F.col("s_suppkey") + F.coalesce("last", F.lit(0))).alias("id"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("source"))  # one row
    return customers.unionByName(extra, allowMissingColumns=True)


@q("""SELECT c_nationkey AS nation FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier""")
def q_set_diff(s, d):
    return t(s, d, "customer").select(F.col("c_nationkey").alias("nation")).exceptAll(t(s, d, "supplier").select("s_nationkey"))


@q("""SELECT c_nationkey AS nation FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier ORDER BY 1""")
def q_sql_union(s, d):
    a = t(s, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("nation"))
    return a.union(t(s, d, "supplier").select("s_nationkey")).distinct().orderBy("nation")


@q("""SELECT 'customers' AS side, count(*) AS n FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'suppliers', count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer)""")
def q_snapshot_diff(s, d):
    from plotwise.sources.sinks import differences

    out = differences(t(s, d, "customer").select(F.col("c_nationkey").alias("nation")), t(s, d, "supplier").select(F.col("s_nationkey").alias("nation")))
    sides = s.createDataFrame([("first", "customers"), ("second", "suppliers")], "side string, name string")
    return sides.join(out.groupBy("side").agg(F.count(F.lit(1)).alias("n")), "side", "left").select(F.col("name").alias("side"), F.coalesce("n", F.lit(0)).alias("n"))


@q("""WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
c AS (SELECT least(CAST(floor((o_totalprice - lo) / (hi - lo) * 12) AS INT), 11) AS bin, count(*) AS n FROM orders, s GROUP BY 1)
SELECT b.bin, coalesce(c.n, 0) AS n, round(lo + (hi - lo) * b.bin / 12, 4) AS lower FROM (SELECT CAST(range AS INT) AS bin FROM range(12)) b LEFT JOIN c USING (bin), s""")
def q_hist_linear(s, d):
    values = t(s, d, "orders").select(F.lit("price").alias("metric"), F.col("o_totalprice").alias("value"))
    return histogram(values, [Metric("price", 12, log=False)]).select("bin", F.col("count").alias("n"), F.round("lower", 4).alias("lower"))


@q("""WITH s AS (SELECT ln(greatest(min(l_extendedprice), 2000.0)) AS lo0, ln(2000.0) AS lo, ln(max(l_extendedprice)) AS hi, min(l_extendedprice) AS mn FROM lineitem),
c AS (SELECT CASE WHEN l_extendedprice <= 2000 THEN 0 ELSE least(CAST(floor((ln(l_extendedprice) - lo) / (hi - lo) * 9) AS INT), 8) + 1 END AS bin, count(*) AS n FROM lineitem, s GROUP BY 1)
SELECT b.bin, coalesce(c.n, 0) AS n FROM (SELECT CAST(range AS INT) AS bin FROM range(10)) b LEFT JOIN c USING (bin)""")
def q_hist_log(s, d):
    values = t(s, d, "lineitem").select(F.lit("price").alias("metric"), F.col("l_extendedprice").alias("value"))
    return histogram(values, [Metric("price", 10, 2000.0, log=True)]).select("bin", F.col("count").alias("n"))


@q("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) AS p5, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(median(l_discount), 4) AS mid FROM lineitem GROUP BY l_returnflag""")
def q_percentiles(s, d):
    lines = t(s, d, "lineitem")
    price = ranks.quantiles(lines, "l_returnflag", "l_extendedprice", p5=0.05, p50=0.5, p95=0.95)
    out = price.join(ranks.quantiles(lines, "l_returnflag", "l_discount", mid=0.5), "l_returnflag")
    return out.select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("p5", "p50", "p95", "mid")))


@q("""SELECT g.p_brand, n, size, label, row_number() OVER (ORDER BY g.p_brand = 'Brand#1', size DESC, n DESC, g.p_brand) AS place FROM
(SELECT p_brand, count(p_name) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY 1) g JOIN
(SELECT p_brand, p_type AS label, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY p_brand, p_type) m ON m.p_brand = g.p_brand AND m.r = 1""")
def q_group_table(s, d):
    g = t(s, d, "part").groupBy("p_brand").agg(F.count("p_name").alias("n"), F.sum("p_size").alias("size"), dedupe.commonest("p_type").alias("label"))
    return ranks.numbered(g.withColumn("pin", (F.col("p_brand") == "Brand#1").cast("int")), ["pin", F.desc("size"), F.desc("n"), "p_brand"], "place").drop("pin")


@q("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END) AS BIGINT) AS dear, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL""")
def q_coverage(s, d):
    return t(s, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 150000).alias("dear"), F.count_distinct("o_custkey").alias("customers"))


@q("""SELECT c_nationkey, count(*) AS n, round(min(c_acctbal), 2) AS low, round(max(c_acctbal), 2) AS high, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1""")
def q_scalar_bounds(s, d):
    return t(s, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("c_acctbal"), 2).alias("low"), F.round(F.max("c_acctbal"), 2).alias("high"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@q("""WITH v AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT min(n) AS lo, max(n) AS hi FROM v)
SELECT k, n, CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor((n - lo) * 6.0 / (hi - lo)), 5) AS INT) END AS step FROM v, r""")
def q_choropleth(s, d):
    """Six steps between the least and the largest count."""
    v = t(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    r = v.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    out = v.crossJoin(F.broadcast(r))  # one row
    return out.select("k", "n", F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("n") - F.col("lo")) * 6.0 / (F.col("hi") - F.col("lo"))), F.lit(5))).cast("int").alias("step"))


@q("""SELECT 'nation' AS kind, CAST(c_nationkey AS VARCHAR) AS key, list(c_custkey ORDER BY c_custkey) AS members FROM customer GROUP BY 2 UNION ALL SELECT 'segment', c_mktsegment, list(c_custkey ORDER BY c_custkey) FROM customer GROUP BY 2""")
def q_inverted_index(s, d):
    keys = F.array(F.struct(F.lit("nation").alias("kind"), F.col("c_nationkey").cast("string").alias("key")), F.struct(F.lit("segment").alias("kind"), F.col("c_mktsegment").alias("key")))
    return t(s, d, "customer").select("c_custkey", F.explode(keys).alias("x")).groupBy("x.kind", "x.key").agg(F.array_sort(F.collect_set("c_custkey")).alias("members"))


@q("""SELECT a.area, count(c_custkey) AS n, CAST(coalesce(sum(c_acctbal > 5000), 0) AS BIGINT) AS rich FROM (SELECT unnest(['rich', 'poor', 'none']) AS area) a
LEFT JOIN (SELECT *, CASE WHEN c_acctbal > 5000 THEN 'rich' WHEN c_acctbal < 0 THEN 'poor' END AS tag FROM customer) c ON c.tag = a.area GROUP BY 1""")
def q_area_members(s, d):
    """Counts by membership in a list of areas, areas without members included."""
    from plotwise.functions.numeric import true_keys

    tags = true_keys({"rich": F.col("c_acctbal") > 5000, "poor": F.col("c_acctbal") < 0})
    areas = s.createDataFrame([("rich",), ("poor",), ("none",)], "area string")
    n = t(s, d, "customer").select("c_acctbal", F.explode(tags).alias("area")).groupBy("area").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 5000).alias("rich"))
    return areas.join(n, "area", "left").fillna(0, ["n", "rich"])


@q("""SELECT p_brand, p_container_first AS first_part, n FROM (SELECT p_brand, min(p_partkey) AS p_container_first, count(*) AS n FROM part GROUP BY 1)""")
def q_first_appearance(s, d):
    part = t(s, d, "part")
    return part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).join(dedupe.order_of_appearance(part, "p_brand", "p_partkey").withColumnRenamed("first", "first_part"), "p_brand")


@q("""SELECT o_custkey, list_slice(list(o_orderkey ORDER BY o_orderkey), 1, 3) AS examples, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS latest, count(*) AS n FROM orders GROUP BY 1""")
def q_examples(s, d):
    """Three examples a group beside counts and the latest date."""
    return t(s, d, "orders").groupBy("o_custkey").agg(F.slice(F.array_sort(F.collect_set("o_orderkey")), 1, 3).alias("examples"), F.to_date(F.max("o_orderdate")).cast("string").alias("latest"), F.count(F.lit(1)).alias("n"))


@q("""SELECT l_orderkey, list(l_suppkey ORDER BY seen, l_suppkey) AS suppliers FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS seen FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def q_ordered_distinct(s, d):
    """Distinct values in the order of their first appearance."""
    first = t(s, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("first"))
    return first.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("suppliers"))
