"""Queries over sources and tables that are written first: inferred types, nested contracts, stable keys, blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plotwise.operators import artifacts, blocks, claims, contract, graph, keys, networks, portfolios, simplify, spatial
from plotwise.operators.graph import ready
from plotwise.sources import files, pages, sinks

from .base import Registry, t
from .joins import _LABELS, _edges

q = Registry()


def _folder(s, name: str) -> str:
    ready(s)
    return f"{s.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@q("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 997 = 0 THEN 'BCS' || o_orderkey ELSE CAST(o_custkey AS VARCHAR) END AS code, o_totalprice AS price, o_orderstatus = 'O' AS open,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey % 50 END AS rooms, 'NA' AS note, o_orderpriority || '; "' || o_orderstatus || '"' AS remark, CAST(NULL AS VARCHAR) AS nothing,
  'bigint,string,double,boolean,bigint,string,string,string' AS kinds FROM orders""")
def q_csv_inferred(s, d):
    """Orders written as delimited files and read again with the types that all rows together have."""
    k, folder = F.col("o_orderkey"), _folder(s, "csv")
    rows = t(s, d, "orders").select(
        k.alias("id"), F.when(k % 997 == 0, F.concat(F.lit("BCS"), k.cast("string"))).otherwise(F.col("o_custkey").cast("string")).alias("code"), F.col("o_totalprice").alias("price"),
        (F.col("o_orderstatus") == "O").alias("open"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 50).alias("rooms"), F.lit("NA").alias("note"),
        F.concat("o_orderpriority", F.lit('; "'), "o_orderstatus", F.lit('"')).alias("remark"), F.lit(None).cast("string").alias("nothing"),
    )
    rows.write.csv(folder, sep=";", header=True, quote='"', escape='"', emptyValue="")
    out = files.read_inferred(s, folder)
    return out.withColumn("kinds", F.lit(",".join(kind for _, kind in out.dtypes)))


MODES = ("R", "A")
ORDER = contract.Group(
    {
        "id": contract.within("bigint", 0),
        "status": contract.one_of("O", "F"),
        "ordered": contract.matching(r"^\d{4}-\d{2}-\d{2}$"),
        "buyer": contract.Group({"name": contract.text(), "balance": contract.within("double", 0), "segment": contract.one_of("BUILDING", "MACHINERY", "HOUSEHOLD", optional=True)}),
        "lines": contract.Items(
            contract.Group({"part": contract.within("bigint"), "quantity": contract.within("double", 1, 45), "mark": contract.one_of(*MODES), "note": contract.text(optional=True), "rates": contract.Items(contract.within("double", 0, 0.07))})
        ),
    }
)
_JOINED = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
_ORDERS = f"(SELECT DISTINCT o_orderkey, o_orderstatus, c_acctbal, c_mktsegment FROM {_JOINED})"


@q(f"""SELECT rule, n FROM (
  SELECT 'status is not one of its values' AS rule, count(*) AS n FROM {_ORDERS} WHERE o_orderstatus NOT IN ('O', 'F')
  UNION ALL SELECT 'buyer.balance is out of range', count(*) FROM {_ORDERS} WHERE c_acctbal < 0
  UNION ALL SELECT 'buyer.segment is not one of its values', count(*) FROM {_ORDERS} WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
  UNION ALL SELECT 'lines[].quantity is out of range', count(*) FROM {_JOINED} WHERE l_quantity > 45
  UNION ALL SELECT 'lines[].mark is null', count(*) FROM {_JOINED} WHERE l_returnflag = 'A' AND l_linenumber = 1
  UNION ALL SELECT 'lines[].mark is not one of its values', count(*) FROM {_JOINED} WHERE l_returnflag = 'N'
  UNION ALL SELECT 'lines[].note is blank or a placeholder', count(*) FROM {_JOINED} WHERE l_linenumber IN (2, 3)
  UNION ALL SELECT 'lines[].rates[] is out of range', sum(CAST(l_discount > 0.07 AS INT) + CAST(l_tax > 0.07 AS INT)) FROM {_JOINED}) WHERE n > 0""")
def q_nested_checks(s, d):
    """Broken rules of orders with buyers and lists of lines, by path."""
    note = F.when(F.col("l_linenumber") == 2, "Unknown ").when(F.col("l_linenumber") == 3, " ").when(F.col("l_linenumber") == 4, "as is")
    line = F.struct(
        F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), F.when(~((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1)), F.col("l_returnflag")).alias("mark"),
        note.alias("note"), F.array("l_discount", "l_tax").alias("rates"),
    )
    lines = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(line).alias("lines"))
    buyers = t(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")).alias("buyer"))
    orders = t(s, d, "orders").join(buyers, "o_custkey").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered"), "buyer")
    return contract.nested_violations(orders.join(lines, "id"), ORDER)


@q("""WITH f AS (SELECT o_custkey, min(o_orderkey) FILTER (o_orderdate < TIMESTAMP '1996-01-01') AS early, min(o_orderkey) AS first FROM orders GROUP BY o_custkey)
  SELECT o_custkey, row_number() OVER (ORDER BY early IS NULL, coalesce(early, first), o_custkey) AS landlord_id FROM f""")
def q_stable_keys(s, d):
    """Numbers of buyers in order of appearance, given to those of the early orders first and kept when all orders come."""
    orders, register = t(s, d, "orders"), _folder(s, "register")
    keys.with_keys(orders.where("o_orderdate < timestamp '1996-01-01'"), "o_custkey", "o_orderkey", register, "landlord_id")
    out = keys.with_keys(orders, "o_custkey", "o_orderkey", register, "landlord_id")
    return out.select("o_custkey", "landlord_id").distinct()


_BOX = "(p_partkey % 40) * 250.0 - 1000 AS x0, floor(p_partkey / 40) * 90.0 AS y0"
_HOUSES = "(SELECT c_custkey AS id, c_acctbal AS x, (c_custkey * 7) % 4400 AS y, c_nationkey AS units, 1900 + c_custkey % 100 AS year, c_mktsegment AS area FROM customer)"
_POINTS = "(SELECT s_suppkey AS id, s_acctbal AS x, CAST((s_suppkey * 37) % 4400 AS DOUBLE) AS y, 'n' || s_nationkey AS area FROM supplier)"


@q(f"""WITH b AS (SELECT p_partkey AS block, {_BOX} FROM part), v AS (SELECT * FROM {_POINTS}),
  held AS (SELECT id, min(block) AS block, any_value(units) AS units, any_value(year) AS year, any_value(area) AS area FROM {_HOUSES} h JOIN b ON h.x BETWEEN x0 AND x0 + 250 AND h.y BETWEEN y0 AND y0 + 90 GROUP BY id),
  areas AS (SELECT block, area, count(*) AS n FROM held GROUP BY ALL), named AS (SELECT block, arg_min(area, (-n, area)) AS area FROM areas GROUP BY block),
  inside AS (SELECT block, area, count(*) AS n FROM (SELECT v.id, min(block) AS block, any_value(area) AS area FROM v JOIN b ON v.x BETWEEN x0 AND x0 + 250 AND v.y BETWEEN y0 AND y0 + 90 GROUP BY v.id) GROUP BY ALL),
  told AS (SELECT block, arg_min(area, (-n, area)) AS area FROM inside GROUP BY block),
  near AS (SELECT block, arg_min(area, (pow(x0 + 125 - x, 2) + pow(y0 + 45 - y, 2), id)) AS area FROM b, v WHERE block NOT IN (SELECT block FROM named) AND block NOT IN (SELECT block FROM told) GROUP BY block)
  SELECT b.block AS block_id, count(id) AS buildings, coalesce(sum(units), 0)::BIGINT AS total_units, median(year) AS median_year,
    coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id), '') AS building_ids, coalesce(any_value(named.area), any_value(told.area), any_value(near.area)) AS area
  FROM b LEFT JOIN held ON held.block = b.block LEFT JOIN named ON named.block = b.block LEFT JOIN told ON told.block = b.block LEFT JOIN near ON near.block = b.block GROUP BY b.block""")
def q_blocks(s, d):
    """Blocks with their buildings; areas from the buildings, from named points in the block, or from the nearest one."""
    x0, y0 = (F.col("p_partkey") % 40) * 250.0 - 1000, F.floor(F.col("p_partkey") / 40) * 90.0
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = F.array(corner(x0, y0), corner(x0 + 250, y0), corner(x0 + 250, y0 + 90), corner(x0, y0 + 90))
    boxes = t(s, d, "part").select(F.col("p_partkey").alias("polygon_id"), F.array(ring).cast(spatial.RINGS).alias("rings"))
    k, n = F.col("c_custkey"), F.col("s_suppkey")
    houses = t(s, d, "customer").select(
        k.alias("point_id"), F.col("c_acctbal").alias("x"), ((k * 7) % 4400).cast("double").alias("y"), F.col("c_nationkey").alias("units"), (1900 + k % 100).alias("year"), F.col("c_mktsegment").alias("area")
    )
    named = t(s, d, "supplier").select(n.alias("point_id"), F.col("s_acctbal").alias("x"), ((n * 37) % 4400).cast("double").alias("y"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("area"))
    out = blocks.with_areas(blocks.counted(boxes, houses, 250.0), named, 250.0)
    return out.select(F.col("polygon_id").alias("block_id"), "buildings", "total_units", "median_year", F.array_join(F.transform("building_ids", lambda x: x.cast("string")), ",").alias("building_ids"), "area")


@q("""SELECT p_partkey AS polygon_id, 4 AS corners, 250.0 * 90 AS area FROM part""")
def q_simplified(s, d):
    """A map of boxes with vertices every few units along shared borders; the corners are left, and the areas stay."""
    x0, y0 = (F.col("p_partkey") % 40) * 250.0, F.floor(F.col("p_partkey") / 40) * 90.0
    steps = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = F.concat(
        F.transform(steps(10), lambda k: corner(x0 + 25 * k, y0)), F.transform(steps(6), lambda k: corner(x0 + 250, y0 + 15 * k)),
        F.transform(steps(10), lambda k: corner(x0 + 250 - 25 * k, y0 + 90)), F.transform(steps(6), lambda k: corner(x0, y0 + 90 - 15 * k)),
    )
    boxes = t(s, d, "part").select(F.col("p_partkey").alias("polygon_id"), F.array(ring).cast(spatial.RINGS).alias("rings"))
    out = simplify.simplified_map(boxes, 0.5)
    edges = spatial.edges_of(F.col("rings"))
    area = F.abs(F.aggregate(edges, F.lit(0.0), lambda a, e: a + e["x1"] * e["y2"] - e["x2"] * e["y1"])) / 2
    return out.select("polygon_id", F.size(F.get("rings", F.lit(0))).alias("corners"), area.alias("area"))


@q("""SELECT * FROM (
  SELECT 'marker' AS kind, c_custkey AS id, CAST(round(c_acctbal / 100, 6) AS DOUBLE) AS x, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS name, CAST(trunc(c_acctbal) AS BIGINT) AS n FROM customer
  UNION ALL SELECT 'block', p_partkey, CAST((p_partkey % 40) * 2 + 2 AS DOUBLE), p_brand, p_size FROM part
  UNION ALL SELECT 'record', s_suppkey, s_acctbal, s_name, s_nationkey FROM supplier
  UNION ALL SELECT 'network', n_nationkey, CAST(NULL AS DOUBLE), n_name, n_regionkey FROM nation
  UNION ALL SELECT 'overlay', r_regionkey, r_regionkey + 1.0, r_name, NULL FROM region
  UNION ALL SELECT 'config', (SELECT count(*) FROM customer), NULL, 'totals', 6)""")
def q_artifacts(s, d):
    """The set of public files, written as single documents by many tasks, and read again."""
    folder = _folder(s, "artifacts")
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    box = lambda x, y, w: F.array(F.array(corner(x, y), corner(x + w, y), corner(x + w, y + w), corner(x, y + w))).cast(spatial.RINGS).alias("rings")
    c, p = t(s, d, "customer"), t(s, d, "part")
    nothing = F.lit(None).cast("string")
    markers = c.select(
        F.col("c_custkey").alias("b_id"), (F.col("c_acctbal") / 100).alias("lat"), F.lit(-123.1234567).alias("lon"), F.when(F.col("c_mktsegment") == "BUILDING", "unknown").otherwise(F.col("c_mktsegment")).alias("owner_key"),
        nothing.alias("network_key"), F.col("c_acctbal").alias("units"), F.lit(1965.0).alias("year_built"), F.lit(" ").alias("local_area"), nothing.alias("housing_type"), F.lit(0).alias("n_issues"), nothing.alias("source"),
    )
    blocks_ = p.select(F.col("p_partkey").alias("polygon_id"), box((F.col("p_partkey") % 40) * 2, F.floor(F.col("p_partkey") / 40) * 2, 2), F.col("p_brand").alias("local_area"), F.col("p_size").alias("buildings"))
    overlays = t(s, d, "region").select(F.col("r_regionkey").alias("polygon_id"), box(F.col("r_regionkey"), F.lit(0), 1), F.col("r_name").alias("name"))
    records = t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("value"), F.col("s_nationkey").alias("units"), F.lit(None).cast("string").alias("note"))
    networks = t(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("tier"))
    artifacts.export(folder, markers=markers, blocks=blocks_, overlays=overlays, records=records, networks=networks, config={"dataset_totals": {"buildings": c.count()}})
    read = lambda name, schema: s.read.schema(schema).json(f"{folder}/{name}", multiLine=True)
    row = lambda kind, id_, x, name, n: [F.lit(kind).alias("kind"), id_.cast("bigint").alias("id"), x.cast("double").alias("x"), name.alias("name"), n.cast("bigint").alias("n")]
    none, col = F.lit(None), F.col
    shape = "features array<struct<geometry:struct<coordinates:array<array<array<double>>>>,properties:struct<{}>>>"
    east = F.array_max(F.transform(F.get("f.geometry.coordinates", F.lit(0)), lambda v: F.get(v, F.lit(0))))
    out = read("marker_metadata.json", "markers array<struct<b_id:bigint,lat:double,owner_key:string,units:bigint>>").select(F.explode("markers").alias("m")).select(*row("marker", col("m.b_id"), col("m.lat"), col("m.owner_key"), col("m.units")))
    tiles = read("blocks.geojson", shape.format("local_area:string,buildings:bigint")).select(F.explode("features").alias("f"))
    south = F.array_min(F.transform(F.get("f.geometry.coordinates", F.lit(0)), lambda v: F.get(v, F.lit(1))))
    place = (south / 2).cast("bigint") * 40 + (east / 2 - 1).cast("bigint")
    out = out.union(tiles.select(*row("block", place, east, col("f.properties.local_area"), col("f.properties.buildings"))))
    keyed = read("building_records.json", "records map<string,struct<id:bigint,name:string,value:double,units:bigint>>").select(F.explode("records").alias("k", "v"))
    out = out.union(keyed.select(*row("record", col("k"), col("v.value"), col("v.name"), col("v.units"))))
    keyed = read("networks.json", "networks map<string,struct<id:bigint,name:string,tier:bigint>>").select(F.explode("networks").alias("k", "v"))
    out = out.union(keyed.select(*row("network", col("k"), none, col("v.name"), col("v.tier"))))
    areas = read("overlay_areas.geojson", shape.format("name:string")).select(F.explode("features").alias("f"))
    out = out.union(areas.select(*row("overlay", east - 1, east, col("f.properties.name"), none)))
    config = read("filter_config.json", "schema_version bigint, dataset_totals struct<buildings:bigint>")
    return out.union(config.select(*row("config", col("dataset_totals.buildings"), none, F.lit("totals"), col("schema_version"))))


_NOW = """SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS a, concat('g', CAST(c_custkey // 7 AS VARCHAR)) AS b FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_acctbal < 0)
  UNION SELECT concat('s', CAST(s_suppkey AS VARCHAR)), concat('g', CAST(s_suppkey * 3 // 4 AS VARCHAR)) FROM supplier UNION SELECT concat('g', CAST(s_nationkey AS VARCHAR)), concat('g', CAST(s_nationkey + 9 AS VARCHAR)) FROM supplier WHERE s_acctbal > 9000"""


@q(f"""WITH RECURSIVE e AS ({_NOW}), two AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, seen) AS (SELECT a, a FROM two UNION SELECT r.node, two.b FROM r JOIN two ON two.a = r.seen)
  SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def q_components_changed(s, d):
    """Components over two relations after claims were retracted and others confirmed: only what they touch is computed again."""
    before = _edges(s, d)
    gone = t(s, d, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal < 0").select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("g"), F.floor(F.col("c_custkey") / 7)).alias("b"))
    new = t(s, d, "supplier").where("s_acctbal > 9000").select(F.concat(F.lit("g"), "s_nationkey").alias("a"), F.concat(F.lit("g"), F.col("s_nationkey") + 9).alias("b"))
    now = before.join(gone, ["a", "b"], "left_anti").union(new)
    return graph.updated(graph.components(before), now, gone.union(new))


_REACH = _LABELS + """, m AS (SELECT component, s_suppkey FROM labels JOIN supplier ON node = concat('s', CAST(s_suppkey AS VARCHAR))),
  parcels AS (SELECT DISTINCT component, l_orderkey AS pid FROM m JOIN lineitem ON l_suppkey = s_suppkey WHERE l_linenumber = 1),
  bu AS (SELECT o_orderkey AS pid, o_custkey AS addr FROM orders WHERE o_orderstatus = 'F'), po AS (SELECT o_orderkey AS pid, o_custkey + 1 AS addr FROM orders WHERE o_orderpriority < '4'),
  rows AS (SELECT component, addr, pid, 'building' AS route, TRUE AS counts FROM parcels JOIN bu USING (pid) UNION ALL SELECT component, s_suppkey * 5, NULL, 'name', TRUE FROM m
    UNION ALL SELECT component, addr, pid, 'point', FALSE FROM parcels JOIN po USING (pid)),
  uncovered AS (SELECT component, addr FROM parcels JOIN po USING (pid) GROUP BY ALL HAVING NOT bool_or(pid IN (SELECT pid FROM bu))),
  found AS (SELECT component, addr, string_agg(DISTINCT route, ',' ORDER BY route) AS routes, count(DISTINCT pid) AS n_pids, bool_or(counts) OR (component, addr) IN (SELECT (component, addr) FROM uncovered) AS counted FROM rows GROUP BY component, addr),
  n AS (SELECT component, count(*) AS n_addr FROM found GROUP BY 1)"""


@q(_REACH + """ SELECT component, addr, routes, n_pids, counted, component = first_value(component) OVER (PARTITION BY addr ORDER BY n_pids DESC, n_addr DESC, component) AS held FROM found JOIN n USING (component)""")
def q_portfolio_routes(s, d):
    """What the suppliers of each component reach by titles, points and names, and which component holds it."""
    return _reach(s, d).withColumn("routes", F.array_join("routes", ","))


@q(_REACH + """ SELECT component, count(*) AS addresses, count(*) FILTER (counted) AS buildings, count(*) FILTER (held) AS held FROM
  (SELECT *, component = first_value(component) OVER (PARTITION BY addr ORDER BY n_pids DESC, n_addr DESC, component) AS held FROM found JOIN n USING (component)) GROUP BY component""")
def q_portfolio_sizes(s, d):
    return portfolios.sizes(_reach(s, d))


def _reach(s, d):
    labels = graph.components(_edges(s, d)).select(F.col("node").alias("entity"), "component")
    owner = F.concat(F.lit("s"), "l_suppkey").alias("entity")
    titles, orders = t(s, d, "lineitem").where("l_linenumber = 1").select(owner, F.col("l_orderkey").alias("pid")), t(s, d, "orders")
    buildings = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("pid"), F.col("o_custkey").alias("addr"))
    points = orders.where("o_orderpriority < '4'").select(F.col("o_orderkey").alias("pid"), (F.col("o_custkey") + 1).alias("addr"))
    named = t(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity"), (F.col("s_suppkey") * 5).alias("addr"))
    return portfolios.reached(labels, titles, buildings, points, named)


@q("""SELECT c_custkey AS id, c_mktsegment AS name, CAST(NULL AS VARCHAR) AS note, o.n AS orders FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def q_rebuilt_store(s, d):
    """Claims kept through two builds, the second of which knows one column more, beside a table that each build makes anew."""
    store = sinks.Store(s, _folder(s, "store"))
    claims = t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"))
    counts = lambda: t(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("orders"))
    store.rebuild({"counts": lambda: counts().where("orders > 3")}, {"claims": claims.schema})
    claims.write.mode("append").parquet(store.tables()["claims"])
    wider = claims.withColumn("note", F.lit(None).cast("string")).schema
    store.rebuild({"counts": counts}, {"claims": wider})
    return store.read("claims", wider).join(store.read("counts"), "id").select("id", "name", "note", "orders")


@q("""WITH f AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN upper(p_brand) || '.' ELSE p_brand END AS body, CASE WHEN l_suppkey % 9 = 0 THEN ' ' WHEN l_suppkey % 9 = 1 THEN lower(p_brand) ELSE 'S ' || (l_suppkey % 9) END AS holder,
    CAST(l_orderkey AS VARCHAR) AS pid, l_returnflag AS interest, CASE WHEN l_linestatus = 'F' THEN strftime(l_shipdate, '%Y-%m-%d 00:00') END AS dated FROM lineitem JOIN part ON p_partkey = l_partkey),
  g AS (SELECT *, replace(rtrim(lower(body), '.'), '#', '-') AS a, replace(lower(holder), ' ', '-') AS b FROM f WHERE trim(holder) <> '' AND rtrim(lower(body), '.') <> lower(holder))
  SELECT 'registry-' || a || '--' || b AS claim_key, count(DISTINCT pid) AS n_pids, array_to_string(list_slice(list(DISTINCT pid ORDER BY pid), 1, 3), ',') AS example_pids,
    string_agg(DISTINCT interest, ',' ORDER BY interest) AS interests, substr(max(dated), 1, 10) AS date_reported FROM g GROUP BY a, b""")
def q_derived_claims(s, d):
    """Claims from filings of bodies and holders, with counted parcels, three examples, interests and the latest date."""
    n, brand = F.col("l_suppkey") % 9, F.col("p_brand")
    rows = t(s, d, "lineitem").join(t(s, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(
        F.struct("l_orderkey", "l_linenumber").alias("ordinal"), F.col("l_orderkey").cast("string").alias("pid"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.upper(brand), F.lit("."))).otherwise(brand).alias("body"),
        F.when(n == 0, " ").when(n == 1, F.lower(brand)).otherwise(F.concat(F.lit("S "), n.cast("string"))).alias("holder"), F.col("l_returnflag").alias("interest"),
        F.when(F.col("l_linestatus") == "F", F.date_format("l_shipdate", "yyyy-MM-dd 00:00")).alias("dated"),
    )
    return claims.derived(rows).select("claim_key", "n_pids", F.array_join("example_pids", ",").alias("example_pids"), F.array_join("interests", ",").alias("interests"), "date_reported")


@q("""SELECT o_custkey % 23 AS network, count(*) AS buildings, sum(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 40 ELSE 0 END)::BIGINT AS units,
  CAST(round_even(sum(CASE WHEN o_orderstatus = 'O' AND o_custkey % 23 <> 5 THEN floor(o_totalprice) WHEN o_orderstatus = 'F' AND o_custkey % 23 <> 5 THEN 7 END), 0) AS BIGINT) AS assessed_value, count(*) FILTER (o_orderpriority < '3') AS open_issues FROM orders GROUP BY 1""")
def q_network_sums(s, d):
    """Totals of networks; one of them has no value on record."""
    k, valued = F.col("o_orderkey"), F.col("o_custkey") % 23 != 5
    rows = t(s, d, "orders").select(
        (F.col("o_custkey") % 23).alias("network"), F.when(k % 3 > 0, k % 40).alias("units"), F.when(valued & (F.col("o_orderstatus") == "O"), F.floor("o_totalprice")).alias("value_land"),
        F.when(valued & (F.col("o_orderstatus") == "F"), 7).alias("value_building"), F.when(F.col("o_orderpriority") < "3", 1).alias("n_issues"),
    )
    return networks.totals(rows)


_SPELLED = """s AS (SELECT p_size % 5 AS network, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN upper(p_brand) || '.' ELSE replace(p_brand, '#', ' ') END AS name, bool_or(p_partkey % 4 = 0) AS registered,
    min(CASE WHEN length(p_brand) = 7 THEN 'individual' WHEN p_brand LIKE '%1%' THEN 'company' ELSE 'unknown' END) AS kind FROM part GROUP BY ALL),
  e AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM s), c AS (SELECT *, CASE WHEN k IN ('brand1', 'brand2') THEN '=pair' ELSE k END AS entity FROM e),
  o AS (SELECT l_suppkey % 5 AS network, c.entity, count(DISTINCT l_orderkey * 10 + l_linenumber) AS buildings FROM lineitem JOIN part ON p_partkey = l_partkey JOIN c ON c.network = l_suppkey % 5 AND c.k = regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') GROUP BY ALL)"""


@q(f"""WITH {_SPELLED}, b AS (SELECT network, entity, arg_min(name, (NOT registered, name)) AS name, arg_min(kind, (NOT registered, name)) AS kind, list(name ORDER BY name) AS names FROM c GROUP BY ALL)
  SELECT b.network, name, array_to_string(list_filter(names, lambda x: x <> name), '|') AS also_named, nullif(kind, 'unknown') AS kind, coalesce(buildings, 0) AS buildings FROM b LEFT JOIN o ON o.network = b.network AND o.entity = b.entity""")
def q_network_entities(s, d):
    """Entities of networks under several spellings, two of them linked by a claim, with the buildings they own."""
    k, brand = F.col("p_partkey"), F.col("p_brand")
    name = F.when(k % 3 == 0, brand).when(k % 3 == 1, F.concat(F.upper(brand), F.lit("."))).otherwise(F.replace(brand, F.lit("#"), F.lit(" ")))
    kind = F.when(F.length(brand) == 7, "individual").when(brand.contains("1"), "company").otherwise("unknown")
    part = t(s, d, "part")
    spelled = part.select((F.col("p_size") % 5).alias("network"), name.alias("name"), (k % 4 == 0).alias("registered"), kind.alias("kind"))
    linked = spelled.select("name").distinct().where(networks.spelling_key(F.col("name")).isin("brand1", "brand2")).withColumn("cluster", F.lit("pair"))
    owners = t(s, d, "lineitem").join(part, F.col("l_partkey") == k).select((F.col("l_suppkey") % 5).alias("network"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("building"), brand.alias("owner"))
    return networks.entities(spelled, owners, linked).withColumn("also_named", F.array_join("also_named", "|"))


_TOLD = "CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 3 = 0 THEN 5 ELSE 6 END"
_LINKED = """(SELECT page_id, told, len(items) AS n, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS card FROM (SELECT page_id, """ + _TOLD + """ AS told, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS items FROM pages))"""


@q(f"""SELECT page_id, card, item AS href, NULL AS problem FROM {_LINKED} WHERE told = n UNION ALL
  SELECT page_id, NULL, NULL, CASE WHEN told IS NULL THEN 'tells no number' ELSE 'tells ' || told || ' cards, has ' || n END FROM (SELECT page_id, {_TOLD} AS told, len(regexp_extract_all(html, '<li>')) AS n FROM pages) WHERE told IS NULL OR told <> n""")
def q_reconciled_cards(s, d):
    """Cards of pages that have as many as they tell, and what is wrong with the other pages."""
    n = F.when(F.col("page_id") % 5 == 0, "").when(F.col("page_id") % 3 == 0, "<p>5 cards found</p>").otherwise("<p>6 cards found</p>")
    good, bad = pages.reconciled(t(s, d, "pages").select("page_id", F.concat("html", n).alias("html")), "<li>", r"<p>(\d+) cards found</p>", ("href",), href=r'<a href="([^"]*)">')
    none = F.lit(None)
    return good.select("page_id", "card", "href", none.cast("string").alias("problem")).union(bad.select("page_id", none.cast("int"), none.cast("string"), "problem"))
