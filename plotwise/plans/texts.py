"""Scalars, text keys, geometry, facets, pages and nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotwise.functions import address as A
from plotwise.functions import names as N
from plotwise.functions import numeric as M
from plotwise.functions import text as X
from plotwise.operators import contract, facets, fees, ownership, spatial
from plotwise.plans.base import Registry, t
from plotwise.sources import pages, sinks

q = Registry()


@q("""SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS owner_key, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS alnum, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS match FROM customer""")
def q_name_key(s, d):
    return t(s, d, "customer").select("c_custkey", N.owner_key(F.col("c_name"), ascii_only=True).alias("owner_key"), X.alnum_key(F.col("c_name")).alias("alnum"), N.match_key(F.col("c_name")).alias("match"))


@q("""SELECT p_partkey, concat(CAST(p_partkey + 1 AS VARCHAR), ' ', p_name, CASE p_partkey % 4 WHEN 0 THEN ' st' WHEN 1 THEN ' ave' WHEN 2 THEN ' blvd' ELSE ' ct' END) AS key, concat(CAST(p_partkey + 1 AS VARCHAR), ' ', p_name, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '' ELSE '' END) AS loose FROM part""")
def q_text_norm(s, d):
    """Long forms, points and stars of part names written as addresses."""
    k = F.col("p_partkey") % 4
    kind = F.when(k == 0, "Street").when(k == 1, "Av.").when(k == 2, "BOULEVARD*").otherwise("crt")
    rows = t(s, d, "part").select("p_partkey", F.concat_ws("  ", (F.col("p_partkey") + 1).cast("string"), F.upper("p_name"), kind).alias("raw"))
    rows = rows.withColumn("key", A.address_key(F.col("raw")))
    return rows.select("p_partkey", "key", A.loose_key(F.col("key")).alias("loose"))


@q("""SELECT c_custkey, c_acctbal AS money, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS bare, concat(substr(lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 1, 3), '-', substr(lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 4, 3), '-', substr(lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 7, 3)) AS pid,
CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS lossy FROM customer""")
def q_money_parse(s, d):
    """Money and identifiers as text, and back."""
    rows = t(s, d, "customer").select("c_custkey", "c_acctbal", F.concat(F.lit(" $"), F.format_number("c_acctbal", 2)).alias("text"))
    return rows.select(
        "c_custkey", X.money(F.col("text")).alias("money"), X.digits(X.dashed(F.col("c_custkey").cast("string"))).alias("bare"), X.dashed(F.col("c_custkey").cast("string")).alias("pid"),
        X.number(F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))).alias("lossy"),
    )


@q("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE o_orderstatus END AS a, CASE WHEN o_orderstatus = 'F' THEN o_orderstatus ELSE o_orderpriority END AS b, CASE WHEN o_totalprice > 300000 AND o_orderstatus = 'O' THEN 'both' WHEN o_totalprice > 300000 THEN 'dear' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'none' END AS label FROM orders""")
def q_masked_assign(s, d):
    """Two columns change places where the mask is true: both see the frame as it was."""
    rows = t(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"), "o_totalprice", "o_orderstatus")
    out = ownership.assign_where(rows, F.col("a") == "F", a=F.col("b"), b=F.col("a"))
    dear, is_open = F.col("o_totalprice") > 300000, F.col("o_orderstatus") == "O"
    return out.select("o_orderkey", "a", "b", F.when(dear & is_open, "both").when(dear, "dear").when(is_open, "open").otherwise("none").alias("label"))


@q("""SELECT doc_id, CASE WHEN lower(source) IN ('src0', 'src1') THEN NULL ELSE source END AS source, CASE WHEN doc_id % 3 > 0 THEN lang END AS lang, CASE WHEN doc_id % 5 = 0 THEN '2024-03-01' END AS day FROM documents""")
def q_sentinel_null(s, d):
    k = F.col("doc_id")
    spelled = F.when(k % 3 == 0, F.lit(" (Unknown) ")).otherwise(F.col("lang"))
    dated = F.when(k % 5 == 0, "2024-03-01T10:00:00").otherwise("soon")
    return t(s, d, "documents").select("doc_id", X.without_placeholders(F.col("source"), ("src0", "src1")).alias("source"), X.sentinel_to_null(spelled).alias("lang"), X.date_prefix(dated).alias("day"))


@q("""SELECT page_id, url, CASE WHEN starts_with(lower(url), 'https://') THEN url END AS safe FROM pages WHERE regexp_matches(lower(url), '^https?://')""")
def q_web_urls(s, d):
    return t(s, d, "pages").select("page_id", X.web_url(F.col("url")).alias("url")).where("url is not null").withColumn("safe", F.when(F.lower("url").startswith("https://"), F.col("url")))


@q("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round(CASE WHEN l_tax + l_discount > 0 THEN l_tax / (l_tax + l_discount) END, 6) AS share, round(CASE WHEN l_discount <> 0 THEN l_tax / l_discount END, 6) AS ratio, round(ln(1 + least(l_quantity, 600.0)), 6) AS radius FROM lineitem""")
def q_share_ratio(s, d):
    share, ratio = M.land_share(F.col("l_tax"), F.col("l_discount")), M.building_ratio(F.lit(None).cast("double"), F.col("l_discount"), F.col("l_tax"))
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.round(share, 6).alias("share"), F.round(ratio, 6).alias("ratio"), F.round(M.marker_radius(F.col("l_quantity")), 6).alias("radius"))


@q("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS INTEGER) AS n_links, list_extract(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS first_link FROM pages""")
def q_html_extract(s, d):
    links = pages.links(F.col("html"))
    return t(s, d, "pages").select("page_id", pages.title(F.col("html")).alias("title"), F.size(links).alias("n_links"), F.try_element_at(links, F.lit(1)).alias("first_link"))


@q("""SELECT page_id, CAST(page_id AS VARCHAR) || ' Main St' AS street, CAST(page_id AS DOUBLE) / 100 AS lat, CAST(page_id % 50 AS INTEGER) AS units FROM pages""")
def q_jsonld(s, d):
    """JSON-LD written into each page and read again."""
    k = F.col("page_id")
    ld = F.concat(
        F.lit('<script type="application/ld+json">{"name":"x"}</script><script type="application/ld+json">'),
        F.to_json(F.struct(F.struct(F.concat(k, F.lit(" Main St")).alias("streetAddress")).alias("address"), F.struct((k / 100).alias("latitude"), F.lit(1).alias("longitude")).alias("geo"), (k % 50).alias("numberOfAccommodationUnits"))), F.lit("</script>"),
    )
    rows = t(s, d, "pages").select("page_id", pages.property_of(F.concat("html", ld)).alias("p"))
    return rows.select("page_id", "p.street", "p.lat", "p.units")


@q("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS filled, CASE WHEN o_orderstatus = 'O' THEN 'open' END AS open_state, CAST(round_even(o_totalprice, 0) AS DOUBLE) AS price, CASE WHEN o_orderstatus = 'F' THEN ['status', 'price'] ELSE ['price'] END AS listed FROM orders""")
def q_nested_contract(s, d):
    """Optional structs, flattened again; lists of true flags."""
    filled = F.col("o_orderstatus") == "F"
    rows = t(s, d, "orders").select(
        "o_orderkey", contract.when_any(filled, price=F.col("o_totalprice")).alias("sale"), contract.when_any(F.col("o_orderstatus") == "O", state=F.lit("open")).alias("pending"),
        X.half_even(F.col("o_totalprice")).alias("price"), M.true_keys({"status": filled, "price": F.col("o_totalprice") > 0}).alias("listed"),
    )
    return rows.select("o_orderkey", F.col("sale.price").alias("filled"), F.col("pending.state").alias("open_state"), "price", "listed")


@q("""SELECT 'c_acctbal is out of range' AS rule, count(*) AS n FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0 UNION ALL SELECT 'c_mktsegment is not one of its values', count(*) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') HAVING count(*) > 0""")
def q_violations(s, d):
    return contract.violations(t(s, d, "customer"), required=["c_custkey"], enums={"c_mktsegment": ("BUILDING", "MACHINERY")}, ranges={"c_acctbal": (0, 1e9)})


@q("""SELECT CAST(to_json(struct_pack(c_custkey := c_custkey, c_name := c_name, balance := CASE WHEN c_acctbal > 0 THEN c_acctbal END, place := struct_pack(nation := c_nationkey))) AS VARCHAR) AS json FROM customer""")
def q_export_json(s, d):
    return contract.records(t(s, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.struct(F.col("c_nationkey").alias("nation")).alias("place")))


@q("""SELECT concat(CAST(n_nationkey AS VARCHAR), ',', chr(34), n_name, ', ', chr(34), chr(34), 'the nation', chr(34), chr(34), chr(34), ',', CAST(n_regionkey AS VARCHAR)) AS line FROM nation""")
def q_csv_lines(s, d):
    return sinks.csv_lines(t(s, d, "nation").select("n_nationkey", F.concat("n_name", F.lit(', "the nation"')).alias("name"), "n_regionkey"))


@q("""SELECT p_partkey, CAST(p_size * 98 AS DOUBLE) AS fee, DATE '2026-01-01' AS issued, false AS non_profit, 'rate' AS reading, p_size AS dwellings, 0 AS housekeeping, 0 AS sleeping, 0 AS pool, true AS certain FROM part""")
def q_fee_decode(s, d):
    """Fees made from part sizes, read back as dwellings."""
    licences = t(s, d, "part").select("p_partkey", (F.col("p_size") * fees.DWELLING).cast("double").alias("fee"), F.to_date(F.lit("2026-01-01")).alias("issued"), F.lit(False).alias("non_profit"))
    return fees.decode_fees(licences)


_POLYGONS = "(VALUES (1, [0.0, 0.0, 0.1, 0.1]), (2, [-0.2, -0.1, 0.05, 0.2]), (3, [-0.3, -0.3, -0.05, 0.0])) AS p(polygon_id, b)"


def _points(s, d):
    e = t(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("point_id"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


def _boxes(s):
    rows = [(1, 0.0, 0.0, 0.1, 0.1), (2, -0.2, -0.1, 0.05, 0.2), (3, -0.3, -0.3, -0.05, 0.0)]
    return s.createDataFrame([(k, [[(a, b), (c, b), (c, e), (a, e)]]) for k, a, b, c, e in rows], f"polygon_id int, rings {spatial.RINGS}")


@q(f"""SELECT vec_id AS point_id, min(polygon_id) AS polygon_id FROM embeddings LEFT JOIN {_POLYGONS} ON CAST(embedding[1] AS DOUBLE) BETWEEN b[1] AND b[3] AND CAST(embedding[2] AS DOUBLE) BETWEEN b[2] AND b[4] GROUP BY 1""")
def q_pip(s, d):
    return spatial.assigned(_points(s, d), _boxes(s), 0.1).select("point_id", "polygon_id")


@q(f"""SELECT vec_id AS point_id, bool_or(polygon_id IS NOT NULL) AS inside FROM embeddings LEFT JOIN {_POLYGONS} ON CAST(embedding[1] AS DOUBLE) BETWEEN b[1] AND b[3] AND CAST(embedding[2] AS DOUBLE) BETWEEN b[2] AND b[4] GROUP BY 1""")
def q_point_flags(s, d):
    return spatial.flagged(_points(s, d), _boxes(s), 0.1).select("point_id", "inside")


@q("""SELECT a.vec_id AS point_id, arg_min(b.vec_id, (pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.vec_id)) AS target_id FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings WHERE vec_id % 2 = 0) a, (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings WHERE vec_id % 2 = 1) b GROUP BY 1""")
def q_nearest_point(s, d):
    p = _points(s, d)
    targets = p.where("point_id % 2 = 1").select(F.col("point_id").alias("target_id"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    return spatial.nearest(p.where("point_id % 2 = 0"), targets, 0.02).select("point_id", "target_id")


@q("""SELECT label, round(min(CAST(embedding[1] AS DOUBLE)), 6) AS west, round(max(CAST(embedding[1] AS DOUBLE)), 6) AS east, round(min(CAST(embedding[2] AS DOUBLE)), 6) AS south, round(max(CAST(embedding[2] AS DOUBLE)), 6) AS north FROM embeddings GROUP BY 1""")
def q_bounds(s, d):
    x, y = (F.get("embedding", F.lit(k)).cast("double") for k in (0, 1))
    return t(s, d, "embeddings").groupBy("label").agg(F.round(F.min(x), 6).alias("west"), F.round(F.max(x), 6).alias("east"), F.round(F.min(y), 6).alias("south"), F.round(F.max(y), 6).alias("north"))


def _box_of(x0, y0, x1, y1):
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))).cast(spatial.RINGS)


@q("SELECT p_partkey AS polygon_id, p_partkey + p_size / 2.0 AS cx, CAST(p_size AS DOUBLE) AS cy FROM part")
def q_centroids(s, d):
    """Centroids of boxes as wide as the part's size and twice as high."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = t(s, d, "part").select(k.alias("polygon_id"), _box_of(k, F.lit(0), k + size, 2 * size).alias("rings"))
    cx, cy = spatial.centroid(F.get("rings", F.lit(0)))
    return rows.select("polygon_id", F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"))


@q("""SELECT DISTINCT s_suppkey AS polygon_id FROM supplier JOIN nation ON s_suppkey % 300 <= n_nationkey * 10 + 4.5 AND s_suppkey % 300 + 2 >= n_nationkey * 10 + 0.5 AND s_suppkey % 11 <= 5.5 AND s_suppkey % 11 + 1 >= 0.5""")
def q_polygon_meet(s, d):
    """Suppliers' boxes that meet a nation's."""
    k, x, y = F.col("s_suppkey"), F.col("s_suppkey") % 300, F.col("s_suppkey") % 11
    rows = t(s, d, "supplier").select(k.alias("polygon_id"), _box_of(x, y, x + 2, y + 1).alias("rings"))
    n = F.col("n_nationkey")
    nations = t(s, d, "nation").select(n.alias("polygon_id"), _box_of(n * 10 + 0.5, F.lit(0.5), n * 10 + 4.5, F.lit(5.5)).alias("rings"))
    return spatial.intersecting(rows, nations, 10.0).select("polygon_id").distinct()


def _facet_rows(s, d):
    p = t(s, d, "part")
    return p.select(
        "p_partkey", F.col("p_brand").alias("area"), F.array(F.concat(F.lit("z"), (F.col("p_partkey") % 3).cast("string"))).alias("areas"), F.col("p_type").alias("owner"), F.lit(None).cast("string").alias("network"), F.lit(None).cast("string").alias("manager"),
        F.array("p_type").alias("housing"), F.array(F.when(F.col("p_size") > 20, "private").otherwise("coop")).alias("owner_types"), F.array(F.when(F.col("p_size") > 35, "company").otherwise("trust")).alias("legal_forms"), (F.col("p_partkey") % 4 == 0).alias("inferred"),
        F.when(F.col("p_size") > 10, "market").alias("market"), (F.col("p_partkey") % 5).alias("n_issues"), F.col("p_size").alias("units"), F.lit(True).alias("has_owner"), F.col("p_size").cast("double").alias("size"), F.when(F.col("p_partkey") % 6 > 0, F.col("p_retailprice")).alias("price"),
    )


_FACETS = """WITH r AS (SELECT *, CASE WHEN p_partkey % 6 > 0 THEN p_retailprice END AS price FROM part WHERE (p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') OR p_partkey % 3 = 1) AND p_partkey % 5 > 0
AND (p_size <= 20 OR (p_size > 20 AND p_size > 35)) AND p_partkey % 4 <> 0)"""
_CHOSEN = dict(areas=["Brand#1", "Brand#2", "Brand#3"], special_areas=["z1"], only_issues=True, owner_types=["coop", "private"], legal_forms=["company"], with_inferred=False, ranges={"size": (5, 40), "price": (None, 1000)})


@q(_FACETS + " SELECT p_partkey FROM r WHERE p_size BETWEEN 5 AND 40 AND (price IS NULL OR price <= 1000)")
def q_facet_filter(s, d):
    return facets.visible(_facet_rows(s, d), facets.Filters(**_CHOSEN)).select("p_partkey")


@q(_FACETS + """ SELECT metric, bin, count(*) FILTER (ok) AS count FROM (SELECT 'size' AS metric, CASE WHEN p_size < 25 THEN 0 ELSE 1 END AS bin, price IS NULL OR price <= 1000 AS ok FROM r UNION ALL SELECT 'price', CASE WHEN price < 1000 THEN 0 ELSE 1 END, p_size BETWEEN 5 AND 40 FROM r WHERE price IS NOT NULL) GROUP BY 1, 2""")
def q_faceted_hist(s, d):
    bins = {"size": [(0, 25), (25, 60)], "price": [(0, 1000), (1000, 1e9)]}
    return facets.faceted_bars(_facet_rows(s, d), facets.Filters(**_CHOSEN), bins)


@q("""SELECT c_custkey AS block FROM customer WHERE c_mktsegment = 'BUILDING' AND (c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) OR c_custkey NOT IN (SELECT o_custkey FROM orders))""")
def q_member_visibility(s, d):
    orders = t(s, d, "orders").select(F.col("o_custkey").alias("block"), F.col("o_orderkey").alias("member"), "o_totalprice")
    blocks = t(s, d, "customer").select(F.col("c_custkey").alias("block"), F.col("c_mktsegment").alias("area"))
    return facets.visible_blocks(blocks, orders.select("block", "member"), orders.where("o_totalprice > 400000"), ["BUILDING"], True).select("block")


@q("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 AND p_partkey % 2 = 0 THEN 'mixed' WHEN p_partkey % 2 = 0 THEN 'private' WHEN p_size % 4 = 0 THEN 'government' WHEN p_size % 3 = 0 THEN 'coop' END AS owner,
CASE WHEN p_size % 3 = 0 THEN 'non_market' WHEN p_size % 4 = 0 AND p_partkey % 2 = 1 THEN 'non_market' WHEN p_partkey % 2 = 0 AND p_size % 4 > 0 THEN 'market' END AS market FROM part""")
def q_owner_axes(s, d):
    size, k, none = F.col("p_size"), F.col("p_partkey"), F.lit(None).cast("string")
    titles = F.when(k % 2 == 0, F.array(F.lit("company"))).otherwise(F.array().cast("array<string>"))
    owner = ownership.owner_axis(titles, size % 4 == 0, size % 3 == 0, none, F.lit(False), none, none)
    market = ownership.market_axis(F.lit(False), size % 3 == 0, F.lit(False), F.col("o"), none)
    return t(s, d, "part").withColumn("o", owner).select("p_partkey", F.col("o.value").alias("owner"), market.alias("market"))


@q("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, 2000 + CAST(year(o_orderdate) % 100 AS INTEGER) AS year, CASE WHEN o_totalprice / 500000 <= 0.1 THEN 0 WHEN o_totalprice / 500000 <= 0.25 THEN 1 WHEN o_totalprice / 500000 <= 0.5 THEN 2 WHEN o_totalprice / 500000 <= 0.75 THEN 3 WHEN o_totalprice / 500000 <= 1 THEN 4 ELSE 5 END AS bucket FROM orders""")
def q_dates_buckets(s, d):
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return t(s, d, "orders").select("o_orderkey", M.date_part(text).alias("day"), M.full_year((F.year(M.utc_time(text)) % 100)).cast("int").alias("year"), M.bucket(F.col("o_totalprice") / 500000).alias("bucket"))
