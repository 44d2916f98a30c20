"""Operator 3: URL filters by association rules.

``mine_rules`` runs Spark's FP-growth over the URL tokens of labelled bad pages and counts what it finds over all
labelled pages; rules "token combination => bad" that pass a support, a confidence and a lift stay.  ``match_rules``
finds the rules whose whole combination occurs in a URL through an inverted index: each rule is filed under its rarest
item.  Explicit host and path rules come first; the longest that fits decides.

Everything is DataFrame and SQL functions; URLs are matched once per distinct text, so a URL or host with a third
of all rows costs no more than any other.

Defined cases: a null URL, or one without ``://``, has empty host and path, no tokens and the verdict ``allow``;
repeated rows each get their row, and each counts as a labelled page; without labels nothing is mined; of equally
confident rules the last by name is reported; other columns of the input are ignored.  Rules of up to three items are
all found, however many items a page has, and so are longer ones where no bad page has more than ``widest`` items.  Where
one has, a longer rule is found unless a part of it is a rule, which then matches what the longer one would.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: (verdict, host, path): what the operator takes if it is given no rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("allow", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Fixed by the query's contract.
CONTRACT = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.0002, 0.3, 2.0
MIN_COUNT = 5  # bad pages that a rule needs however few are labelled
WIDEST = 12  # items of a page that FP-growth combines at any length; of wider pages combinations are counted besides, level by level


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens, each with its place: labels of the host, pieces of the path, names in the query."""
    host, path = host_of(url), path_of(url)
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    parts = [
        F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host:"), x)),
        F.transform(F.split(F.lower(path), r"[/._-]+"), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"^[0-9]+$", "#"))),
        F.transform(F.split(F.lower(query), "&"), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1))),
    ]
    known = F.when(F.instr(url, "://") > 0, F.array_distinct(F.filter(F.concat(*parts), lambda x: ~x.rlike("^(host|path|query):$"))))
    return F.coalesce(known, F.array().cast("array<string>"))


def explicit_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, domain, prefix in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1])):  # longer rules are tested first
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(domain + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _classes(labelled: DataFrame, least: Column) -> DataFrame:
    """(token, item, n, n_bad): tokens of enough bad pages, by count; item: the first of those that stand on the same pages."""
    posted = labelled.select("bad", F.explode("tokens").alias("token"), F.xxhash64("url").cast("decimal(38,0)").alias("x"), F.xxhash64("url", F.lit(1)).cast("decimal(38,0)").alias("y"))
    counts = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    kept = counts.where(F.col("n_bad") >= least)
    items = kept.groupBy("n", "x", "y").agg(F.min("token").alias("item"))
    return kept.join(items, ["n", "x", "y"]).select("token", "item", "n", "n_bad")


def mine_rules(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_count: int = MIN_COUNT, widest: int = WIDEST
) -> tuple[DataFrame, DataFrame]:
    """From (url, bad boolean): rules (rule_id, items array, confidence, support, lift), and (token, item) of their items.

    Support is the share of all labelled pages that are bad and hold the items.  An item stands for all tokens that
    occur on the same labelled pages, so that a long URL's own tokens are one item, not a power set.  A token that is a
    rule by itself is given as such and not combined further: what its longer rules match, it matches.  The bad pages
    alone are mined, each with the ``widest`` items of the highest confidence; if a bad page has more, all pairs and
    triples on enough bad pages are counted too, and what no part decides is combined further, at any length.  Confidence
    is then counted over all pages.
    """
    known = labelled.where("url is not null and bad is not null").select("url", "bad", tokens_of(F.col("url")).alias("tokens"))
    pages, bad = known.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    least = max(min_count, math.ceil(min_support * pages - 1e-9))
    base = bad / pages if pages else 0.0
    enough = lambda n_bad, n: (n_bad / n >= min_confidence) & (n_bad / n >= min_lift * base) & (n_bad >= least)
    classes = cut(_classes(known, F.lit(least)))
    items = classes.select("item", "n", "n_bad").distinct()
    single = items.where(enough(F.col("n_bad"), F.col("n"))).select(F.array("item").alias("items"), "n", "n_bad")
    rest = items.where(~enough(F.col("n_bad"), F.col("n")) & (F.col("n") < pages))
    posted = known.withColumn("page", F.monotonically_increasing_id()).select("page", "bad", F.explode("tokens").alias("token"))
    named = posted.join(classes.select("token", "item"), "token").join(rest.select("item", (F.col("n_bad") / F.col("n")).alias("share")), "item")
    held = cut(named.groupBy("page").agg(F.first("bad").alias("bad"), F.array_sort(F.collect_set(F.struct((-F.col("share")).alias("order"), "item"))).alias("held")))
    held = held.select("bad", F.transform("held", lambda x: x["item"]).alias("held"))
    baskets = held.where("bad").select(F.slice("held", 1, widest).alias("items"))
    n_baskets, n_wide = held.where("bad").agg(F.count(F.lit(1)), F.count_if(F.size("held") > widest)).first()
    if not n_baskets:
        several = single.limit(0)
    else:
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n_baskets)).fit(baskets)
        sets = model.freqItemsets.where(F.size("items") > 1).select(F.array_sort("items").alias("items"))
        if n_wide:
            short = cut(_pairs_and_triples(held.where("bad").select("held"), least))
            sets = sets.union(short).union(_longer(short.where(F.size("items") == 3), held, rest, least, enough)).distinct()
        sets = cut(sets)
        several = _counted(sets, held, rest).where(enough(F.col("n_bad"), F.col("n")))
    rules = single.unionByName(several.select("items", "n", "n_bad")).select(
        F.array_join("items", " ").alias("rule_id"), "items", (F.col("n_bad") / F.col("n")).alias("confidence"), (F.col("n_bad") / max(pages, 1)).alias("support"), (F.col("n_bad") / F.col("n") / (base or 1.0)).alias("lift")
    )
    return cut(rules), classes.select("token", "item", "n")


def _pairs_and_triples(held: DataFrame, least: int) -> DataFrame:
    """(items): the pairs and triples that stand on so many pages, from each page's items in an order that all pages share.

    Equal pages are one row with a weight.  A triple is only formed of pairs that are frequent themselves.
    """
    pages = cut(held.where(F.size("held") > 1).groupBy("held").agg(F.count(F.lit(1)).alias("weight"))).withColumn("page", F.monotonically_increasing_id())
    firsts = pages.select("page", "weight", "held", F.posexplode("held").alias("at", "a"))
    pairs = firsts.select("page", "weight", "at", "a", F.posexplode(F.expr("slice(held, at + 2, size(held))")).alias("further", "b"))
    frequent = cut(pairs.groupBy("a", "b").agg(F.sum("weight").alias("n")).where(F.col("n") >= least).select("a", "b"))
    kept = cut(pairs.join(frequent, ["a", "b"]).select("page", "weight", "a", "b", (F.col("at") + F.col("further")).alias("place")))
    seconds = kept.select("page", "a", F.col("b").alias("c"), F.col("place").alias("later"))
    triples = kept.join(seconds, ["page", "a"]).where("place < later").join(frequent.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"], "leftsemi")
    triples = triples.groupBy("a", "b", "c").agg(F.sum("weight").alias("n")).where(F.col("n") >= least)
    return frequent.select(F.array_sort(F.array("a", "b")).alias("items")).union(triples.select(F.array_sort(F.array("a", "b", "c"))))


def _longer(triples: DataFrame, held: DataFrame, counts: DataFrame, least: int, enough) -> DataFrame:
    """(items): the combinations of four and more on so many bad pages of which no part of three or more is a rule.

    Level by level: combinations that differ in their last item are put together if all their parts are open too, that is,
    frequent and no rule.
    """
    found, size, level = triples.limit(0), 3, _counted(triples, held, counts)
    while not (still := cut(level.where(~enough(F.col("n_bad"), F.col("n"))).select("items"))).isEmpty():
        heads = still.select(F.slice("items", 1, size - 1).alias("head"), F.element_at("items", -1).alias("last"))
        pairs = heads.join(heads.withColumnRenamed("last", "further").hint("merge"), "head").where("last < further")
        made = pairs.select(F.concat("head", F.array("last", "further")).alias("items"))
        parts = made.select("items", F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("part"))
        whole = parts.join(still.select(F.col("items").alias("part")).hint("merge"), "part").groupBy("items").agg(F.count(F.lit(1)).alias("open"))
        size += 1
        level = cut(_counted(cut(whole.where(F.col("open") == size).select("items")), held, counts).where(F.col("n_bad") >= least))
        found = found.union(level.select("items"))
    return found


def _filed(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """(item, items): each combination under the rarest of its items."""
    rarest = sets.select("items", F.explode("items").alias("item")).join(counts.select("item", "n").distinct(), "item")
    return rarest.groupBy("items").agg(F.min_by("item", F.struct("n", "item")).alias("item"))


def _counted(sets: DataFrame, held: DataFrame, counts: DataFrame) -> DataFrame:
    """(items, n, n_bad): on how many pages, and bad pages, each combination stands."""
    found = held.select("bad", "held", F.explode("held").alias("item")).join(_filed(sets, counts), "item")
    found = found.where(F.size(F.array_except("items", "held")) == 0)
    return found.groupBy("items").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"))


def match_rules(urls: DataFrame, rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """(url, mined_rule): for each distinct URL that holds all items of a rule, its most confident rule.

    An item is held if any of its tokens is.  Only tokens of rules leave the scan, a row each and without the others.
    """
    used = rules.select(F.explode("items").alias("item")).distinct()
    wanted = cut(tokens.join(used, "item").select("token", "item", "n"))
    posted = urls.where("url is not null").select("url").distinct().select("url", F.explode(tokens_of(F.col("url"))).alias("token"))
    held = posted.join(wanted.select("token", "item"), "token").groupBy("url").agg(F.collect_set("item").alias("held"))
    filed = _filed(rules, wanted).join(rules.select("items", "rule_id", "confidence"), "items")
    met = held.select("url", "held", F.explode("held").alias("item")).join(filed, "item").where(F.size(F.array_except("items", "held")) == 0)
    return met.groupBy("url").agg(F.max_by("rule_id", F.struct("confidence", "rule_id")).alias("mined_rule"))


def judge(pages: DataFrame, rules: DataFrame, tokens: DataFrame, explicit=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, mined_rule; rules and tokens as ``mine_rules`` gives them."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = explicit_rule(F.col("host"), F.col("path"), explicit)
    mined = match_rules(pages, rules, tokens)
    return (
        pages.select("page_id", "url")
        .join(mined, "url", "left")
        .withColumns({"host": host, "path": path})
        .withColumns({"rule": rule, "decided": verdict})
        .select(
            "page_id", "host", "path", "rule",
            F.coalesce("decided", F.when(F.col("mined_rule").isNotNull(), F.lit("block")), F.lit("allow")).alias("verdict"),
            "mined_rule",
        )
    )


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return judge(pages, *mine_rules(pages.join(labels, "page_id")), CONTRACT)
