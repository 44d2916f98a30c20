"""URL rules against exhaustive counting, SQL for the explicit ones, and URLs of any length."""

import random
from itertools import combinations

import duckdb
from pyspark.sql import functions as F

from plotwise.llm import url_rules

DIR = "/root/testdata/sf0.01"
SQL = f"""
WITH p AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN url END AS u FROM '{DIR}/pages.parquet'),
h AS (SELECT page_id, coalesce(regexp_extract(substr(u, instr(u, '://') + 3), '^[^/?#]*'), '') AS raw, substr(u, instr(u, '://') + 3) AS rest FROM p),
s AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h),
r(kind, domain, prefix) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f AS (SELECT page_id, arg_max(domain || prefix, length(domain || prefix)) AS rule, arg_max(kind, length(domain || prefix)) AS verdict FROM s JOIN r ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix) GROUP BY 1)
SELECT s.page_id, host, path, rule, verdict FROM s LEFT JOIN f USING (page_id)"""


def test_explicit_rules_by_sql(spark):
    got = {r.page_id: r for r in url_rules.op3_url_rules(spark, DIR).collect()}
    want = duckdb.sql(SQL).fetchall()
    assert len(got) == len(want) == 250
    for page, host, path, rule, verdict in want:
        r = got[page]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.mined_rule else "allow"))


def test_query_by_the_contracts_rules(spark, tmp_path):
    urls = ["http://x.net/de/8", "http://net/de/", "http://EXAMPLE.net/de/7", "http://example.net/de/8#y", "http://a.example.net/de/88?z", "http://a.com/en/", "http://b.example.com/en/7", "http://a.org/es/", "http://notnet/de/", "http://a.net/DE/8", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.op3_url_rules(spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(len(urls))] == [
        ("net/de/", "allow"), ("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("example.net/de/8", "block"),
        ("com/en/", "block"), ("example.com/en/7", "allow"), ("org/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"),
    ]


def tokens(spark, urls):
    rows = spark.createDataFrame([(u,) for u in urls], "url string").distinct().select("url", url_rules.tokens_of(F.col("url")).alias("t")).collect()
    return {r.url: frozenset(r.t) for r in rows}


def test_rules_are_all_that_counting_finds(spark):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        host, lang, word = rng.choice("abcd"), rng.choice(("en", "de")), rng.choice(("win", "news", "shop"))
        bad = rng.random() < (0.8 if (host, word) == ("a", "win") else 0.7 if (lang, word, host) == ("de", "shop", "b") else 0.1)
        rows.append((f"http://{host}.example/{lang}/{word}/{k % 5 and 'x'}?q={k}&ref=1", bad))
    rows += [(None, True), ("http://a.example/en", None)]
    rules, items = url_rules.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"), 0.01, 0.5, 2.0, 5)
    got = {frozenset(r["items"]): (r.confidence, r.support, r.lift) for r in rules.collect()}
    item = {r.token: r.item for r in items.collect()}
    known = [(u, b) for u, b in rows if u is not None and b is not None]
    held = {u: frozenset(item[t] for t in ts if t in item) for u, ts in tokens(spark, [u for u, _ in known]).items()}
    share = sum(b for _, b in known) / len(known)
    singles = {i for i in set(item.values()) if rule_of(known, held, {i}, share)}
    want = {frozenset([i]): rule_of(known, held, {i}, share) for i in singles}
    rest = sorted(i for i in set(item.values()) - singles if sum(i in held[u] for u, _ in known) < len(known))
    for n in range(2, len(rest) + 1):
        for chosen in combinations(rest, n):
            if found := rule_of(known, held, set(chosen), share):
                want[frozenset(chosen)] = found
    assert set(got) == set(want) and len(got) >= 2
    assert all(abs(x - y) < 1e-9 for k in got for x, y in zip(got[k], want[k]))
    urls = [u for u, _ in known] + ["http://a.example/de/other/win", "http://zz/", "none"]
    matched = {r.url: r.mined_rule for r in url_rules.match_rules(spark.createDataFrame([(u,) for u in urls] + [(None,)], "url string"), rules, items).collect()}
    for u, ts in tokens(spark, urls).items():
        own = {item[t] for t in ts if t in item}
        best = max(((c, " ".join(sorted(k))) for k, (c, *_) in got.items() if k <= own), default=None)
        assert matched.get(u) == (best and best[1])


def test_pairs_and_triples_of_wide_pages(spark):
    """Bad pages of thirty items whose telling pairs and triples are less telling, item by item, than what fills the pages."""
    rng = random.Random(7)
    filler = [f"f{chr(97 + k)}" for k in range(26)]
    rows = []
    for k in range(60):
        core = ["xa", "xb"] if k % 2 else ["ya", "yb", "yc"]
        rows.append((core + rng.sample(filler, 24) + [f"own{k}"], True))
    for k in range(600):
        core = rng.sample(["xa", "xb"], 1) + rng.sample(["ya", "yb", "yc"], 2)
        rows.append((core + rng.sample(filler, 3), False))
    rows += [rows[0]] * 3
    made = [("http://h/" + "/".join(words), bad) for words, bad in rows]
    rules, items = url_rules.mine_rules(spark.createDataFrame(made, "url string, bad boolean"), 0.001, 0.6, 2.0, 20)
    got = {frozenset(r["items"]): (r.confidence, r.support, r.lift) for r in rules.collect() if len(r["items"]) < 4}
    item = {r.token: r.item for r in items.collect()}
    held = {u: frozenset(item[t] for t in ts if t in item) for u, ts in tokens(spark, [u for u, _ in made]).items()}
    share = sum(b for _, b in made) / len(made)

    def strong(chosen):
        hits = [b for u, b in made if chosen <= held[u]]
        bad = sum(hits)
        return (bad / len(hits), bad / len(made), bad / len(hits) / share) if bad >= 20 and bad / len(hits) >= max(0.6, 2 * share) else None

    present = sorted(set(item.values()))
    singles = {i for i in present if strong({i})}
    rest = [i for i in present if i not in singles and sum(i in held[u] for u, _ in made) < len(made)]
    want = {frozenset([i]): strong({i}) for i in singles}
    for n in (2, 3):
        want |= {frozenset(c): found for c in combinations(rest, n) if (found := strong(set(c)))}
    assert set(got) == set(want) and frozenset(["path:xa", "path:xb"]) in got and frozenset(["path:ya", "path:yb", "path:yc"]) in got
    assert all(abs(x - y) < 1e-9 for k in got for x, y in zip(got[k], want[k]))


def test_long_rules_of_wide_pages(spark):
    """Four items, and five others, that tell only together, on bad pages that more telling items fill."""
    rng = random.Random(3)
    filler, four, five = [f"f{chr(97 + k)}" for k in range(16)], ["wa", "wb", "wc", "wd"], ["va", "vb", "vc", "vd", "ve"]
    rows = [((four if k % 2 else five) + rng.sample(filler, 14) + [f"own{k}"], True) for k in range(60)]
    rows += [(rng.sample(four, 3) + rng.sample(five, 4) + rng.sample(filler, 2), False) for _ in range(1200)]
    rules, items = url_rules.mine_rules(spark.createDataFrame([("http://h/" + "/".join(w), bad) for w, bad in rows], "url string, bad boolean"), 0.001, 0.6, 2.0, 20)
    made = {tuple(w): "http://z/" + "/".join(w) for w in combinations(four + five, 4)} | {tuple(five): "http://z/" + "/".join(five)}
    found = {r.url for r in url_rules.match_rules(spark.createDataFrame([(u,) for u in made.values()], "url string"), rules, items).collect()}
    assert found == {made[tuple(four)], made[tuple(five)]}


def rule_of(known, held, chosen, share):
    hits = [b for u, b in known if chosen <= held[u]]
    bad = sum(hits)
    if bad >= 5 and bad / len(hits) >= 0.5 and bad / len(hits) >= 2 * share:
        return bad / len(hits), bad / len(known), bad / len(hits) / share
    return None


def test_one_long_url_gives_no_power_set(spark):
    path = "/".join(f"p{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200))
    rows = [(f"http://bad.example/{path}?n={k}", True) for k in range(8)] + [(f"http://good.example/a/{k}", False) for k in range(23)] + [("http://x.example/" + "/".join(f"only{k}" for k in range(16)), True)]
    rules, items = url_rules.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"))
    assert rules.count() <= 2 and items.where("token = 'path:paa'").count() == 1
    found = url_rules.match_rules(spark.createDataFrame([("https://other.example/zz/pab",), ("http://good.example/a/1",)], "url string"), rules, items)
    assert [r.url for r in found.collect()] == ["https://other.example/zz/pab"]


def test_urls_of_any_length(spark):
    urls = ["http://a.com/en/" + "x/" * 500_000, "http://" + "a." * 300_000 + "com/en/", "x" * 1_000_000, "http://h/" + "9" * 1_000_000, "http://h/?" + "a=1&" * 300_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules, items = url_rules.mine_rules(spark.createDataFrame([(urls[0], True)] * 6 + [("http://b.com/", False)] * 40, "url string, bad boolean"))
    got = {r.page_id: (r.verdict, r.rule) for r in url_rules.judge(pages, rules, items).collect()}
    assert got[0] == ("block", "com/en/") and got[1] == ("block", "com/en/") and got[2] == ("allow", None)


def test_nothing_to_learn_from(spark):
    for rows in ([], [("http://a/", None)], [("http://a/", False)] * 9, [(None, True)] * 9):
        rules, items = url_rules.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"))
        assert rules.count() == 0
        assert url_rules.match_rules(spark.createDataFrame([("http://a/",)], "url string"), rules, items).count() == 0
