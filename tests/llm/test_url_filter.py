import random
import re

from helpers import lower_ascii
from textlake.llm.url_filter import bloom_blocks, filter_urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b", "", "block")]


def brute(url, rules, default="allow"):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (lower_ascii(m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def run(spark, urls, rules):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, key string, verdict string")
    out = filter_urls(df, spark.createDataFrame(rules, "host string, path string, action string"), keep=("page_id",))
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}, out


def test_matches_brute_force(spark):
    rng = random.Random(3)
    hosts = ["net", "example.net", "WWW.Example.NET", "x.example.com", "example.com", "myexample.net", "q.org", "org", "a.b", "z.a.b", "", "net.", "é.org"]
    paths = ["", "/", "/en/", "/en", "/en/x?y=/de/", "/de/1#t", "/fr/", "/fr/é", "?q=/en/", "#/fr/"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "http:/one.net/", "a://b://c.net/"]
    urls += urls[:5]  # repeated rows
    got, out = run(spark, urls, RULES)
    assert got == {i: brute(u, RULES) for i, u in enumerate(urls)}
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict", "possible"]


def test_many_rules_and_false_positives(spark):
    rng = random.Random(5)
    rules = [(f"h{rng.randrange(400)}.net", f"/{rng.randrange(20)}", rng.choice(["allow", "block"])) for _ in range(300)]
    rules = list({r[:2]: r for r in rules}.values())
    urls = [f"http://w.h{rng.randrange(500)}.net/{rng.randrange(30)}/{i % 7}" for i in range(2000)]
    got, out = run(spark, urls, rules)
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}
    assert out.where("rule IS NOT NULL AND NOT possible").count() == 0


def test_filter_holds_every_listed_key(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) AS key")
    blocks = bloom_blocks(keys, 100)
    assert blocks.count() == 100


def test_empty_tables(spark):
    none = spark.createDataFrame([], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert [tuple(r) for r in filter_urls(pages, none, keep=("page_id",)).select("page_id", "rule", "verdict").collect()] == [(1, None, "allow")]
    assert filter_urls(pages.limit(0), none, keep=("page_id",)).count() == 0


def test_native_plan(spark):
    _, out = run(spark, ["http://a.net/x"], RULES)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
