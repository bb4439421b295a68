import random
import re

import pytest
from lodestrata.llm import url_filter


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match("[^/?#]*", rest)[0])
        path = re.match("[^?#]*", rest[len(host) :])[0]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def run(df, rules, **how):
    return sorted((str(r["id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, rules, **how).collect())


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    hosts = ["com", "example.com", "www.example.com", "WWW.Example.COM", "aexample.com", "b.net", "net", "x.y.z.net", "example.com:80", "", "..com", "net."]
    urls = ["".join([rng.choice(["http://", "https://", "", "://"]), rng.choice(hosts), rng.choice(["", "/", "/en", "/en/", "/en/a?b=/es/", "/es/x", "/fr/#top", "?q=/en/", "/EN/", "/en/http://net/es/"])]) for _ in range(300)]
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(None, None, "x"), (7, None, None), (7, urls[3], None), (7, urls[3], None), (None, urls[5], None), (400, "http://" + "a." * 2000 + "com/" + "p" * 3000, None)]
    return spark.createDataFrame(rows, "page_id long, url string, host string")


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_query_rules(spark, pages, limit):
    want = sorted((str(r["page_id"]), *brute(r["url"], url_filter.RULES)) for r in pages.collect())
    got = run(pages, url_filter.query_rules(spark), broadcast_bytes=limit)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_many_rules(spark, pages):
    rng = random.Random(6)
    rules = [(rng.choice(["com", "net", "example.com", "y.z.net", "z.net", f"h{k}.org"]), rng.choice(["", "/", "/e", "/en", "/en/a", f"/p{k}"]), rng.choice(["allow", "block"])) for k in range(200)]
    own = {}
    for h, p, v in rules:
        own[h, p] = max(v, own.get((h, p), v))
    df = spark.createDataFrame([*rules, ("", "/", "block"), (None, "/", "block"), ("com", "/", None)], "host string, path string, verdict string")
    want = sorted((str(r["page_id"]), *brute(r["url"], [(h, p, v) for (h, p), v in own.items()])) for r in pages.collect())
    assert sorted(map(str, run(pages, df))) == sorted(map(str, want))


def test_filter_lets_no_member_out(spark):
    rows = [(f"h{k}.com", f"/{k % 7}", "block") for k in range(3000)]
    listed = url_filter._canonical(spark.createDataFrame(rows, "host string, path string, verdict string"))
    sieve, blocks = url_filter.bloom(listed, 3000)
    assert sieve.count() <= blocks
    urls = spark.createDataFrame([(k, f"http://h{k}.com/{k % 7}") for k in range(3000)] + [(k, f"http://n{k}.com/{k % 7}") for k in range(3000, 6000)], "page_id long, url string")
    got = url_filter.filter_urls(urls, spark.createDataFrame(rows, "host string, path string, verdict string")).collect()
    assert all((r["verdict"] == "block") == (r["id"] < 3000) for r in got)


def test_empty(spark, pages):
    none = url_filter.query_rules(spark).limit(0)
    assert {r[3:] for r in run(pages, none)} == {(None, "allow")}
    assert run(pages.limit(0), url_filter.query_rules(spark)) == []
