"""URL rules and the list against plain Python; the filter loses no listed URL."""

import re

import pytest

from mnemora.llm import urls
from pyspark.sql import functions as F

RULES = [urls.Rule.of(*r) for r in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))]
URLS = [
    None, "", "no scheme", "http://", "http://A.Example.NET/en/x?y#z", "https://example.net/de/", "http://notexample.net/en/1", "http://example.net", "http://net/", "http://net?x", "ftp://sub.net/x",
    "https://example.com/de/1", "https://example.com/DE/1", "http://xexample.com/de/1", "http://a.org/fr/2", "http://a.org/fr", "http://org/fr/", "http://É.com/Ü?q", "a://b://c.net/d", "http://listed.com/a/?utm_source=x&b=2&a=1#top",
    "https://www.listed.com:443//a?a=1&b=2", "http://listed.com/a?a=1", "http://me@LISTED.com./a/?b=2&a=1&ref=y", "http://listed.net/a", "http://long.com/" + "p" * 20000, "http://line.com/a\nb?c\n", "http://x.com/?&&", "http://x.com",
]
LIST = ["http://listed.com/a?a=1&b=2", "http://listed.net/a", "https://long.com/" + "p" * 20000, None, "none", "http://listed.com/a?a=1&b=2", "http://x.com/"]


def split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    return "".join(c.lower() if c < "\x80" else c for c in host), re.match("[^?#]*", rest[len(host) :])[0], rest


def canonical(url):
    if not url or "://" not in url:
        return None
    host, path, rest = split(url)
    host = re.sub(r"\.?(:(80|443)?)?\Z", "", re.sub(r"^www\.", "", host.rsplit("@", 1)[-1]), count=1)
    asked = re.match(r"[^?#]*\??([^#]*)", rest)[1]
    kept = sorted(p for p in asked.split("&") if p and not re.match(r"(utm_[^=]*|ref|gclid|fbclid)(=|\Z)", p))
    return host + re.sub(r"/\Z", "", re.sub("//+", "/", path)) + ("?" + "&".join(kept) if kept else "")


def judged(url, listed):
    host, path, _ = split(url)
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fit:
        r = max(fit, key=lambda r: len(r.host + r.path))
        return host, path, r.host + r.path, r.action
    return host, path, None, "block" if canonical(url) in listed - {None} else "allow"


@pytest.mark.parametrize("heavy,blocks", [(1024, 1 << 17), (2, 1), (10**9, 4)])
def test_verdicts_against_plain_python(spark, heavy, blocks):
    rows = [(i, u) for i, u in enumerate(URLS + URLS[19:20] * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    got = urls.filter_urls(pages, spark, spark.createDataFrame([(u,) for u in LIST], "url string"), RULES, heavy=heavy, most_blocks=blocks).collect()
    listed = {canonical(u) for u in LIST}
    assert sorted((r.page_id, r.url or "", r.host, r.path, r.rule, r.verdict) for r in got) == sorted((i, u or "", *judged(u, listed)) for i, u in rows)
    assert {r.verdict for r in got if r.rule is None} == {"block", "allow"}


def test_filter_holds_every_key_and_few_others(spark):
    keys = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    found, blocks = urls.bloom(keys.where("key < 'k5'"), 11111)
    assert found.count() <= blocks == 1024
    asked = urls.passing(keys, found, blocks)
    n = asked.groupBy((F.col("key") < "k5").alias("in")).agg(F.count("*").alias("n"), F.count_if("passes").alias("p")).collect()
    n = {r["in"]: (r.n, r.p) for r in n}
    assert n[True][0] == n[True][1] and n[False][1] < 0.01 * n[False][0]


def test_clashing_columns_empty_tables_and_no_python(spark):
    pages = spark.createDataFrame([("k", "http://a.net/", "h", 1, "w0")], "key string, url string, host string, rule int, w0 string")
    none = spark.createDataFrame([], "url string")
    got = urls.filter_urls(pages, spark, none, RULES)
    assert [r.asDict() for r in got.collect()] == [{"key": "k", "url": "http://a.net/", "w0": "w0", "host": "a.net", "path": "/", "rule": "net/", "verdict": "block"}]
    assert urls.filter_urls(pages.limit(0), spark, pages, RULES).collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
