"""URL algebra against the standard library."""

import hashlib
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from weblode.functions import urls as U

BASES = ["http://h.com", "http://h.com/", "http://h.com/a", "http://h.com/a/b/", "http://h.com/a//b?q=1#f",
         "https://u:p@H.com:80/x;p=1/y;z=2?k", "HTTP://h.com/a/../b/./c"]
HREFS = ["", "x", "../x", "../../../x", "/x/../y", "//cdn/z", "?q=2", "?", "#f", "g;x=1/../y", ".", "..", "a/..", "a//b",
         "http:x", "mailto:a@b", "./", "../", "/", ";x", "x;", "x;y?", "http://[::1]/a", "http://[zz/a", "http://h/a?b?",
         " \t http://h/q\n", "//", "///x", "http:///p", "x:y", "/a/b/../../../c/.", "a:/b", "JavaScript:x", "é/ü?ß",
         "http://x／y/z", "//h.com?x", "https:///", "http://", "/..", "/.", "..//x", "http:/abs", "https:rel", "a b|c",
         "ftp://f/x;type=i", "%zz", "http://under_score.com:8080/x?a=1&b=2#c"]


def expected(base, href):
    try:
        joined = urljoin(base, href)
    except ValueError:
        return None, None
    try:
        text = urlparse(joined)._replace(fragment="").geturl()
        return joined, text[:-1] if text.endswith("?") else text
    except ValueError:
        return joined, None


def test_join_and_normalize(spark):
    df = spark.createDataFrame([(b, h) for b in BASES for h in HREFS], "base string, href string")
    df = U.with_resolved_url(U.with_resolved_url(df, "base", "href", "joined", normalized=False), "base", "href", "url")
    for row in df.collect():
        assert (row.joined, row.url) == expected(row.base, row.href), (row.base, row.href)


def test_parts(spark):
    urls = [h for h in HREFS + BASES if h]
    rows = U.with_url_parts(spark.createDataFrame([(u,) for u in urls], "url string"), "url").collect()
    for row in rows:
        try:
            assert tuple(row.u)[:6] == tuple(urlparse(row.url)) and row.u.error is None
        except ValueError:
            assert row.u.error is not None, row.url


@pytest.mark.parametrize("shards", [7, 10, 16, 1000])
def test_queue_shard(spark, shards):
    hosts = [f"h{i}.example.com:{i}" for i in range(200)] + ["", "é.example"]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", U.queue_shard("h", shards).alias("s"), U.url_hash("h").alias("x"))
    for row in rows.collect():
        assert row.s == int(hashlib.md5(row.h.encode()).hexdigest(), 16) % shards
        assert row.x == hashlib.sha256(row.h.encode()).hexdigest()[:16]


def test_registered_domain(spark):
    cases = {"http://a.b.co.uk/": "b.co.uk", "http://www.Example.COM:80/": "Example.COM", "http://1.2.3.4/x": "1.2.3.4.",
             "http://localhost/": "localhost.", "http://com/": ".com", "http://x.unknown/": "unknown.", "http://a.foo.ck/": "a.foo.ck",
             "http://x.a.foo.ck/": "a.foo.ck", "http://www.ck/": "www.ck", "http://u:p@b.com.": "b.com", "http://[::1]:8/": "[::1]."}
    cases["http://a.foo.ck/"] = "a.foo.ck"
    df = U.with_url_parts(spark.createDataFrame([(u,) for u in cases], "url string"), "url")
    rows = df.select("url", U.registered_domain(F.col("u"), ["com", "uk", "co.uk", "*.ck", "!www.ck"]).alias("d")).collect()
    assert {r.url: r.d for r in rows} == cases


def test_labels_and_extension(spark):
    df = U.with_url_parts(spark.createDataFrame([
        ("http://h:8080/" + "p" * 50, None), ("http://h/a.JPG", ".jpg"), ("http://h/a.jpg;v=1", ".jpg"), ("http://h/x.tar.gz", ".gz"),
        ("http://h/js", None), ("http://h/.xml", ".xml"), ("http://h/a.js?x=.png", ".js")], "url string, want string"), "url")
    rows = df.select("url", "want", U.binary_extension(F.col("u")).alias("ext"), U.short_url(F.col("u")).alias("short"),
                     U.display_url("url", F.col("u")).alias("shown")).collect()
    assert all(r.ext == r.want for r in rows)
    assert rows[0].short == "h:8080/" + "p" * 39 and rows[0].shown == "h/" + "p" * 29 + "…"
