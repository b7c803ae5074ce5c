"""Extraction, rules and robots on hand-made rows."""

from pyspark.sql import functions as F

from weblode.functions import urls as U
from weblode.operators import extract as X, filters as L

PAGES = [
    ("plain", "<html><title>A</title><title>B</title><body>one two</body></html>"),
    ("upper", "<HTML LANG='de'><TITLE>\n  T &amp;amp; &#65;&#x42; &eacute;&lt;  </TITLE><META CONTENT=' d ' NAME=\"description\"><A HREF=/x>X</A>"),
    ("bare", "<p>no title</p><meta name=description><link rel=canonical href=https://c/>"),
    ("empty title", "<title></title><base target=x><base href=' /b/ '>"),
    ("links", "<a href='javascript:x'>j</a><a href=mailto:x>m</a><a href='tel:1'>t</a><a href='#f'>f</a><a href='data:x'>d</a>"
              "<a href=''>self</a><a name=n>none</a><a data-href=/no href=' /yes?a=1&amp;b=2 '> <b> bold </b> <i>it</i> </a>"
              "<a title='x > y' href=/gt>g</a><a href=/up JAVASCRIPT>u</a>"),
    ("long", "<a href=/l>" + "z" * 300 + "</a>"),
    ("hidden", "<script>var a='<a href=/s>s</a>';</script><!-- <a href=/c>c</a> --><style>p{}</style><a href=/v>v</a>a&nbsp;b<br>c"),
    ("open", "<script>never closed <a href=/s>s</a>"),
    ("none", None),
]


def test_extraction(spark):
    pages = spark.createDataFrame([(n, "http://h/", h) for n, h in PAGES], "name string, url string, html string")
    rows = {r.name: r for r in X.extract_pages(pages).collect()}
    assert {n: r.title for n, r in rows.items()} == {
        "plain": "A", "upper": "T &amp; AB é<", "bare": None, "empty title": "", "links": None, "long": None, "hidden": None, "open": None, "none": None}
    assert rows["upper"].description == "d" and rows["bare"].description == "" and rows["plain"].description is None
    assert rows["bare"].canonical_url == "https://c/" and rows["upper"].canonical_url is None
    assert rows["upper"].lang == "de" and rows["plain"].lang is None
    assert rows["empty title"].base_href == " /b/ " and rows["plain"].base_href == "http://h/"
    assert [tuple(x) for x in rows["links"].links] == [("", "self"), ("/yes?a=1&b=2", "boldit"), ("/gt", "g"), ("/up", "u")]
    assert rows["long"].links[0].anchor == "z" * 200
    assert [x.href for x in rows["hidden"].links] == ["/v"] and rows["hidden"].word_count == 4
    assert rows["plain"].word_count == 4 and rows["open"].links == [] and rows["open"].word_count == 0
    assert rows["none"].error and rows["none"].title is None and rows["none"].links == [] and rows["plain"].error is None


def test_big_page_needs_no_recursion(spark):
    big = "<p>" + "word " * 400_000 + "<a href='/x' " + "data-a='1' " * 50_000 + ">y</a><!--" + "c" * 500_000
    row = X.extract_pages(spark.createDataFrame([("http://h/", big)], "url string, html string")).collect()[0]
    assert row.word_count == 400_001 and [tuple(x) for x in row.links] == [("/x", "y")]


def test_decode(spark):
    raw = b"a\xff\xe2\x82b\xf0\x9f\xc3\xa9"
    df = X.decode_pages(spark.createDataFrame([(bytearray(raw),)], "content binary"))
    assert df.collect()[0].html == raw.decode("utf-8", errors="replace")


def verdicts(spark, rows, **config):
    df = spark.createDataFrame([(i, u, d) for i, (u, d) in enumerate(rows)], "i int, url string, depth int")
    domains = config.get("domains")
    df = U.with_url_parts(df, "url").withColumn("max_depth", F.lit(config.get("max_depth", 3))).withColumn(
        "allowed_domains", F.array(*map(F.lit, domains)).cast("array<string>") if domains is not None else F.lit(None).cast("array<string>")
    ).withColumn("url_pattern", F.lit(config.get("pattern")).cast("string"))
    out = L.classify_urls(df, ["com", "org"]).orderBy("i").collect()
    return [(r.reason, r.detail) for r in out]


def test_rule_order(spark):
    long = "ftp://h.com/" + "a" * 2049
    assert verdicts(spark, [
        (long, 9), ("ftp://h.com/a.jpg", 9), ("http:///a.jpg", 9), ("http://h.com/a.jpg", 9), ("http://h.org/x", 4), ("http://h.org/x", 3),
        ("http://a.h.com/y", 3), ("http://a.h.com/x", 3), ("http://[x/", 1), ("JavaScript:x", 0),
    ], domains=["h.com"], pattern="x$") == [
        ("invalid_url", "URL too long"), ("invalid_url", "Unsupported scheme: ftp"), ("invalid_url", "No host"),
        ("bad_content_type", "Binary extension: .jpg"), ("max_depth", "Depth 4 > max 3"), ("wrong_domain", "Domain h.org not in allowlist"),
        ("filter_rule", "URL did not match pattern"), (None, None), ("invalid_url", "Invalid IPv6 URL"),
        ("invalid_url", "Unsupported scheme: javascript")]


def test_allowlist(spark):
    urls = [("http://h:8080/", 0), ("http://1.2.3.4/", 0)]
    assert verdicts(spark, urls, domains=["h:8080"]) == [(None, None), ("wrong_domain", "Domain 1.2.3.4. not in allowlist")]
    assert verdicts(spark, urls, domains=[]) == [(None, None)] * 2 == verdicts(spark, urls, domains=None)


def test_fetch_rules(spark):
    limit = 100
    rows = [(0, True, "timeout", 500, "x", 1), (1, False, "timeout", 500, "x", 1), (2, False, None, 404, "x", 1), (3, False, None, 200, "image/png", 999),
            (4, False, None, 200, "Text/HTML; charset=x", 101), (5, False, None, 399, "text/htmlx", 100), (6, False, None, 200, "", None), (7, False, None, 200, None, 0)]
    df = spark.createDataFrame(rows, "i int, robots_blocked boolean, fetch_error string, status_code int, content_type string, content_length bigint")
    def run(types):
        typed = df.withColumn("types", F.lit(None).cast("array<string>") if types is None else F.array(*map(F.lit, types)).cast("array<string>"))
        return [r.reason for r in L.classify_fetches(typed, "types", limit).orderBy("i").collect()]
    assert run(["text/html"]) == ["robots_txt", "timeout", "http_error", "bad_content_type", "too_large", None, "bad_content_type", "bad_content_type"]
    assert run(None) == run([]) == ["robots_txt", "timeout", "http_error", "too_large", "too_large", None, None, None]


def simple_robots(text):
    """The rule in plain Python, line by line."""
    agent, out = None, []
    for line in text.splitlines():
        name, _, value = line.strip().partition(":")
        if name.lower() == "user-agent":
            agent = value.strip()
        elif name.lower() == "disallow" and agent in ("*", "Crawlerbot") and value.strip():
            out.append(value.strip())
    return out


def test_robots(spark):
    texts = [
        "User-agent: a\nUser-agent: *\nDisallow: /x\nUser-agent: b\nDisallow: /y", "USER-AGENT:*\r\nDISALLOW:/p\r\nDisallow:\r\nAllow: /p/q",
        "Disallow: /early\nUser-agent: crawlerbot\nDisallow: /no\nUser-agent: Crawlerbot\nDisallow: /yes # c", "", "  user-agent: *  \n\t disallow:  /t  ",
        "User-agent: *\rDisallow: /cr\x0bDisallow: /vt\u2028Disallow: /ls", "x-user-agent: *\nDisallow: /n\nUser-agent: *\nNo-disallow: /m"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "netloc string, robots_txt string")
    assert [r.prefixes for r in L.robots_rules(df).orderBy("netloc").collect()] == [simple_robots(t) for t in texts]
    urls = spark.createDataFrame([("http://0/xx",), ("http://0",), ("http://0/y?/x",), ("http://9/x",), ("https://1/p;v",)], "url string")
    rows = L.robots_verdict(U.with_url_parts(urls, "url"), L.robots_rules(df)).collect()
    assert {r.url for r in rows if r.robots_blocked} == {"http://0/xx", "https://1/p;v"}
