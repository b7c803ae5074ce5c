"""A crawl step follows its job's settings, and hot jobs stay spread when nothing is broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from weblode.functions import urls as U
from weblode.operators import frontier as Q, metrics as M
from weblode.plans import crawl

FETCHES = ("page_id bigint, url string, final_url string, html string, job_id string, depth int, parent_url string, fetch_error string, "
           "status_code int, content_type string, content_length bigint")
ROBOTS = [("h.example.com", "User-agent: *\nDisallow: /private")]
JOBS = ("job_id string, max_depth int, max_pages bigint, allowed_domains string, url_pattern string, config string")


def fetch(i, url, job="a", html="", final=None, kind="text/html", status=200):
    return (i, url, final, html, job, 0, "https://up.example.com/", None, status, kind, 10)


@pytest.fixture(scope="module")
def step(spark):
    fetches = spark.createDataFrame([
        fetch(1, "https://h.example.com/private/x", "a"), fetch(2, "https://h.example.com/private/x", "b"),
        fetch(3, "https://h.example.com/doc", "a", kind="application/pdf"), fetch(4, "https://h.example.com/doc", "b", kind="application/pdf"),
        fetch(5, "https://h.example.com/old/", "b", '<a href="n1">1</a><a href="/n2">2</a><a href="n3">3</a><a href="http://[x">bad</a>',
              final="https://h.example.com/new/"),
        fetch(6, "https://h.example.com/gone", "b", status=404),
    ], FETCHES)
    jobs = Q.job_config(spark.createDataFrame([
        ("a", 5, 100, None, None, '{"respect_robots": false, "allowed_content_types": ["text/html"]}'), ("b", 5, 3, None, None, None)], JOBS))
    seen = spark.createDataFrame([("b", "https://h.example.com/new/n1"), ("b", "https://h.example.com/")], "job_id string, url string").select(
        "job_id", U.url_hash("url").alias("url_hash"))
    out = crawl.crawl_step(fetches, spark.createDataFrame(ROBOTS, "netloc string, robots_txt string"), jobs, ["com"], seen)
    return {k: v.collect() for k, v in out.items()}


def test_settings_of_the_job_count(step):
    fetch_stage = {(r.job_id, r.url): (r.reason, r.parent_url) for r in step["discards"] if r.discard_stage == "fetch"}
    assert fetch_stage == {("b", "https://h.example.com/private/x"): ("robots_txt", "https://up.example.com/"),
                           ("a", "https://h.example.com/doc"): ("bad_content_type", "https://up.example.com/"),
                           ("b", "https://h.example.com/gone"): ("http_error", "https://up.example.com/")}
    assert {(r.job_id, r.page_id) for r in step["pages"]} == {("a", 1), ("b", 4), ("b", 5)}


def test_links_resolve_against_the_final_url_and_fill_the_rest_of_the_cap(step):
    """Limit 3, two admitted before: one more, the first new one; the seen one is a duplicate."""
    assert [r.url for r in step["frontier"]] == ["https://h.example.com/n2"]
    reasons = {r.url: r.reason for r in step["discards"] if r.discard_stage == "link"}
    assert reasons == {"https://h.example.com/new/n1": "duplicate", "https://h.example.com/new/n3": "max_pages"}
    assert [(r.job_id, r.skipped_links) for r in step["skipped"]] == [("b", 1)]


def test_links_resolve_against_the_base_element_if_asked(spark):
    fetches = spark.createDataFrame([
        fetch(1, "https://h.example.com/a/p", "b", '<base href="https://h.example.com/b/"><a href="x">1</a><a href="/y">2</a>'),
        fetch(2, "https://h.example.com/a/q", "b", '<base href="sub/"><a href="x">1</a>', final="https://h.example.com/moved/q"),
        fetch(3, "https://h.example.com/a/r", "b", '<a href="x">1</a>', final="https://h.example.com/f/r"),
        fetch(4, "https://h.example.com/a/s", "b", '<base href="http://[x"><a href="z">1</a>')], FETCHES)
    jobs = Q.job_config(spark.createDataFrame([("b", 5, 100, None, None, None)], JOBS))
    robots = spark.createDataFrame(ROBOTS, "netloc string, robots_txt string")
    site = "https://h.example.com"
    for asked, want in ((True, {"/b/x", "/y", "/moved/sub/x", "/f/x", "/a/z"}), (False, {"/a/x", "/y", "/moved/x", "/f/x", "/a/z"})):
        out = crawl.crawl_step(fetches, robots, jobs, ["com"], use_base_href=asked)
        assert {r.url for r in out["frontier"].collect()} == {site + path for path in want}


def exchange_keys(df):
    """Key columns of every hash exchange of the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.findall(r"(\w+)#", keys) for keys in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)]


def test_hot_jobs_stay_spread_without_broadcast(spark):
    """No full-size exchange goes by job_id alone: each names a slice, a block or the URL."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = spark.range(600).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("j"), F.col("id") % 50)).alias("job_id"), F.lit(1).alias("depth"),
            F.col("id").alias("parent_seq"), F.lit(0).alias("pos"), F.lit("https://h.example.com/").alias("page_url"),
            F.concat(F.lit("/p"), F.col("id") % 200).alias("href"), F.lit("x").alias("anchor"))
        jobs = links.select("job_id").distinct().select(
            "job_id", F.lit(5).alias("max_depth"), F.lit(20).cast("bigint").alias("max_pages"), F.lit(None).cast("array<string>").alias("allowed_domains"),
            F.lit(None).cast("string").alias("url_pattern"))
        outcomes = Q.admit(crawl.classified_links(links, jobs, ["com"]))
        assert outcomes.where("queued AND job_id = 'hot'").count() == 200
        keys = exchange_keys(outcomes)
        assert ["job_id", "_spread"] in keys and {"job_id", "url_hash", "_salt"} <= set(sum((k for k in keys if "_salt" in k), []))
        assert all(k != ["job_id"] for k in keys if "job_id" in k) or keys.count(["job_id"]) <= 1  # the job list itself is made distinct
        events = links.select("job_id", F.col("parent_seq").alias("seq"), F.lit("url_queued").alias("event_type"),
                              F.create_map(F.lit("done"), F.lit(1.0)).alias("metrics"))
        assert ["job_id", "_spread"] in exchange_keys(M.live_metrics(events))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

