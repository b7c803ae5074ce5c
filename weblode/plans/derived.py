"""Crawl tables derived from the two given tables, ``pages`` and ``events``.

Batch and streaming readers share these functions; each is a projection, except where a GROUP BY is
named. The same definitions are written in SQL in ``oracle.py``.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from weblode.functions import urls as U
from weblode.operators.events import micros
from weblode.operators.extract import explode_links, extract_pages
from weblode.operators.filters import classify_fetches, robots_rules, robots_verdict
from weblode.schema import SYSTEM_JOB

SUFFIXES = ["com", "net", "org"]


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def crawl_events(raw: DataFrame) -> DataFrame:
    """The event table read as a crawl event log."""
    k = F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("bigint")
    user, eid, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")

    def pick(**by_kind):
        out = None
        for name, value in by_kind.items():
            value = F.lit(value) if isinstance(value, (str, int)) else value
            out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
        return out

    text = lambda c: c.cast("string")
    host = F.concat(F.lit("d"), text(user % 40), F.lit(".example.com"))
    url = F.concat(F.lit("https://"), host, F.lit("/"), text(user), F.lit("/"), text(k % 5))
    parent = F.concat(F.lit("https://d"), text((user * 7 + 3) % 40), F.lit(".example.com/"))
    fetched = kind == "click"
    reason = F.element_at(F.array(*[F.lit(r) for r in ("duplicate", "max_depth", "robots_txt", "http_error", "wrong_domain")]),
                          (eid % 5 + 1).cast("int"))
    metrics = F.map_filter(F.create_map(
        F.lit("queued_total"), F.when((kind == "view") & (k == 7), 1000 + eid % 100).cast("double"),
        F.lit("frontier_depth"), F.when((kind == "view") & k.isin(7, 8), eid % 500).cast("double"),
        F.lit("done"), F.when((kind == "purchase") & (k == 9), eid % 300).cast("double")), lambda n, v: v.isNotNull())
    return raw.select(
        eid.alias("seq"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("job-"), text(user % 4)).alias("job_id"),
        F.coalesce(pick(signup="url_queued", view="url_fetching", click="url_fetched", purchase="url_stored"),
                   F.lit("url_discarded")).alias("event_type"),
        F.coalesce(pick(signup="queued", view="fetching", click="fetched", purchase="done"), F.lit("discarded")).alias("status"),
        F.concat(F.lit("w"), text(eid % 8)).alias("worker_id"),
        host.alias("domain"), url.alias("url"), parent.alias("parent_url"),
        pick(signup=parent).alias("source_url"), pick(signup=url).alias("target_url"),
        (user % 6).cast("int").alias("depth"),
        pick(click=200).alias("status_code"),
        pick(click="text/html").alias("content_type"),
        pick(purchase=k % 7).alias("links_found"),
        F.when(fetched, F.col("value") * 10).alias("fetch_duration_ms"),
        F.when(fetched, k * 1000).alias("content_length"),
        F.when(kind == "error", reason).alias("discard_reason"),
        F.when(kind == "error", F.concat(F.lit("k="), text(k))).alias("discard_detail"),
        F.when(kind == "error", F.when((eid % 5).isin(2, 3), "fetch").otherwise("link")).alias("discard_stage"),
        F.when(F.size(metrics) > 0, metrics).alias("metrics"),
    )


def worker_events(raw: DataFrame) -> DataFrame:
    """What workers say of themselves, under the system job: every third event of the table read as a heartbeat, a change to
    busy or idle (all with the worker's whole state) or a sign-off (without). Their ``seq`` is odd."""
    eid = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ["worker_offline", "worker_idle", "worker_busy", "worker_heartbeat"])), ((eid % 12) / 3 + 1).cast("int"))
    worker = F.concat(F.lit("w"), (F.floor(eid / 12) % 8).cast("string"))
    busy = eid % 12 == 6
    at = F.col("ts").cast("timestamp_ntz")
    state = F.struct(
        worker.alias("worker_id"), F.concat(F.lit("h"), (eid % 3).cast("string")).alias("hostname"), (eid % 1000).alias("pid"),
        F.when(busy, F.concat(F.lit("https://d"), (F.col("user_id") % 40).cast("string"), F.lit(".example.com/"))).alias("current_url"),
        F.when(busy, F.concat(F.lit("job-"), (F.col("user_id") % 4).cast("string"))).alias("current_job_id"),
        F.when(busy, "busy").otherwise("idle").alias("status"), F.when(eid % 24 != 9, eid % 500).alias("urls_processed"),
        F.when(eid % 36 != 6, eid % 7).alias("errors"), F.when(eid % 60 != 3, eid * 100).alias("bytes_downloaded"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("started_at"), at.alias("last_heartbeat"))
    signs_off = kind == "worker_offline"
    return raw.where((eid % 3 == 0) & (~signs_off | (eid % 120 == 0))).select(
        (eid * 2 + 1).alias("seq"), at.alias("ts"), F.lit(SYSTEM_JOB).alias("job_id"), kind.alias("event_type"), worker.alias("worker_id"),
        F.when(~signs_off, state).alias("worker_state"))


def full_log(raw: DataFrame) -> DataFrame:
    """The crawl events, at even places, and those of the workers between them."""
    return crawl_events(raw).withColumn("seq", F.col("seq") * 2).unionByName(worker_events(raw), allowMissingColumns=True)


def job_events(raw: DataFrame) -> DataFrame:
    """Starts and completions of one job per user."""
    return raw.where(F.col("event_type").isin("signup", "purchase")).select(
        F.col("event_id").alias("seq"), F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        F.when(F.col("event_type") == "signup", "job_started").otherwise("job_completed").alias("event_type"))


def jobs(raw: DataFrame) -> DataFrame:
    """One job per user of the event table (GROUP BY user_id)."""
    u = F.col("user_id")
    text = lambda c: c.cast("string")
    seed = lambda n: F.concat(F.lit('"https://d'), text(n), F.lit(".example.com/"))
    kind = lambda k: F.col("event_type") == k
    return raw.groupBy("user_id").agg(
        F.min("ts").cast("timestamp_ntz").alias("created_at"), F.count_if(kind("signup")).alias("urls_queued"),
        F.count_if(kind("purchase")).alias("urls_fetched"), F.count_if(kind("error")).alias("urls_discarded"),
    ).select(
        F.concat(F.lit("job-"), text(u)).alias("job_id"), F.concat(F.lit("crawl "), text(u)).alias("name"),
        F.element_at(F.array(*map(F.lit, ["running", "running", "paused", "stopped"])), (u % 4 + 1).cast("int")).alias("status"),
        F.concat(F.lit("["), seed(u % 40), F.lit('", '), seed(u % 40), F.lit('", '), seed((u + 1) % 40), F.lit('a#x"]')).alias("seed_urls"),
        F.when(u % 7 != 5, F.element_at(F.array(*map(F.lit, [3, 3, 5, 6])), (u % 4 + 1).cast("int"))).alias("max_depth"),
        F.when(u % 4 == 3, 50).otherwise(1_000_000).cast("bigint").alias("max_pages"),
        F.when(u % 4 == 1, '["example.com"]').when(u % 4 == 3, "[]").alias("allowed_domains"),
        F.when(u % 4 == 2, "/[a-m]").alias("url_pattern"),
        F.when(u % 3 == 0, '{"max_depth": 9, "politeness_delay": 0.5, "respect_robots": false}')
        .when(u % 3 == 1, '{"respect_robots": true, "allowed_content_types": ["text/html"]}').alias("config"),
        "created_at", "urls_queued", "urls_fetched", "urls_discarded")


def job_settings(raw: DataFrame) -> DataFrame:
    """Jobs with their allowlist as an array, as the rules want it."""
    return jobs(raw).withColumn("allowed_domains", F.from_json("allowed_domains", "array<string>"))


def fetches(pages: DataFrame) -> DataFrame:
    """The page table read as a fetch log."""
    p = F.col("page_id")
    error = F.when(p % 25 == 7, "timeout").when(p % 25 == 8, "connection_error")
    return pages.select(
        "page_id", "url", "html", F.concat(F.lit("job-"), (p % 4).cast("string")).alias("job_id"),
        (p % 6).cast("int").alias("depth"), error.alias("fetch_error"),
        F.when(error.isNotNull(), 0).when(p % 20 == 0, 404).when(p % 20 == 1, 500).otherwise(200).alias("status_code"),
        F.when(p % 10 == 3, "application/pdf").when(p % 10 == 4, "TEXT/HTML; charset=utf-8")
        .when(p % 10 == 5, "application/xhtml+xml").otherwise("text/html").alias("content_type"),
        F.length("html").cast("bigint").alias("content_length"),
        (50 + (p * 37) % 900).cast("double").alias("fetch_ms"), (p * 1000).alias("arrival_ms"))


def robots(pages: DataFrame) -> DataFrame:
    """One robots text per host (GROUP BY host)."""
    hosts = pages.select(U.url_netloc("url").alias("netloc")).distinct()
    d = U.queue_shard("netloc", 16)
    return hosts.select("netloc", F.when(d < 4, "User-agent: *\nDisallow: /en/1\nDisallow:\nAllow: /en/15")
                        .when(d < 8, "User-agent: Other\nDisallow: /\nuser-agent: *\nDISALLOW: /fr/")
                        .when(d < 11, "").otherwise("User-agent: Crawlerbot\nDisallow: /de").alias("robots_txt"))


def link_graph(pages: DataFrame) -> DataFrame:
    """Three links per page, from page numbers."""
    n = pages.agg(F.count("*")).scalar()
    p = F.col("page_id")
    targets = F.array((p * 7 + 3) % n, (p * 13 + 5) % n, (p * p + 1) % n)
    return pages.select(p.alias("src"), F.posexplode(targets).alias("pos", "dst")).select("src", "dst", "pos")


def link_occurrences(pages: DataFrame) -> DataFrame:
    """Every link of every page, with the job and depth its target would have."""
    rows = explode_links(fetches(pages), ["page_id", "job_id", "url", "depth"])
    return rows.select("page_id", "job_id", F.col("url").alias("page_url"), (F.col("depth") + 1).alias("depth"),
                       "pos", "href", "anchor", F.col("page_id").alias("parent_seq"))


def fetch_outcomes(pages: DataFrame) -> DataFrame:
    """Fetch log with robots and fetch rules applied; the page text stays out of it."""
    log = fetches(pages.select("page_id", "url", "html")).drop("html")
    checked = robots_verdict(U.with_url_parts(log, "url"), robots_rules(robots(pages)))
    return classify_fetches(checked).withColumn("parent_url", F.lit(None).cast("string"))  # the fetch log has none


def stored_pages(pages: DataFrame) -> DataFrame:
    """Pages a crawl of the fetch log would store (fetch rules only, no robots)."""
    log = classify_fetches(fetches(pages)).where("allowed")
    parent = F.concat(F.lit("https://d"), ((F.col("page_id") * 7 + 3) % 40).cast("string"), F.lit(".example.com/"))
    out = extract_pages(log, fields=("title", "links"))
    return out.select(
        "job_id", "url", F.when(F.col("page_id") % 9 == 0, F.col("url")).when(F.col("page_id") % 9 > 1, parent).alias("parent_url"),
        "depth", "status_code", "title", "content_type", F.size("links").cast("bigint").alias("links_found"),
        F.col("fetch_ms").alias("fetch_duration_ms"), "content_length",
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(secs=(F.col("arrival_ms") / 1000).cast("decimal(18,6)"))).alias("fetched_at"))


def robots_snapshots(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("event_type") == "signup").select(
        F.concat(F.lit("d"), (F.col("user_id") % 40).cast("string"), F.lit(".example.com")).alias("netloc"),
        micros(F.col("ts").cast("timestamp_ntz")).alias("at_us"),
        F.concat(F.lit("User-agent: *\nDisallow: /"), F.col("event_id").cast("string")).alias("robots_txt"))


def robots_probes(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("event_type") == "view").select(
        F.concat(F.lit("d"), (F.col("user_id") % 40).cast("string"), F.lit(".example.com")).alias("netloc"),
        micros(F.col("ts").cast("timestamp_ntz")).alias("at_us"), F.col("event_id").alias("seq"))
