"""Tables and graphs shown to a reader: pages, discards, jobs, graph, URL detail."""

from pyspark.sql import DataFrame, Window, functions as F

from weblode.functions import urls as U
from weblode.operators.blocks import PLACE, RANGE, counted, ordering, ranged, top_per_group, written
from weblode.operators.events import url_state
from weblode.schema import ROBOTS_TTL_SECONDS

PAGE_COLUMNS = ["url", "parent_url", "depth", "status_code", "title", "content_type", "links_found",
                "fetch_duration_ms", "fetched_at"]


def page_of(df: DataFrame, by: list, order: list, n: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` + 1 to ``offset`` + ``n`` of each group."""
    head = top_per_group(df, by, order, offset + n)
    if not offset:
        return head
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*ordering(order)))
    return head.withColumn("_rn", rank).where(F.col("_rn") > offset).drop("_rn")


def pages_page(pages: DataFrame, n: int = 50, offset: int = 0) -> DataFrame:
    """Newest stored pages of each job."""
    return page_of(pages.select("job_id", *PAGE_COLUMNS), ["job_id"], ["-fetched_at", "url"], n, offset)


def index_pages(pages: DataFrame, ranges: int | None = None) -> tuple:
    """Stored pages in the order they are shown, newest first, as a table cut into ranges; and how many of each job's pages
    every range has and how many come before. Written once; any page is then found by ``page_at``."""
    rows = ranged(pages.select("job_id", *PAGE_COLUMNS), ["job_id", "-fetched_at", "url"], ranges)
    return rows, written(counted(rows, ["job_id"]), "counts")


def page_at(rows: DataFrame, counts: DataFrame, job_id: str, n: int = 50, offset: int = 0) -> DataFrame:
    """Rows ``offset`` + 1 to ``offset`` + ``n`` of a job, in order, from ``index_pages``.

    The counts name the few ranges that hold them and their places there; both are numbers stored with the rows, so the scan
    skips all other files and nothing that lies before is ranked, however deep the page.
    """
    held = counts.where((F.col("job_id") == job_id) & (F.col("_end") > offset) & (F.col("_offset") < offset + n)).collect()
    wanted = F.lit(False)
    for c in held:  # at most as many as the page has rows
        low, high = c["_from"] + max(offset - c["_offset"], 0), c["_from"] + min(offset + n, c["_end"]) - c["_offset"]
        wanted = wanted | ((F.col(RANGE) == c[RANGE]) & (F.col(PLACE) >= low) & (F.col(PLACE) < high))
    return rows.where((F.col("job_id") == job_id) & F.col(RANGE).isin(*[c[RANGE] for c in held]) & wanted).orderBy(RANGE, PLACE).drop(RANGE, PLACE)


def discards_page(discards: DataFrame, n: int = 100, reason: str | None = None) -> DataFrame:
    """Newest discards of each job, optionally of one reason."""
    rows = discards if reason is None else discards.where(F.col("reason") == reason)
    return page_of(rows, ["job_id"], ["-discarded_at", "-seq"], n)


def jobs_list(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), "job_id")


def graph_nodes(pages: DataFrame, n: int | None = 500) -> DataFrame:
    """One node per stored URL of a job, the first page of a URL winning; at most ``n`` pages."""
    rows = pages.select("job_id", "url", "depth", "status_code", "title", "fetched_at")
    if n is not None:
        rows = top_per_group(rows, ["job_id"], ["fetched_at", "url"], n)
    first = rows.groupBy("job_id", "url").agg(F.min(F.struct("fetched_at", "depth", "status_code", "title")).alias("p"))
    return U.with_url_parts(first, "url").select(
        "job_id", F.col("url").alias("id"), U.short_url(F.col("u")).alias("label"), "p.depth",
        F.lit("done").alias("status"), "p.status_code", "p.title")


def graph_edges(pages: DataFrame, n: int | None = 500) -> DataFrame:
    """Parent to page, for the same pages as ``graph_nodes``; parents may lie outside."""
    rows = pages.select("job_id", "url", "parent_url", "fetched_at")
    if n is not None:
        rows = top_per_group(rows, ["job_id"], ["fetched_at", "url"], n)
    return rows.where(F.col("parent_url") != F.col("url")).select(
        "job_id", F.col("parent_url").alias("source"), F.col("url").alias("target"))


def url_detail(keys: DataFrame, events: DataFrame) -> DataFrame:
    """State of each wanted (job, URL); the newest discard where no state is known."""
    entry = url_state(events, ignore_link_stage=True).select(
        "job_id", "url", F.struct("status", "depth", "discard_reason", "seq").alias("entry"))
    discard = events.where(F.col("event_type") == "url_discarded").groupBy("job_id", "url").agg(
        F.max(F.struct("seq", "status", "depth", "discard_reason")).alias("d"))
    discard = discard.select("job_id", "url", F.struct("d.status", "d.depth", "d.discard_reason", "d.seq").alias("discard"))
    return (
        keys.select("job_id", "url").join(entry, ["job_id", "url"], "left").join(discard, ["job_id", "url"], "left")
        .select("job_id", "url", F.when(F.col("entry").isNotNull(), "entry").when(F.col("discard").isNotNull(), "discard").alias("found_in"),
                F.coalesce("entry", "discard").alias("e"))
        .select("job_id", "url", "found_in", "e.*")
    )


def robots_as_of(probes: DataFrame, snapshots: DataFrame, ttl_seconds: int = ROBOTS_TTL_SECONDS) -> DataFrame:
    """Robots copy valid at each probe: the latest of its host, younger than ``ttl_seconds``.

    Probes (netloc, at_us, ...), snapshots (netloc, at_us, robots_txt). A copy lives no longer than
    the bucket width, so it matters only in its own bucket and the next: it is entered in both, and
    the window runs inside (host, bucket). A hot host is spread over its buckets.
    """
    width = ttl_seconds * 1_000_000
    bucket = F.floor(F.col("at_us") / width)
    copies = snapshots.groupBy("netloc", "at_us").agg(F.max("robots_txt").alias("robots_txt")).select(
        "netloc", "at_us", F.struct(F.col("at_us").alias("snap_us"), "robots_txt").alias("copy"),
        F.explode(F.array(bucket, bucket + 1)).alias("_b"))
    asked = probes.withColumn("_b", bucket).withColumn("_probe", F.lit(1))
    both = asked.unionByName(copies.withColumn("_probe", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("netloc", "_b").orderBy("at_us", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.col("at_us") - F.col("last.snap_us") < width
    return (
        both.withColumn("last", F.last("copy", ignorenulls=True).over(w)).where(F.col("_probe") == 1)
        .select(*probes.columns, F.when(fresh, F.col("last.snap_us")).alias("snap_us"),
                F.when(fresh, F.col("last.robots_txt")).alias("robots_txt"),
                F.coalesce(~fresh, F.lit(True)).alias("needs_refresh"))
    )
