"""The crawl frontier as tables: admission, order, caps and pacing."""

from pyspark.sql import DataFrame, Window, functions as F

from weblode.functions import urls as U
from weblode.operators.blocks import (
    PLACE, RANGE, before_range, carried, join_spread, mark_first, mark_limit, rank_in_group, ranged, top_per_group)
from weblode.schema import MAX_PAGES, POLITENESS_DELAY_MS, QUEUE_SHARDS

ARRIVAL = ["depth", "parent_seq", "pos"]


def seed_frontier(jobs: DataFrame) -> DataFrame:
    """Seeds of each job at depth 0, de-duplicated, in the order they were given."""
    seeds = jobs.select("job_id", F.posexplode(F.from_json("seed_urls", "array<string>")).alias("pos", "url"))
    return (
        seeds.groupBy("job_id", "url").agg(F.min("pos").alias("pos"))
        .select("job_id", "url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url"),
                F.col("pos").cast("bigint").alias("discovered_seq"), U.url_hash("url").alias("url_hash"))
    )


def job_config(jobs: DataFrame) -> DataFrame:
    """Saved JSON settings overlaid by the columns of the job table."""
    saved = F.from_json(
        "config", "max_depth int, max_pages bigint, politeness_delay double, respect_robots boolean, "
                  "use_playwright boolean, allowed_content_types array<string>")
    return jobs.withColumn("_c", saved).select(
        "job_id",
        F.coalesce("max_depth", "_c.max_depth").alias("max_depth"),
        F.coalesce("max_pages", "_c.max_pages").alias("max_pages"),
        F.from_json("allowed_domains", "array<string>").alias("allowed_domains"),
        F.col("url_pattern"),
        F.coalesce("_c.politeness_delay", F.lit(POLITENESS_DELAY_MS / 1000)).alias("politeness_delay"),
        F.coalesce("_c.respect_robots", F.lit(True)).alias("respect_robots"),
        F.coalesce("_c.use_playwright", F.lit(False)).alias("use_playwright"),
        F.col("_c.allowed_content_types").alias("allowed_content_types"),
    )


def admit(links: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Outcome of every link: ``queued`` once per (job, URL), ``duplicate`` for each later one.

    Rows that a rule already refused keep their reason. The first occurrence is the least
    (depth, parent_seq, pos). ``seen`` (job_id, url_hash) holds what was admitted before; it meets
    only the slice that can win, on the partitioning the rows already have.
    """
    rows = links if "url_hash" in links.columns else links.withColumn("url_hash", U.url_hash("url"))
    marked = mark_first(rows, ["job_id", "url_hash"], ARRIVAL, "_first", F.col("reason").isNull())
    known = F.lit(False)
    if seen is not None:
        known_keys = seen.select("job_id", "url_hash", F.lit(0).alias("_slice"), F.lit(True).alias("_seen"))
        marked = marked.join(known_keys.distinct(), ["job_id", "url_hash", "_slice"], "left")
        known = F.coalesce("_seen", F.lit(False))
    queued = F.col("_first") & ~known
    refused = F.col("reason").isNotNull()
    return marked.select(
        *[c for c in rows.columns if c not in ("reason", "detail", "allowed")],
        queued.alias("queued"),
        F.when(refused, F.col("reason")).when(~queued, "duplicate").alias("reason"),
        F.when(refused, F.col("detail")).when(~queued, "Already seen").alias("detail"),
    )


def admitted_counts(outcomes: DataFrame) -> DataFrame:
    """Accepted links per job."""
    return outcomes.groupBy("job_id").agg(F.count_if("queued").alias("accepted"))


def admitted_domains(links: DataFrame, key=("job_id",)) -> DataFrame:
    """Per domain and outcome, how many links had it; counts only, so no window at all.

    Equal to ``admit`` followed by a count: one row per distinct URL is queued, the rest of its
    rows are duplicates. Both aggregates combine before the shuffle, so a hot URL is one row.
    """
    refused = F.col("reason").isNotNull()
    # Refused rows need no identity: they share one key per domain and reason.
    per_url = links.groupBy(
        *key, "domain", F.coalesce("reason", F.lit("")).alias("why"),
        F.when(~refused, F.col("url")).alias("which")).agg(F.count("*").alias("n"))
    outcome = F.when(F.col("why") != "", F.array(F.struct(F.col("why").alias("outcome"), F.col("n").alias("n")))) \
        .otherwise(F.array(F.struct(F.lit("queued").alias("outcome"), F.lit(1).cast("bigint").alias("n")),
                           F.struct(F.lit("duplicate").alias("outcome"), (F.col("n") - 1).alias("n"))))
    return (
        per_url.select(*key, "domain", F.inline(outcome))
        .groupBy(*key, "domain", "outcome").agg(F.sum("n").alias("links")).where(F.col("links") > 0)
    )


def frontier_order(frontier: DataFrame) -> DataFrame:
    """Shallowest first, then order of discovery."""
    return frontier.orderBy("depth", "discovered_seq", "url")


def next_batch(frontier: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` next URLs of each job, marked fetching."""
    return top_per_group(frontier, ["job_id"], ["depth", "discovered_seq", "url"], n).withColumn(
        "status", F.lit("fetching"))


def dispatch_plan(frontier: DataFrame, shards: int = QUEUE_SHARDS, ranges: int | None = None) -> DataFrame:
    """Queue of each URL and its place in that queue."""
    routed = frontier.withColumn("queue_shard", U.queue_shard(U.url_netloc("url"), shards))
    ranked = rank_in_group(routed, ["job_id", "queue_shard"], ["depth", "discovered_seq", "url"], "position", ranges)
    return ranked.withColumn("queue_name", U.queue_name("queue_shard"))


def cap_pages(frontier: DataFrame, limits: DataFrame, ranges: int | None = None, used: DataFrame | None = None) -> DataFrame:
    """Keep the first ``max_pages`` URLs of each job, less what ``used`` (job_id, used) says it has already; the others
    get reason max_pages. A job without a limit has the default one.

    The order is cut wherever ranges of like size end, within a depth and within the links of one page too.
    """
    limit = limits.select("job_id", F.coalesce("max_pages", F.lit(MAX_PAGES)).alias("_limit"))
    if used is not None:
        limit = limit.join(used, "job_id", "left").select(
            "job_id", F.greatest(F.col("_limit") - F.coalesce("used", F.lit(0)), F.lit(0)).alias("_limit"))
    limited = join_spread(frontier, limit, ["job_id"], ["url"]).withColumn("_limit", F.coalesce("_limit", F.lit(MAX_PAGES)))
    marked = mark_limit(limited, ["job_id"], ["depth", "discovered_seq", "pos", "url"], "_limit", "kept", ranges)
    return marked.drop("_limit").withColumn("reason", F.when(~F.col("kept"), "max_pages"))


def politeness_schedule(fetches: DataFrame, delay_ms: int = POLITENESS_DELAY_MS, jobs: DataFrame | None = None, ranges: int | None = None) -> DataFrame:
    """Earliest start of each fetch when a host rests after each fetch has ended: ``delay_ms``, or what ``jobs`` (job_id,
    politeness_delay in seconds, see ``job_config``) says for the job. A delay of 0 or less means no pacing.

    Input (job_id, domain, arrival_ms, fetch_ms, seq). The wait recurrence
    start(i) = max(arrival(i), start(i-1) + fetch(i-1) + delay) is a chain of functions t -> max(a, t + b), which compose into
    one of the same form. So with S(i) the sum of fetch + delay of the fetches before i,
    start(i) = S(i) + max over j <= i of arrival(j) - S(j): a prefix sum and a prefix maximum. Both run inside (host, range of
    the sorted table); one summary row per (host, range) composes what lies before. Ranges are cut by size, so a host all of
    whose fetches arrive at once is spread as well.
    """
    host = ["job_id", "domain"]
    rows = fetches.withColumn("_delay", F.lit(delay_ms).cast("bigint"))
    if jobs is not None:
        given = jobs.select("job_id", (F.col("politeness_delay") * 1000).cast("bigint").alias("_own"))
        rows = join_spread(rows, given, ["job_id"], ["seq"]).withColumn("_delay", F.coalesce("_own", "_delay")).drop("_own")
    rows = ranged(rows, [*host, "arrival_ms", "seq"], ranges)
    inside = Window.partitionBy(*host, RANGE).orderBy(PLACE)
    busy = (F.col("fetch_ms") + F.col("_delay")).cast("bigint")
    local = (
        rows.withColumn("_s", F.coalesce(F.sum(busy).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_slack", F.col("arrival_ms") - F.col("_s"))
        .withColumn("_m", F.max("_slack").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    )
    earlier = before_range(host)
    carry = (
        local.groupBy(*host, RANGE).agg(F.sum(busy).alias("_total"), F.max("_slack").alias("_peak"))
        .withColumn("_c", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .withColumn("_k", F.max(F.col("_peak") - F.col("_c")).over(earlier))
        .select(*host, RANGE, "_c", "_k")
    )
    paced = F.col("_c") + F.col("_s") + F.greatest(F.col("_k"), F.col("_m") - F.col("_c"))
    start = F.when(F.col("_delay") > 0, paced).otherwise(F.col("arrival_ms"))
    return (
        carried(local, carry, host).withColumn("start_ms", start.cast("bigint"))
        .withColumn("wait_ms", (F.col("start_ms") - F.col("arrival_ms")).cast("bigint"))
        .select(*fetches.columns, "start_ms", "wait_ms")
    )


def politeness_wait(ends: DataFrame, at_ms, delay_ms: int = POLITENESS_DELAY_MS) -> DataFrame:
    """Milliseconds each host must still rest at time ``at_ms``; 0 means it may be fetched now.

    Input (job_id, domain, end_ms). ``at_ms`` is a number or a one-row scalar column.
    """
    at = F.lit(at_ms) if isinstance(at_ms, int) else at_ms
    left = F.col("last_end_ms") + delay_ms - at
    return ends.groupBy("job_id", "domain").agg(F.max("end_ms").alias("last_end_ms")).select(
        "job_id", "domain", F.greatest(F.lit(0), left).cast("bigint").alias("wait_ms"))


def live_frontier(frontier: DataFrame, jobs: DataFrame) -> DataFrame:
    """Frontier without the pending rows of stopped jobs."""
    stopped = jobs.where(F.col("status") == "stopped").select("job_id")
    return frontier.join(stopped, "job_id", "left_anti")


def since_clear(events: DataFrame, clears: DataFrame) -> DataFrame:
    """The events a job still knows: those after its last clear; ``clears`` (job_id, cleared_seq), any number per job.

    A clear empties the frontier, the seen set, the states and the counters of a job at once. All four are folds of the
    log, so the mark is honoured by folding only what follows it: ``metrics.pending_frontier``, ``seen_urls``,
    ``events.url_state`` and ``metrics.job_metrics`` of the result.
    """
    last = clears.groupBy("job_id").agg(F.max("cleared_seq").alias("_cleared"))
    marked = join_spread(events, last, ["job_id"], ["seq"])
    return marked.where(F.col("_cleared").isNull() | (F.col("seq") > F.col("_cleared"))).drop("_cleared")


def seen_urls(events: DataFrame) -> DataFrame:
    """(job_id, url_hash) of the URLs queued in a log, as ``admit`` wants them."""
    queued = events.where((F.col("event_type") == "url_queued") & F.col("url").isNotNull())
    return queued.select("job_id", "url").distinct().select("job_id", U.url_hash("url").alias("url_hash"))
