"""Counters per job, domain, shard and worker.

Aggregates keep numbers in their buffers and strings in their keys, so that Spark aggregates by
hash, combines before the shuffle, and a hot job or domain costs one row per task.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from weblode.functions import urls as U
from weblode.operators.blocks import join_spread
from weblode.operators.events import _active_worker, _domain_activity, micros
from weblode.schema import QUEUE_SHARDS, SYSTEM_JOB, WORKER_STATE, WORKER_TTL_SECONDS


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def _finished() -> Column:
    return _is("url_stored") | (_is("url_discarded") & (F.col("discard_stage") == "fetch"))


def job_metrics(events: DataFrame) -> DataFrame:
    """Queue, done, discard (fetch stage) and error counters, distinct URLs accepted and pending."""
    per_url = events.where(F.col("job_id") != SYSTEM_JOB).groupBy("job_id", "url").agg(
        _n(_is("url_queued")).alias("queued"), _n(_is("url_stored")).alias("done"),
        _n(_is("url_discarded") & (F.col("discard_stage") == "fetch")).alias("discarded"),
        _n(_is("url_error")).alias("error"))
    accepted = F.col("url").isNotNull() & (F.col("queued") > 0)
    return per_url.groupBy("job_id").agg(
        F.sum("queued").alias("queued_total"), F.sum("done").alias("done"),
        F.sum("discarded").alias("discarded"), F.sum("error").alias("error"),
        _n(accepted).alias("accepted_total"),
        _n(accepted & (F.col("done") == 0) & (F.col("discarded") == 0)).alias("frontier_depth"))


def pending_frontier(events: DataFrame) -> DataFrame:
    """URLs accepted and not yet stored or discarded, with their first arrival.

    The host is read from the URL, as seeds are queued without one."""
    queued_at = F.when(_is("url_queued"), F.col("seq"))
    return (
        events.where(F.col("url").isNotNull()).groupBy("job_id", "url").agg(
            F.min(queued_at).alias("discovered_seq"), F.min_by("depth", queued_at).alias("depth"),
            F.count_if(_finished()).alias("_finished"))
        .where(F.col("discovered_seq").isNotNull() & (F.col("_finished") == 0))
        .select("job_id", "url", U.url_netloc("url").alias("domain"), "depth", "discovered_seq")
    )


def stored_fetches(events: DataFrame) -> DataFrame:
    """(job_id, url, domain, ms, bytes, worker_id) of each stored URL: time and size of its last fetch, worker that
    stored it last. Only fetch events carry the two, so they are brought together by URL."""
    fetched_at, stored_at = F.when(_is("url_fetched"), F.col("seq")), F.when(_is("url_stored"), F.col("seq"))
    last = lambda c, at: F.max_by(c, F.when(F.col(c).isNotNull(), at))
    return (
        events.where(F.col("url").isNotNull() & (_is("url_fetched") | _is("url_stored"))).groupBy("job_id", "url").agg(
            F.max("domain").alias("domain"), last("fetch_duration_ms", fetched_at).alias("ms"),
            last("content_length", fetched_at).alias("bytes"), last("worker_id", stored_at).alias("worker_id"),
            F.max(stored_at).alias("_stored"))
        .where(F.col("_stored").isNotNull()).drop("_stored")
    )


def frontier_size(frontier: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows in the frontier of every job, empty ones included."""
    sizes = frontier.groupBy("job_id").agg(F.count("*").alias("size"))
    size = F.coalesce("size", F.lit(0))
    return jobs.select("job_id").join(sizes, "job_id", "left").select("job_id", size.alias("size"), (size == 0).alias("is_empty"))


# Counter of the live panel -> event type that adds one to it.
_LIVE = {"queued_total": "url_queued", "done": "url_stored", "discarded": "url_discarded", "error": "url_error"}


def live_metrics(events: DataFrame) -> DataFrame:
    """Counters as a dashboard sees them: one per event, reset by a metrics snapshot.

    A snapshot sets a counter to its value after its own event was counted, and later events count
    on from there. So a counter is its last snapshot plus the events after it: one aggregate finds
    the last snapshots (few rows carry one), a second counts.
    """
    own = events.where(F.col("job_id") != SYSTEM_JOB)
    names = [*_LIVE, "frontier_depth"]

    def reset_at(name: str) -> Column:
        return F.when(F.col("metrics")[name].isNotNull(), F.col("seq"))

    resets = own.where(F.col("metrics").isNotNull()).groupBy("job_id").agg(
        *[F.max(reset_at(c)).alias(f"at_{c}") for c in names],
        *[F.max_by(F.col("metrics")[c], reset_at(c)).alias(f"base_{c}") for c in names])
    counted = join_spread(own.select("job_id", "seq", "event_type"), resets, ["job_id"], ["seq"])
    return (
        counted.groupBy("job_id").agg(
            *[F.count_if(_is(kind) & (F.col("seq") > F.coalesce(f"at_{c}", F.lit(-1)))).alias(f"n_{c}") for c, kind in _LIVE.items()],
            *[F.max(f"base_{c}").alias(f"b_{c}") for c in names])
        .select("job_id", *[(F.coalesce(f"b_{c}", F.lit(0)) + F.col(f"n_{c}")).cast("bigint").alias(c) for c in _LIVE],
                F.coalesce("b_frontier_depth", F.lit(0)).cast("bigint").alias("frontier_depth"))
    )


def half_up(value: Column, digits: int = 0) -> Column:
    """Round half up by a formula that every SQL engine evaluates alike."""
    scale = float(10 ** digits)
    return F.floor(value * scale + 0.5) / scale


def domain_stats(events: DataFrame, shards: int = QUEUE_SHARDS) -> DataFrame:
    """Queued, done, mean fetch time, busy worker and queue of each (job, domain)."""
    per_worker = _domain_activity(
        events, F.count_if(_is("url_queued")).alias("queued"), F.count_if(_is("url_stored")).alias("done"))
    counts = per_worker.groupBy("job_id", "domain").agg(
        F.sum("queued").alias("queued"), F.sum("done").alias("done"), _active_worker().alias("active_worker"))
    took = stored_fetches(events).groupBy("job_id", "domain").agg(
        F.sum(F.col("ms").cast("bigint")).alias("_took"), F.count("ms").alias("_timed"))
    mean = F.when(F.col("_timed") > 0, half_up(F.col("_took") / F.col("_timed"), 1)).otherwise(F.lit(0.0))
    out = counts.join(took, ["job_id", "domain"], "left").select(
        "job_id", "domain", "queued", "done", mean.alias("avg_fetch_ms"), "active_worker")
    return out.withColumn("queue_shard", U.queue_shard("domain", shards)).withColumn("queue_name", U.queue_name("queue_shard"))


def domain_summary(stats: DataFrame) -> DataFrame:
    """Totals over the domains of each job."""
    return stats.groupBy("job_id").agg(
        F.count("*").alias("domains"), F.count("active_worker").alias("active"),
        F.count_distinct("queue_shard").alias("shards_used"),
        F.sum("done").alias("done"), F.sum("queued").alias("queued"))


def shard_heatmap(stats: DataFrame, shards: int = QUEUE_SHARDS) -> DataFrame:
    """Domains and activity of every shard of each job, empty shards included."""
    per_shard = stats.groupBy("job_id", "queue_shard").agg(
        F.count("*").alias("domains"), (F.count("active_worker") > 0).alias("has_active"))
    grid = stats.select("job_id").distinct().select(
        "job_id", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("queue_shard"))
    return grid.join(per_shard, ["job_id", "queue_shard"], "left").select(
        "job_id", "queue_shard", F.coalesce("domains", F.lit(0)).alias("domains"),
        F.coalesce("has_active", F.lit(False)).alias("has_active"))


def queue_depths(frontier: DataFrame, shards: int = QUEUE_SHARDS) -> DataFrame:
    """Pending URLs of every shard, empty shards included."""
    depths = frontier.groupBy(U.queue_shard("domain", shards).alias("queue_shard")).agg(F.count("*").alias("n"))
    grid = frontier.sparkSession.range(shards).select(F.col("id").cast("int").alias("queue_shard"))
    return grid.join(depths, "queue_shard", "left").select(
        "queue_shard", U.queue_name("queue_shard").alias("queue_name"), F.coalesce("n", F.lit(0)).alias("pending"))


def url_status_counts(states: DataFrame, events: DataFrame) -> DataFrame:
    """Tab counters of a URL table: entries by state, and length of the discard list."""
    tabs = states.groupBy("job_id").agg(
        F.count("*").alias("all"), _n(F.col("status") == "done").alias("done"),
        _n(F.col("status").isin("fetching", "parsing")).alias("fetching"),
        _n(F.col("status") == "error").alias("error"))
    discards = events.where(_is("url_discarded")).groupBy("job_id").agg(F.count("*").alias("n"))
    return tabs.join(discards, "job_id", "left").select(
        "job_id", "all", "done", "fetching", F.coalesce("n", F.lit(0)).alias("discarded"), "error")


def success_rate(metrics: DataFrame) -> DataFrame:
    """Whole per cent of finished URLs that were stored; 0 when none is finished."""
    total = F.col("done") + F.col("discarded") + F.col("error")
    return metrics.select("job_id", F.when(total > 0, F.floor(F.lit(100.0) * F.col("done") / total + 0.5))
                          .otherwise(0).cast("bigint").alias("success_rate"))


def worker_states(events: DataFrame) -> DataFrame:
    """What each worker last said of itself: a row per worker with the fields of ``worker_state``, and ``reported_seq``.

    A later state replaces the earlier one whole, so a field it leaves out is NULL again; counters left out count as 0.
    The fold is one maximum by ``seq``, merged before the shuffle; a busy worker costs one row per task.
    """
    said = events.where(F.col("worker_state").isNotNull() & F.col("worker_id").isNotNull())
    last = said.groupBy("worker_id").agg(F.max_by("worker_state", "seq").alias("s"), F.max("seq").alias("reported_seq"))
    counters = ("urls_processed", "errors", "bytes_downloaded")
    return last.select("worker_id", *[F.coalesce(f"s.{f.name}", F.lit(0)).alias(f.name) if f.name in counters else F.col(f"s.{f.name}").alias(f.name)
                                      for f in WORKER_STATE if f.name != "worker_id"], "reported_seq")


def worker_stats(events: DataFrame) -> DataFrame:
    """Pages stored, errors and bytes of stored pages of each worker, its status and task as it last reported them (NULL if it
    never did), and its last sign of life."""
    counts = events.where(F.col("worker_id").isNotNull()).groupBy("worker_id").agg(
        _n(_is("url_stored")).alias("urls_processed"), _n(_is("url_error")).alias("errors"), F.max("ts").alias("last_heartbeat"))
    size = stored_fetches(events).groupBy("worker_id").agg(F.sum("bytes").alias("_bytes"))
    if "worker_state" not in events.columns:
        events = events.withColumn("worker_state", F.lit(None).cast(WORKER_STATE))
    states = worker_states(events).select("worker_id", F.col("status").alias("last_status"), "current_url", "current_job_id")
    return counts.join(size, "worker_id", "left").join(states, "worker_id", "left").select(
        "worker_id", "urls_processed", "errors", F.coalesce("_bytes", F.lit(0)).alias("bytes_downloaded"), "last_status",
        "current_url", "current_job_id", "last_heartbeat")


def worker_liveness(events: DataFrame, ttl_seconds: int = WORKER_TTL_SECONDS) -> DataFrame:
    """Workers with their last sign of life, alive within ``ttl_seconds`` of the log's end.

    A worker that signed off is not alive until it shows again.
    """
    now = events.agg(F.max(micros(F.col("ts")))).scalar()
    last = events.where(F.col("worker_id").isNotNull()).groupBy("worker_id").agg(
        F.max("ts").alias("last_heartbeat"),
        F.max(F.when(_is("worker_offline"), F.col("seq"))).alias("_off"),
        F.max(F.when(~_is("worker_offline"), F.col("seq"))).alias("_on"))
    fresh = micros(F.col("last_heartbeat")) >= now - ttl_seconds * 1_000_000
    signed_off = F.coalesce(F.col("_off") > F.coalesce("_on", F.lit(-1)), F.lit(False))
    return last.select("worker_id", "last_heartbeat", (fresh & ~signed_off).alias("alive"))


def worker_sessions(events: DataFrame, gap_seconds: int = WORKER_TTL_SECONDS) -> DataFrame:
    """Up-intervals of each worker: beats less than ``gap_seconds`` apart belong together; a sign-off is no beat.

    Beats are first merged per bucket as wide as the gap, which can never span two sessions; the
    window then sees a bounded number of rows per worker and hour, however busy the worker is.
    """
    at = micros(F.col("ts"))
    gap = gap_seconds * 1_000_000
    beats = events.where(F.col("worker_id").isNotNull() & F.coalesce(~_is("worker_offline"), F.lit(True)))
    buckets = beats.groupBy(
        "worker_id", F.floor(at / gap).alias("_b")).agg(
        F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n"))
    w = Window.partitionBy("worker_id").orderBy("_b")
    starts = (micros(F.col("lo")) - micros(F.lag("hi").over(w)) >= gap)
    return (
        buckets.withColumn("_start", F.coalesce(starts.cast("int"), F.lit(1)))
        .withColumn("_session", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("worker_id", "_session")
        .agg(F.min("lo").alias("first_beat"), F.max("hi").alias("last_beat"), F.sum("n").alias("beats"))
        .select("worker_id", "first_beat", "last_beat", "beats")
    )


def feed_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id").agg(F.count("*").alias("events"))


def job_latency(events: DataFrame) -> DataFrame:
    """Sum of fetch times of the stored pages of each job."""
    return stored_fetches(events).groupBy("job_id").agg(F.sum("ms").alias("latency_sum"))


def job_status(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Status of each job after its start and completion events."""
    # Event types that move a job, and where to.
    moves = {"job_started": "running", "job_completed": "completed"}
    last = events.where(F.col("event_type").isin(*moves)).groupBy("job_id").agg(
        *[F.max(F.when(_is(kind), F.col("seq"))).alias(f"_{kind}") for kind in moves])
    started, completed = (F.coalesce(f"_{kind}", F.lit(-1)) for kind in moves)
    moved = F.when(completed > started, moves["job_completed"]).when(started > completed, moves["job_started"])
    return jobs.join(last, "job_id", "left").select("job_id", F.coalesce(moved, F.col("status")).alias("status"))


def job_overview(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Jobs with their live counters; a stored counter is used where no live one exists."""
    stored = _is("url_stored")
    activity = events.groupBy("job_id").agg(
        F.count_if(stored).alias("_stored"),
        F.max(micros(F.col("ts"))).alias("_hi"), F.min(micros(F.col("ts"))).alias("_lo"))
    m = job_metrics(events).select("job_id", F.col("queued_total").alias("_q"), F.col("done").alias("_d"), F.col("discarded").alias("_x"))
    size = stored_fetches(events).groupBy("job_id").agg(F.sum("bytes").alias("_bytes"))
    seconds = (F.col("_hi") - F.col("_lo")) / 1e6
    return (
        jobs.join(m, "job_id", "left").join(activity, "job_id", "left").join(size, "job_id", "left").select(
            "job_id", "name", "status",
            F.coalesce("_q", "urls_queued").alias("urls_queued"),
            F.coalesce("_d", "urls_fetched").alias("urls_fetched"),
            F.coalesce("_x", "urls_discarded").alias("urls_discarded"),
            F.coalesce("_bytes", F.lit(0)).alias("bytes_downloaded"),
            F.coalesce(F.when(seconds > 0, F.col("_stored") / seconds), F.lit(0.0)).alias("pages_per_second"))
    )
