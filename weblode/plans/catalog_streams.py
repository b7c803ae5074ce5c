"""Streaming part of the query catalogue: each query drains a stream and returns its table."""

from pyspark.sql import DataFrame, functions as F

from weblode.functions import urls as U
from weblode.operators.blocks import scratch_path, written
from weblode.operators.metrics import half_up
from weblode.plans import crawl, derived as D
from weblode.plans.catalog import _LIVE_SQL, _SESSIONS, _STATE, _sent, big, query
from weblode.sources import event_log
from weblode.streaming import folds, sink


FILES = 5
ROW_GROUP = 1 << 20
"""Bytes of a row group of such a file before compression, so that a micro-batch is read by many tasks."""
_written: dict = {}


def in_files(spark, sf, table: str, number: str) -> DataFrame:
    """A given table followed as a stream of ``FILES`` files, one a micro-batch; SQL expression ``number`` deals the rows out.

    The files are written once per session, one after the other."""
    at = (spark.sparkContext.applicationId, sf, table, number)
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    if at not in _written:
        _written[at] = dealt(df, number)
    return event_log.tail_events(spark, _written[at], df.schema, files_per_batch=1)


def dealt(df: DataFrame, number: str) -> str:
    """Folder with the rows in ``FILES`` files by ``number``."""
    folder = scratch_path(df.sparkSession, "files")
    numbered = df.withColumn("_file", F.expr(number))
    for i in range(FILES):
        numbered.where(F.col("_file") == i).drop("_file").coalesce(1).write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(folder)
    return folder


def live_log(spark, sf, derive=D.crawl_events) -> DataFrame:
    """The event table in order, as a log that grows."""
    n = D.events(spark, sf).agg(F.max("event_id") + 1).first()[0] or 1
    return derive(in_files(spark, sf, "events", f"least({FILES - 1}, floor(event_id * {FILES} / {n}))"))


@query("event_tail", "SELECT event_id AS seq, ts, event_type, user_id FROM events")
def event_tail(spark, sf):
    path = scratch_path(spark, "tail")
    sink.drain(live_log(spark, sf, lambda raw: raw).select(F.col("event_id").alias("seq"), "ts", "event_type", "user_id"), path)
    return sink.appended(spark, path)


@query("stream_job_filter", "SELECT seq, job_id, event_type FROM crawl_events WHERE job_id = 'job-2'", "crawl_events")
def stream_job_filter(spark, sf):
    path = scratch_path(spark, "job")
    sink.drain(folds.job_filter(live_log(spark, sf), "job-2").select("seq", "job_id", "event_type"), path)
    return sink.appended(spark, path)


@query("stream_live_metrics", _LIVE_SQL, "crawl_events")
def stream_live_metrics(spark, sf):
    path = scratch_path(spark, "metrics")
    sink.drain(live_log(spark, sf), path, transform=folds.live_metrics_step(path))
    return sink.last_batch(spark, path)


@query("stream_domain_stats", "SELECT job_id, domain, queued, done, avg_fetch_ms, active_worker FROM domain_stats", "domain_stats")
def stream_domain_stats(spark, sf):
    counts, fetches = scratch_path(spark, "domains"), scratch_path(spark, "fetches")
    log = live_log(spark, sf)
    both = [sink.start_keyed(folds.domain_counts(log), counts, ["job_id", "domain"], every=2),
            sink.start_keyed(folds.fetch_pairs(log, "60 DAYS"), fetches, ["job_id", "url"], "append", ["fetch_seq"], every=2)]
    for running in both:
        running.awaitTermination()
    return folds.domain_stats(sink.keyed(spark, counts, ["job_id", "domain"]), sink.keyed(spark, fetches, ["job_id", "url"], ["fetch_seq"]))


@query("stream_fetch_pairs", """SELECT f.job_id, f.url, f.seq AS fetch_seq, s.seq AS store_seq, f.fetch_duration_ms AS ms FROM crawl_events f JOIN crawl_events s
  ON f.job_id = s.job_id AND f.url = s.url AND abs(epoch_us(f.ts) - epoch_us(s.ts)) <= 172800000000
WHERE f.event_type = 'url_fetched' AND s.event_type = 'url_stored' AND f.fetch_duration_ms IS NOT NULL""", "crawl_events")
def stream_fetch_pairs(spark, sf):
    path = scratch_path(spark, "pairs")
    sink.drain(folds.fetch_pairs(live_log(spark, sf), "2 DAYS", "1 hour"), path)
    return sink.appended(spark, path).select("job_id", "url", "fetch_seq", "store_seq", "ms")


@query("stream_url_state", f"SELECT {_STATE} FROM url_state", "url_state")
def stream_url_state(spark, sf):
    path = scratch_path(spark, "state")
    sink.drain_keyed(folds.url_state(live_log(spark, sf)), path, ["job_id", "url"], every=2)
    return sink.keyed(spark, path, ["job_id", "url"])


@query("stream_bounded_url_state", "SELECT job_id, url, status, seq FROM url_state", "url_state")
def stream_bounded_url_state(spark, sf):
    path = scratch_path(spark, "bounded")
    with folds.use_rocksdb(spark):
        sink.drain_keyed(folds.bounded_url_state(live_log(spark, sf), 40 * 86_400), path, ["job_id", "url"], every=2)
    return sink.keyed(spark, path, ["job_id", "url"])


@query("stream_crawl_rate", """SELECT job_id, date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) AS pages,
  floor(count(*) / 3600.0::DOUBLE * 1e9::DOUBLE + 0.5) / 1e9::DOUBLE AS rate FROM crawl_events WHERE event_type = 'url_stored' GROUP BY 1, 2
HAVING epoch_us(date_trunc('hour', ts)::TIMESTAMP) + 3600000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM crawl_events WHERE event_type = 'url_stored') - 60000000""", "crawl_events")
def stream_crawl_rate(spark, sf):
    path = scratch_path(spark, "rate")
    sink.drain(folds.crawl_rate(live_log(spark, sf), "1 hour", 3600), path)
    return sink.appended(spark, path).withColumn("rate", half_up(F.col("rate"), 9))


_BEATS = "(SELECT max(epoch_us(ts)) // 1000 FROM full_log WHERE event_type <> 'worker_offline')"


@query("stream_worker_sessions", f"SELECT * FROM ({_SESSIONS}) x WHERE epoch_us(last_beat) + 3600000000 <= {_BEATS} * 1000 - 60000000", "full_log")
def stream_worker_sessions(spark, sf):
    path = scratch_path(spark, "sessions")
    sink.drain(folds.worker_sessions(live_log(spark, sf, D.full_log), "1 hour"), path)
    return sink.appended(spark, path)


@query("stream_worker_liveness", f"""SELECT worker_id, event_type, ms FROM (
  SELECT worker_id, 'worker_online' AS event_type, epoch_us(first_beat) // 1000 AS ms FROM ({_SESSIONS}) a
  UNION ALL SELECT worker_id, 'worker_offline', epoch_us(last_beat) // 1000 + 3600000 FROM ({_SESSIONS}) b) t
WHERE event_type = 'worker_online' OR ms <= {_BEATS} - 60000""", "full_log")
def stream_worker_liveness(spark, sf):
    path = scratch_path(spark, "liveness")
    with folds.use_rocksdb(spark):
        sink.drain(folds.worker_liveness(live_log(spark, sf, D.full_log), 3600), path)
    return sink.appended(spark, path)


@query("stream_dedup", """SELECT job_id, url FROM crawl_events WHERE event_type = 'url_queued' GROUP BY ALL""", "crawl_events")
def stream_dedup(spark, sf):
    path = scratch_path(spark, "dedup")
    queued = live_log(spark, sf).where(F.col("event_type") == "url_queued").select("job_id", "url", "ts")
    sink.drain(folds.dedup(queued, ("job_id", "url")), path)
    return sink.appended(spark, path).select("job_id", "url")


_PAGE_FILE = f"least({FILES - 1}, page_id * {FILES} // (SELECT max(page_id) + 1 FROM pages))"


@query("stream_admission", f"""SELECT page_id AS parent_seq, pos, job_id, url, coalesce(reason, CASE WHEN rn > 1 THEN 'duplicate' ELSE 'queued' END) AS outcome FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, url, reason IS NULL ORDER BY known DESC, {_PAGE_FILE}, depth, page_id, pos) AS rn FROM (
    SELECT page_id, pos, job_id, url, depth, reason, false AS known FROM judged_links
    UNION ALL SELECT NULL, NULL, job_id, url, NULL, NULL, true FROM (SELECT DISTINCT job_id, url FROM judged_links WHERE pos = 5)) k) r
WHERE page_id IS NOT NULL""", "judged_links")
def stream_admission(spark, sf):
    path = scratch_path(spark, "admission")
    links = written(crawl.classified_links(D.link_occurrences(D.pages(spark, sf)), D.job_settings(D.events(spark, sf)), D.SUFFIXES), "links")
    n = D.pages(spark, sf).agg(F.max("page_id") + 1).first()[0] or 1
    live = event_log.tail_events(spark, dealt(links, f"least({FILES - 1}, floor(parent_seq * {FILES} / {n}))"), links.schema, files_per_batch=1)
    seen = links.where(F.col("pos") == 5).select("job_id", U.url_hash("url").alias("url_hash"))
    with folds.use_rocksdb(spark):
        sink.drain(folds.admission(live, seen), path)
    return sink.appended(spark, path).select(
        "parent_seq", big("pos"), "job_id", "url", F.coalesce("reason", F.lit("queued")).alias("outcome"))


@query("stream_discards", """SELECT job_id, url, parent_url, depth, discard_reason AS reason, discard_detail AS detail, ts AS discarded_at, seq, discard_stage
FROM crawl_events WHERE event_type = 'url_discarded'""", "crawl_events")
def stream_discards(spark, sf):
    path = scratch_path(spark, "discards")
    sink.drain(folds.discards(live_log(spark, sf)), path)
    return sink.appended(spark, path)


@query("stream_late_events", f"""SELECT event_id AS seq, ts, coalesce(epoch_us(ts) < (
  SELECT max(epoch_us(ts)) // 1000 - 864000000 FROM events o WHERE o.event_id % {FILES} < e.event_id % {FILES}) * 1000, false) AS late FROM events e""")
def stream_late_events(spark, sf):
    path = scratch_path(spark, "late")
    # Every file has events of all days; ten days are allowed.
    live = D.crawl_events(in_files(spark, sf, "events", f"event_id % {FILES}")).select("seq", "ts")
    sink.drain(folds.with_watermark(live, "10 days"), path, transform=folds.late_split_step(path), parts=["late"])
    return sink.appended(spark, path).select("seq", "ts", F.col("late").cast("boolean").alias("late"))


@query("stream_event_encode", """SELECT seq, ts, job_id, event_type, url, depth, discard_stage, worker_id FROM crawl_events""", "crawl_events")
def stream_event_encode(spark, sf):
    """Events written in wire form as they come, read back as a log."""
    path = scratch_path(spark, "encoded")
    # A micro-batch is one file, which few tasks read; encoding costs far more than moving the rows as they are given.
    spread = lambda raw: D.crawl_events(raw.repartition(spark.sparkContext.defaultParallelism))
    event_log.start_encoded(_sent(live_log(spark, sf, spread)), path).awaitTermination()
    decoded = event_log.decode_events(sink.appended(spark, path), keep=("seq",))
    return event_log.as_log(event_log.valid_events(decoded)).select("seq", "ts", "job_id", "event_type", "url", "depth", "discard_stage", "worker_id")
