"""Stream equals batch over several files, and sinks survive a replay."""

import pytest
from compare import SMALL
from pyspark.sql import functions as F

from weblode.functions import urls as U
from weblode.operators import events as E, frontier as Q, metrics as M
from weblode.operators.blocks import scratch_path, written
from weblode.plans import crawl, derived as D
from weblode.sources import event_log, store
from weblode.streaming import folds, sink

FILES = 5


def split_by_order(spark, df, column, folder):
    """The table in ``FILES`` files, written one after the other in order of ``column``."""
    edges = df.approxQuantile(column, [i / FILES for i in range(FILES + 1)], 0.0)
    for i in range(FILES):
        part = df.where((F.col(column) >= edges[i] if i == 0 else F.col(column) > edges[i]) & (F.col(column) <= edges[i + 1]))
        part.coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture(scope="module")
def raw(spark):
    return D.events(spark, SMALL)


@pytest.fixture(scope="module")
def folder(spark, raw):
    path = scratch_path(spark, "events")
    split_by_order(spark, raw, "event_id", path)
    return path


@pytest.fixture
def live(spark, raw, folder):
    return D.crawl_events(event_log.tail_events(spark, folder, raw.schema, files_per_batch=1))


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def batches(spark, path):
    return spark.read.parquet(f"{path}/data").select("batch").distinct().count()


def test_tail(spark, raw, live):
    path = scratch_path(spark, "t")
    sink.drain(folds.job_filter(live, "job-1"), path)
    assert rows(sink.appended(spark, path)) == rows(D.crawl_events(raw).where("job_id = 'job-1'"))
    assert batches(spark, path) == FILES


def test_live_metrics(spark, raw, live):
    path = scratch_path(spark, "t")
    sink.drain(live, path, transform=folds.live_metrics_step(path))
    assert rows(sink.last_batch(spark, path)) == rows(M.live_metrics(D.crawl_events(raw)))


def test_domain_stats(spark, raw, live):
    counts, fetches = scratch_path(spark, "t"), scratch_path(spark, "t")
    sink.drain_keyed(folds.domain_counts(live), counts, ["job_id", "domain"], every=3)
    sink.drain_keyed(folds.fetch_pairs(live, "60 DAYS"), fetches, ["job_id", "url"], "append", ["fetch_seq"], every=3)
    got = folds.domain_stats(sink.keyed(spark, counts, ["job_id", "domain"]), sink.keyed(spark, fetches, ["job_id", "url"], ["fetch_seq"]))
    assert rows(got) == rows(M.domain_stats(D.crawl_events(raw)).drop("queue_shard", "queue_name"))


def test_fetches_wait_for_their_store_and_are_forgotten(spark):
    """Either side may come first and files later; after the wait the state is freed, and a partner too late finds nothing."""
    base = "timestamp_ntz'2024-01-01 00:00:00'"
    def event(seq, minute, kind, url):
        return (seq, minute, kind, url, 5.0 if kind == "url_fetched" else None)
    files = [[event(1, 0, "url_fetched", "a"), event(2, 1, "url_fetched", "b"), event(3, 2, "url_stored", "c")],
             [event(4, 20, "url_stored", "a"), event(5, 25, "url_fetched", "c")],
             [event(6, 200, "url_fetched", "z")], [event(7, 201, "url_stored", "b"), event(8, 230, "url_stored", "z")], [event(9, 400, "url_fetched", "y")]]
    folder, path = scratch_path(spark, "in"), scratch_path(spark, "t")
    for some in files:
        df = spark.createDataFrame(some, "seq bigint, minute bigint, event_type string, url string, fetch_duration_ms double")
        df = df.selectExpr("seq", f"{base} + make_dt_interval(0, 0, minute, 0) AS ts", "event_type", "'j' AS job_id", "url", "'d' AS domain", "fetch_duration_ms")
        df.coalesce(1).write.mode("append").parquet(folder)
    stream = event_log.tail_events(spark, folder, df.schema, files_per_batch=1)
    query = sink.start(folds.fetch_pairs(stream, "1 HOUR", "10 minutes"), path)
    query.awaitTermination()
    assert sorted((r.url, r.fetch_seq, r.store_seq) for r in sink.appended(spark, path).collect()) == [("a", 1, 4), ("c", 5, 3), ("z", 6, 8)]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # Left are the newest of either side, which the watermark (of the slower side, at minute 220) has not passed by an hour.
    assert max(held) > 4 and held[-1] == 4


def test_url_state(spark, raw, live):
    path = scratch_path(spark, "t")
    sink.drain_keyed(folds.url_state(live), path, ["job_id", "url"], every=2)
    assert rows(sink.keyed(spark, path, ["job_id", "url"])) == rows(E.url_state(D.crawl_events(raw)))


def test_keyed_table_stays_small_over_fifty_batches(spark):
    path = scratch_path(spark, "t")
    write = sink.keyed_writer(path, ["k"], ["at"], every=8)
    want = {}
    for batch in range(50):
        data = [((batch * 7 + i) % 13, (batch * 31) % 50 + i, f"{batch}-{i}") for i in range(5)]
        for k, at, v in data:
            want[k] = max(want.get(k, (-1, -1, "")), (at, batch, v))
        df = spark.createDataFrame(data, "k int, at int, v string").coalesce(1)
        write(df, batch)
        if batch in (15, 16, 31):
            write(df, batch)  # a replay, with and without a merge
    got = {r.k: (r.at, r.v) for r in sink.keyed(spark, path, ["k"], ["at"]).collect()}
    assert got == {k: (at, v) for k, (at, _, v) in want.items()}
    assert len(sink._finished(spark, f"{path}/base")) <= 2 and len(sink._finished(spark, f"{path}/data")) <= 16
    assert sink._unmerged(spark, path)[1].count() <= 13 + 8 * 5


def test_bounded_url_state(spark, raw, live):
    path = scratch_path(spark, "t")
    with folds.use_rocksdb(spark):
        sink.drain(folds.bounded_url_state(live, 40 * 86_400), path, "update")
    assert rows(sink.latest(spark, path, ["job_id", "url"])) == rows(E.url_state(D.crawl_events(raw)).select("job_id", "url", "status", "seq"))


def test_worker_sessions_and_liveness(spark, raw, folder):
    path, other = scratch_path(spark, "t"), scratch_path(spark, "t")
    live = D.full_log(event_log.tail_events(spark, folder, raw.schema, files_per_batch=1))
    sink.drain(folds.worker_sessions(live, "3 hours"), path)
    whole = M.worker_sessions(D.full_log(raw), 3 * 3600)
    newest = D.full_log(raw).where("event_type <> 'worker_offline'").agg(F.max(E.micros(F.col("ts")))).first()[0] // 1000 * 1000
    want = whole.where(E.micros(F.col("last_beat")) + 3 * 3_600_000_000 <= newest - 60_000_000)
    assert 0 < want.count() < whole.count() and rows(sink.appended(spark, path)) == rows(want)
    with folds.use_rocksdb(spark):
        sink.drain(folds.worker_liveness(live, 3 * 3600), other)
    seen = sink.appended(spark, other)
    online = seen.where("event_type = 'worker_online'").select("worker_id", "ms")
    assert rows(online) == rows(whole.select("worker_id", F.floor(E.micros(F.col("first_beat")) / 1000).alias("ms")))
    offline = {(r.worker_id, r.ms) for r in seen.where("event_type = 'worker_offline'").collect()}
    ends = {(r.worker_id, r.ms) for r in whole.select("worker_id", (F.floor(E.micros(F.col("last_beat")) / 1000) + 3 * 3_600_000).alias("ms")).collect()}
    assert offline <= ends and len(ends - offline) <= 8


def test_crawl_rate_windows_close(spark, raw, live):
    path = scratch_path(spark, "t")
    query = sink.start(folds.crawl_rate(live, "6 hours", 6 * 3600), path)
    query.awaitTermination()
    stored = D.crawl_events(raw).where("event_type = 'url_stored'")
    want = stored.groupBy("job_id", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("pages"))
    newest = stored.agg(F.max(E.micros(F.col("ts")))).first()[0] // 1000 * 1000
    closed = want.where(F.unix_micros(F.col("w.end").cast("timestamp")) <= newest - 60_000_000).select("job_id", F.col("w.start").alias("window_start"), "pages")
    got = sink.appended(spark, path).select("job_id", "window_start", "pages")
    assert rows(got) == rows(closed) and got.count() < want.count()
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= want.count() - closed.count()


def test_dedup(spark, raw, live):
    path, other = scratch_path(spark, "t"), scratch_path(spark, "t")
    queued = live.where("event_type = 'url_queued'").select("job_id", "url", "ts")
    want = rows(D.crawl_events(raw).where("event_type = 'url_queued'").select("job_id", "url").distinct())
    sink.drain(folds.dedup(queued, ("job_id", "url")), path)
    assert rows(sink.appended(spark, path).select("job_id", "url")) == want
    sink.drain(folds.dedup(queued, ("job_id", "url"), late="40 days"), other)
    assert rows(sink.appended(spark, other).select("job_id", "url")) == want


def test_admission_over_batches(spark):
    """Batch by batch as ``frontier.admit`` with all that was admitted before; the state begins with what is given as seen."""
    pages = D.pages(spark, SMALL)
    settings = D.job_settings(D.events(spark, SMALL))
    links = written(crawl.classified_links(D.link_occurrences(pages), settings, D.SUFFIXES), "links")
    folder, path = scratch_path(spark, "pages"), scratch_path(spark, "t")
    split_by_order(spark, links, "parent_seq", folder)
    known = links.where("pos = 5").select("job_id", U.url_hash("url").alias("url_hash"))
    stream = event_log.tail_events(spark, folder, links.schema, files_per_batch=1)
    with folds.use_rocksdb(spark):
        sink.drain(folds.admission(stream, known), path)
    assert batches(spark, path) >= FILES
    edges = links.approxQuantile("parent_seq", [i / FILES for i in range(FILES + 1)], 0.0)
    seen, want = known, []
    for i in range(FILES):
        part = links.where((F.col("parent_seq") >= edges[i] if i == 0 else F.col("parent_seq") > edges[i]) & (F.col("parent_seq") <= edges[i + 1]))
        out = written(Q.admit(part, seen), "out")
        want += rows(out)
        fresh = spark.createDataFrame(out.where("queued").select("job_id", "url_hash").collect(), "job_id string, url_hash string")
        seen = seen.unionByName(fresh)
    assert rows(sink.appended(spark, path)) == sorted(want)


def test_late_rows_go_aside(spark, raw):
    folder, path = scratch_path(spark, "late"), scratch_path(spark, "t")
    log = D.crawl_events(raw).select("seq", "ts")
    for i in range(FILES):
        log.where(F.col("seq") % FILES == i).coalesce(1).write.mode("append").parquet(folder)
    stream = folds.with_watermark(event_log.tail_events(spark, folder, log.schema, files_per_batch=1), "1 day")
    step = folds.late_split_step(path)
    sink.drain(stream, path, transform=step, parts=["late"])
    got = {r.seq: r.late == "true" for r in sink.appended(spark, path).collect()}  # a folder name
    known = {r.seq: r.us for r in log.select("seq", E.micros(F.col("ts")).alias("us")).collect()}
    newest, want = None, {}
    for i in range(FILES):
        part = {s: us for s, us in known.items() if s % FILES == i}
        want |= {s: newest is not None and us < newest // 1000 * 1000 - 86_400_000_000 for s, us in part.items()}
        newest = max([*part.values(), newest or 0])
    assert got == want and len(set(want.values())) == 2
    again = step(log.where(F.col("seq") % FILES == 3), 3)
    assert {r.seq: r.late for r in again.collect()} == {s: late for s, late in want.items() if s % FILES == 3}


def test_replayed_batch_changes_nothing(spark, raw, live):
    path = scratch_path(spark, "t")
    step = folds.live_metrics_step(path)
    sink.drain(live, path, transform=step)
    before = rows(sink.last_batch(spark, path))
    last = D.crawl_events(raw.where(F.col("event_id") > raw.approxQuantile("event_id", [(FILES - 1) / FILES], 0.0)[0]))
    again = step(last, FILES - 1).collect()
    assert sorted(r.job_id for r in again) == sorted({r.job_id for r in D.crawl_events(raw).select("job_id").distinct().collect()})
    assert rows(sink.last_batch(spark, path)) == before and sorted(map(repr, again)) == sorted(
        map(repr, sink.last_batch(spark, path).select(*again[0].__fields__).collect()))


def test_store_ignores_known_pages(spark):
    path = scratch_path(spark, "store")
    pages = D.stored_pages(D.pages(spark, SMALL))
    store.append_pages(pages.where("length(url) % 2 = 0"), path)
    store.append_pages(pages.unionByName(pages), path)
    table = store.read_pages(spark, path)
    assert table.count() == pages.count() == table.select("id").distinct().count()


def test_repeated_batches_change_nothing(spark):
    drops = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("a", "u3")], "job_id string, url string")
    path = scratch_path(spark, "drops")
    for _ in range(2):
        store.append_discards(drops, path, batch="1")
        store.append_discards(drops.where("job_id = 'a'"), path, batch="2")
    assert sorted((r.job_id, r.url, r.batch) for r in spark.read.parquet(path).collect()) == [
        ("a", "u1", 1), ("a", "u1", 2), ("a", "u3", 1), ("a", "u3", 2), ("b", "u2", 1)]


def test_known_pages_are_read_by_job(spark):
    path = scratch_path(spark, "store")
    pages = D.stored_pages(D.pages(spark, SMALL))
    store.append_pages(pages, path)
    kept = store.read_pages(spark, path).select("job_id", "id").where(F.col("job_id").isin("job-1"))
    assert "PartitionFilters: [" in kept._jdf.queryExecution().toString() and "job_id" in kept._jdf.queryExecution().toString().split("PartitionFilters")[1][:80]


def test_crawl_step_tables(spark):
    pages = D.pages(spark, SMALL)
    out = crawl.crawl_step(D.fetches(pages), D.robots(pages), D.job_settings(D.events(spark, SMALL)), D.SUFFIXES)
    stored, drops = out["pages"].count(), out["discards"]
    assert stored + drops.where("discard_stage = 'fetch'").count() == pages.count()
    links = out["links"].count()
    assert out["frontier"].count() + drops.where("discard_stage = 'link'").count() == links
    assert out["frontier"].where("job_id = 'job-3'").count() <= 50


def test_bounded_url_state_costs_few_calls_of_the_state(spark, raw):
    """A micro-batch reads and writes the state once per bucket, however many URLs it holds."""
    import pandas as pd

    class Held:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

        def clear(self):
            self.calls += 1
            self.value = None

    class Handle:
        def __init__(self):
            self.held, self.timers = Held(), []

        def getValueState(self, name, schema):
            return self.held

        def registerTimer(self, ms):
            self.timers.append(ms)

    class At:
        def __init__(self, ms):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms

    handle, fold = Handle(), folds._BoundedState(1000)
    fold.init(handle)

    def step(*events):
        frames = iter([pd.DataFrame([e], columns=["url", "rank", "seq", "status", "ms"]) for e in events])
        return sorted(map(tuple, pd.concat(fold.handleInputRows(("j", 0), frames, None)).itertuples(index=False)))

    many = [(f"u{i}", 0, i, "queued", 100 + i) for i in range(50)]
    assert len(step(*many)) == 50 and handle.held.calls == 2 and handle.timers == [1100]
    assert step(("u0", 4, 60, "done", 500), ("u0", 1, 61, "fetching", 900), ("u1", 0, 1, "queued", 90)) == [("j", "u0", "done", 60)]
    assert step(("u9", 0, 9, "queued", 99)) == []
    assert handle.held.calls == 6 and handle.timers == [1100]  # u1 is due at 1101 still
    assert list(fold.handleExpiredTimer(("j", 0), At(1102), At(1102))) == []  # u1 and u2, but not u0
    assert handle.timers == [1100, 1103]
    assert step(("u2", 1, 70, "fetching", 1200), ("u0", 1, 71, "fetching", 1200)) == [("j", "u2", "fetching", 70)]
    fold.handleExpiredTimer(("j", 0), At(9999), At(9999))
    assert handle.held.value is None


def test_a_micro_batch_is_encoded_by_many_tasks(spark, tmp_path):
    """Each micro-batch of the encoder is one file; its rows are spread over all cores."""
    import datetime

    import pyarrow.parquet as pq

    from weblode.plans.catalog import QUERIES
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=i), i % 9, ("signup", "view", "error")[i % 3], 1.0, '{"k": 1}') for i in range(400)]
    pq.write_table(spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").toArrow(),
                   tmp_path / "events.parquet")
    out = QUERIES["stream_event_encode"](spark, str(tmp_path))
    assert out.count() == 400 and len(out.inputFiles()) >= 5 * min(4, spark.sparkContext.defaultParallelism)
