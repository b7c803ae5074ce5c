"""Event folds against a sequential reducer, on shuffled input."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F, types as T

from weblode.operators import events as E, metrics as M, views as V
from weblode.schema import URL_STATUSES, WORKER_STATE
from weblode.sources import event_log

SCHEMA = ("seq bigint, ts timestamp_ntz, job_id string, event_type string, status string, worker_id string, domain string, url string, "
          "parent_url string, source_url string, target_url string, depth int, status_code int, content_type string, links_found bigint, "
          "fetch_duration_ms double, content_length bigint, discard_reason string, discard_detail string, discard_stage string, "
          "metrics map<string,double>")
KINDS = {"url_queued": "queued", "url_fetching": "fetching", "url_fetched": "fetched", "url_parsing": "parsing", "url_stored": "done",
         "url_discarded": "discarded", "url_error": "error"}


def make(n=1500, seed=7):
    rng, t = random.Random(seed), datetime(2024, 1, 1)
    out = []
    for seq in range(n):
        t += timedelta(seconds=rng.choice([0, 1, 5, 40]), microseconds=rng.randrange(1000))
        kind = rng.choice(list(KINDS))
        url = "https://hot.example/p" if rng.random() < 0.34 else f"https://h{rng.randrange(6)}.example/{rng.randrange(20)}"
        job = "__system__" if rng.random() < 0.03 else f"j{rng.randrange(3)}"
        stage = rng.choice(["fetch", "link"]) if kind == "url_discarded" else None
        metrics = {rng.choice(["queued_total", "done", "frontier_depth"]): float(rng.randrange(100))} if rng.random() < 0.02 else None
        out.append((seq, t, job, kind, KINDS[kind], f"w{rng.randrange(4)}", url.split("/")[2], url, "p", "s" if kind == "url_queued" else None,
                    url if kind == "url_queued" else None, rng.randrange(5), rng.choice([None, 200, 404]), None, None,
                    float(rng.randrange(500)) if kind == "url_fetched" else None, 10 if kind == "url_fetched" else None, stage and "duplicate", None, stage, metrics))
    return out


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def log(spark, rows):
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    return spark.createDataFrame(mixed, SCHEMA).repartition(5).cache()


def col(name):
    return [c.split()[0] for c in SCHEMA.split(", ")].index(name)


def test_url_state(rows, log):
    state = {}
    for r in rows:
        key, rank = (r[2], r[7]), URL_STATUSES.index(r[4])
        if key not in state or rank >= URL_STATUSES.index(state[key][4]):
            state[key] = r
    got = {(r.job_id, r.url): (r.seq, r.status, r.status_code, r.depth) for r in E.url_state(log).collect()}
    assert got == {k: (r[0], r[4], r[12], r[11]) for k, r in state.items()}


def test_late_duplicate_moves_a_stored_url_only_with_link_stage(spark):
    base = make(1)[0]
    def event(seq, kind, stage=None):
        r = list(base)
        r[0], r[2], r[3], r[4], r[19], r[20] = seq, "j", kind, KINDS[kind], stage, None
        return tuple(r)
    log = spark.createDataFrame([event(1, "url_queued"), event(2, "url_stored"), event(3, "url_discarded", "link")], SCHEMA)
    assert E.url_state(log).first().status == "discarded"
    assert E.url_state(log, ignore_link_stage=True).first().status == "done"


def test_live_metrics(rows, log):
    counters = {"url_queued": "queued_total", "url_stored": "done", "url_discarded": "discarded", "url_error": "error"}
    want = defaultdict(lambda: dict.fromkeys(["queued_total", "done", "discarded", "error", "frontier_depth"], 0))
    for r in rows:
        if r[2] != "__system__":
            m = want[r[2]]
            if r[3] in counters:
                m[counters[r[3]]] += 1
            m.update({k: int(v) for k, v in (r[20] or {}).items()})
    got = {r.job_id: {k: r[k] for k in ("queued_total", "done", "discarded", "error", "frontier_depth")} for r in M.live_metrics(log).collect()}
    assert got == dict(want)


@pytest.mark.parametrize("limit", [None, 25])
@pytest.mark.parametrize("blocks", [1, 16])
def test_live_graph_nodes(rows, log, limit, blocks):
    nodes = defaultdict(dict)
    for r in rows:
        graph, url, status, code = nodes[r[2]], r[7], r[4], r[12]
        if limit is not None and len(graph) >= limit:
            continue
        if url not in graph:
            graph[url] = [r[11], status, code]
        elif graph[url][1] != status:
            graph[url][1:] = [status, code if code is not None else graph[url][2]]
    got = {(r.job_id, r.url): [r.depth, r.status, r.status_code] for r in E.live_graph_nodes(log, limit, blocks).collect()}
    assert got == {(j, u): v for j, g in nodes.items() for u, v in g.items()}


def test_active_domains(rows, log):
    active = {}
    for r in rows:
        if r[2] == "__system__":
            continue
        active.setdefault((r[2], r[6]), None)
        if r[3] == "url_fetching":
            active[r[2], r[6]] = r[5]
        if r[3] in ("url_stored", "url_discarded"):
            active[r[2], r[6]] = None
    assert {(r.job_id, r.domain): r.active_worker for r in E.active_domains(log).collect()} == active
    stats = {(r.job_id, r.domain): r for r in M.domain_stats(log).collect()}
    for key, r in stats.items():
        stored = [x[7] for x in rows if (x[2], x[6]) == key and x[3] == "url_stored"]
        last = {x[7]: x[15] for x in rows if x[2] == key[0] and x[3] == "url_fetched"}
        times = [int(last[url]) for url in set(stored) if url in last]
        assert r.active_worker == active[key] and r.done == len(stored)
        assert r.avg_fetch_ms == pytest.approx(round(sum(times) / len(times), 1) if times else 0, abs=0.051)


def test_retention_and_history(rows, log):
    for n in (1, 37, 1499, 5000):
        for blocks in (1, 16):
            assert sorted(r.seq for r in E.retain_latest(log, n, blocks).collect()) == list(range(1500))[-n:]
    got = sorted(r.seq for r in E.history(log, "j1", 100, 50).collect())
    assert got == [r[0] for r in rows[100:150] if r[2] == "j1"]


def test_crawl_rate_and_timeline(rows, log):
    stored = defaultdict(list)
    for r in rows:
        if r[3] == "url_stored" and r[2] != "__system__":
            stored[r[2]].append(r)
    got = {(r.job_id, r.seq): r.rate for r in E.crawl_rate(log, 20).collect()}
    for job, events in stored.items():
        for before, r in list(zip([None, *events], events))[-20:]:
            gap = (r[1] - before[1]).total_seconds() if before else 0
            assert got.pop((job, r[0])) == pytest.approx(1 / gap if gap else 0)
    assert not got
    lines = defaultdict(list)
    for r in rows:
        for key in {r[7], r[9]} - {None}:
            lines[r[2], key].append(r[0])
    timeline = defaultdict(list)
    for r in E.url_timeline(log, 10).collect():
        timeline[r.job_id, r.key_url].append(r.seq)
    assert {k: sorted(v) for k, v in timeline.items()} == {k: v[-10:] for k, v in lines.items()}


def test_sessions_and_liveness(rows, log):
    gap, sessions, last = 30.0, defaultdict(list), {}
    for r in rows:
        w = r[5]
        if w not in last or (r[1] - last[w]).total_seconds() >= gap:
            sessions[w].append([r[1], r[1], 0])
        sessions[w][-1][1], last[w] = r[1], r[1]
        sessions[w][-1][2] += 1
    got = defaultdict(list)
    for r in M.worker_sessions(log, 30).orderBy("first_beat").collect():
        got[r.worker_id].append([r.first_beat, r.last_beat, r.beats])
    assert got == sessions
    alive = {r.worker_id: r.alive for r in M.worker_liveness(log, 30).collect()}
    assert alive == {w: (rows[-1][1] - t).total_seconds() <= 30 for w, t in last.items()}


def test_worker_signed_off_is_not_alive(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, t, "worker_heartbeat", "a"), (2, t, "worker_offline", "a"), (3, t, "worker_offline", "b"), (4, t, "worker_online", "b")]
    df = spark.createDataFrame(rows, "seq bigint, ts timestamp_ntz, event_type string, worker_id string")
    assert {r.worker_id: r.alive for r in M.worker_liveness(df).collect()} == {"a": False, "b": True}


def test_robots_as_of(spark):
    hour = 3600 * 10**6
    snaps = [("h", 0, "s0"), ("h", 5 * hour, "s5"), ("h", 5 * hour + 10, "s6")]
    asks = [("h", 0), ("h", hour - 1), ("h", hour), ("h", 5 * hour + 9), ("h", 5 * hour + 10), ("h", 6 * hour + 9), ("h", 6 * hour + 10), ("x", 1)]
    out = V.robots_as_of(spark.createDataFrame(asks, "netloc string, at_us bigint"),
                         spark.createDataFrame(snaps, "netloc string, at_us bigint, robots_txt string")).collect()
    got = {(r.netloc, r.at_us): (r.robots_txt, r.needs_refresh) for r in out}
    assert [got[a] for a in asks] == [("s0", False), ("s0", False), (None, True), ("s5", False), ("s6", False), ("s6", False), (None, True), (None, True)]


def test_labels(spark):
    df = spark.createDataFrame([("url_stored", "wrong_domain"), ("job_failed_hard_now", None)], "event_type string, discard_reason string")
    assert [(r.event_label, r.reason_label) for r in E.event_labels(df).collect()] == [("✓ STORE", "DOMAIN"), ("JOB FAILED_HARD_NOW", None)]


def test_job_status_and_overview_fallback(spark, log):
    jobs = spark.createDataFrame([("a", "created"), ("b", "created"), ("c", "paused")], "job_id string, status string")
    moves = spark.createDataFrame([(1, "a", "job_started"), (2, "b", "job_started"), (3, "b", "job_completed"), (4, "c", "job_paused")],
                                  "seq bigint, job_id string, event_type string")
    assert {r.job_id: r.status for r in M.job_status(jobs, moves).collect()} == {"a": "running", "b": "completed", "c": "paused"}
    table = spark.createDataFrame([("j0", "n", "s", 1, 2, 3), ("zz", "n", "s", 1, 2, 3)],
                                  "job_id string, name string, status string, urls_queued bigint, urls_fetched bigint, urls_discarded bigint")
    out = {r.job_id: r for r in M.job_overview(table, log).collect()}
    assert (out["zz"].urls_queued, out["zz"].urls_fetched, out["zz"].bytes_downloaded, out["zz"].pages_per_second) == (1, 2, 0, 0.0)
    assert out["j0"].urls_fetched > 2 and out["j0"].pages_per_second > 0


def test_wire_round_trip(spark, log):
    typed = log.withColumnRenamed("ts", "timestamp").withColumn("event_id", F.col("seq").cast("string"))
    flat = event_log.encode_events(typed)
    back = event_log.valid_events(event_log.decode_events(flat))
    names = ["event_id", "event_type", "job_id", "timestamp", "url", "depth", "status_code", "fetch_duration_ms", "status", "discard_reason", "metrics"]
    key = lambda r: int(r[0])
    assert sorted(map(tuple, back.select(*names).collect()), key=key) == sorted(map(tuple, typed.select(*names).collect()), key=key)
    assert back.count() == 1500


def test_wire_rejects(spark):
    good = {"event_type": "url_stored", "job_id": "12", "url": "true"}
    bad = [dict(good, event_type="bogus"), dict(good, depth="x"), {"event_type": "url_stored"}, dict(good, status="lost"), dict(good, timestamp="noon")]
    df = spark.createDataFrame([(m,) for m in [good, *bad]], "data map<string,string>")
    decoded = event_log.decode_events(df)
    kept = event_log.valid_events(decoded).collect()
    assert len(kept) == 1 and kept[0].job_id == "12" and kept[0].url == "true"
    assert sorted(r.error for r in event_log.invalid_events(decoded).collect()) == [
        "depth malformed", "event_type unknown", "job_id missing", "status unknown", "timestamp malformed"]


def wire(**fields):
    base = dict.fromkeys([c.split()[0] for c in SCHEMA.split(", ")])
    return tuple({**base, "job_id": "j", "ts": datetime(2024, 1, 1), **fields}.values())


def test_fetch_figures_come_from_fetch_events(spark):
    """Stored events carry neither time nor size; a seed is queued without host, shard or worker."""
    url, other = "https://h.example/a", "https://h.example/b"
    log = spark.createDataFrame([
        wire(seq=1, event_type="url_queued", status="queued", url=url, depth=0),
        wire(seq=2, event_type="url_fetched", status="fetched", url=url, domain="h.example", worker_id="w1", fetch_duration_ms=40.0, content_length=7),
        wire(seq=3, event_type="url_fetched", status="fetched", url=url, domain="h.example", worker_id="w1", fetch_duration_ms=80.5, content_length=9),
        wire(seq=4, event_type="url_stored", status="done", url=url, domain="h.example", worker_id="w2"),
        wire(seq=5, event_type="url_fetched", status="fetched", url=other, domain="h.example", worker_id="w1", fetch_duration_ms=999.0, content_length=999),
        wire(seq=6, event_type="url_queued", status="queued", url="https://s.example:8080/", depth=0),
    ], SCHEMA)
    stats = {r.domain: r for r in M.domain_stats(log).collect()}
    assert stats["h.example"].avg_fetch_ms == 80.0 and stats["h.example"].done == 1
    assert {r.worker_id: r.bytes_downloaded for r in M.worker_stats(log).collect()} == {"w1": 0, "w2": 9}
    assert M.job_latency(log).first().latency_sum == 80.5
    pending = M.pending_frontier(log).collect()
    assert [(r.url, r.domain) for r in pending] == [("https://s.example:8080/", "s.example:8080")]
    assert M.job_metrics(log).first().frontier_depth == len(pending)


def test_worker_state_must_be_an_object(spark):
    raw = spark.createDataFrame([(1, {"event_type": "url_queued", "job_id": "j", "worker_state": "not json"}),
                                 (2, {"event_type": "url_queued", "job_id": "j", "worker_state": "[1]"}),
                                 (3, {"event_type": "url_queued", "job_id": "j", "worker_state": '{"status": "idle"}'}),
                                 (4, {"event_type": "url_queued", "job_id": "j"})], "n int, data map<string,string>")
    got = {r.n: r.error for r in event_log.decode_events(raw, keep=["n"]).collect()}
    assert got == {1: "worker_state malformed", 2: "worker_state malformed", 3: None, 4: None}


def test_retention_keeps_the_newest(spark):
    df = spark.range(1000).selectExpr("id AS seq", "id * 2 AS x").union(spark.sql("SELECT CAST(NULL AS bigint), 1L"))
    for n in (0, 1, 37, 500, 999, 1000, 1001, 5000):
        got = sorted((r.seq is not None, r.seq or 0) for r in E.retain_latest(df, n, blocks=16).collect())
        assert len(got) == min(n, 1001) and [s for ok, s in got if ok] == list(range(1000))[max(0, 1000 - n):]


def test_worker_states_are_the_last_reports(spark):
    """A beat after a stored page does not touch the status; a state replaces the one before whole; a sign-off reports none."""
    state = lambda status, url, done: ("w1", "h", 7, url, None, status, done, None, 5, None, None)
    rows = [(1, "w1", "worker_online", "__system__", None, state("idle", None, 0)), (2, "w1", "worker_busy", "__system__", None, state("busy", "u", None)),
            (3, "w1", "url_stored", "j", "u", None), (5, "w1", "worker_idle", "__system__", None, state("idle", None, 4)),
            (6, "w1", "url_error", "j", "v", None), (4, "w2", "url_stored", "j", "x", None), (7, "w1", "worker_offline", "__system__", None, None),
            (8, None, "worker_heartbeat", "__system__", None, state("busy", "u", 9))]
    df = spark.createDataFrame(rows, T.StructType.fromDDL("seq bigint, worker_id string, event_type string, job_id string, url string").add("worker_state", WORKER_STATE))
    df = df.withColumns({"ts": F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, seq)"), "domain": F.lit("d"),
                         "fetch_duration_ms": F.lit(None).cast("double"), "content_length": F.lit(None).cast("bigint"), "status": F.lit(None).cast("string")})
    got = {r.worker_id: r for r in M.worker_states(df).collect()}
    assert set(got) == {"w1"} and (got["w1"].status, got["w1"].current_url, got["w1"].urls_processed, got["w1"].errors, got["w1"].reported_seq) == ("idle", None, 4, 0, 5)
    upto = {r.worker_id: r for r in M.worker_states(df.where("seq < 5")).collect()}
    assert (upto["w1"].status, upto["w1"].current_url, upto["w1"].urls_processed) == ("busy", "u", 0)
    stats = {r.worker_id: r for r in M.worker_stats(df).collect()}
    assert (stats["w1"].last_status, stats["w1"].urls_processed, stats["w1"].errors) == ("idle", 1, 1) and stats["w2"].last_status is None
    alive = {r.worker_id: r.alive for r in M.worker_liveness(df).collect()}
    assert alive == {"w1": False, "w2": True}
    assert M.worker_stats(df.drop("worker_state")).where("last_status is not null").isEmpty()


def test_decoded_events_feed_the_folds(spark):
    """The stage of a discard is told by its fields; a metric that is no number does not reject its event."""
    base = {"job_id": "j", "timestamp": "2024-01-01T00:00:01.5"}
    wire = [(1, base | {"event_type": "url_queued", "url": "u", "domain": "d"}), (2, base | {"event_type": "url_queued", "url": "v", "domain": "d"}),
            (3, base | {"event_type": "url_discarded", "url": "u", "discard_reason": "http_error", "domain": "d", "status": "discarded"}),
            (4, base | {"event_type": "url_discarded", "url": "v", "discard_reason": "max_depth", "status": "discarded"}),
            (5, base | {"event_type": "url_discarded", "url": "v", "discard_reason": "duplicate", "domain": "d", "status": "discarded"}),
            (6, base | {"event_type": "metrics_update", "metrics": '{"done": 7, "note": "odd", "list": [1], "queued_total": "5"}'})]
    decoded = event_log.decode_events(spark.createDataFrame(wire, "seq bigint, data map<string,string>"), keep=("seq",))
    log = event_log.as_log(event_log.valid_events(decoded))
    assert {r.seq: r.discard_stage for r in log.collect()} == {1: None, 2: None, 3: "fetch", 4: "link", 5: "link", 6: None}
    m = M.job_metrics(log).first()
    assert (m.queued_total, m.discarded, m.accepted_total, m.frontier_depth) == (2, 1, 2, 1)
    live = M.live_metrics(log).first()
    assert (live.done, live.queued_total, live.discarded) == (7, 5, 3)
    assert log.where("seq = 6").first().metrics == {"done": 7.0, "note": None, "list": None, "queued_total": 5.0}
