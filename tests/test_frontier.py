"""Frontier operators against brute force on skewed fixtures."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from weblode.operators import blocks, frontier as Q
from weblode.plans import crawl

LINKS = "job_id string, url string, depth int, parent_seq bigint, pos int, reason string, detail string"


def skewed_links(n=3000, seed=1):
    """A third of all links point to one URL, a third of the rest belongs to one job."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        url = "http://hot/" if rng.random() < 0.34 else f"http://h{rng.randrange(300)}/"
        reason = "max_depth" if rng.random() < 0.1 else None
        rows.append((f"job-{0 if rng.random() < 0.5 else rng.randrange(4)}", url, rng.randrange(4), rng.randrange(500), i, reason, reason and "deep"))
    return rows


def brute_admit(rows, seen=()):
    seen, out = set(seen), {}
    for row in sorted(rows, key=lambda r: (r[2], r[3], r[4])):
        job, url, _, _, pos, reason, _ = row
        if reason:
            out[pos] = reason
        elif (job, url) in seen:
            out[pos] = "duplicate"
        else:
            seen.add((job, url))
            out[pos] = None
    return out


def test_admit(spark):
    rows = skewed_links()
    seen = {("job-0", "http://h5/"), ("job-1", "http://hot/"), ("job-9", "http://h1/")}
    links = spark.createDataFrame(rows, LINKS)
    table = spark.createDataFrame(list(seen), "job_id string, url string").select("job_id", F.substring(F.sha2("url", 256), 1, 16).alias("url_hash"))
    for before, known in ((None, ()), (table, seen)):
        out = Q.admit(links, before).collect()
        assert len(out) == len(rows)
        assert {r.pos: r.reason for r in out} == brute_admit(rows, known)
        assert all(r.queued == (r.reason is None) for r in out)
        assert all(r.detail == {"duplicate": "Already seen", "max_depth": "deep", None: None}[r.reason] for r in out)


def test_admit_again_admits_nothing(spark):
    links = spark.createDataFrame(skewed_links(500), LINKS)
    first = Q.admit(links).where("queued")
    assert Q.admitted_counts(Q.admit(links, first)).agg(F.sum("accepted")).first()[0] == 0


def test_domain_counts_equal_row_outcomes(spark):
    links = spark.createDataFrame(skewed_links(), LINKS).withColumn("domain", F.split("url", "/")[2])
    rows = Q.admit(links).groupBy("job_id", "domain", F.coalesce("reason", F.lit("queued")).alias("outcome")).agg(F.count("*").alias("links"))
    counts = Q.admitted_domains(links)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, rows.collect()))


def test_hot_key_is_spread(spark):
    links = spark.createDataFrame(skewed_links(), LINKS).where("reason is null")
    marked = blocks.mark_first(links, ["url"], ["depth", "parent_seq", "pos"], "first", F.lit(True))
    sizes = [r["count"] for r in marked.where("url = 'http://hot/'").groupBy("_slice").count().collect()]
    assert len(sizes) > 30 and max(sizes) < sum(sizes) / 10


def test_top_per_group(spark):
    rng = random.Random(2)
    rows = [("a" if rng.random() < 0.5 else f"k{rng.randrange(20)}", rng.randrange(50), i) for i in range(2000)]
    out = blocks.top_per_group(spark.createDataFrame(rows, "k string, v int, i int"), ["k"], ["-v", "i"], 7).collect()
    want = []
    for key in {r[0] for r in rows}:
        want += sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))[:7]
    assert sorted(map(tuple, out)) == sorted(want)


def ranked(rows):
    by, place = defaultdict(list), {}
    for r in rows:
        by[r[0]].append(r)
    for group in by.values():
        for i, r in enumerate(sorted(group, key=lambda r: (r[1], r[2], r[3]))):
            place[r[3]] = i + 1
    return place


def test_rank_and_limit(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", rng.randrange(3), rng.choice([5, rng.randrange(10_000)]), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, depth int, seq bigint, id int")
    place = ranked(rows)
    for n in (1, 7, 64):
        out = blocks.rank_in_group(df, ["g"], ["depth", "seq", "id"], "place", n).collect()
        assert {r.id: r.place for r in out} == place
        capped = df.withColumn("cap", F.when(F.col("g") == "hot", 100).when(F.col("g") == "g1", 0).when(F.col("g") == "g2", 10**6))
        marked = blocks.mark_limit(capped, ["g"], ["depth", "seq", "id"], "cap", "kept", n).collect()
        caps = {"hot": 100, "g1": 0}
        assert {r.id: r.kept for r in marked} == {i: place[i] <= caps.get(g, 10**9) for g, _, _, i in rows}


def test_politeness(spark):
    rng = random.Random(4)
    rows = [("j", "hot" if rng.random() < 0.4 else f"d{rng.randrange(9)}", rng.randrange(200_000), rng.randrange(900), i) for i in range(600)]
    df = spark.createDataFrame(rows, "job_id string, domain string, arrival_ms bigint, fetch_ms bigint, seq int")
    free, want = {}, {}
    for _, domain, arrival, took, seq in sorted(rows, key=lambda r: (r[2], r[4])):
        start = max(arrival, free.get(domain, 0))
        free[domain], want[seq] = start + took + 1000, start
    for ranges in (1, 13):
        out = Q.politeness_schedule(df, 1000, ranges=ranges).collect()
        assert {r.seq: r.start_ms for r in out} == want
        assert all(r.wait_ms == r.start_ms - r.arrival_ms for r in out)
    assert all(r.wait_ms == 0 for r in Q.politeness_schedule(df, 0).collect())
    ends = Q.politeness_schedule(df, 1000).withColumn("end_ms", F.col("start_ms") + F.col("fetch_ms"))
    waits = {r.domain: r.wait_ms for r in Q.politeness_wait(ends, 150_000, 1000).collect()}
    assert waits == {d: max(0, t - 150_000) for d, t in free.items()}


def brute_crawl(seeds, edges, depth_limit, cap):
    out, level = {n: (0, None) for n in seeds}, sorted(seeds)
    for depth in range(1, depth_limit + 1):
        found = {}
        for src, dst, pos in sorted(edges, key=lambda e: (e[0], e[2])):
            if src in level and dst not in out and dst not in found:
                found[dst] = src
        order = sorted(found, key=lambda d: min((s, p, d) for s, t, p in edges if t == d and s in level))
        kept = order[:max(0, cap - len(out))]
        if not kept:
            break
        out.update({d: (depth, found[d]) for d in kept})
        level = kept
    return out


def test_crawl_levels(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), 0 if rng.random() < 0.3 else rng.randrange(120), pos) for pos in range(300)]
    seeds = {"a": [3], "b": [3, 7], "c": [11]}
    limits = {"a": (9, 10**6), "b": (2, 10**6), "c": (9, 9)}
    out = crawl.crawl_levels(
        spark.createDataFrame([(j, n, n) for j, ns in seeds.items() for n in ns], "job_id string, node bigint, seq bigint"),
        spark.createDataFrame([(s, d, d, p) for s, d, p in edges], "src bigint, dst bigint, dst_seq bigint, pos int"),
        spark.createDataFrame([(j, *v) for j, v in limits.items()], "job_id string, max_depth int, max_pages bigint")).collect()
    got = defaultdict(dict)
    for r in out:
        assert r.node not in got[r.job_id]
        got[r.job_id][r.node] = (r.depth, r.parent)
    for job in seeds:
        assert got[job] == brute_crawl(seeds[job], edges, *limits[job]), job
    assert len(got["c"]) == 9


def test_seeds_and_config(spark):
    jobs = spark.createDataFrame([("j", '["u","v","u"]', '{"max_depth": 9, "respect_robots": false}', None, 5, None, "x"),
                                  ("k", "[]", None, 2, None, '["a"]', None)],
                                 "job_id string, seed_urls string, config string, max_depth int, max_pages bigint, allowed_domains string, url_pattern string")
    assert [(r.url, r.discovered_seq, r.depth) for r in Q.seed_frontier(jobs).orderBy("discovered_seq").collect()] == [("u", 0, 0), ("v", 1, 0)]
    j, k = Q.job_config(jobs).orderBy("job_id").collect()
    assert (j.max_depth, j.max_pages, j.respect_robots, j.allowed_domains) == (9, 5, False, None)
    assert (k.max_depth, k.max_pages, k.respect_robots, k.allowed_domains, k.politeness_delay) == (2, None, True, ["a"], 1.0)


def test_rows_without_order_are_kept(spark):
    df = spark.createDataFrame([("a", 1, 5, 1, 2), ("a", 1, None, 2, 2), ("a", None, 7, 3, 2), (None, 1, None, 4, 1), (None, 1, 3, 5, 1)],
                               "g string, depth int, seq bigint, id int, cap bigint")
    ranked = {r.id: r.place for r in blocks.rank_in_group(df, ["g"], ["depth", "seq", "id"], "place").collect()}
    assert ranked == {3: 1, 2: 2, 1: 3, 4: 1, 5: 2}
    marked = {r.id: r.kept for r in blocks.mark_limit(df, ["g"], ["depth", "seq", "id"], "cap", "kept").collect()}
    assert marked == {3: True, 2: True, 1: False, 4: True, 5: False}


def test_a_hub_is_spread_over_ranges(spark):
    """Nine of ten links come from one page of one depth; still no range holds much more than its share."""
    links = spark.range(20_000).selectExpr("'j' AS job_id", "1 AS depth", "if(id % 10 = 0, id, 7) AS discovered_seq", "cast(id AS int) AS pos", "concat('u', id) AS url")
    rows = blocks.ranged(links, ["job_id", "depth", "discovered_seq", "pos", "url"], 20)
    sizes = [r["count"] for r in rows.groupBy("_range").count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) >= 15 and max(sizes) < 3_000
    capped = Q.cap_pages(links, spark.createDataFrame([("j", 12_345)], "job_id string, max_pages bigint"), 20)
    kept = {r.pos for r in capped.where("kept").collect()}
    order = sorted(range(20_000), key=lambda i: (i if i % 10 == 0 else 7, i))
    assert kept == set(order[:12_345]) and capped.where("reason = 'max_pages'").count() == 20_000 - 12_345


def test_a_host_whose_fetches_arrive_at_once(spark):
    """Each job paces by its own delay; one without settings by the default; no pacing at 0."""
    rows = [(job, "h", 5, 10 + i % 7, i) for job in ("a", "b", "c") for i in range(2_000)] + [(None, None, 5, 3, i) for i in range(3)]
    df = spark.createDataFrame(rows, "job_id string, domain string, arrival_ms bigint, fetch_ms bigint, seq int")
    jobs = spark.createDataFrame([("a", 0.5), ("b", 0.0)], "job_id string, politeness_delay double")
    got = {(r.job_id, r.seq): r.start_ms for r in Q.politeness_schedule(df, 1000, jobs, ranges=16).collect()}
    want = {}
    for job, _, arrival, took, seq in rows:
        delay = {"a": 500, "b": 0}.get(job, 1000)
        start = max(arrival, want.get((job, "free"), 0)) if delay else arrival
        want[job, seq], want[job, "free"] = start, start + took + delay
    assert got == {k: v for k, v in want.items() if k[1] != "free"}
    plan = blocks.ranged(df, ["job_id", "domain", "arrival_ms", "seq"], 16).groupBy("_range").count().collect()
    assert max(r["count"] for r in plan) < 2_000


def test_pages_at_any_depth(spark):
    from weblode.operators import views as V
    rows = spark.range(5_000).selectExpr("if(id % 5 = 0, 'k', 'j') AS job_id", "concat('u', id) AS url", "'p' AS parent_url", "0 AS depth", "200 AS status_code",
                                         "'t' AS title", "'c' AS content_type", "id AS links_found", "1.0D AS fetch_duration_ms",
                                         "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id % 50 AS int), 0) AS fetched_at")
    table, counts = V.index_pages(rows, 12)
    for job, total in (("j", 4_000), ("k", 1_000)):
        every = [r.url for r in rows.where(F.col("job_id") == job).orderBy(F.desc("fetched_at"), "url").collect()]
        for offset, n in ((0, 3), (total // 2, 40), (total - 2, 10), (total, 5), (100, 700)):
            assert [r.url for r in V.page_at(table, counts, job, n, offset).collect()] == every[offset:offset + n]
    assert V.page_at(table, counts, "no such job").isEmpty()
    plan = V.page_at(table, counts, "j", 5, 3_000)._jdf.queryExecution().toString()
    assert "_range" in plan.split("PushedFilters")[1][:200]


def test_a_cleared_job_begins_anew(spark):
    events = spark.createDataFrame([(1, "a", "url_queued", "u"), (2, "a", "url_queued", "v"), (3, "a", "url_stored", "u"), (4, "b", "url_queued", "u"), (7, "a", "url_queued", "w")],
                                   "seq bigint, job_id string, event_type string, url string")
    clears = spark.createDataFrame([("a", 2), ("a", 5)], "job_id string, cleared_seq bigint")
    left = Q.since_clear(events, clears)
    assert sorted(r.seq for r in left.collect()) == [4, 7] and Q.seen_urls(left).count() == 2
    offered = events.where("event_type = 'url_queued'").selectExpr("job_id", "url", "0 AS depth", "seq AS parent_seq", "0 AS pos", "cast(null AS string) AS reason", "cast(null AS string) AS detail")
    assert {(r.job_id, r.url) for r in Q.admit(offered, Q.seen_urls(left)).where("queued").collect()} == {("a", "u"), ("a", "v")}


def test_levels_go_as_deep_as_the_links(spark):
    from weblode.plans.crawl import crawl_levels
    edges = spark.range(20).selectExpr("id AS src", "id + 1 AS dst", "id + 1 AS dst_seq", "0 AS pos")
    seeds = spark.createDataFrame([("j", 0, 0)], "job_id string, node bigint, seq bigint")
    limits = spark.createDataFrame([("j", 12, 1000)], "job_id string, max_depth int, max_pages bigint")
    got = crawl_levels(seeds, edges, limits)
    assert got.count() == 13 and got.agg(F.max("depth")).first()[0] == 12
