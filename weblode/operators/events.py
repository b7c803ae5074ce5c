"""Folds of the crawl event log: states, feeds, timelines and graphs.

An event row has at least (seq, ts, job_id, event_type); ``seq`` is unique and gives the order of
arrival. All folds are order-free aggregates, so a log may be split, replayed in parallel and
merged.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from weblode.functions import urls as U
from weblode.operators.blocks import RANGE, block_number, cut_points, join_spread, ranged, top_per_group
from weblode.schema import EVENT_HISTORY, EVENT_LABELS, EVENT_RETENTION, REASON_LABELS, SYSTEM_JOB, URL_STATUSES

ENTRY = ["parent_url", "depth", "status", "status_code", "content_type", "links_found",
         "fetch_duration_ms", "discard_reason", "discard_detail", "worker_id", "ts"]


def status_rank(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in URL_STATUSES]), F.coalesce(status, F.lit("queued"))) - 1


def url_events(events: DataFrame, ignore_link_stage: bool = False) -> DataFrame:
    """Events about a URL; optionally without discards of links that were never fetched."""
    out = events.where(F.col("url").isNotNull())
    if ignore_link_stage:
        out = out.where(F.coalesce("discard_stage", F.lit("")) != "link")
    return out


def latest_entry() -> Column:
    """Aggregate: the row that survives the state fold (highest rank, then latest)."""
    defaults = {"status": "queued", "depth": 0}
    row = F.struct(*[F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in ENTRY], "seq")
    return F.max_by(row, F.struct(status_rank(F.col("status")), F.col("seq")))


def url_state(events: DataFrame, ignore_link_stage: bool = False) -> DataFrame:
    """State of each (job, URL).

    An event replaces the whole row when its status ranks at least as high as the current one.
    The survivor of that fold is the row with the greatest (rank, seq), which is an aggregate that
    combines before the shuffle. With ``ignore_link_stage`` a stored URL that is linked again stays
    done; without, the later duplicate discard outranks it.
    """
    return (
        url_events(events, ignore_link_stage).groupBy("job_id", "url").agg(latest_entry().alias("e"))
        .select("job_id", "url", "e.*")
    )


def history(events: DataFrame, job_id: str, start: int = 0, count: int = EVENT_HISTORY) -> DataFrame:
    """Events of one job among the first ``count`` events of the log from ``start`` on."""
    return events.where(F.col("seq") >= start).orderBy("seq").limit(count).where(F.col("job_id") == job_id)


def retain_latest(events: DataFrame, n: int = EVENT_RETENTION, blocks: int = 128) -> DataFrame:
    """The newest ``n`` events.

    Counts per block of ``seq`` find the block in which the limit falls. Newer blocks stay whole and only that one
    is sorted; both are plain ranges of ``seq``, which the scan can skip files by. No task sorts the whole log.
    """
    cuts = cut_points(events, "seq", blocks)
    sizes = {r["b"]: r["n"] for r in events.groupBy(block_number("seq", cuts).alias("b")).agg(F.count("*").alias("n")).collect()}
    newer = 0
    for b in range(len(cuts), -1, -1):
        if newer + sizes.get(b, 0) > n:
            break
        newer += sizes.get(b, 0)
    else:
        return events
    in_block = (F.col("seq") > cuts[b - 1]) if b else F.lit(True)
    if b < len(cuts):
        older = (F.col("seq") <= cuts[b]) if b else F.col("seq").isNull() | (F.col("seq") <= cuts[b])
        edge = events.where(in_block & older).orderBy(F.desc("seq")).limit(n - newer)
        return events.where(F.col("seq") > cuts[b]).unionByName(edge)
    return events.where(in_block).orderBy(F.desc("seq")).limit(n)


def feed(events: DataFrame, n: int = 200, salts: int = 64) -> DataFrame:
    """Newest ``n`` events of each job."""
    return top_per_group(events, ["job_id"], ["-seq"], n, salts)


def discard_feed(events: DataFrame, n: int = 5000) -> DataFrame:
    """Newest ``n`` discards of each job."""
    return top_per_group(events.where(F.col("event_type") == "url_discarded"), ["job_id"], ["-seq"], n)


def event_labels(events: DataFrame) -> DataFrame:
    """Short labels of event type and discard reason, from literal maps.

    An unknown type is upper-cased and only its first underscore becomes a space.
    """
    def table(labels: dict) -> Column:
        return F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])

    kind, reason = F.col("event_type"), F.col("discard_reason")
    fallback = F.regexp_replace(F.upper(kind), "^([^_]*)_", "$1 ")
    return events.withColumn("event_label", F.coalesce(F.try_element_at(table(EVENT_LABELS), kind), fallback)) \
        .withColumn("reason_label", F.coalesce(F.try_element_at(table(REASON_LABELS), reason), reason))


def url_timeline(events: DataFrame, n: int = 30) -> DataFrame:
    """Newest ``n`` events of every URL, as the URL itself or as the source of a link."""
    keys = F.array_distinct(F.array_compact(F.array("url", "source_url")))
    keyed = events.select(F.explode(keys).alias("key_url"), *events.columns)
    return top_per_group(keyed, ["job_id", "key_url"], ["-seq"], n, salts=16)


def crawl_rate(events: DataFrame, keep: int = 120) -> DataFrame:
    """Pages per second at each of the last ``keep`` stored pages of a job.

    Only ``keep`` + 1 pages per job take part, so the window that looks back is bounded.
    """
    stored = events.where((F.col("event_type") == "url_stored") & (F.col("job_id") != SYSTEM_JOB)).select("job_id", "seq", "ts")
    last = top_per_group(stored, ["job_id"], ["-ts", "-seq"], keep + 1)
    w = Window.partitionBy("job_id").orderBy("ts", "seq")
    gap = micros(F.col("ts")) - micros(F.lag("ts").over(w))
    newest = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("seq")))
    return (
        last.withColumn("rate", F.coalesce(F.when(gap > 0, F.lit(1e6) / gap), F.lit(0.0)))
        .withColumn("_n", newest).where(F.col("_n") <= keep).select("job_id", "seq", "ts", "rate")
    )


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ, independent of any time zone."""
    gap = ts - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    whole = F.extract(F.lit("DAY"), gap) * 86400 + F.extract(F.lit("HOUR"), gap) * 3600 + F.extract(F.lit("MINUTE"), gap) * 60
    return whole.cast("bigint") * 1_000_000 + (F.extract(F.lit("SECOND"), gap) * 1_000_000).cast("bigint")


def active_domains(events: DataFrame) -> DataFrame:
    """Worker busy on each (job, domain): set by url_fetching, cleared by stored or discarded.

    Grouping by worker first keeps every buffer a number, so Spark aggregates by hash.
    """
    per_worker = _domain_activity(events)
    return per_worker.groupBy("job_id", "domain").agg(_active_worker().alias("active_worker"))


def _domain_activity(events: DataFrame, *extra) -> DataFrame:
    known = events.where(F.col("domain").isNotNull() & (F.col("job_id") != SYSTEM_JOB))
    kind = F.col("event_type")
    return known.groupBy("job_id", "domain", "worker_id").agg(
        F.max(F.when(kind == "url_fetching", F.col("seq"))).alias("busy_seq"),
        F.max(F.when(kind.isin("url_stored", "url_discarded"), F.col("seq"))).alias("idle_seq"),
        *extra)


def _active_worker() -> Column:
    busy, idle = F.max("busy_seq"), F.max("idle_seq")
    return F.when(busy.isNotNull() & (busy > F.coalesce(idle, F.lit(-1))), F.max_by("worker_id", "busy_seq"))


def live_graph_nodes(events: DataFrame, max_nodes: int | None = None, ranges: int | None = None) -> DataFrame:
    """Node per (job, URL): depth of its first event, status of its latest, last known code.

    The code moves only when the status changes (or on the first event), so each event is compared
    with the one before. That runs inside ranges of the log; one summary row per (URL, range) then
    settles the first row of each range. With ``max_nodes`` a job stops at the event that brings
    its last node.
    """
    rows = url_events(events).select(
        "job_id", "url", "seq", F.coalesce("status", F.lit("queued")).alias("status"), "status_code",
        F.coalesce("depth", F.lit(0)).alias("depth"))
    if max_nodes is not None:
        first = rows.groupBy("job_id", "url").agg(F.min("seq").alias("seq"))
        last = top_per_group(first, ["job_id"], ["seq"], max_nodes).groupBy("job_id").agg(
            F.max("seq").alias("_last"), F.count("*").alias("_n"))
        rows = join_spread(rows, last, ["job_id"], ["url", "seq"], "inner").where((F.col("_n") < max_nodes) | (F.col("seq") <= F.col("_last"))).drop("_last", "_n")
    rows = ranged(rows, ["job_id", "url", "seq"], ranges).withColumnRenamed(RANGE, "_b")
    w = Window.partitionBy("job_id", "url", "_b").orderBy("seq")
    before = F.lag("status").over(w)
    code = F.col("status_code")
    inner = rows.withColumn("_code", F.when(before.isNotNull() & (before != F.col("status")) & code.isNotNull(),
                                            F.struct("seq", "status_code")))
    summary = inner.groupBy("job_id", "url", "_b").agg(
        F.min(F.struct("seq", "status", "status_code", "depth")).alias("head"),
        F.max(F.struct("seq", "status")).alias("tail"),
        F.max("_code").alias("code"))
    prior = F.lag("tail").over(Window.partitionBy("job_id", "url").orderBy("_b"))
    head_code = F.when((prior.isNull() | (prior["status"] != F.col("head.status"))) & F.col("head.status_code").isNotNull(),
                       F.struct(F.col("head.seq").alias("seq"), F.col("head.status_code").alias("status_code")))
    # A change inside a block is later than its first row.
    settled = summary.withColumn("code", F.coalesce("code", head_code))
    nodes = settled.groupBy("job_id", "url").agg(
        F.min("head").alias("head"), F.max("tail").alias("tail"), F.max("code").alias("code"))
    return U.with_url_parts(nodes, "url", "u").select(
        "job_id", "url", U.display_url("url", F.col("u")).alias("label"), F.col("head.depth").alias("depth"),
        F.col("tail.status").alias("status"), F.col("code.status_code").alias("status_code"))


def live_graph_edges(events: DataFrame, max_edges: int | None = None) -> DataFrame:
    """Distinct links that were queued, with the event that brought each first."""
    edges = (
        events.where((F.col("event_type") == "url_queued") & F.col("source_url").isNotNull() & F.col("target_url").isNotNull())
        .groupBy("job_id", F.col("source_url").alias("source"), F.col("target_url").alias("target"))
        .agg(F.min("seq").alias("first_seq"))
    )
    return edges if max_edges is None else top_per_group(edges, ["job_id"], ["first_seq"], max_edges)
