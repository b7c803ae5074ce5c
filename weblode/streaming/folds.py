"""The event folds as streaming queries.

Each function takes a streaming DataFrame of events and returns one to be written by ``sink.start``;
the output mode is named in its docstring. Event time needs TIMESTAMP, so ``ts`` is cast; the
session time zone must be UTC.
"""


import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from weblode.functions import urls as U
from weblode.operators import events as E, frontier as Q, metrics as M
from weblode.schema import SYSTEM_JOB, WORKER_TTL_SECONDS
from weblode.streaming.sink import batch_folder, watermark as sink_watermark

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def job_filter(stream: DataFrame, job_id: str | None = None) -> DataFrame:
    """Events of one job, or of all jobs (append). Write it partitioned by job to serve all readers at once."""
    return stream if job_id is None else stream.where(F.col("job_id") == job_id)


def url_state(stream: DataFrame, ignore_link_stage: bool = False) -> DataFrame:
    """``events.url_state`` kept up to date (update); state holds one row per URL for ever."""
    return E.url_state(stream, ignore_link_stage)


def domain_counts(stream: DataFrame) -> DataFrame:
    """Counters and busy worker per (job, domain) (update); one aggregate, as streams want it."""
    kind = F.col("event_type")
    own = stream.where(F.col("domain").isNotNull() & (F.col("job_id") != SYSTEM_JOB))
    return own.groupBy("job_id", "domain").agg(
        F.count_if(kind == "url_queued").alias("queued"), F.count_if(kind == "url_stored").alias("done"),
        F.max(F.when(kind == "url_fetching", F.struct("seq", "worker_id"))).alias("busy"),
        F.max(F.when(kind.isin("url_stored", "url_discarded"), F.col("seq"))).alias("idle_seq"),
    ).select("job_id", "domain", "queued", "done",
             F.when(F.col("busy.seq") > F.coalesce("idle_seq", F.lit(-1)), F.col("busy.worker_id")).alias("active_worker"))


def fetch_pairs(stream: DataFrame, within: str = "1 hour", late: str = "1 minute") -> DataFrame:
    """Fetches with a time and the storing of their page, brought together by URL (append).

    A stream-stream join: each side waits for the other for ``within`` and is forgotten once the watermark, ``late`` behind
    the newest event, has passed that. Either may come first.
    """
    at, kind = F.col("ts").cast("timestamp"), F.col("event_type")
    fetched = stream.where((kind == "url_fetched") & F.col("url").isNotNull() & F.col("fetch_duration_ms").isNotNull()).select(
        "job_id", "url", "domain", F.col("fetch_duration_ms").alias("ms"), F.col("seq").alias("fetch_seq"), at.alias("fetched_at")).withWatermark("fetched_at", late)
    stored = stream.where((kind == "url_stored") & F.col("url").isNotNull()).select(
        F.col("job_id").alias("_job"), F.col("url").alias("_url"), F.col("seq").alias("store_seq"), at.alias("stored_at")).withWatermark("stored_at", late)
    wait = F.expr(f"INTERVAL {within}")
    near = (F.col("stored_at") >= F.col("fetched_at") - wait) & (F.col("stored_at") <= F.col("fetched_at") + wait)
    return fetched.join(stored, (F.col("job_id") == F.col("_job")) & (F.col("url") == F.col("_url")) & near).select(
        "job_id", "url", "domain", "ms", "fetch_seq", "store_seq", "fetched_at", "stored_at")


def domain_stats(counts: DataFrame, fetches: DataFrame) -> DataFrame:
    """``metrics.domain_stats`` without the queue, from the tables of ``domain_counts`` (keyed by job and domain) and ``fetch_pairs``
    (keyed by job and URL, greatest ``fetch_seq``): the time of a URL is that of its last fetch, counted once its page is stored."""
    took = fetches.groupBy("job_id", "domain").agg(F.sum(F.col("ms").cast("bigint")).alias("_took"), F.count("*").alias("_timed"))
    mean = F.when(F.col("_timed") > 0, M.half_up(F.col("_took") / F.col("_timed"), 1)).otherwise(F.lit(0.0))
    return counts.join(took, ["job_id", "domain"], "left").select("job_id", "domain", "queued", "done", mean.alias("avg_fetch_ms"), "active_worker")


def live_metrics_step(path: str):
    """Batch transform that carries ``metrics.live_metrics`` from batch to batch.

    A metrics snapshot resets a counter, so the state is the counter's value so far: with a snapshot
    in the batch its value and the events after it, else the old value and the events of the batch.
    The state is one row per job, kept in the folder of each batch; a replay reads the batch before.
    """
    counters = ["queued_total", "done", "discarded", "error", "frontier_depth"]

    def step(batch: DataFrame, batch_id: int) -> DataFrame:
        new = M.live_metrics(batch)
        resets = batch.where(F.col("metrics").isNotNull()).groupBy("job_id").agg(*[
            F.max(F.col("metrics")[c].isNotNull()).alias(f"_{c}") for c in counters])
        new = new.join(resets, "job_id", "left")
        if batch_id == 0:
            return new.select("job_id", *counters)
        old = batch.sparkSession.read.parquet(batch_folder(f"{path}/data", batch_id - 1)).select(
            "job_id", *[F.col(c).alias(f"old_{c}") for c in counters])
        return new.join(old, "job_id", "full").select("job_id", *[
            (F.coalesce(c, F.lit(0)) + F.when(F.coalesce(f"_{c}", F.lit(False)), 0).otherwise(F.coalesce(f"old_{c}", F.lit(0)))).alias(c)
            for c in counters])

    return step


def crawl_rate(stream: DataFrame, width: str = "1 minute", seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """Stored pages per second in tumbling windows per job (append: a window comes once the watermark closes it, and its state goes)."""
    stored = stream.where(F.col("event_type") == "url_stored").withColumn("at", F.col("ts").cast("timestamp"))
    return (
        stored.withWatermark("at", late).groupBy("job_id", F.window("at", width).alias("w")).agg(F.count("*").alias("pages"))
        .select("job_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "pages",
                (F.col("pages") / float(seconds)).alias("rate"))
    )


def _beat():
    """A sign of life: any event of a worker but its sign-off."""
    return F.col("worker_id").isNotNull() & F.coalesce(F.col("event_type") != "worker_offline", F.lit(True))


def worker_sessions(stream: DataFrame, gap: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Up-intervals of workers by session window (append: an interval comes once the watermark closes it, and its state goes)."""
    beats = stream.where(_beat()).withColumn("at", F.col("ts").cast("timestamp"))
    return (
        beats.withWatermark("at", late).groupBy("worker_id", F.session_window("at", gap).alias("w"))
        .agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("beats"))
        .select("worker_id", F.col("lo").cast("timestamp_ntz").alias("first_beat"),
                F.col("hi").cast("timestamp_ntz").alias("last_beat"), "beats")
    )


class _Liveness(StatefulProcessor):
    """Emits online when a silent worker beats, offline ``ttl`` after its last beat."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint")

    def handleInputRows(self, key, rows, timerValues):
        # Beats less than the limit apart cannot part an interval, so of those in a stretch as long as the limit the
        # first and the last will do: what is held depends on the time a micro-batch spans, not on the number of beats.
        edges = {}
        for frame in rows:
            ends = frame["ms"].groupby(frame["ms"] // self.ttl_ms).agg(["min", "max"])
            for stretch, low, high in ends.itertuples():
                least, most = edges.get(stretch, (low, high))
                edges[stretch] = min(least, low), max(most, high)
        beats = [int(t) for stretch in sorted(edges) for t in edges[stretch]]
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for ms in beats:
            if last is not None and ms - last >= self.ttl_ms:
                out.append((key[0], "worker_offline", last + self.ttl_ms))
                last = None
            if last is None:
                out.append((key[0], "worker_online", ms))
            last = ms if last is None else max(last, ms)
        self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.ttl_ms)
        yield pd.DataFrame(out, columns=["worker_id", "event_type", "ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last = self.last.get()[0] if self.last.exists() else None
        if last is not None and expiredTimerInfo.getExpiryTimeInMs() >= last + self.ttl_ms:
            self.last.clear()
            yield pd.DataFrame([(key[0], "worker_offline", last + self.ttl_ms)], columns=["worker_id", "event_type", "ms"])

    def close(self) -> None:
        pass


def worker_liveness(stream: DataFrame, ttl_seconds: int = WORKER_TTL_SECONDS, late: str = "1 minute") -> DataFrame:
    """worker_online and worker_offline events (append); one timer and one number per worker.

    Needs the RocksDB state store: see ``use_rocksdb``.
    """
    beats = (
        stream.where(_beat()).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
        .select("worker_id", "at", F.unix_millis("at").alias("ms"))
    )
    return beats.groupBy("worker_id").transformWithStateInPandas(
        _Liveness(ttl_seconds * 1000), "worker_id string, event_type string, ms bigint", "append", "eventTime")


class _BoundedState(StatefulProcessor):
    """State fold of the URLs of a bucket, each forgotten some event time after its last event.

    A call of the handle is a round trip to the JVM, which costs more than folding many rows. So the state of a bucket is one
    value, a table with a row per URL, read and written once a micro-batch, with one timer for the URL that is due first.
    """

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "entries binary, due bigint")

    def _load(self) -> tuple:
        held = self.held.get()
        return (None, None) if held is None else (pa.ipc.open_stream(bytes(held[0])).read_all().to_pandas(), held[1])

    def _save(self, entries, due) -> None:
        """Keep the entries, with a timer no later than the first of them is due."""
        first = int(entries["ms"].min()) + self.ttl_ms
        if due is None or first < due:
            self.handle.registerTimer(first)
            due = first
        out, table = pa.BufferOutputStream(), pa.Table.from_pandas(entries, _ENTRY, preserve_index=False)
        with pa.ipc.new_stream(out, _ENTRY) as writer:
            writer.write_table(table)
        self.held.update((out.getvalue().to_pybytes(), due))

    def handleInputRows(self, key, rows, timerValues):
        before, due = self._load()
        after = before
        for frame in rows:
            frame = frame[_ENTRY.names]
            both = frame if after is None else pd.concat([after, frame], ignore_index=True)
            newest = both.groupby("url")["ms"].max()
            after = both.sort_values(["rank", "seq"], kind="stable").drop_duplicates("url", keep="last")
            after = after.assign(ms=after["url"].map(newest)).reset_index(drop=True)
        self._save(after, due)
        if before is not None:
            old = after[["url"]].merge(before, "left", "url")
            after = after[~((old["rank"] == after["rank"]) & (old["seq"] == after["seq"]) & (old["status"] == after["status"]))]
        yield after.assign(job_id=key[0])[["job_id", "url", "status", "seq"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        entries, due = self._load()
        if entries is not None:
            end = entries["ms"] + self.ttl_ms
            entries = entries[(end > expiredTimerInfo.getExpiryTimeInMs()) & (end >= timerValues.getCurrentWatermarkInMs())]
            if len(entries):
                self._save(entries, None)
            else:
                self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


_ENTRY = pa.schema([("url", pa.string()), ("rank", pa.int32()), ("seq", pa.int64()), ("status", pa.string()), ("ms", pa.int64())])
_NO_SEQ = -(1 << 63)
"""Stands for no ``seq`` in the fold, where it comes before all others as it does in the batch fold."""


def bounded_url_state(stream: DataFrame, ttl_seconds: int = 86_400, late: str = "1 minute", buckets: int = 512) -> DataFrame:
    """``url_state`` with bounded memory (update): a URL is forgotten ``ttl_seconds`` after its last event.

    A duplicate discard that comes later than that finds no state and starts a new one. The events of a URL pass by the
    batch and only the best row is held. The URLs of a job are dealt out to ``buckets``, whose states are read and written
    as a whole: take so many that a bucket has some thousand live URLs, and leave the number for the life of the query.
    Needs the RocksDB state store.
    """
    status = F.coalesce("status", F.lit("queued"))
    rank = F.coalesce(E.status_rank(status).cast("int"), F.lit(-1))
    rows = stream.where(F.col("url").isNotNull()).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    rows = rows.select("job_id", F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int").alias("bucket"), "url", rank.alias("rank"),
                       F.coalesce("seq", F.lit(_NO_SEQ)).alias("seq"), status.alias("status"), "at",
                       F.coalesce(F.unix_millis("at"), F.lit(0)).alias("ms"))
    return rows.groupBy("job_id", "bucket").transformWithStateInPandas(
        _BoundedState(ttl_seconds * 1000), "job_id string, url string, status string, seq bigint", "update", "eventTime",
    ).withColumn("seq", F.when(F.col("seq") != _NO_SEQ, F.col("seq")))


class use_rocksdb:
    """Run queries started inside with the RocksDB state store."""

    def __init__(self, spark: SparkSession) -> None:
        self.conf, self.key = spark.conf, "spark.sql.streaming.stateStore.providerClass"

    def __enter__(self):
        self.before = self.conf.get(self.key, None)
        self.conf.set(self.key, ROCKSDB)

    def __exit__(self, *error):
        self.conf.unset(self.key) if self.before is None else self.conf.set(self.key, self.before)


def dedup(stream: DataFrame, key=("job_id", "url_hash"), late: str | None = None) -> DataFrame:
    """First arrival of each key (append); with ``late`` keys are forgotten after the watermark."""
    if late is None:
        return stream.dropDuplicates(list(key))
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.dropDuplicatesWithinWatermark(list(key)).drop("at")


class _Admission(StatefulProcessor):
    """Whether a (job, URL) was admitted before; of a micro-batch's rows the first in order of arrival is admitted."""

    def __init__(self, columns: list, ttl_ms: int | None) -> None:
        self.columns, self.ttl_ms = columns, ttl_ms

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "known boolean", self.ttl_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows, timerValues):
        # Rows leave as they come and only the first so far is held back, so a hot URL needs no memory.
        known, first, least = self.seen.exists(), None, None
        for row in rows:
            place = tuple((row[c] is not None, row[c] or 0) for c in Q.ARRIVAL)
            if known or (first is not None and place >= least):
                yield self._out(row, False)
                continue
            if first is not None:
                yield self._out(first, False)
            first, least = row, place
        if first is not None:
            self.seen.update((True,))
            yield self._out(first, True)

    def _out(self, row, queued: bool) -> Row:
        return Row(**{c: row[c] for c in self.columns}, queued=queued)

    def close(self) -> None:
        pass


def admission(links: DataFrame, seen: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """``frontier.admit`` on an endless stream of links (append): outcome of every link against all that came before.

    The URLs admitted so far are keyed state, one flag each, so a micro-batch costs what it brings and nothing for the
    history; ``seen`` (job_id, url_hash) is the state to begin with. Within a micro-batch the least (depth, parent_seq, pos)
    is first. With ``ttl_ms`` a URL is forgotten that long after it was admitted, by the clock. Refused links pass by the
    state. Needs the RocksDB state store.
    """
    rows = links if "url_hash" in links.columns else links.withColumn("url_hash", U.url_hash("url"))
    schema = T.StructType([*rows.schema.fields, T.StructField("queued", T.BooleanType())])
    begun = None if seen is None else seen.select("job_id", "url_hash").distinct().withColumn("known", F.lit(True)).groupBy("job_id", "url_hash")
    judged = rows.where(F.col("reason").isNull()).groupBy("job_id", "url_hash").transformWithState(
        _Admission(rows.columns, ttl_ms), schema, "append", "none" if ttl_ms is None else "processingTime", begun)
    refused = rows.where(F.col("reason").isNotNull()).withColumn("queued", F.lit(False))
    duplicate = F.col("reason").isNull() & ~F.col("queued")
    return judged.unionByName(refused).select(
        *[c for c in rows.columns if c not in ("reason", "detail", "allowed")], "queued",
        F.when(duplicate, "duplicate").otherwise(F.col("reason")).alias("reason"),
        F.when(duplicate, "Already seen").otherwise(F.col("detail")).alias("detail"))


def discards(stream: DataFrame) -> DataFrame:
    """Discard events in the form of the discard table (append)."""
    return stream.where(F.col("event_type") == "url_discarded").select(
        "job_id", "url", "parent_url", "depth", F.col("discard_reason").alias("reason"), F.col("discard_detail").alias("detail"),
        F.col("ts").alias("discarded_at"), "seq", "discard_stage")


def late_split_step(path: str):
    """Batch transform for a stream with a watermark on its event time: adds ``late``, by which the rows are parted into folders.

    A row is late if its ``ts`` lies before the watermark its micro-batch runs with, the one by which stateful queries
    drop rows. Nothing is dropped here; rows without a time are not late. The watermark is read from the query's own
    log, so a replay repeats the split; rows are written once, both sides together.
    """
    def step(batch: DataFrame, batch_id: int):
        mark = sink_watermark(batch.sparkSession, path, batch_id)
        return batch.withColumn("late", F.coalesce(E.micros(F.col("ts")) < mark * 1000, F.lit(False)))

    return step


def with_watermark(stream: DataFrame, late: str) -> DataFrame:
    """The stream with a watermark ``late`` behind its newest ``ts``."""
    return stream.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late).drop("_at")
