"""Sinks that survive replays: each micro-batch owns one folder and overwrites it.

A keyed table (``start_keyed``) is merged in generations: every so many batches the last generation and the batches after it
are folded into a new one, row by row per key. Readers take the newest finished generation and what came later, so what
they read and the number of files depend on the number of keys, not on how long the query has run.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

MERGE_EVERY = 16


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def writer(path: str, transform=None, parts=()):
    """(batch, batch_id) -> None for ``foreachBatch``: the batch, or what ``transform`` (DataFrame, batch_id) -> DataFrame makes of
    it, goes to the folder of the batch, with a folder per value of the columns ``parts``. A batch that is transformed is
    held, since a transform may read it several times."""
    def write(batch: DataFrame, batch_id: int) -> None:
        if transform is None:
            batch.write.mode("overwrite").partitionBy(*parts).parquet(batch_folder(f"{path}/data", batch_id))
            return
        batch = batch.persist()
        try:
            transform(batch, batch_id).write.mode("overwrite").partitionBy(*parts).parquet(batch_folder(f"{path}/data", batch_id))
        finally:
            batch.unpersist()

    return write


def started(stream: DataFrame, path: str, mode: str, write, once: bool = True, interval: str = "10 seconds") -> StreamingQuery:
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write)
    out = out.trigger(availableNow=True) if once else out.trigger(processingTime=interval)
    return out.start()


def start(stream: DataFrame, path: str, mode: str = "append", transform=None, once: bool = True,
          interval: str = "10 seconds", parts=()) -> StreamingQuery:
    """Write each micro-batch to its own folder under ``path``/data; state goes to ``path``/checkpoint.

    A replayed batch replaces its folder, so the table holds every batch exactly once.
    ``transform`` (DataFrame, batch_id) -> DataFrame runs on the batch before it is written.
    """
    return started(stream, path, mode, writer(path, transform, parts), once, interval)


def drain(stream: DataFrame, path: str, mode: str = "append", transform=None, parts=()) -> None:
    """Process all that has arrived and stop."""
    start(stream, path, mode, transform, parts=parts).awaitTermination()


def watermark(spark: SparkSession, path: str, batch_id: int) -> int:
    """The watermark, in milliseconds, with which a batch of the query at ``path`` runs; 0 before there is one.

    It is in the query's offset log before the batch starts, so a replay of the batch finds the same."""
    said = spark.read.text(f"{path}/checkpoint/offsets/{batch_id}").select(F.get_json_object("value", "$.batchWatermarkMs").cast("bigint").alias("w"))
    return said.where(F.col("w").isNotNull()).first()["w"]


def appended(spark: SparkSession, path: str) -> DataFrame:
    """All rows of an append-mode table."""
    return spark.read.parquet(f"{path}/data").drop("batch")


def latest(spark: SparkSession, path: str, keys: list) -> DataFrame:
    """Newest row per key of an update-mode table."""
    rows = spark.read.parquet(f"{path}/data")
    names = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("r")).select("r.*")


def last_batch(spark: SparkSession, path: str) -> DataFrame:
    """Result of a complete-mode query: its last batch."""
    rows = spark.read.parquet(f"{path}/data")
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar()).drop("batch")


# Keyed tables -----------------------------------------------------------------------------------

def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _finished(spark: SparkSession, path: str) -> list:
    """Numbers n of the folders ``path``/<name>=n whose write has finished."""
    files, at = _folder(spark, path)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n.partition("=")[2]) for n in names if "=" in n and files.exists(new(f"{path}/{n}/_SUCCESS")))


def _best(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """Per key the row greatest by ``order``, of equal ones that of the newest batch."""
    rest = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(rest, F.struct(*order, "_batch")).alias("_r")).select(*keys, "_r.*")


def _unmerged(spark: SparkSession, path: str, upto: int | None = None) -> tuple:
    """(number of the newest generation before ``upto`` or -1, rows of it and of the batches since)."""
    before = [g for g in _finished(spark, f"{path}/base") if upto is None or g < upto]
    newest = before[-1] if before else -1
    parts = [spark.read.parquet(batch_folder(f"{path}/data", b)).withColumn("_batch", F.lit(b).cast("bigint"))
             for b in _finished(spark, f"{path}/data") if b > newest and (upto is None or b <= upto)]
    if before:
        parts.insert(0, spark.read.parquet(f"{path}/base/upto={newest}"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return newest, rows


def merge(spark: SparkSession, path: str, keys: list, order: list, upto: int) -> None:
    """Fold the last generation and the batches since into generation ``upto``, and drop what the one before last superseded.

    Repeating it writes the same generation again. The last generation and the batches since stay for readers of it.
    """
    last, rows = _unmerged(spark, path, upto)
    _best(rows, keys, order).write.mode("overwrite").parquet(f"{path}/base/upto={upto}")
    files, _ = _folder(spark, path)
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for g in _finished(spark, f"{path}/base"):
        if g < last:
            files.delete(new(f"{path}/base/upto={g}"), True)
    for b in _finished(spark, f"{path}/data"):
        if b <= last:
            files.delete(new(batch_folder(f"{path}/data", b)), True)


def keyed_writer(path: str, keys: list, order: list = (), every: int = MERGE_EVERY, transform=None):
    """``writer`` for a keyed table: every ``every``-th batch ends with a merge."""
    put = writer(path, transform)

    def write(batch: DataFrame, batch_id: int) -> None:
        put(batch, batch_id)
        if batch_id % every == every - 1:
            merge(batch.sparkSession, path, keys, list(order), batch_id)

    return write


def start_keyed(stream: DataFrame, path: str, keys: list, mode: str = "update", order: list = (), every: int = MERGE_EVERY,
                transform=None, once: bool = True, interval: str = "10 seconds") -> StreamingQuery:
    """Keep a table with one row per key: the row greatest by the columns ``order``, or without any the newest."""
    return started(stream, path, mode, keyed_writer(path, keys, order, every, transform), once, interval)


def drain_keyed(stream: DataFrame, path: str, keys: list, mode: str = "update", order: list = (), every: int = MERGE_EVERY) -> None:
    start_keyed(stream, path, keys, mode, order, every).awaitTermination()


def keyed(spark: SparkSession, path: str, keys: list, order: list = ()) -> DataFrame:
    """A keyed table as of now."""
    return _best(_unmerged(spark, path)[1], keys, list(order)).drop("_batch")
