"""Writers of the crawl tables. Row ids are pure functions of the key, so a retry repeats them."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from weblode.functions import urls as U

PAGES = ("id string, url string, parent_url string, depth int, status_code int, content_type string, content_length bigint, "
         "title string, fetch_duration_ms double, links_found bigint, fetched_at timestamp_ntz, job_id string")


PRUNED_JOBS = 1000


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def append_pages(pages: DataFrame, path: str) -> None:
    """Insert or ignore: a page already stored under its (job, URL) stays as it is.

    The earliest row of a batch wins. The check reads only ids, and only the folders of the batch's jobs while
    these are at most ``PRUNED_JOBS``. Rows are dealt by job before writing, a large job to several tasks.
    """
    spark = pages.sparkSession
    names = [f.split()[0] for f in PAGES.split(", ") if f.split()[0] not in ("id", "job_id", "url")]
    first = (
        pages.groupBy("job_id", "url").agg(F.min(F.struct("fetched_at", *[n for n in names if n != "fetched_at"])).alias("p"))
        .select(U.row_id("job_id", "url").alias("id"), "url", *[F.col(f"p.{n}").alias(n) for n in names], "job_id")
    )
    if _exists(spark, path):
        known = read_pages(spark, path).select("job_id", "id")
        jobs = [r["job_id"] for r in pages.select("job_id").distinct().limit(PRUNED_JOBS + 1).collect()]
        if len(jobs) <= PRUNED_JOBS:
            known = known.where(F.col("job_id").isin(*jobs))  # a filter on the partition column: pruned when planned
        first = first.join(known, ["job_id", "id"], "left_anti")
    first.hint("rebalance", "job_id").write.mode("append").partitionBy("job_id").parquet(path)


def _append(df: DataFrame, path: str, batch: str | None) -> None:
    """Append by job. With a batch name the rows go to folders of their own, which a repeat of the batch replaces."""
    rows = df.hint("rebalance", "job_id")
    if batch is None:
        rows.write.mode("append").partitionBy("job_id").parquet(path)
    else:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "job_id", "batch").parquet(path)


def append_discards(discards: DataFrame, path: str, batch: str | None = None) -> None:
    """Append discards (job_id, url, parent_url, depth, reason, detail, ...); name the batch to make a repeat harmless."""
    _append(discards, path, batch)


def link_table(links: DataFrame) -> DataFrame:
    """Edge list (job_id, source_id, target_url, anchor_text) of resolved links."""
    return links.select("job_id", U.row_id("job_id", "parent_url").alias("source_id"), F.col("url").alias("target_url"),
                        F.col("anchor").alias("anchor_text"))


def append_links(links: DataFrame, path: str, batch: str | None = None) -> None:
    """Append the edges of resolved links; name the batch to make a repeat harmless."""
    _append(link_table(links), path, batch)
