"""Plans that chain operators: link discovery, one crawl step, and a whole crawl by levels."""

import itertools
import uuid

from pyspark.sql import DataFrame, functions as F

from weblode.functions import urls as U
from weblode.operators.blocks import join_spread, mark_limit, scratch_path, written
from weblode.operators.extract import extract_pages, link_rows
from weblode.operators.filters import (
    classify_fetches, classify_urls, discard_report, resolve_links, robots_rules, robots_verdict, skipped_links, with_config)
from weblode.operators.frontier import admit, admitted_domains, cap_pages
from weblode.schema import MAX_DEPTH, MAX_PAGES


def classified_links(occurrences: DataFrame, jobs: DataFrame, suffixes) -> DataFrame:
    """Links resolved and judged by the URL rules; ``reason`` is NULL where all pass.

    One narrow stage apart from the join with the job settings. A link that cannot be parsed has
    no URL; ``filters.skipped_links`` counts those.
    """
    judged = classify_urls(with_config(resolve_links(occurrences), jobs), suffixes)
    keep = ["job_id", "url", "depth", "parent_seq", "pos", "anchor", "reason", "detail"]
    return judged.select(*keep, F.col("page_url").alias("parent_url"), F.col("u.netloc").alias("domain"))


def discovery(occurrences: DataFrame, jobs: DataFrame, suffixes) -> DataFrame:
    """Which domains newly found URLs belong to, and why every other link was dropped."""
    return admitted_domains(classified_links(occurrences, jobs, suffixes))


def crawl_step(fetches: DataFrame, robots: DataFrame, jobs: DataFrame, suffixes, seen: DataFrame | None = None,
               max_pages: bool = True, use_base_href: bool = False) -> dict:
    """One step of a crawl over a fetch log.

    Returns the tables ``pages``, ``links``, ``discards``, ``frontier`` and ``skipped`` (links without a target, per
    job). ``jobs`` may carry ``respect_robots`` and ``allowed_content_types`` (see ``frontier.job_config``); ``fetches``
    may carry ``final_url``, against which links resolve, and ``parent_url``. With ``use_base_href`` links resolve against what a
    page's first base element names, itself taken relative to that URL. Pages are taken apart where they are read,
    so no text travels; the result and the admission of links are each written once. ``seen`` (job_id, url_hash)
    holds what was admitted before and counts towards the page limit.
    """
    rows = U.with_url_parts(extract_pages(fetches), "url")
    given = [c for c in ("respect_robots", "allowed_content_types") if c in jobs.columns]
    if given:
        rows = join_spread(rows, jobs.select("job_id", *[F.col(c).alias(f"_{c}") for c in given]), ["job_id"], ["url"])
    rows = robots_verdict(rows, robots_rules(robots))
    if "respect_robots" in given:
        rows = rows.withColumn("robots_blocked", F.col("robots_blocked") & F.coalesce("_respect_robots", F.lit(True)))
    types = "_allowed_content_types" if "allowed_content_types" in given else None
    judged = written(classify_fetches(rows, types).drop("u", *[f"_{c}" for c in given]), "extracted")
    extracted, refused = judged.where("allowed"), judged.where(~F.col("allowed"))
    if "parent_url" not in fetches.columns:
        refused = refused.withColumn("parent_url", F.lit(None).cast("string"))
    at = F.coalesce("final_url", "url") if "final_url" in fetches.columns else F.col("url")
    linking = extracted.withColumn("_at", at)
    if use_base_href:
        linking = U.with_resolved_url(linking, "_at", "base_href", "_base", normalized=False).withColumn(
            "_at", F.when(F.col("base_href") != F.col("url"), F.coalesce("_base", "_at")).otherwise(F.col("_at")))
    links = link_rows(linking, ["job_id", "_at", "depth", "page_id"]).select(
        "job_id", F.col("_at").alias("page_url"), (F.col("depth") + 1).alias("depth"),
        F.col("page_id").alias("parent_seq"), "pos", "href", "anchor")
    outcomes = written(admit(classified_links(links, jobs, suffixes), seen), "outcomes")
    accepted = outcomes.where("queued").withColumnRenamed("parent_seq", "discovered_seq")
    used = None if seen is None else seen.select("job_id", "url_hash").distinct().groupBy("job_id").agg(F.count("*").alias("used"))
    capped = cap_pages(accepted, jobs, used=used) if max_pages else accepted.withColumn("kept", F.lit(True))
    over = capped.where(~F.col("kept")).withColumn("detail", F.lit(None).cast("string"))
    link_drops = outcomes.select("job_id", "url", "parent_url", "depth", "reason", "detail").unionByName(
        over.select("job_id", "url", "parent_url", "depth", "reason", "detail"))
    return {"pages": extracted, "links": outcomes, "discards": discard_report(refused, link_drops),
            "frontier": capped.where("kept"), "skipped": skipped_links(links)}


def url_judge(jobs: DataFrame, suffixes):
    """``judge`` for ``crawl_levels`` on URLs: a link must pass its job's URL rules.

    Refused links leave through the generator, so the verdict is computed once (see
    ``filters.resolve_links``).
    """
    def judge(found: DataFrame) -> DataFrame:
        judged = classify_urls(with_config(U.with_url_parts(found, "node"), jobs, "node"), suffixes, url="node")
        passed = F.array_compact(F.array(F.when(F.col("reason").isNull(), F.col("node"))))
        return judged.select(*[c for c in found.columns if c != "node"], F.explode(passed).alias("node"))

    return judge


def crawl_levels(seeds: DataFrame, edges: DataFrame, limits: DataFrame, judge=None) -> DataFrame:
    """Crawl a link table level by level; (job_id, node, depth, parent, parent_seq, pos) per node.

    ``seeds`` (job_id, node, seq), ``edges`` (src, dst, dst_seq, pos), ``limits`` (job_id,
    max_depth, max_pages). Each level is one job: join the last level with the links, let ``judge``
    (DataFrame -> DataFrame) refuse some, keep the least (parent_seq, pos) per (job, node), drop
    what was admitted before, apply the page cap. The first occurrence is an aggregate that
    combines before the shuffle, so a page that a third of all links point to is one row per task.
    Each level is written to the shared folder: lineage stays short and a lost executor costs one
    level at most. A job without limits has the default ones. The loop reads back one row per level: is it empty, does a job exceed its limit.
    """
    spark = seeds.sparkSession
    root = scratch_path(spark, "levels")
    node_type = dict(seeds.dtypes)["node"]
    schema = (f"job_id string, node {node_type}, seq bigint, depth int, parent {node_type}, "
              "parent_seq bigint, pos int")
    names = ["job_id", "node", "seq", "depth", "parent", "parent_seq", "pos"]
    paths = []

    def save(df: DataFrame) -> DataFrame:
        paths.append(f"{root}/{uuid.uuid4().hex}")
        df.select(*names).write.mode("error").parquet(paths[-1])
        return spark.read.schema(schema).parquet(paths[-1])

    # Every level reads the limits twice.
    bounds = written(limits.select("job_id", F.coalesce("max_depth", F.lit(MAX_DEPTH)).alias("_deepest"),
                                   F.coalesce("max_pages", F.lit(MAX_PAGES)).alias("_most")), "limits")
    level = save(seeds.select(
        "job_id", "node", F.col("seq").cast("bigint").alias("seq"), F.lit(0).alias("depth"),
        F.lit(None).cast(node_type).alias("parent"), F.lit(None).cast("bigint").alias("parent_seq"),
        F.lit(None).cast("int").alias("pos")))
    for depth in itertools.count(1):  # ends when a level is empty, at each job's own depth at the latest
        known = spark.read.schema(schema).parquet(*paths)
        used = known.groupBy("job_id").agg(F.count("*").alias("_used"))
        room = bounds.join(used, "job_id", "left").select(
            "job_id", "_deepest", (F.col("_most") - F.coalesce("_used", F.lit(0))).alias("_room"))
        growing = join_spread(level, room, ["job_id"], ["node"]).where(
            F.coalesce(F.col("_deepest") >= depth, F.lit(depth <= MAX_DEPTH)) & F.coalesce(F.col("_room") > 0, F.lit(True)))
        found = (
            growing.select("job_id", F.col("node").alias("src"), F.col("seq").alias("parent_seq")).join(edges, "src")
            .select("job_id", F.col("dst").alias("node"), F.col("dst_seq").alias("seq"), F.lit(depth).alias("depth"),
                    F.col("src").alias("parent"), "parent_seq", "pos")
        )
        if judge is not None:
            found = judge(found)
        first = found.groupBy("job_id", "node").agg(F.min(F.struct("parent_seq", "pos", "parent", "seq", "depth")).alias("f"))
        fresh = first.select("job_id", "node", "f.*").join(known.select("job_id", "node"), ["job_id", "node"], "left_anti")
        level = save(fresh)
        per_job = level.groupBy("job_id").agg(F.count("*").alias("_new")).join(room, "job_id", "left")
        state = per_job.agg(F.count("*").alias("jobs"), F.max(F.col("_new") > F.col("_room")).alias("over")).first()
        if state.jobs == 0:
            break
        if state.over:
            # Some job reaches its page limit on this level: rank only there, and replace the level.
            paths.pop()
            level = save(mark_limit(join_spread(level, room.drop("_deepest"), ["job_id"], ["node"]), ["job_id"], ["parent_seq", "pos", "node"], "_room", "_kept")
                         .where("_kept"))
    return spark.read.schema(schema).parquet(*paths)
