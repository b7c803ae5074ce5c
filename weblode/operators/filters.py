"""Admission of URLs and of fetch results, and the report of what was discarded."""

from pyspark.sql import DataFrame, functions as F

from weblode.functions import robots as R, rules, urls as U
from weblode.operators.blocks import join_spread, top_per_group
from weblode.schema import MAX_CONTENT_BYTES, MAX_DEPTH, MAX_URL_LENGTH

CONFIG = ["max_depth", "max_pages", "allowed_domains", "url_pattern"]


def resolve_links(links: DataFrame, base: str = "page_url", href: str = "href", out: str = "url") -> DataFrame:
    """Absolute, normalised target of each link in ``out`` and its parts in ``u``.

    A link that cannot be parsed has no target and is left out. It is left out by the generator
    rather than by a filter: Spark would move a filter in front of the steps that compute the
    target and so compute it again.
    """
    resolved = U.with_resolved_url(links, base, href, out)
    parsed = resolved.select(*links.columns, F.explode(F.array_compact(F.array(out))).alias(out))
    return U.with_url_parts(parsed, out, "u")


def with_config(df: DataFrame, jobs: DataFrame, by: str = "url") -> DataFrame:
    """Attach the settings of each row's job; one config row per job, so no row multiplies. A job with very many
    rows is met slice by slice of column ``by``."""
    return join_spread(df, jobs.select("job_id", *CONFIG), ["job_id"], [by])


def skipped_links(links: DataFrame, base: str = "page_url", href: str = "href") -> DataFrame:
    """(job_id, skipped_links): links that cannot be parsed and so have no target; jobs without any are left out."""
    return U.with_resolved_url(links, base, href, "_target").where(F.col("_target").isNull()).groupBy("job_id").agg(
        F.count("*").alias("skipped_links"))


def classify_urls(df: DataFrame, suffixes, url: str = "url", parts: str = "u", depth: str = "depth",
                  max_length: int = MAX_URL_LENGTH) -> DataFrame:
    """Add allowed, reason and detail to rows that carry their job's settings."""
    verdict = rules.url_verdict(
        F.col(url), F.col(parts), F.col(depth), F.coalesce("max_depth", F.lit(MAX_DEPTH)),
        F.col("allowed_domains"), F.col("url_pattern"), suffixes, max_length)
    return df.withColumn("_v", verdict).select(*df.columns, "_v.allowed", "_v.reason", "_v.detail")


def robots_rules(robots: DataFrame) -> DataFrame:
    """(netloc, prefixes): the disallowed path prefixes of each host."""
    return robots.select("netloc", R.disallowed_prefixes(F.col("robots_txt")).alias("prefixes"))


def robots_verdict(urls: DataFrame, rules_by_host: DataFrame, parts: str = "u") -> DataFrame:
    """Add ``robots_blocked``; a host without rules blocks nothing.

    One rule row per host: the join is one to one, a hot host is split by AQE's skew join, and the
    rule side is broadcast only where its measured size is under Spark's threshold.
    """
    rules_ = rules_by_host.select(F.col("netloc").alias("_host"), "prefixes")
    return (
        urls.join(rules_, F.col(f"{parts}.netloc") == F.col("_host"), "left")
        .withColumn("robots_blocked", R.blocked_by(F.col(f"{parts}.path"), F.col("prefixes")))
        .drop("_host", "prefixes")
    )


def classify_fetches(fetches: DataFrame, allowed_types: str | None = None, limit: int = MAX_CONTENT_BYTES) -> DataFrame:
    """Add allowed, reason and detail to a fetch log; ``robots_blocked`` is used when present."""
    blocked = F.col("robots_blocked") if "robots_blocked" in fetches.columns else F.lit(False)
    detail = F.col("error_detail") if "error_detail" in fetches.columns else F.lit("")
    types = F.col(allowed_types) if allowed_types else F.lit(None).cast("array<string>")
    verdict = rules.fetch_verdict(
        F.col("fetch_error"), F.col("status_code"), F.col("content_type"), F.col("content_length"),
        types, blocked, detail, limit)
    return fetches.withColumn("_v", verdict).select(*fetches.columns, "_v.allowed", "_v.reason", "_v.detail")


DISCARD_COLUMNS = ["job_id", "url", "parent_url", "depth", "reason", "detail"]


def discard_report(fetch_outcomes: DataFrame, link_outcomes: DataFrame) -> DataFrame:
    """Discards of both stages in one table; each branch is a filter of one classified table."""
    def branch(df: DataFrame, stage: str) -> DataFrame:
        return df.where(F.col("reason").isNotNull()).select(*DISCARD_COLUMNS, F.lit(stage).alias("discard_stage"))

    return branch(fetch_outcomes, "fetch").unionByName(branch(link_outcomes, "link"))


def url_search(rows: DataFrame, text: str = "", status: str | None = None, n: int = 300, by=("job_id",)) -> DataFrame:
    """Newest ``n`` rows per group whose URL contains the text, in any case."""
    found = rows.where(F.contains(F.lower("url"), F.lit(text.lower()))) if text else rows
    if status:
        found = found.where(F.col("status") == status)
    return top_per_group(found, list(by), ["-seq", "url"], n)
