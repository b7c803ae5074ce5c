"""The query catalogue: every operator on the given tables, with its SQL twin where one exists."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from weblode.functions import html as H, robots as R, rules, urls as U
from weblode.operators import events as E, extract as X, filters as L, frontier as Q, metrics as M, views as V
from weblode.operators.blocks import scratch_path, written
from weblode.plans import crawl, derived as D
from weblode.plans.oracle import with_
from weblode.schema import HTML_CONTENT_TYPES
from weblode.sources import event_log, store

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None, tables: str = "", recursive: bool = False):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_(tables, sql, recursive) if tables else sql.strip()
        return fn
    return register


def big(column, name: str | None = None):
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("bigint").alias(name or column)


def log(spark: SparkSession, sf: str) -> DataFrame:
    return D.crawl_events(D.events(spark, sf))


def full_log(spark: SparkSession, sf: str) -> DataFrame:
    return D.full_log(D.events(spark, sf))


# Page tables ------------------------------------------------------------------------------------

@query("scan_pages", "SELECT page_id, url, html FROM pages")
def scan_pages(spark, sf):
    return D.pages(spark, sf).select("page_id", "url", "html")


def _extracted(spark, sf, *fields):
    return X.extract_pages(D.pages(spark, sf), fields=fields)


@query("extract_title", """SELECT page_id, trim(replace(replace(replace(replace(
  regexp_extract(html, '<title>(.*?)</title>', 1), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title FROM pages""")
def extract_title(spark, sf):
    return _extracted(spark, sf, "title").select("page_id", "title")


def _with_head(spark, sf):
    """Pages given the head elements the corpus lacks; two of three pages get a description."""
    p = F.col("page_id")
    text = lambda c: c.cast("string")
    head = F.concat(
        F.when(p % 3 == 0, F.concat(F.lit('<META content=" Page '), text(p), F.lit(" &amp; more \" NAME='description'>")))
        .when(p % 3 == 1, "<meta name=description>").otherwise('<meta name="keywords" content="description">'),
        F.when(p % 4 < 2, F.concat(F.lit("<link rel='alternate canonical' href=/c/"), text(p), F.lit(">"))).otherwise(""),
        F.when(p % 5 == 0, F.concat(F.lit('<base target=x><base href="https://b.example.com/'), text(p), F.lit('/">'))).otherwise(""))
    return D.pages(spark, sf).select("page_id", "url", F.concat(head, "html").alias("html"))


@query("extract_description", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('Page ', page_id, ' & more') WHEN 1 THEN '' END AS description
FROM pages""")
def extract_description(spark, sf):
    return X.extract_pages(_with_head(spark, sf), fields=("description",)).select("page_id", "description")


@query("extract_canonical", "SELECT page_id, CASE WHEN page_id % 4 < 2 THEN concat('/c/', page_id) END AS canonical_url FROM pages")
def extract_canonical(spark, sf):
    return X.extract_pages(_with_head(spark, sf), fields=("canonical_url",)).select("page_id", "canonical_url")


@query("extract_base_href", """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN concat('https://b.example.com/', page_id, '/') ELSE url END AS base_href
FROM pages""")
def extract_base_href(spark, sf):
    return X.extract_pages(_with_head(spark, sf), fields=("base_href",)).select("page_id", "base_href")


@query("extract_lang", "SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def extract_lang(spark, sf):
    return _extracted(spark, sf, "lang").select("page_id", "lang")


@query("extract_word_count", """SELECT page_id, CAST(len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(html,
  '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n\\f]+'), lambda w: w <> '')) AS BIGINT) AS word_count
FROM pages""")
def extract_word_count(spark, sf):
    return _extracted(spark, sf, "word_count").select("page_id", "word_count")


@query("extract_links", "SELECT page_id, pos, href, anchor FROM links", "links")
def extract_links(spark, sf):
    return X.explode_links(D.pages(spark, sf), ["page_id"]).select("page_id", big("pos"), "href", "anchor")


@query("links_per_page", "SELECT page_id, CAST(len(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS BIGINT) AS links_found FROM pages")
def links_per_page(spark, sf):
    return _extracted(spark, sf, "links").select("page_id", big(F.size("links"), "links_found"))


@query("decode_content", "SELECT page_id, CAST(length(html) + 2 AS BIGINT) AS chars, md5(concat(html, chr(65533), '!')) AS digest FROM pages")
def decode_content(spark, sf):
    raw = D.pages(spark, sf).select("page_id", F.concat(F.encode("html", "UTF-8"), F.unhex(F.lit("FF21"))).alias("content"))
    return X.decode_pages(raw).select("page_id", big(F.length("html"), "chars"), F.md5("html").alias("digest"))


@query("parse_errors", """SELECT page_id, CASE WHEN fetch_error IS NULL THEN regexp_extract(html, '<html lang="([^"]*)"', 1) END AS lang,
  CAST(CASE WHEN fetch_error IS NULL THEN len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) ELSE 0 END AS BIGINT) AS links_found,
  fetch_error IS NOT NULL AS failed FROM fetches""", "fetches")
def parse_errors(spark, sf):
    broken = D.fetches(D.pages(spark, sf)).withColumn("html", F.when(F.col("fetch_error").isNull(), F.col("html")))
    out = X.extract_pages(broken, fields=("lang", "links"))
    return out.select("page_id", "lang", big(F.size("links"), "links_found"), F.col("error").isNotNull().alias("failed"))


# URL algebra ------------------------------------------------------------------------------------

def variants(pages: DataFrame) -> DataFrame:
    """Eight URLs per page that exercise the rules, with job and depth."""
    text = lambda c: c.cast("string")
    base = U.with_url_parts(pages.select("page_id", "url"), "url").select(
        "page_id", "url", F.concat("u.scheme", F.lit("://"), "u.netloc").alias("site"), "u.netloc")
    p, site = F.col("page_id"), F.col("site")
    urls = F.array(
        F.col("url"), F.concat(site, F.lit("/img/"), text(p), F.lit(".JPG")), F.concat(F.lit("ftp://"), "netloc", F.lit("/x")),
        F.concat(F.lit("http:///p"), text(p)), F.concat(site, F.lit("/"), F.repeat(F.lit("a"), 2100)),
        F.concat(site, F.lit("/a.js;v="), text(p), F.lit("?q="), text(p)), F.lit("JavaScript:x"), F.concat(site, F.lit(":8080/zz")))
    rows = base.select("page_id", F.concat(F.lit("job-"), text(p % 4)).alias("job_id"), (p % 8).cast("int").alias("depth"),
                       F.posexplode(urls).alias("variant", "url"))
    return U.with_url_parts(rows.withColumn("variant", F.col("variant").cast("bigint")), "url")


def _variants(spark, sf):
    return variants(D.pages(spark, sf))


@query("url_components", "SELECT page_id, variant, scheme, netloc, path, params, query, fragment FROM variants", "variants")
def url_components(spark, sf):
    return _variants(spark, sf).select("page_id", "variant", *[F.col(f"u.{c}").alias(c) for c in
                                                               ("scheme", "netloc", "path", "params", "query", "fragment")])


_RELATIVE = ["x", "?q=2", "//cdn.example.net/z", "#f", "", "../x", "mailto:a@b", "/r/../s/./t", "g;x=1"]


@query("resolve_url", """SELECT page_id, v AS variant, CASE v WHEN 0 THEN concat(site, folder, 'x') WHEN 1 THEN concat(site, path, '?q=2')
  WHEN 2 THEN concat(split_part(site, ':', 1), '://cdn.example.net/z') WHEN 3 THEN concat(regexp_replace(url, '#.*$', ''), '#f') WHEN 4 THEN url
  WHEN 5 THEN concat(site, regexp_replace(folder, '[^/]+/$', ''), 'x') WHEN 6 THEN 'mailto:a@b' WHEN 7 THEN concat(site, '/s/t')
  ELSE concat(site, folder, 'g;x=1') END AS resolved
FROM (SELECT *, regexp_replace(path, '[^/]*$', '') AS folder FROM (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, unnest(range(9)) AS v FROM pages) p) q""")
def resolve_url(spark, sf):
    rows = D.pages(spark, sf).select("page_id", "url", F.posexplode(F.array(*map(F.lit, _RELATIVE))).alias("variant", "href"))
    return U.with_resolved_url(rows, "url", "href", "resolved", normalized=False).select("page_id", big("variant"), "resolved")


@query("normalize_url", """SELECT page_id, variant, CASE variant WHEN 0 THEN regexp_replace(url, '#.*$', '') WHEN 6 THEN 'javascript:x' ELSE url END AS normalized
FROM variants""", "variants")
def normalize_url(spark, sf):
    return _variants(spark, sf).select("page_id", "variant", U.normalize_parts(F.col("u")).alias("normalized"))


@query("url_domain", "SELECT page_id, variant, netloc AS domain FROM variants", "variants")
def url_domain(spark, sf):
    return _variants(spark, sf).select("page_id", "variant", F.col("u.netloc").alias("domain"))


@query("registered_domain", """SELECT page_id, variant, CASE WHEN netloc = '' THEN '.'
  ELSE regexp_extract(netloc, '([^.]+\\.[^.:]+)(:[0-9]+)?$', 1) END AS registered FROM variants""", "variants")
def registered_domain(spark, sf):
    return _variants(spark, sf).select("page_id", "variant", U.registered_domain(F.col("u"), D.SUFFIXES).alias("registered"))


_SHARD = "instr('0123456789abcdef', right(md5({c}), 1)) - 1"


@query("queue_shard", f"SELECT page_id, variant, CAST({_SHARD.format(c='netloc')} AS INT) AS shard FROM variants", "variants")
def queue_shard(spark, sf):
    return _variants(spark, sf).select("page_id", "variant", U.queue_shard(F.col("u.netloc")).alias("shard"))


@query("queue_name", f"SELECT page_id, variant, concat('crawl.', {_SHARD.format(c='netloc')}) AS queue FROM variants", "variants")
def queue_name(spark, sf):
    return _variants(spark, sf).select("page_id", "variant", U.queue_name(U.queue_shard(F.col("u.netloc"))).alias("queue"))


@query("url_hash", "SELECT page_id, variant, substr(sha256(url), 1, 16) AS url_hash FROM variants", "variants")
def url_hash(spark, sf):
    return _variants(spark, sf).select("page_id", "variant", U.url_hash("url").alias("url_hash"))


@query("short_url", "SELECT page_id, variant, concat(netloc, substr(path, 1, 40)) AS label FROM variants", "variants")
def short_url(spark, sf):
    return _variants(spark, sf).select("page_id", "variant", U.short_url(F.col("u")).alias("label"))


@query("url_extension", """SELECT page_id, variant, CASE WHEN variant = 1 THEN '.jpg' WHEN variant = 5 THEN '.js' END AS extension
FROM variants""", "variants")
def url_extension(spark, sf):
    return _variants(spark, sf).select("page_id", "variant", U.binary_extension(F.col("u")).alias("extension"))


# Rules ------------------------------------------------------------------------------------------

def _rule(spark, sf, condition):
    return _variants(spark, sf).select("page_id", "variant", condition.alias("refused"))


def _rule_with_config(spark, sf, condition):
    rows = L.with_config(_variants(spark, sf), D.job_settings(D.events(spark, sf)))
    return rows.select("page_id", "variant", condition.alias("refused"))


@query("filter_url_length", "SELECT page_id, variant, length(url) > 2048 AS refused FROM variants", "variants")
def filter_url_length(spark, sf):
    return _rule(spark, sf, rules.too_long(F.col("url")))


@query("filter_scheme", "SELECT page_id, variant, scheme NOT IN ('http', 'https') AS refused FROM variants", "variants")
def filter_scheme(spark, sf):
    return _rule(spark, sf, rules.bad_scheme(F.col("u")))


@query("filter_host", "SELECT page_id, variant, netloc = '' AS refused FROM variants", "variants")
def filter_host(spark, sf):
    return _rule(spark, sf, rules.no_host(F.col("u")))


@query("filter_extension", "SELECT page_id, variant, variant IN (1, 5) AS refused FROM variants", "variants")
def filter_extension(spark, sf):
    return _rule(spark, sf, U.binary_extension(F.col("u")).isNotNull())


@query("filter_depth", """SELECT page_id, variant, v.depth > coalesce(j.max_depth, 3) AS refused
FROM variants v LEFT JOIN jobs j ON v.job_id = j.job_id""", "variants jobs")
def filter_depth(spark, sf):
    return _rule_with_config(spark, sf, rules.too_deep(F.col("depth"), F.coalesce("max_depth", F.lit(3))))


_OUTSIDE = """coalesce(len(j.allowed_domains) > 2 AND NOT regexp_matches(v.netloc, '(^|\\.)example\\.com(:[0-9]+)?$'), FALSE)"""


@query("filter_domain", f"SELECT page_id, variant, {_OUTSIDE} AS refused FROM variants v LEFT JOIN jobs j ON v.job_id = j.job_id", "variants jobs")
def filter_domain(spark, sf):
    return _rule_with_config(spark, sf, rules.outside_domains(
        F.col("u"), F.col("allowed_domains"), U.registered_domain(F.col("u"), D.SUFFIXES)))


@query("filter_pattern", """SELECT page_id, variant, coalesce(NOT regexp_matches(v.url, j.url_pattern), FALSE) AS refused
FROM variants v LEFT JOIN jobs j ON v.job_id = j.job_id""", "variants jobs")
def filter_pattern(spark, sf):
    return _rule_with_config(spark, sf, rules.misses_pattern(F.col("url"), F.col("url_pattern")))


@query("classify_url", f"""SELECT page_id, variant, reason IS NULL AS allowed, reason, detail FROM (
  SELECT page_id, variant, CASE WHEN length(url) > 2048 OR scheme NOT IN ('http', 'https') OR netloc = '' THEN 'invalid_url'
      WHEN variant IN (1, 5) THEN 'bad_content_type' WHEN too_deep THEN 'max_depth' WHEN outside THEN 'wrong_domain' WHEN missed THEN 'filter_rule' END AS reason,
    CASE WHEN length(url) > 2048 THEN 'URL too long' WHEN scheme NOT IN ('http', 'https') THEN concat('Unsupported scheme: ', scheme)
      WHEN netloc = '' THEN 'No host' WHEN variant = 1 THEN 'Binary extension: .jpg' WHEN variant = 5 THEN 'Binary extension: .js'
      WHEN too_deep THEN concat('Depth ', depth, ' > max ', deepest)
      WHEN outside THEN concat('Domain ', regexp_extract(netloc, '([^.]+\\.[^.:]+)(:[0-9]+)?$', 1), ' not in allowlist')
      WHEN missed THEN 'URL did not match pattern' END AS detail
  FROM (SELECT v.*, coalesce(j.max_depth, 3) AS deepest, v.depth > coalesce(j.max_depth, 3) AS too_deep, {_OUTSIDE} AS outside,
    coalesce(NOT regexp_matches(v.url, j.url_pattern), FALSE) AS missed FROM variants v LEFT JOIN jobs j ON v.job_id = j.job_id) c) r""", "variants jobs")
def classify_url(spark, sf):
    rows = L.with_config(_variants(spark, sf), D.job_settings(D.events(spark, sf)))
    return L.classify_urls(rows, D.SUFFIXES).select("page_id", "variant", "allowed", "reason", "detail")





def _fetch_rule(spark, sf, condition):
    return D.fetches(D.pages(spark, sf)).select("page_id", condition.alias("refused"))


@query("filter_content_type", "SELECT page_id, content_type = 'application/pdf' AS refused FROM fetches", "fetches")
def filter_content_type(spark, sf):
    types = F.array(*map(F.lit, HTML_CONTENT_TYPES))
    return _fetch_rule(spark, sf, rules.bad_content_type(F.col("content_type"), types))


@query("filter_size", "SELECT page_id, content_length > 4000 AS refused FROM fetches", "fetches")
def filter_size(spark, sf):
    return _fetch_rule(spark, sf, rules.too_large(F.col("content_length"), 4000))


@query("classify_fetch", """SELECT page_id, reason IS NULL AS allowed, reason, detail FROM (
  SELECT page_id, CASE WHEN fetch_error IS NOT NULL THEN fetch_error WHEN status_code >= 400 THEN 'http_error'
      WHEN content_type = 'application/pdf' THEN 'bad_content_type' WHEN content_length > 4000 THEN 'too_large' END AS reason,
    CASE WHEN fetch_error IS NOT NULL THEN '' WHEN status_code >= 400 THEN concat('HTTP ', status_code)
      WHEN content_type = 'application/pdf' THEN 'Content-Type: application/pdf'
      WHEN content_length > 4000 THEN concat('Content-Length ', content_length, ' > 4000') END AS detail FROM fetches) r""", "fetches")
def classify_fetch(spark, sf):
    rows = D.fetches(D.pages(spark, sf)).drop("html").withColumn("types", F.array(*map(F.lit, HTML_CONTENT_TYPES)))
    return L.classify_fetches(rows, "types", limit=4000).select("page_id", "allowed", "reason", "detail")


@query("robots_rules", "SELECT netloc, prefix FROM robots_rules", "robots_rules")
def robots_rules(spark, sf):
    return L.robots_rules(D.robots(D.pages(spark, sf))).select("netloc", F.explode("prefixes").alias("prefix"))


@query("robots_allowed", "SELECT page_id, NOT robots_blocked AS allowed FROM blocked", "blocked")
def robots_allowed(spark, sf):
    pages = D.pages(spark, sf).select("page_id", "url")
    rows = L.robots_verdict(U.with_url_parts(pages, "url"), L.robots_rules(D.robots(pages)))
    return rows.select("page_id", (~F.col("robots_blocked")).alias("allowed"))


def _judged(spark, sf):
    return crawl.classified_links(D.link_occurrences(D.pages(spark, sf)), D.job_settings(D.events(spark, sf)), D.SUFFIXES)


@query("discard_report", """SELECT job_id, url, CAST(NULL AS VARCHAR) AS parent_url, depth, reason, detail, 'fetch' AS discard_stage
FROM fetch_outcomes WHERE reason IS NOT NULL
UNION ALL SELECT job_id, url, page_url, depth, outcome, outcome_detail, 'link' FROM link_outcomes WHERE outcome IS NOT NULL""",
       "fetch_outcomes link_outcomes")
def discard_report(spark, sf):
    return L.discard_report(D.fetch_outcomes(D.pages(spark, sf)), Q.admit(_judged(spark, sf)))


@query("url_search", """SELECT job_id, url, status, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC, url) AS rn FROM url_state WHERE contains(lower(url), '/1')) r
WHERE rn <= 300""", "url_state")
def url_search(spark, sf):
    return L.url_search(E.url_state(log(spark, sf)), "/1").select("job_id", "url", "status", "seq")


# Frontier ---------------------------------------------------------------------------------------

@query("discover_domains", """SELECT job_id, domain, coalesce(outcome, 'queued') AS outcome, count(*) AS links FROM link_outcomes
GROUP BY ALL""", "link_outcomes")
def discover_domains(spark, sf):
    return crawl.discovery(D.link_occurrences(D.pages(spark, sf)), D.job_settings(D.events(spark, sf)), D.SUFFIXES).select(
        "job_id", "domain", "outcome", "links")


@query("seed_frontier", """SELECT job_id, url, CAST(0 AS INT) AS depth, CAST(NULL AS VARCHAR) AS parent_url, min(pos) AS discovered_seq,
  substr(sha256(url), 1, 16) AS url_hash FROM (
  SELECT job_id, unnest(string_split(replace(replace(seed_urls, '["', ''), '"]', ''), '", "')) AS url, unnest(range(3)) AS pos FROM jobs) s
GROUP BY job_id, url""", "jobs")
def seed_frontier(spark, sf):
    return Q.seed_frontier(D.jobs(D.events(spark, sf)))


@query("job_config", """SELECT job_id, CAST(coalesce(max_depth, CASE WHEN config_kind = 0 THEN 9 END) AS INT) AS max_depth, max_pages,
  CASE allowed_domains WHEN '["example.com"]' THEN 'example.com' WHEN '[]' THEN '' END AS allowed_domains, url_pattern,
  CASE WHEN config_kind = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS politeness_delay, config_kind <> 0 AS respect_robots,
  CASE WHEN config_kind = 1 THEN 'text/html' END AS allowed_content_types FROM jobs""", "jobs")
def job_config(spark, sf):
    c = Q.job_config(D.jobs(D.events(spark, sf)))
    return c.select("job_id", "max_depth", "max_pages", F.array_join("allowed_domains", ",").alias("allowed_domains"), "url_pattern",
                    "politeness_delay", "respect_robots", F.array_join("allowed_content_types", ",").alias("allowed_content_types"))


def _seen(links: DataFrame) -> DataFrame:
    """URLs admitted before: the targets of every page's sixth link."""
    return links.where(F.col("pos") == 5).select("job_id", U.url_hash("url").alias("url_hash"))


_ADMIT = """SELECT l.page_id AS parent_seq, pos, l.job_id, l.url, coalesce(l.outcome, CASE WHEN s.url IS NOT NULL THEN 'duplicate' ELSE 'queued' END) AS outcome
FROM link_outcomes l LEFT JOIN (SELECT DISTINCT job_id, url FROM links WHERE pos = 5) s ON l.job_id = s.job_id AND l.url = s.url"""


@query("frontier_new_urls", _ADMIT, "link_outcomes")
def frontier_new_urls(spark, sf):
    links = written(_judged(spark, sf), "links")
    out = Q.admit(links, _seen(links))
    return out.select("parent_seq", big("pos"), "job_id", "url", F.coalesce("reason", F.lit("queued")).alias("outcome"))


@query("frontier_add_batch", f"SELECT job_id, count(*) FILTER (outcome = 'queued') AS accepted FROM ({_ADMIT}) a GROUP BY job_id", "link_outcomes")
def frontier_add_batch(spark, sf):
    links = written(_judged(spark, sf), "links")
    return Q.admitted_counts(Q.admit(links, _seen(links)))


def _pending(spark, sf):
    return M.pending_frontier(log(spark, sf))


@query("frontier_order", "SELECT job_id, url, domain, depth, discovered_seq FROM pending ORDER BY depth, discovered_seq, url", "pending")
def frontier_order(spark, sf):
    return Q.frontier_order(_pending(spark, sf))


@query("frontier_next_batch", """SELECT job_id, url, domain, depth, discovered_seq, 'fetching' AS status FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY depth, discovered_seq, url) AS rn FROM pending) r WHERE rn <= 10""", "pending")
def frontier_next_batch(spark, sf):
    return Q.next_batch(_pending(spark, sf))


@query("dispatch_plan", """SELECT job_id, url, depth, queue_shard, concat('crawl.', queue_shard) AS queue_name,
  row_number() OVER (PARTITION BY job_id, queue_shard ORDER BY depth, discovered_seq, url) AS position FROM (
  SELECT *, CAST(instr('0123456789abcdef', right(md5(domain), 1)) - 1 AS INT) AS queue_shard FROM pending) p""", "pending")
def dispatch_plan(spark, sf):
    return Q.dispatch_plan(written(_pending(spark, sf), "frontier")).select("job_id", "url", "depth", "queue_shard", "queue_name", "position")


@query("max_pages_cap", """SELECT r.job_id, url, r.depth, CASE WHEN place > max_pages THEN 'max_pages' END AS reason FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY depth, page_id, pos, url) AS place FROM link_outcomes WHERE queued) r
LEFT JOIN jobs j ON r.job_id = j.job_id""", "link_outcomes jobs")
def max_pages_cap(spark, sf):
    queued = Q.admit(_judged(spark, sf)).where("queued").select(
        "job_id", "url", "depth", F.col("parent_seq").alias("discovered_seq"), "pos")
    return Q.cap_pages(written(queued, "queued"), D.jobs(D.events(spark, sf))).select("job_id", "url", "depth", "reason")


def _paced(spark, sf):
    return D.fetches(D.pages(spark, sf)).select(
        "job_id", U.url_netloc("url").alias("domain"), "arrival_ms", big("fetch_ms"), F.col("page_id").alias("seq"))


_SCHEDULE = """SELECT page_id AS seq, job_id, domain, fetch_ms, arrival_ms, CAST(s + max(arrival_ms - s) OVER (PARTITION BY job_id, domain ORDER BY arrival_ms, page_id) AS BIGINT) AS start_ms FROM (
  SELECT page_id, job_id, netloc AS domain, arrival_ms, CAST(fetch_ms AS BIGINT) AS fetch_ms, coalesce(sum(CAST(fetch_ms AS BIGINT) + 90000) OVER (
    PARTITION BY job_id, netloc ORDER BY arrival_ms, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM fetches) p"""


@query("politeness_schedule", f"SELECT seq, job_id, domain, start_ms, start_ms - arrival_ms AS wait_ms FROM ({_SCHEDULE}) t", "fetches")
def politeness_schedule(spark, sf):
    return Q.politeness_schedule(_paced(spark, sf), delay_ms=90_000).select("seq", "job_id", "domain", "start_ms", "wait_ms")


@query("politeness_schedule_by_job", """SELECT page_id AS seq, job_id, domain, CAST(s + max(arrival_ms - s) OVER (PARTITION BY job_id, domain ORDER BY arrival_ms, page_id) AS BIGINT) AS start_ms FROM (
  SELECT page_id, job_id, domain, arrival_ms, coalesce(sum(CAST(fetch_ms AS BIGINT) + delay) OVER (
    PARTITION BY job_id, domain ORDER BY arrival_ms, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
    SELECT f.page_id, f.job_id, netloc AS domain, page_id // 100 AS arrival_ms, fetch_ms, CASE WHEN config_kind = 0 THEN 500 ELSE 1000 END AS delay
    FROM fetches f LEFT JOIN jobs j ON j.job_id = f.job_id) d) p""", "fetches jobs")
def politeness_schedule_by_job(spark, sf):
    at_once = _paced(spark, sf).withColumn("arrival_ms", F.floor(F.col("seq") / 100))  # a hundred fetches in a millisecond
    return Q.politeness_schedule(at_once, jobs=Q.job_config(D.jobs(D.events(spark, sf)))).select("seq", "job_id", "domain", "start_ms")


@query("politeness_wait", f"""SELECT job_id, domain, CAST(greatest(0, max(start_ms + fetch_ms) + 90000 - (SELECT max(arrival_ms) FROM fetches)) AS BIGINT) AS wait_ms
FROM ({_SCHEDULE}) t GROUP BY job_id, domain""", "fetches")
def politeness_wait(spark, sf):
    paced = _paced(spark, sf)
    plan = Q.politeness_schedule(paced, delay_ms=90_000)
    ends = plan.select("job_id", "domain", (F.col("start_ms") + F.col("fetch_ms")).alias("end_ms"))
    return Q.politeness_wait(ends, paced.agg(F.max("arrival_ms")).scalar(), 90_000)


@query("expand_links", """SELECT f.job_id, g.dst, f.page_id AS parent, CAST(g.pos AS BIGINT) AS pos, f.depth + 1 AS depth
FROM fetches f JOIN link_graph g ON f.page_id = g.src WHERE f.fetch_error IS NULL AND f.status_code < 400""", "fetches link_graph")
def expand_links(spark, sf):
    pages = D.pages(spark, sf).select("page_id", "url", "html")
    ready = L.classify_fetches(D.fetches(pages)).where("allowed").select("job_id", F.col("page_id").alias("src"), "depth")
    return ready.join(D.link_graph(pages.select("page_id")), "src").select(
        "job_id", "dst", F.col("src").alias("parent"), big("pos"), (F.col("depth") + 1).alias("depth"))


@query("crawl_levels", """, seeds AS (SELECT concat('job-', page_id % 4) AS job_id, min(page_id) AS node FROM pages GROUP BY 1),
caps AS (SELECT * FROM (VALUES ('job-0', 3, 1000000), ('job-1', 3, 1000000), ('job-2', 5, 1000000), ('job-3', 6, 50)) t(job_id, deepest, most)),
walk AS (SELECT job_id, node, 0 AS depth FROM seeds
  UNION SELECT w.job_id, g.dst, w.depth + 1 FROM walk w JOIN link_graph g ON w.node = g.src JOIN caps c ON w.job_id = c.job_id WHERE w.depth < c.deepest),
reached AS (SELECT job_id, node, min(depth) AS depth FROM walk GROUP BY job_id, node),
placed AS (SELECT r.job_id, r.node, r.depth, p.node AS parent, g.pos, row_number() OVER (PARTITION BY r.job_id, r.node ORDER BY p.node, g.pos) AS rn
  FROM reached r LEFT JOIN (SELECT l.dst, l.src, l.pos, q.job_id, q.depth, q.node FROM link_graph l JOIN reached q ON l.src = q.node) AS g
    ON g.dst = r.node AND g.job_id = r.job_id AND g.depth = r.depth - 1
  LEFT JOIN reached p ON p.job_id = r.job_id AND p.node = g.src),
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY depth, parent, pos, node) AS place FROM placed WHERE rn = 1)
SELECT r.job_id, node, CAST(depth AS INT) AS depth, parent FROM ranked r JOIN caps c ON r.job_id = c.job_id WHERE place <= most""", "link_graph", recursive=True)
def crawl_levels(spark, sf):
    pages = D.pages(spark, sf).select("page_id")
    p = F.col("page_id")
    seeds = pages.groupBy(F.concat(F.lit("job-"), (p % 4).cast("string")).alias("job_id")).agg(F.min(p).alias("node")).withColumn("seq", F.col("node"))
    edges = written(D.link_graph(pages).withColumn("dst_seq", F.col("dst")), "edges")
    return crawl.crawl_levels(seeds, edges, D.jobs(D.events(spark, sf))).select("job_id", "node", "depth", "parent")


_WALK_RULES = """, seeds AS (SELECT concat('job-', page_id % 4) AS job_id, min(page_id) AS node FROM pages GROUP BY 1),
caps AS (SELECT * FROM (VALUES ('job-0', 3, 1000000), ('job-1', 3, 1000000), ('job-2', 5, 1000000), ('job-3', 6, 50)) t(job_id, deepest, most)),
steps AS (SELECT c.job_id, c.deepest, g.src, g.dst, g.pos FROM link_graph g JOIN pages p ON g.dst = p.page_id JOIN caps c
  ON (c.job_id <> 'job-1' OR regexp_matches(p.url, '^https?://([^/?#]*[.])?example[.]com([/?#]|$)')) AND (c.job_id <> 'job-2' OR regexp_matches(p.url, '/[a-m]'))),
walk AS (SELECT job_id, node, 0 AS depth FROM seeds
  UNION SELECT w.job_id, s.dst, w.depth + 1 FROM walk w JOIN steps s ON w.node = s.src AND w.job_id = s.job_id WHERE w.depth < s.deepest),
reached AS (SELECT job_id, node, min(depth) AS depth FROM walk GROUP BY job_id, node),
placed AS (SELECT r.job_id, r.node, r.depth, g.src AS parent, g.pos, row_number() OVER (PARTITION BY r.job_id, r.node ORDER BY g.src, g.pos) AS rn
  FROM reached r LEFT JOIN (SELECT s.job_id, s.src, s.dst, s.pos, q.depth FROM steps s JOIN reached q ON q.job_id = s.job_id AND q.node = s.src) g
    ON g.job_id = r.job_id AND g.dst = r.node AND g.depth = r.depth - 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY depth, parent, pos, node) AS place FROM placed WHERE rn = 1)
SELECT r.job_id, n.url, CAST(r.depth AS INT) AS depth, p.url AS parent_url FROM ranked r JOIN caps c ON r.job_id = c.job_id
JOIN pages n ON n.page_id = r.node LEFT JOIN pages p ON p.page_id = r.parent WHERE place <= most"""


@query("crawl_levels_with_rules", _WALK_RULES, "link_graph", recursive=True)
def crawl_levels_with_rules(spark, sf):
    pages = D.pages(spark, sf).select("page_id", "url")
    job = F.concat(F.lit("job-"), (F.col("page_id") % 4).cast("string")).alias("job_id")
    seeds = pages.groupBy(job).agg(F.min_by("url", "page_id").alias("node"), F.min("page_id").alias("seq"))
    by_id = lambda key, name: pages.select(F.col("page_id").alias(key), F.col("url").alias(name))
    graph = D.link_graph(pages).withColumnsRenamed({"src": "s", "dst": "d"})
    edges = graph.join(by_id("s", "src"), "s").join(by_id("d", "dst"), "d").select("src", "dst", F.col("d").alias("dst_seq"), "pos")
    jobs = written(D.job_settings(D.events(spark, sf)), "jobs")
    out = crawl.crawl_levels(seeds, written(edges, "edges"), jobs, crawl.url_judge(jobs, D.SUFFIXES))
    return out.select("job_id", F.col("node").alias("url"), "depth", F.col("parent").alias("parent_url"))


@query("job_clear", """SELECT p.job_id, p.url, p.depth, p.discovered_seq FROM pending p JOIN jobs j ON p.job_id = j.job_id
WHERE j.status <> 'stopped'""", "pending jobs")
def job_clear(spark, sf):
    return Q.live_frontier(_pending(spark, sf), D.jobs(D.events(spark, sf))).select("job_id", "url", "depth", "discovered_seq")


_CLEARED = """(SELECT j.job_id, (SELECT max(event_id) // 2 FROM events) AS cleared_seq FROM jobs j WHERE j.status = 'stopped')"""


def _clears(spark, sf):
    """Stopped jobs are cleared half way through the log."""
    raw = D.events(spark, sf)
    half = raw.agg(F.max("event_id")).first()[0] or 0
    return D.jobs(raw).where(F.col("status") == "stopped").select("job_id", F.lit(half // 2).cast("bigint").alias("cleared_seq"))


@query("job_clear_metrics", f"""SELECT job_id, CAST(sum(q) AS BIGINT) AS queued_total, CAST(sum(d) AS BIGINT) AS done, CAST(sum(x) AS BIGINT) AS discarded,
  CAST(sum(e) AS BIGINT) AS error, count(*) FILTER (q > 0) AS accepted_total, count(*) FILTER (q > 0 AND d = 0 AND x = 0) AS frontier_depth
FROM (SELECT c.job_id, url, count(*) FILTER (event_type = 'url_queued') AS q, count(*) FILTER (event_type = 'url_stored') AS d,
    count(*) FILTER (discard_stage = 'fetch') AS x, count(*) FILTER (event_type = 'url_error') AS e
  FROM crawl_events c LEFT JOIN {_CLEARED} k ON k.job_id = c.job_id WHERE coalesce(seq > cleared_seq, true) GROUP BY c.job_id, url) u GROUP BY job_id""", "crawl_events jobs")
def job_clear_metrics(spark, sf):
    return M.job_metrics(Q.since_clear(log(spark, sf), _clears(spark, sf)))


@query("job_clear_readmit", f"""SELECT s.job_id, s.url, NOT bool_or(seq > coalesce(cleared_seq, -1)) AS queued
FROM crawl_events s LEFT JOIN {_CLEARED} k ON k.job_id = s.job_id WHERE event_type = 'url_queued' GROUP BY s.job_id, s.url""", "crawl_events jobs")
def job_clear_readmit(spark, sf):
    """Every URL ever queued is offered again: only those that a clear made the job forget are admitted."""
    events = log(spark, sf)
    offered = events.where(F.col("event_type") == "url_queued").select("job_id", "url").distinct().select(
        "job_id", "url", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("parent_seq"), F.lit(0).alias("pos"),
        F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("detail"))
    return Q.admit(offered, Q.seen_urls(Q.since_clear(events, _clears(spark, sf)))).select("job_id", "url", "queued")


# Event log --------------------------------------------------------------------------------------

@query("event_history", """SELECT seq, job_id, event_type, url FROM (SELECT * FROM crawl_events WHERE seq >= 100 ORDER BY seq LIMIT 500) h
WHERE job_id = 'job-1'""", "crawl_events")
def event_history(spark, sf):
    return E.history(log(spark, sf), "job-1", start=100).select("seq", "job_id", "event_type", "url")


def _sent(events: DataFrame) -> DataFrame:
    """Events as they are sent: the time by its wire name, an id, no stage, and no domain on links that a rule refused."""
    by_rule = F.coalesce((F.col("discard_stage") == "link") & (F.col("discard_reason") != "duplicate"), F.lit(False))
    return events.withColumnRenamed("ts", "timestamp").withColumns({
        "event_id": F.concat(F.lit("e"), F.col("seq").cast("string")), "domain": F.when(~by_rule, F.col("domain"))}).drop("discard_stage")


def _wire(spark, sf) -> DataFrame:
    """The log as a stored table of flat maps; some event types are unknown, some depths no numbers."""
    rows = _sent(log(spark, sf))
    flat = event_log.encode_events(rows, keep=("seq",))
    broken = F.when(F.col("seq") % 50 == 3, F.map_from_arrays(F.array(F.lit("event_type")), F.array(F.lit("url_bogus")))).when(
        F.col("seq") % 50 == 4, F.map_from_arrays(F.array(F.lit("depth")), F.array(F.lit("deep")))).otherwise(F.expr("cast(map() as map<string,string>)"))
    merged = F.map_zip_with("data", broken, lambda k, a, b: F.coalesce(b, a))
    return written(flat.withColumn("data", merged), "wire")


@query("event_decode", """SELECT seq, concat('e', seq) AS event_id, event_type, job_id, ts AS timestamp, url, depth, status_code, content_length,
  fetch_duration_ms, status, discard_reason, m_frontier::DOUBLE AS frontier_depth FROM crawl_events WHERE seq % 50 NOT IN (3, 4)""", "crawl_events")
def event_decode(spark, sf):
    good = event_log.valid_events(event_log.decode_events(_wire(spark, sf), keep=("seq",)))
    return good.select("seq", "event_id", "event_type", "job_id", "timestamp", "url", "depth", "status_code", "content_length",
                       "fetch_duration_ms", "status", "discard_reason", F.col("metrics")["frontier_depth"].alias("frontier_depth"))


@query("event_decode_rejects", """SELECT seq, CASE seq % 50 WHEN 3 THEN 'event_type unknown' ELSE 'depth malformed' END AS error
FROM crawl_events WHERE seq % 50 IN (3, 4)""", "crawl_events")
def event_decode_rejects(spark, sf):
    return event_log.invalid_events(event_log.decode_events(_wire(spark, sf), keep=("seq",))).select("seq", "error")


@query("wire_job_metrics", """SELECT job_id, CAST(sum(q) AS BIGINT) AS queued_total, CAST(sum(d) AS BIGINT) AS done, CAST(sum(x) AS BIGINT) AS discarded,
  CAST(sum(e) AS BIGINT) AS error, count(*) FILTER (q > 0) AS accepted_total, count(*) FILTER (q > 0 AND d = 0 AND x = 0) AS frontier_depth
FROM (SELECT job_id, url, count(*) FILTER (event_type = 'url_queued') AS q, count(*) FILTER (event_type = 'url_stored') AS d,
    count(*) FILTER (discard_stage = 'fetch') AS x, count(*) FILTER (event_type = 'url_error') AS e
  FROM crawl_events WHERE seq % 50 NOT IN (3, 4) GROUP BY job_id, url) u GROUP BY job_id""", "crawl_events")
def wire_job_metrics(spark, sf):
    return M.job_metrics(event_log.as_log(event_log.valid_events(event_log.decode_events(_wire(spark, sf), keep=("seq",)))))


@query("event_encode", """SELECT seq, CAST(10 + (event_type = 'url_queued')::INT * 2 + (status_code IS NOT NULL)::INT * 2 + (links_found IS NOT NULL)::INT
    + (content_length IS NOT NULL)::INT + (fetch_duration_ms IS NOT NULL)::INT + (discard_reason IS NOT NULL)::INT * 2
    + (coalesce(m_queued, m_frontier, m_done) IS NOT NULL)::INT AS BIGINT) AS fields,
  CAST(depth AS VARCHAR) AS depth, CAST(content_length AS VARCHAR) AS content_length, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, url
FROM crawl_events""", "crawl_events")
def event_encode(spark, sf):
    flat = event_log.encode_events(log(spark, sf).withColumnRenamed("ts", "timestamp").withColumn("event_id", F.col("seq").cast("string")), keep=("seq",))
    value = lambda name: F.col("data")[name].alias(name)
    return flat.select("seq", big(F.size("data"), "fields"), value("depth"), value("content_length"), value("timestamp"), value("url"))


@query("event_retention", "SELECT seq, job_id, event_type FROM crawl_events ORDER BY seq DESC LIMIT 5000", "crawl_events")
def event_retention(spark, sf):
    return E.retain_latest(log(spark, sf), 5000).select("seq", "job_id", "event_type")


_STATE = "job_id, url, parent_url, depth, status, status_code, content_type, links_found, fetch_duration_ms, discard_reason, discard_detail, worker_id, ts, seq"


@query("url_state", f"SELECT {_STATE} FROM url_state", "url_state")
def url_state(spark, sf):
    return E.url_state(log(spark, sf))


@query("url_state_fetch_stage", "SELECT job_id, url, status, depth, discard_reason, seq FROM url_state_fetch", "url_state_fetch")
def url_state_fetch_stage(spark, sf):
    return E.url_state(log(spark, sf), ignore_link_stage=True).select("job_id", "url", "status", "depth", "discard_reason", "seq")


@query("live_graph_nodes", """SELECT c.job_id, c.url, regexp_extract(c.url, '^[a-z]+://(.*)$', 1) AS label,
  CAST(arg_min(depth, seq) AS INT) AS depth, arg_max(status, seq) AS status,
  CAST(arg_max(CASE WHEN before IS NULL OR before <> status THEN status_code END, CASE WHEN status_code IS NOT NULL AND (before IS NULL OR before <> status) THEN seq END) AS INT) AS status_code
FROM (SELECT *, lag(status) OVER (PARTITION BY job_id, url ORDER BY seq) AS before FROM crawl_events) c GROUP BY c.job_id, c.url""", "crawl_events")
def live_graph_nodes(spark, sf):
    return E.live_graph_nodes(log(spark, sf))


@query("live_graph_edges", """SELECT job_id, source_url AS source, target_url AS target, min(seq) AS first_seq FROM crawl_events
WHERE event_type = 'url_queued' GROUP BY ALL""", "crawl_events")
def live_graph_edges(spark, sf):
    return E.live_graph_edges(log(spark, sf))


@query("discard_feed", """SELECT job_id, seq, url, discard_reason FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn
FROM crawl_events WHERE event_type = 'url_discarded') d WHERE rn <= 300""", "crawl_events")
def discard_feed(spark, sf):
    return E.discard_feed(log(spark, sf), 300).select("job_id", "seq", "url", "discard_reason")


@query("event_feed", """SELECT job_id, seq, event_type, url FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn
FROM crawl_events) d WHERE rn <= 200""", "crawl_events")
def event_feed(spark, sf):
    return E.feed(log(spark, sf)).select("job_id", "seq", "event_type", "url")


@query("event_labels", """SELECT seq, CASE event_type WHEN 'url_queued' THEN '→ QUEUE' WHEN 'url_fetching' THEN '⟳ FETCH' WHEN 'url_fetched' THEN '✓ FETCH'
    WHEN 'url_stored' THEN '✓ STORE' ELSE '✗ DISCARD' END AS event_label,
  CASE discard_reason WHEN 'duplicate' THEN 'DUP' WHEN 'max_depth' THEN 'DEPTH' WHEN 'robots_txt' THEN 'ROBOTS' WHEN 'http_error' THEN 'HTTP'
    WHEN 'wrong_domain' THEN 'DOMAIN' END AS reason_label FROM crawl_events""", "crawl_events")
def event_labels(spark, sf):
    return E.event_labels(log(spark, sf)).select("seq", "event_label", "reason_label")


@query("url_timeline", """SELECT job_id, key_url, seq FROM (SELECT *, row_number() OVER (PARTITION BY job_id, key_url ORDER BY seq DESC) AS rn FROM (
  SELECT job_id, url AS key_url, seq FROM crawl_events UNION ALL
  SELECT job_id, source_url, seq FROM crawl_events WHERE source_url <> url) k) r WHERE rn <= 30""", "crawl_events")
def url_timeline(spark, sf):
    return E.url_timeline(log(spark, sf)).select("job_id", "key_url", "seq")


@query("crawl_rate", """SELECT job_id, seq, ts, rate FROM (
  SELECT job_id, seq, ts, coalesce(1e6::DOUBLE / nullif(epoch_us(ts) - lag(epoch_us(ts)) OVER w, 0), 0.0) AS rate,
    row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS rn FROM crawl_events WHERE event_type = 'url_stored'
  WINDOW w AS (PARTITION BY job_id ORDER BY ts, seq)) r WHERE rn <= 120""", "crawl_events")
def crawl_rate(spark, sf):
    return E.crawl_rate(log(spark, sf))


@query("active_domains", "SELECT job_id, domain, active_worker FROM active", "active")
def active_domains(spark, sf):
    return E.active_domains(log(spark, sf))


# Metrics ----------------------------------------------------------------------------------------

@query("job_metrics", "SELECT * FROM job_metrics", "job_metrics")
def job_metrics(spark, sf):
    return M.job_metrics(log(spark, sf))


@query("frontier_size", """SELECT j.job_id, count(p.url) AS size, count(p.url) = 0 AS is_empty FROM jobs j LEFT JOIN pending p ON j.job_id = p.job_id
GROUP BY j.job_id""", "jobs pending")
def frontier_size(spark, sf):
    return M.frontier_size(_pending(spark, sf), D.jobs(D.events(spark, sf)))


_LIVE_SQL = """SELECT c.job_id,
  CAST(coalesce(arg_max(c.m_queued, CASE WHEN c.m_queued IS NOT NULL THEN c.seq END), 0) + count(*) FILTER (event_type = 'url_queued' AND c.seq > coalesce(r.q, -1)) AS BIGINT) AS queued_total,
  CAST(coalesce(arg_max(c.m_done, CASE WHEN c.m_done IS NOT NULL THEN c.seq END), 0) + count(*) FILTER (event_type = 'url_stored' AND c.seq > coalesce(r.d, -1)) AS BIGINT) AS done,
  count(*) FILTER (event_type = 'url_discarded') AS discarded, count(*) FILTER (event_type = 'url_error') AS error,
  CAST(coalesce(arg_max(c.m_frontier, CASE WHEN c.m_frontier IS NOT NULL THEN c.seq END), 0) AS BIGINT) AS frontier_depth
FROM crawl_events c JOIN (SELECT job_id, max(CASE WHEN m_queued IS NOT NULL THEN seq END) AS q, max(CASE WHEN m_done IS NOT NULL THEN seq END) AS d
  FROM crawl_events GROUP BY job_id) r ON c.job_id = r.job_id GROUP BY c.job_id"""


@query("live_metrics", _LIVE_SQL, "crawl_events")
def live_metrics(spark, sf):
    return M.live_metrics(log(spark, sf))


@query("domain_stats", "SELECT * FROM domain_stats", "domain_stats")
def domain_stats(spark, sf):
    return M.domain_stats(log(spark, sf))


@query("domain_summary", """SELECT job_id, count(*) AS domains, count(active_worker) AS active, count(DISTINCT queue_shard) AS shards_used,
  CAST(sum(done) AS BIGINT) AS done, CAST(sum(queued) AS BIGINT) AS queued FROM domain_stats GROUP BY job_id""", "domain_stats")
def domain_summary(spark, sf):
    return M.domain_summary(M.domain_stats(log(spark, sf)))


@query("shard_heatmap", """SELECT j.job_id, CAST(s.shard AS INT) AS queue_shard, count(d.domain) AS domains, count(d.active_worker) > 0 AS has_active
FROM (SELECT DISTINCT job_id FROM domain_stats) j CROSS JOIN (SELECT unnest(range(16)) AS shard) s
LEFT JOIN domain_stats d ON d.job_id = j.job_id AND d.queue_shard = s.shard GROUP BY ALL""", "domain_stats")
def shard_heatmap(spark, sf):
    return M.shard_heatmap(M.domain_stats(log(spark, sf)))


@query("queue_depths", f"""SELECT CAST(s.shard AS INT) AS queue_shard, concat('crawl.', s.shard) AS queue_name, count(p.url) AS pending
FROM (SELECT unnest(range(16)) AS shard) s LEFT JOIN pending p ON {_SHARD.format(c='p.domain')} = s.shard GROUP BY s.shard""", "pending")
def queue_depths(spark, sf):
    return M.queue_depths(_pending(spark, sf))


@query("url_status_counts", """SELECT s.job_id, count(*) AS "all", count(*) FILTER (status = 'done') AS done,
  count(*) FILTER (status IN ('fetching', 'parsing')) AS fetching, any_value(d.n) AS discarded, count(*) FILTER (status = 'error') AS error
FROM url_state s JOIN (SELECT job_id, count(*) AS n FROM crawl_events WHERE event_type = 'url_discarded' GROUP BY job_id) d ON s.job_id = d.job_id
GROUP BY s.job_id""", "url_state")
def url_status_counts(spark, sf):
    events = log(spark, sf)
    return M.url_status_counts(E.url_state(events), events)


@query("success_rate", """SELECT job_id, CAST(CASE WHEN done + discarded + error > 0 THEN floor(100.0::DOUBLE * done / (done + discarded + error) + 0.5)
  ELSE 0 END AS BIGINT) AS success_rate FROM job_metrics""", "job_metrics")
def success_rate(spark, sf):
    return M.success_rate(M.job_metrics(log(spark, sf)))


@query("worker_states", """SELECT worker_id, s_hostname AS hostname, s_pid AS pid, s_url AS current_url, s_job AS current_job_id, s_status AS status,
  s_urls AS urls_processed, s_errors AS errors, s_bytes AS bytes_downloaded, TIMESTAMP '2024-01-01 00:00:00' AS started_at, ts AS last_heartbeat,
  seq AS reported_seq FROM reported""", "reported")
def worker_states(spark, sf):
    return M.worker_states(full_log(spark, sf))


@query("worker_stats", """SELECT e.worker_id, count(*) FILTER (event_type = 'url_stored') AS urls_processed, count(*) FILTER (event_type = 'url_error') AS errors,
  CAST(coalesce((SELECT sum(bytes) FROM stored_fetches f WHERE f.worker_id = e.worker_id), 0) AS BIGINT) AS bytes_downloaded, max(s_status) AS last_status,
  max(s_url) AS current_url, max(s_job) AS current_job_id, max(e.ts) AS last_heartbeat FROM full_log e LEFT JOIN (
  SELECT worker_id, s_status, s_url, s_job FROM reported) r ON r.worker_id = e.worker_id GROUP BY e.worker_id""", "stored_fetches full_log reported")
def worker_stats(spark, sf):
    return M.worker_stats(full_log(spark, sf))


@query("feed_counts", "SELECT job_id, count(*) AS events FROM crawl_events GROUP BY job_id", "crawl_events")
def feed_counts(spark, sf):
    return M.feed_counts(log(spark, sf))


@query("job_latency", """SELECT job_id, floor(sum(ms) * 10 + 0.5) / 10 AS latency_sum FROM stored_fetches
GROUP BY job_id""", "stored_fetches")
def job_latency(spark, sf):
    return M.job_latency(log(spark, sf)).withColumn("latency_sum", M.half_up(F.col("latency_sum"), 1))


@query("job_status_fold", """SELECT j.job_id, coalesce(e.status, j.status) AS status FROM jobs j LEFT JOIN (
  SELECT user_id, CASE arg_max(event_type, event_id) WHEN 'signup' THEN 'running' ELSE 'completed' END AS status FROM events
  WHERE event_type IN ('signup', 'purchase') GROUP BY user_id) e ON j.user_id = e.user_id""", "jobs")
def job_status_fold(spark, sf):
    raw = D.events(spark, sf)
    return M.job_status(D.jobs(raw), D.job_events(raw))


@query("job_overview", """SELECT j.job_id, j.name, j.status, coalesce(m.queued_total, j.urls_queued) AS urls_queued,
  coalesce(m.done, j.urls_fetched) AS urls_fetched, coalesce(m.discarded, j.urls_discarded) AS urls_discarded,
  coalesce(a.bytes, 0) AS bytes_downloaded, floor(coalesce(a.stored / a.seconds, 0.0) * 1e9::DOUBLE + 0.5) / 1e9::DOUBLE AS pages_per_second
FROM jobs j LEFT JOIN job_metrics m ON j.job_id = m.job_id LEFT JOIN (
  SELECT job_id, CAST((SELECT sum(bytes) FROM stored_fetches f WHERE f.job_id = e.job_id) AS BIGINT) AS bytes, count(*) FILTER (event_type = 'url_stored') AS stored,
    (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6::DOUBLE AS seconds FROM crawl_events e GROUP BY job_id) a ON j.job_id = a.job_id""", "jobs job_metrics stored_fetches")
def job_overview(spark, sf):
    out = M.job_overview(D.jobs(D.events(spark, sf)), log(spark, sf))
    return out.withColumn("pages_per_second", M.half_up(F.col("pages_per_second"), 9))


@query("worker_liveness", """SELECT worker_id, max(ts) AS last_heartbeat, epoch_us(max(ts)) >= (SELECT max(epoch_us(ts)) FROM full_log) - 900000000
  AND coalesce(max(seq) FILTER (event_type = 'worker_offline') < max(seq) FILTER (event_type <> 'worker_offline'), true) AS alive
FROM full_log GROUP BY worker_id""", "full_log")
def worker_liveness(spark, sf):
    return M.worker_liveness(full_log(spark, sf), ttl_seconds=900)


_SESSIONS = """SELECT worker_id, min(ts) AS first_beat, max(ts) AS last_beat, count(*) AS beats FROM (
  SELECT *, sum(starts) OVER (PARTITION BY worker_id ORDER BY ts, seq) AS session FROM (
    SELECT worker_id, ts, seq, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY worker_id ORDER BY ts, seq) < 3600000000 THEN 0 ELSE 1 END AS starts
    FROM full_log WHERE event_type <> 'worker_offline') b) s GROUP BY worker_id, session"""


@query("worker_sessions", _SESSIONS, "full_log")
def worker_sessions(spark, sf):
    return M.worker_sessions(full_log(spark, sf), gap_seconds=3600)


# Views ------------------------------------------------------------------------------------------

_PAGE = "url, parent_url, depth, status_code, title, content_type, links_found, fetch_duration_ms, fetched_at"


def _stored(spark, sf):
    return D.stored_pages(D.pages(spark, sf))


@query("pages_page", f"""SELECT job_id, {_PAGE} FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY fetched_at DESC, url) AS rn FROM stored) p
WHERE rn > 10 AND rn <= 60""", "stored")
def pages_page(spark, sf):
    return V.pages_page(_stored(spark, sf), n=50, offset=10)


@query("pages_page_at", f"""SELECT job_id, {_PAGE} FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY fetched_at DESC, url) AS rn,
  count(*) OVER (PARTITION BY job_id) AS n FROM stored) p WHERE job_id = 'job-2' AND rn > n * 3 // 4 AND rn <= n * 3 // 4 + 7""", "stored")
def pages_page_at(spark, sf):
    rows, counts = V.index_pages(_stored(spark, sf))
    n = counts.where(F.col("job_id") == "job-2").agg(F.coalesce(F.max("_end"), F.lit(0))).first()[0]
    return V.page_at(rows, counts, "job-2", 7, n * 3 // 4)


def _discard_rows(spark, sf):
    return log(spark, sf).where(F.col("event_type") == "url_discarded").select(
        "job_id", "url", "parent_url", "depth", F.col("discard_reason").alias("reason"), F.col("discard_detail").alias("detail"),
        F.col("ts").alias("discarded_at"), "seq")


@query("discards_page", """SELECT job_id, url, parent_url, depth, discard_reason AS reason, discard_detail AS detail, ts AS discarded_at FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS rn FROM crawl_events WHERE discard_reason = 'robots_txt') d
WHERE rn <= 100""", "crawl_events")
def discards_page(spark, sf):
    return V.discards_page(_discard_rows(spark, sf), reason="robots_txt").drop("seq")


@query("jobs_list", "SELECT job_id, name, status, created_at FROM jobs ORDER BY created_at DESC, job_id", "jobs")
def jobs_list(spark, sf):
    return V.jobs_list(D.jobs(D.events(spark, sf))).select("job_id", "name", "status", "created_at")


@query("graph_nodes", """SELECT job_id, url AS id, concat(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), substr(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), 1, 40)) AS label,
  depth, 'done' AS status, status_code, title FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY fetched_at, url) AS rn FROM stored) p
WHERE rn <= 500""", "stored")
def graph_nodes(spark, sf):
    return V.graph_nodes(_stored(spark, sf))


@query("graph_edges", """SELECT job_id, parent_url AS source, url AS target FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY fetched_at, url) AS rn FROM stored) p
WHERE rn <= 500 AND parent_url <> url""", "stored")
def graph_edges(spark, sf):
    return V.graph_edges(_stored(spark, sf))


@query("url_detail", """SELECT k.job_id, k.url, CASE WHEN s.seq IS NOT NULL THEN 'entry' ELSE 'discard' END AS found_in,
  coalesce(s.status, 'discarded') AS status, CASE WHEN s.seq IS NOT NULL THEN s.depth ELSE d.depth END AS depth,
  CASE WHEN s.seq IS NOT NULL THEN s.discard_reason ELSE d.discard_reason END AS discard_reason, coalesce(s.seq, d.seq) AS seq
FROM (SELECT DISTINCT job_id, url FROM crawl_events) k LEFT JOIN url_state_fetch s ON k.job_id = s.job_id AND k.url = s.url
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY job_id, url ORDER BY seq DESC) AS rn FROM crawl_events WHERE event_type = 'url_discarded') d
  ON k.job_id = d.job_id AND k.url = d.url AND d.rn = 1""", "url_state_fetch")
def url_detail(spark, sf):
    events = log(spark, sf)
    return V.url_detail(events.select("job_id", "url").distinct(), events)


@query("robots_as_of", """SELECT p.event_id AS seq, max(s.at_us) AS snap_us, max(s.at_us) IS NULL AS needs_refresh FROM (
  SELECT event_id, user_id % 40 AS host, epoch_us(ts) AS at_us FROM events WHERE event_type = 'view') p LEFT JOIN (
  SELECT user_id % 40 AS host, epoch_us(ts) AS at_us FROM events WHERE event_type = 'signup') s
  ON p.host = s.host AND s.at_us <= p.at_us AND p.at_us - s.at_us < 3600000000 GROUP BY p.event_id""")
def robots_as_of(spark, sf):
    raw = D.events(spark, sf)
    return V.robots_as_of(D.robots_probes(raw), D.robots_snapshots(raw)).select("seq", "snap_us", "needs_refresh")


# Stored tables ----------------------------------------------------------------------------------

@query("store_pages", "SELECT sha256(concat(job_id, chr(10), url)) AS id, job_id, url, depth, title, links_found, content_length FROM stored", "stored")
def store_pages(spark, sf):
    path = scratch_path(spark, "pages")
    pages = _stored(spark, sf)
    store.append_pages(pages, path)
    store.append_pages(pages.withColumn("title", F.lit("stored again")), path)
    return store.read_pages(spark, path).select("id", "job_id", "url", "depth", "title", "links_found", "content_length")


@query("store_discards", "SELECT job_id, url, depth, reason, detail FROM fetch_outcomes WHERE reason IS NOT NULL", "fetch_outcomes")
def store_discards(spark, sf):
    path = scratch_path(spark, "discards")
    out = D.fetch_outcomes(D.pages(spark, sf)).where(F.col("reason").isNotNull())
    store.append_discards(out.select(*L.DISCARD_COLUMNS), path)
    return spark.read.parquet(path).select("job_id", "url", "depth", "reason", "detail")


@query("store_links", """SELECT job_id, sha256(concat(job_id, chr(10), page_url)) AS source_id, url AS target_url, anchor AS anchor_text FROM links""", "links")
def store_links(spark, sf):
    path = scratch_path(spark, "links")
    store.append_links(_judged(spark, sf), path)
    return spark.read.parquet(path).select("job_id", "source_id", "target_url", "anchor_text")


@query("crawl_step", """SELECT job_id, url, reason, discard_stage FROM (
  SELECT job_id, url, reason, 'fetch' AS discard_stage FROM fetch_outcomes WHERE reason IS NOT NULL
  UNION ALL SELECT l.job_id, l.url, coalesce(l.reason, CASE WHEN l.rn > 1 THEN 'duplicate' WHEN l.place > j.max_pages THEN 'max_pages' ELSE 'queued' END), 'link' FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id, reason IS NULL, rn = 1 ORDER BY depth, page_id, pos) AS place FROM (
      SELECT l.*, row_number() OVER (PARTITION BY l.job_id, l.url, l.reason IS NULL ORDER BY l.depth, l.page_id, l.pos) AS rn
      FROM judged_links l JOIN fetch_outcomes f ON l.page_id = f.page_id AND f.reason IS NULL) a) l LEFT JOIN jobs j ON l.job_id = j.job_id) t""",
       "judged_links fetch_outcomes")
def crawl_step(spark, sf):
    pages = D.pages(spark, sf)
    out = crawl.crawl_step(D.fetches(pages), D.robots(pages), D.job_settings(D.events(spark, sf)), D.SUFFIXES)
    queued = out["frontier"].select("job_id", "url", F.lit("queued").alias("reason"), F.lit("link").alias("discard_stage"))
    return out["discards"].select("job_id", "url", "reason", "discard_stage").unionByName(queued)


from weblode.plans import catalog_streams  # noqa: E402,F401  (registers the streaming queries)
