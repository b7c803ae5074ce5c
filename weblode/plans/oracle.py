"""The catalogue's queries in SQL, for a second engine to check against.

``with_`` puts the derived tables a query needs in front of it. The derived tables are the SQL twins
of ``derived.py``.
"""

DERIVED = {
    "crawl_events": """
SELECT event_id AS seq, ts, concat('job-', user_id % 4) AS job_id,
  CASE event_type WHEN 'signup' THEN 'url_queued' WHEN 'view' THEN 'url_fetching' WHEN 'click' THEN 'url_fetched'
    WHEN 'purchase' THEN 'url_stored' ELSE 'url_discarded' END AS event_type,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'fetching' WHEN 'click' THEN 'fetched'
    WHEN 'purchase' THEN 'done' ELSE 'discarded' END AS status,
  concat('w', event_id % 8) AS worker_id,
  concat('d', user_id % 40, '.example.com') AS domain,
  concat('https://d', user_id % 40, '.example.com/', user_id, '/', k % 5) AS url,
  concat('https://d', (user_id * 7 + 3) % 40, '.example.com/') AS parent_url,
  CASE WHEN event_type = 'signup' THEN concat('https://d', (user_id * 7 + 3) % 40, '.example.com/') END AS source_url,
  CASE WHEN event_type = 'signup' THEN concat('https://d', user_id % 40, '.example.com/', user_id, '/', k % 5) END AS target_url,
  CAST(user_id % 6 AS INT) AS depth,
  CASE WHEN event_type = 'click' THEN 200 END AS status_code,
  CASE WHEN event_type = 'click' THEN 'text/html' END AS content_type,
  CASE WHEN event_type = 'purchase' THEN k % 7 END AS links_found,
  CASE WHEN event_type = 'click' THEN value * 10 END AS fetch_duration_ms,
  CASE WHEN event_type = 'click' THEN k * 1000 END AS content_length,
  CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 'duplicate' WHEN 1 THEN 'max_depth'
    WHEN 2 THEN 'robots_txt' WHEN 3 THEN 'http_error' ELSE 'wrong_domain' END END AS discard_reason,
  CASE WHEN event_type = 'error' THEN concat('k=', k) END AS discard_detail,
  CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 5 IN (2, 3) THEN 'fetch' ELSE 'link' END END AS discard_stage,
  CASE WHEN event_type = 'view' AND k = 7 THEN 1000 + event_id % 100 END AS m_queued,
  CASE WHEN event_type = 'view' AND k IN (7, 8) THEN event_id % 500 END AS m_frontier,
  CASE WHEN event_type = 'purchase' AND k = 9 THEN event_id % 300 END AS m_done,
  user_id, k
FROM (SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events) b""",
    "worker_events": """
SELECT event_id * 2 + 1 AS seq, ts, '__system__' AS job_id, concat('w', (event_id // 12) % 8) AS worker_id,
  CASE event_id % 12 WHEN 0 THEN 'worker_offline' WHEN 3 THEN 'worker_idle' WHEN 6 THEN 'worker_busy' ELSE 'worker_heartbeat' END AS event_type,
  CASE event_id % 12 WHEN 0 THEN NULL WHEN 6 THEN 'busy' ELSE 'idle' END AS s_status, concat('h', event_id % 3) AS s_hostname, event_id % 1000 AS s_pid,
  CASE WHEN event_id % 12 = 6 THEN concat('https://d', user_id % 40, '.example.com/') END AS s_url,
  CASE WHEN event_id % 12 = 6 THEN concat('job-', user_id % 4) END AS s_job,
  CASE WHEN event_id % 24 <> 9 THEN event_id % 500 ELSE 0 END AS s_urls, CASE WHEN event_id % 36 <> 6 THEN event_id % 7 ELSE 0 END AS s_errors,
  CASE WHEN event_id % 60 <> 3 THEN event_id * 100 ELSE 0 END AS s_bytes
FROM events WHERE event_id % 3 = 0 AND (event_id % 12 <> 0 OR event_id % 120 = 0)""",
    "full_log": """
SELECT seq * 2 AS seq, ts, job_id, event_type, worker_id, status FROM crawl_events
UNION ALL SELECT seq, ts, job_id, event_type, worker_id, NULL FROM worker_events""",
    "reported": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY seq DESC) AS rn FROM worker_events WHERE s_status IS NOT NULL) r WHERE rn = 1""",
    "jobs": """
SELECT concat('job-', user_id) AS job_id, concat('crawl ', user_id) AS name,
  CASE user_id % 4 WHEN 2 THEN 'paused' WHEN 3 THEN 'stopped' ELSE 'running' END AS status,
  concat('["https://d', user_id % 40, '.example.com/", "https://d', user_id % 40, '.example.com/", "https://d',
    (user_id + 1) % 40, '.example.com/a#x"]') AS seed_urls,
  CASE WHEN user_id % 7 <> 5 THEN CASE user_id % 4 WHEN 2 THEN 5 WHEN 3 THEN 6 ELSE 3 END END AS max_depth,
  CAST(CASE WHEN user_id % 4 = 3 THEN 50 ELSE 1000000 END AS BIGINT) AS max_pages,
  CASE user_id % 4 WHEN 1 THEN '["example.com"]' WHEN 3 THEN '[]' END AS allowed_domains,
  CASE WHEN user_id % 4 = 2 THEN '/[a-m]' END AS url_pattern,
  user_id % 3 AS config_kind, user_id,
  min(ts) AS created_at, count(*) FILTER (event_type = 'signup') AS urls_queued,
  count(*) FILTER (event_type = 'purchase') AS urls_fetched, count(*) FILTER (event_type = 'error') AS urls_discarded
FROM events GROUP BY user_id""",
    "fetches": """
SELECT page_id, url, html, concat('job-', page_id % 4) AS job_id, CAST(page_id % 6 AS INT) AS depth,
  CASE WHEN page_id % 25 = 7 THEN 'timeout' WHEN page_id % 25 = 8 THEN 'connection_error' END AS fetch_error,
  CASE WHEN page_id % 25 IN (7, 8) THEN 0 WHEN page_id % 20 = 0 THEN 404 WHEN page_id % 20 = 1 THEN 500 ELSE 200 END AS status_code,
  CASE page_id % 10 WHEN 3 THEN 'application/pdf' WHEN 4 THEN 'TEXT/HTML; charset=utf-8'
    WHEN 5 THEN 'application/xhtml+xml' ELSE 'text/html' END AS content_type,
  CAST(length(html) AS BIGINT) AS content_length, CAST(50 + (page_id * 37) % 900 AS DOUBLE) AS fetch_ms,
  page_id * 1000 AS arrival_ms,
  regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS netloc, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path
FROM pages""",
    "robots": """
SELECT netloc, CASE
  WHEN d < 4 THEN concat('User-agent: *', chr(10), 'Disallow: /en/1', chr(10), 'Disallow:', chr(10), 'Allow: /en/15')
  WHEN d < 8 THEN concat('User-agent: Other', chr(10), 'Disallow: /', chr(10), 'user-agent: *', chr(10), 'DISALLOW: /fr/')
  WHEN d < 11 THEN '' ELSE concat('User-agent: Crawlerbot', chr(10), 'Disallow: /de') END AS robots_txt
FROM (SELECT netloc, instr('0123456789abcdef', right(md5(netloc), 1)) - 1 AS d
  FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS netloc FROM pages) h) x""",
    "robots_lines": """
SELECT netloc, pos, trim(line) AS line FROM (
  SELECT netloc, unnest(string_split(robots_txt, chr(10))) AS line,
    unnest(range(len(string_split(robots_txt, chr(10))))) AS pos FROM robots) l""",
    "robots_rules": """
SELECT netloc, trim(substr(line, 10)) AS prefix FROM (
  SELECT netloc, line, last_value(CASE WHEN lower(line) LIKE 'user-agent:%' THEN trim(substr(line, 12)) END IGNORE NULLS)
    OVER (PARTITION BY netloc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS agent FROM robots_lines) a
WHERE lower(line) LIKE 'disallow:%' AND agent IN ('*', 'Crawlerbot') AND trim(substr(line, 10)) <> ''""",
    "blocked": """
SELECT f.page_id, count(r.prefix) > 0 AS robots_blocked FROM fetches f
LEFT JOIN robots_rules r ON f.netloc = r.netloc AND starts_with(f.path, r.prefix) GROUP BY f.page_id""",
    "links": """
SELECT page_id, job_id, page_url, depth, pos, trim(href) AS href, trim(anchor) AS anchor,
  regexp_extract(page_url, '^([a-z]+://[^/?#]*)', 1) || trim(href) AS url,
  regexp_extract(page_url, '^[a-z]+://([^/?#]*)', 1) AS domain FROM (
  SELECT page_id, job_id, url AS page_url, depth + 1 AS depth,
    unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href,
    unnest(regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>([^<]*)</a>', 1)) AS anchor,
    unnest(range(len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)))) AS pos FROM fetches) o""",
    "judged_links": """
SELECT l.*, CASE
    WHEN regexp_matches(lower(l.url), '\\.(jpe?g|png|gif|css|js|json|xml)$') THEN 'bad_content_type'
    WHEN l.depth > coalesce(j.max_depth, 3) THEN 'max_depth'
    WHEN len(j.allowed_domains) > 2 AND NOT regexp_matches(l.domain, '(^|\\.)example\\.com$') THEN 'wrong_domain'
    WHEN j.url_pattern IS NOT NULL AND NOT regexp_matches(l.url, j.url_pattern) THEN 'filter_rule' END AS reason,
  CASE WHEN l.depth > coalesce(j.max_depth, 3) THEN concat('Depth ', l.depth, ' > max ', coalesce(j.max_depth, 3))
    WHEN len(j.allowed_domains) > 2 AND NOT regexp_matches(l.domain, '(^|\\.)example\\.com$')
      THEN concat('Domain ', regexp_extract(l.domain, '([^.]+\\.[^.]+)$', 1), ' not in allowlist')
    WHEN j.url_pattern IS NOT NULL AND NOT regexp_matches(l.url, j.url_pattern) THEN 'URL did not match pattern' END AS detail
FROM links l LEFT JOIN jobs j ON l.job_id = j.job_id""",
    "link_outcomes": """
SELECT *, reason IS NULL AND rn = 1 AS queued, coalesce(reason, CASE WHEN rn > 1 THEN 'duplicate' END) AS outcome,
  CASE WHEN reason IS NOT NULL THEN detail WHEN rn > 1 THEN 'Already seen' END AS outcome_detail FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, url, reason IS NULL ORDER BY depth, page_id, pos) AS rn FROM judged_links) r""",
    "fetch_outcomes": """
SELECT f.job_id, f.page_id, f.url, f.depth, CASE WHEN b.robots_blocked THEN 'robots_txt' WHEN fetch_error IS NOT NULL THEN fetch_error
    WHEN status_code >= 400 THEN 'http_error' END AS reason,
  CASE WHEN b.robots_blocked THEN 'Blocked by robots.txt' WHEN fetch_error IS NOT NULL THEN ''
    WHEN status_code >= 400 THEN concat('HTTP ', status_code) END AS detail
FROM fetches f JOIN blocked b ON f.page_id = b.page_id""",
    "stored": """
SELECT job_id, page_id, url, CASE WHEN page_id % 9 = 0 THEN url WHEN page_id % 9 > 1 THEN
    concat('https://d', (page_id * 7 + 3) % 40, '.example.com/') END AS parent_url,
  depth, status_code, trim(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&quot;', '"'), '&amp;', '&')) AS title,
  content_type, len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS links_found,
  fetch_ms AS fetch_duration_ms, content_length, make_timestamp(1704067200000000 + arrival_ms * 1000) AS fetched_at
FROM fetches WHERE fetch_error IS NULL AND status_code < 400""",
    "variants": """
SELECT page_id, job_id, depth, v AS variant, CASE v WHEN 0 THEN url WHEN 1 THEN concat(site, '/img/', page_id, '.JPG')
    WHEN 2 THEN concat('ftp://', netloc, '/x') WHEN 3 THEN concat('http:///p', page_id) WHEN 4 THEN concat(site, '/', repeat('a', 2100))
    WHEN 5 THEN concat(site, '/a.js;v=', page_id, '?q=', page_id) WHEN 6 THEN 'JavaScript:x' ELSE concat(site, ':8080/zz') END AS url,
  CASE WHEN v IN (3, 6) THEN '' WHEN v = 7 THEN concat(netloc, ':8080') ELSE netloc END AS netloc,
  CASE v WHEN 2 THEN 'ftp' WHEN 3 THEN 'http' WHEN 6 THEN 'javascript' ELSE split_part(site, ':', 1) END AS scheme,
  CASE v WHEN 0 THEN path WHEN 1 THEN concat('/img/', page_id, '.JPG') WHEN 2 THEN '/x' WHEN 3 THEN concat('/p', page_id)
    WHEN 4 THEN concat('/', repeat('a', 2100)) WHEN 5 THEN '/a.js' WHEN 6 THEN 'x' ELSE '/zz' END AS path,
  CASE WHEN v = 5 THEN concat('v=', page_id) ELSE '' END AS params,
  CASE v WHEN 0 THEN regexp_extract(url, '\\?([^#]*)', 1) WHEN 5 THEN concat('q=', page_id) ELSE '' END AS query,
  CASE WHEN v = 0 THEN regexp_extract(url, '#(.*)$', 1) ELSE '' END AS fragment
FROM (SELECT page_id, concat('job-', page_id % 4) AS job_id, CAST(page_id % 8 AS INT) AS depth, url,
    regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS netloc,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, unnest(range(8)) AS v FROM pages) p""",
    "url_state": """
SELECT job_id, url, parent_url, depth, status, status_code, content_type, links_found, fetch_duration_ms, discard_reason,
  discard_detail, worker_id, ts, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, url ORDER BY CASE status WHEN 'queued' THEN 0 WHEN 'fetching' THEN 1
    WHEN 'fetched' THEN 2 WHEN 'parsing' THEN 3 WHEN 'done' THEN 4 WHEN 'discarded' THEN 5 ELSE 6 END DESC, seq DESC) AS rn
  FROM crawl_events) s WHERE rn = 1""",
    "url_state_fetch": """
SELECT job_id, url, status, depth, discard_reason, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, url ORDER BY CASE status WHEN 'queued' THEN 0 WHEN 'fetching' THEN 1
    WHEN 'fetched' THEN 2 WHEN 'parsing' THEN 3 WHEN 'done' THEN 4 WHEN 'discarded' THEN 5 ELSE 6 END DESC, seq DESC) AS rn
  FROM crawl_events WHERE coalesce(discard_stage, '') <> 'link') s WHERE rn = 1""",
    "pending": """
SELECT job_id, url, domain, depth, discovered_seq FROM (
  SELECT job_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain, min(CASE WHEN event_type = 'url_queued' THEN seq END) AS discovered_seq,
    arg_min(depth, CASE WHEN event_type = 'url_queued' THEN seq END) AS depth,
    count(*) FILTER (event_type = 'url_stored' OR discard_stage = 'fetch') AS finished
  FROM crawl_events GROUP BY job_id, url) p WHERE discovered_seq IS NOT NULL AND finished = 0""",
    "job_metrics": """
SELECT job_id, CAST(sum(q) AS BIGINT) AS queued_total, CAST(sum(d) AS BIGINT) AS done, CAST(sum(x) AS BIGINT) AS discarded,
  CAST(sum(e) AS BIGINT) AS error, count(*) FILTER (q > 0) AS accepted_total, count(*) FILTER (q > 0 AND d = 0 AND x = 0) AS frontier_depth
FROM (SELECT job_id, url, count(*) FILTER (event_type = 'url_queued') AS q, count(*) FILTER (event_type = 'url_stored') AS d,
    count(*) FILTER (discard_stage = 'fetch') AS x, count(*) FILTER (event_type = 'url_error') AS e
  FROM crawl_events GROUP BY job_id, url) u GROUP BY job_id""",
    "stored_fetches": """
SELECT job_id, url, max(domain) AS domain, arg_max(fetch_duration_ms, seq) FILTER (event_type = 'url_fetched') AS ms,
  arg_max(content_length, seq) FILTER (event_type = 'url_fetched') AS bytes, arg_max(worker_id, seq) FILTER (event_type = 'url_stored') AS worker_id
FROM crawl_events GROUP BY job_id, url HAVING count(*) FILTER (event_type = 'url_stored') > 0""",
    "active": """
SELECT job_id, domain, CASE WHEN event_type = 'url_fetching' THEN worker_id END AS active_worker FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, domain ORDER BY CASE WHEN event_type IN ('url_fetching', 'url_stored', 'url_discarded')
    THEN seq ELSE -1 END DESC) AS rn FROM crawl_events) a WHERE rn = 1""",
    "domain_stats": """
SELECT s.job_id, s.domain, queued, done, avg_fetch_ms, active_worker,
  CAST(instr('0123456789abcdef', right(md5(s.domain), 1)) - 1 AS INT) AS queue_shard,
  concat('crawl.', instr('0123456789abcdef', right(md5(s.domain), 1)) - 1) AS queue_name FROM (
  SELECT job_id, domain, queued, done, coalesce(floor(took / timed * 10 + 0.5) / 10, 0.0) AS avg_fetch_ms FROM (
    SELECT job_id, domain, count(*) FILTER (event_type = 'url_queued') AS queued, count(*) FILTER (event_type = 'url_stored') AS done
    FROM crawl_events GROUP BY job_id, domain) c LEFT JOIN (
    SELECT job_id, domain, CAST(sum(CAST(trunc(ms) AS BIGINT)) AS DOUBLE) AS took, count(ms) AS timed FROM stored_fetches GROUP BY job_id, domain) t
  USING (job_id, domain)) s JOIN active a ON s.job_id = a.job_id AND s.domain = a.domain""",
    "link_graph": """
SELECT page_id AS src, (page_id * 7 + 3) % (SELECT count(*) FROM pages) AS dst, 0 AS pos FROM pages
UNION ALL SELECT page_id, (page_id * 13 + 5) % (SELECT count(*) FROM pages), 1 FROM pages
UNION ALL SELECT page_id, (page_id * page_id + 1) % (SELECT count(*) FROM pages), 2 FROM pages""",
}

NEEDS = {
    "full_log": ["crawl_events", "worker_events"], "reported": ["worker_events"],
    "robots_lines": ["robots"], "robots_rules": ["robots_lines"], "blocked": ["fetches", "robots_rules"],
    "links": ["fetches"], "judged_links": ["links", "jobs"], "link_outcomes": ["judged_links"],
    "fetch_outcomes": ["fetches", "blocked"], "stored": ["fetches"], "url_state": ["crawl_events"],
    "url_state_fetch": ["crawl_events"], "pending": ["crawl_events"], "job_metrics": ["crawl_events"],
    "active": ["crawl_events"], "domain_stats": ["crawl_events", "active", "stored_fetches"], "stored_fetches": ["crawl_events"],
}


def with_(tables: str, body: str, recursive: bool = False) -> str:
    """SQL with the named derived tables, and those they need, as common table expressions."""
    order: list = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for table in tables.split():
        add(table)
    ctes = ",\n".join(f"{name} AS ({DERIVED[name].strip()})" for name in order)
    # A body that starts with a comma adds tables of its own.
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body.strip()}"
