"""Vocabulary of the crawl tables: event types, statuses, reasons, defaults and structs."""

from pyspark.sql import types as T

# Event types of the crawl log.
EVENT_TYPES = [
    "url_discovered", "url_queued", "url_dequeued", "url_fetching", "url_fetched",
    "url_parsing", "url_parsed", "url_stored", "url_discarded", "url_error",
    "worker_online", "worker_offline", "worker_idle", "worker_busy", "worker_heartbeat",
    "job_created", "job_started", "job_paused", "job_resumed", "job_completed", "job_failed",
    "metrics_update",
]

# Reasons for a discard.
DISCARD_REASONS = [
    "duplicate", "robots_txt", "max_depth", "max_pages", "wrong_domain", "bad_content_type",
    "http_error", "timeout", "too_large", "invalid_url", "filter_rule", "parse_error",
    "connection_error",
]

# URL statuses; the position is the rank used by the state fold.
URL_STATUSES = ["queued", "fetching", "fetched", "parsing", "done", "discarded", "error"]

# Job statuses.
JOB_STATUSES = ["created", "running", "paused", "stopped", "completed", "failed"]

# File extensions of binary content, never crawled.
BINARY_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".tar", ".gz", ".rar", ".7z",
    ".mp3", ".mp4", ".wav", ".avi", ".mov", ".mkv",
    ".exe", ".dmg", ".pkg", ".deb", ".rpm",
    ".woff", ".woff2", ".ttf", ".eot",
    ".css", ".js", ".json", ".xml",
]

# Content types an HTML crawl keeps.
HTML_CONTENT_TYPES = ["text/html", "application/xhtml+xml", "application/xml", "text/xml"]

# Href prefixes that are not links to pages (compared case-sensitively).
SKIPPED_HREF_PREFIXES = ["javascript:", "mailto:", "tel:", "#", "data:"]

# User agents whose robots groups apply to the crawler.
ROBOTS_AGENTS = ["*", "Crawlerbot"]

# Short labels of event types in a feed.
EVENT_LABELS = {
    "url_queued": "→ QUEUE",
    "url_fetching": "⟳ FETCH",
    "url_fetched": "✓ FETCH",
    "url_parsing": "⟳ PARSE",
    "url_stored": "✓ STORE",
    "url_discarded": "✗ DISCARD",
    "url_error": "✗ ERROR",
    "worker_online": "↑ WORKER",
    "worker_offline": "↓ WORKER",
    "worker_heartbeat": "♥ HB",
    "job_started": "▶ JOB",
    "job_completed": "■ JOB",
    "job_paused": "⏸ JOB",
}

# Short labels of discard reasons in a feed.
REASON_LABELS = {
    "duplicate": "DUP",
    "robots_txt": "ROBOTS",
    "max_depth": "DEPTH",
    "max_pages": "LIMIT",
    "wrong_domain": "DOMAIN",
    "bad_content_type": "CTYPE",
    "http_error": "HTTP",
    "timeout": "TIMEOUT",
    "too_large": "SIZE",
    "invalid_url": "INVALID",
    "filter_rule": "FILTER",
    "parse_error": "PARSE",
    "connection_error": "CONN",
}

SYSTEM_JOB = "__system__"

# Crawl defaults.
MAX_DEPTH = 3
MAX_PAGES = 10_000
MAX_URL_LENGTH = 2048
MAX_CONTENT_BYTES = 10 * 1024 * 1024
POLITENESS_DELAY_MS = 1000
QUEUE_SHARDS = 16
EVENT_RETENTION = 50_000
EVENT_HISTORY = 500
ROBOTS_TTL_SECONDS = 3600
WORKER_TTL_SECONDS = 30
SHORT_URL_PATH = 40
ANCHOR_CHARS = 200

WORKER_STATE = T.StructType([
    T.StructField("worker_id", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("pid", T.LongType()),
    T.StructField("current_url", T.StringType()),
    T.StructField("current_job_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("urls_processed", T.LongType()),
    T.StructField("errors", T.LongType()),
    T.StructField("bytes_downloaded", T.LongType()),
    T.StructField("started_at", T.TimestampNTZType()),
    T.StructField("last_heartbeat", T.TimestampNTZType()),
])

EVENT = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("worker_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("parent_url", T.StringType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("content_length", T.LongType()),
    T.StructField("links_found", T.LongType()),
    T.StructField("fetch_duration_ms", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("discard_reason", T.StringType()),
    T.StructField("discard_detail", T.StringType()),
    T.StructField("worker_state", WORKER_STATE),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("source_url", T.StringType()),
    T.StructField("target_url", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("queue_shard", T.IntegerType()),
])
