"""Admission rules as ordered CASE chains: the first failing rule gives the reason.

The order is part of the meaning (it decides the reason), so the rules are never separate filters
that the optimizer could reorder.
"""

from pyspark.sql import Column, functions as F

from weblode.functions.urls import binary_extension, registered_domain
from weblode.schema import MAX_CONTENT_BYTES, MAX_URL_LENGTH


def _verdict(failures: list) -> Column:
    """Struct (allowed, reason, detail) from [(condition, reason, detail)] in order.

    The number of the first failing rule is found once; reason and detail are looked up by it.
    """
    number = None
    for i, (condition, _, _) in enumerate(failures):
        number = F.when(condition, i) if number is None else number.when(condition, i)
    reason = detail = None
    for i, (_, why, text) in enumerate(failures):
        why = F.lit(why) if isinstance(why, str) else why
        text = F.lit(text) if isinstance(text, str) else text
        own = number == i
        reason = F.when(own, why) if reason is None else reason.when(own, why)
        detail = F.when(own, text) if detail is None else detail.when(own, text)
    return F.struct(number.isNull().alias("allowed"), reason.alias("reason"), detail.alias("detail"))


def too_long(url: Column, limit: int = MAX_URL_LENGTH) -> Column:
    return F.length(url) > limit


def bad_scheme(u: Column) -> Column:
    return ~u["scheme"].isin("http", "https")


def no_host(u: Column) -> Column:
    return u["netloc"] == ""


def too_deep(depth: Column, max_depth: Column) -> Column:
    return F.coalesce(depth > max_depth, F.lit(False))


def outside_domains(u: Column, allowed: Column, registered: Column) -> Column:
    """An allowlist is set and holds neither the registered domain nor the host."""
    return F.coalesce((F.size(allowed) > 0) & ~F.array_contains(allowed, registered)
                      & ~F.array_contains(allowed, u["netloc"]), F.lit(False))


def misses_pattern(url: Column, pattern: Column) -> Column:
    """A pattern is set and is found nowhere in the URL (Java regular expression)."""
    return F.coalesce((pattern != "") & ~F.regexp_like(url, pattern), F.lit(False))


def url_verdict(url: Column, u: Column, depth: Column, max_depth: Column, allowed_domains: Column,
                url_pattern: Column, suffixes, max_length: int = MAX_URL_LENGTH) -> Column:
    """Length, parse, scheme, host, extension, depth, domain and pattern, in this order."""
    extension = binary_extension(u)
    registered = registered_domain(u, suffixes)
    return _verdict([
        (too_long(url, max_length), "invalid_url", "URL too long"),
        (u["error"].isNotNull(), "invalid_url", u["error"]),
        (bad_scheme(u), "invalid_url", F.concat(F.lit("Unsupported scheme: "), u["scheme"])),
        (no_host(u), "invalid_url", "No host"),
        (extension.isNotNull(), "bad_content_type", F.concat(F.lit("Binary extension: "), extension)),
        (too_deep(depth, max_depth), "max_depth",
         F.concat(F.lit("Depth "), depth.cast("string"), F.lit(" > max "), max_depth.cast("string"))),
        (outside_domains(u, allowed_domains, registered), "wrong_domain",
         F.concat(F.lit("Domain "), registered, F.lit(" not in allowlist"))),
        (misses_pattern(url, url_pattern), "filter_rule", "URL did not match pattern"),
    ])


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))


def bad_content_type(content_type: Column, allowed_types: Column) -> Column:
    """A type list is set and the media type starts with none of its entries."""
    media = media_type(content_type)
    return F.coalesce((F.size(allowed_types) > 0)
                      & ~F.exists(allowed_types, lambda t: F.startswith(media, t)), F.lit(False))


def too_large(size: Column, limit: int = MAX_CONTENT_BYTES) -> Column:
    return F.coalesce(size > limit, F.lit(False))


def fetch_verdict(fetch_error: Column, status_code: Column, content_type: Column, size: Column,
                  allowed_types: Column, robots_blocked: Column, error_detail: Column,
                  limit: int = MAX_CONTENT_BYTES) -> Column:
    """Robots, fetch error, HTTP status, content type and size, in this order.

    ``fetch_error`` holds the reason the fetch itself gave (timeout, connection_error, too_large).
    """
    return _verdict([
        (robots_blocked, "robots_txt", "Blocked by robots.txt"),
        (fetch_error.isNotNull(), fetch_error, error_detail),
        (status_code >= 400, "http_error", F.concat(F.lit("HTTP "), status_code.cast("string"))),
        (bad_content_type(content_type, allowed_types), "bad_content_type",
         F.concat(F.lit("Content-Type: "), media_type(content_type))),
        (too_large(size, limit), "too_large",
         F.concat(F.lit("Content-Length "), size.cast("string"), F.lit(f" > {limit}"))),
    ])
