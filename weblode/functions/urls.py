"""URL algebra as native column expressions.

A URL is taken apart once, by ``with_url_parts``, into a struct of plain columns; every other
function works on that struct. Semantics follow the public ``urllib.parse`` documentation: the
network location keeps its case and port, ``;params`` belong to the last path segment, and a URL
whose host cannot be parsed carries the message in ``error``.
"""

import unicodedata
from functools import lru_cache
from urllib.parse import uses_params, uses_netloc, uses_relative

from pyspark.sql import Column, DataFrame, functions as F

from weblode.schema import BINARY_EXTENSIONS, QUEUE_SHARDS, SHORT_URL_PATH

_C0_AND_SPACE = "".join(chr(i) for i in range(0x21))
# The five RFC 3986 components. Line breaks are removed from a URL before the match, which
# leaves "\n" free to separate the parts in one replace.
_RFC3986 = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
_DOT_SEGMENT = r"(^|/)\.\.?(/|\z)"


@lru_cache(None)
def _unsafe_host_chars() -> str:
    """Characters whose compatibility form contains a URL delimiter."""
    return "".join(
        c for c in map(chr, range(0x80, 0x10000))
        if any(d in unicodedata.normalize("NFKC", c) for d in "/?#@:")
    )


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _five(url) -> Column:
    """Scheme, netloc, path with params, query and fragment as an array, from one match."""
    clean = F.translate(F.ltrim(_col(url), F.lit(_C0_AND_SPACE)), "\t\r\n", "")
    return F.split(F.regexp_replace(clean, _RFC3986, "$1\n$2\n$3\n$4\n$5"), "\n")


def _path_and_params(scheme: Column, raw: Column) -> tuple:
    last = F.substring_index(raw, "/", -1)
    has_params = scheme.isin(*sorted(set(uses_params))) & F.contains(last, F.lit(";"))
    cut = F.length(raw) - F.length(last) + F.instr(last, ";")
    return (F.when(has_params, F.left(raw, cut - 1)).otherwise(raw),
            F.when(has_params, F.substr(last, F.instr(last, ";") + 1)).otherwise(F.lit("")))


def url_netloc(url) -> Column:
    """Host part alone, case and port kept."""
    return _five(url)[1]


def with_url_parts(df: DataFrame, url: str, out: str = "u") -> DataFrame:
    """Add struct ``out`` (scheme, netloc, path, params, query, fragment, error) of a URL column.

    The parts become plain columns first and the struct holds those columns. Spark replaces a field
    of a struct by the expression behind it; with plain columns behind it, no work is repeated
    however often later expressions name the parts.
    """
    p = lambda name: f"_{out}_{name}"
    five = df.withColumn(p("five"), _five(url))
    cut = five.withColumns({
        p("scheme"): F.lower(F.col(p("five"))[0]), p("netloc"): F.col(p("five"))[1], p("raw"): F.col(p("five"))[2]})
    path, params = _path_and_params(F.col(p("scheme")), F.col(p("raw")))
    whole = cut.withColumns({p("path"): path, p("params"): params, p("error"): _host_error(F.col(p("netloc")))})
    return whole.select(*df.columns, F.struct(
        F.col(p("scheme")).alias("scheme"), F.col(p("netloc")).alias("netloc"), F.col(p("path")).alias("path"),
        F.col(p("params")).alias("params"), F.col(p("five"))[3].alias("query"), F.col(p("five"))[4].alias("fragment"),
        F.col(p("error")).alias("error")).alias(out))


def _host_error(netloc: Column) -> Column:
    opening, closing = F.contains(netloc, F.lit("[")), F.contains(netloc, F.lit("]"))
    address = F.regexp_extract(netloc, r"\[([^\]]*)\]", 1)
    return (
        F.when(opening != closing, "Invalid IPv6 URL")
        .when(opening & ~address.rlike(r"^(?=[^:]*:[^:]*:)[0-9A-Fa-f:.]+(%.+)?$|^v[0-9A-Fa-f]+\.\S+$"),
              F.concat(F.lit("'"), address, F.lit("' does not appear to be an IPv4 or IPv6 address")))
        .when(netloc.rlike("[" + _unsafe_host_chars() + "]"),
              F.concat(F.lit("netloc '"), netloc,
                       F.lit("' contains invalid characters under NFKC normalization")))
    )


def build_url(u, fragment: bool = True) -> Column:
    """Put the parts back together; empty query, params and fragment leave no delimiter."""
    path = F.concat(u["path"], F.when(u["params"] != "", F.concat(F.lit(";"), u["params"])).otherwise(""))
    with_host = (
        F.when(u["netloc"] != "", F.concat(
            F.lit("//"), u["netloc"],
            F.when((path != "") & ~F.startswith(path, F.lit("/")), "/").otherwise(""), path))
        .when(F.startswith(path, F.lit("//")), F.concat(F.lit("//"), path))
        .when((u["scheme"] != "") & u["scheme"].isin(*sorted(set(uses_netloc)))
              & ((path == "") | F.startswith(path, F.lit("/"))), F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    out = F.concat(
        F.when(u["scheme"] != "", F.concat(u["scheme"], F.lit(":"))).otherwise(""),
        with_host,
        F.when(u["query"] != "", F.concat(F.lit("?"), u["query"])).otherwise(""),
    )
    if fragment:
        out = F.concat(out, F.when(u["fragment"] != "", F.concat(F.lit("#"), u["fragment"])).otherwise(""))
    return out


def _is_relative(b: Column, h: Column) -> Column:
    return ((h["scheme"] == "") | (h["scheme"] == b["scheme"])) & b["scheme"].isin(*sorted(set(uses_relative)))


def _merged(b: Column, h: Column) -> Column:
    """Path of a relative reference put behind the folder of its base."""
    folder = F.left(b["path"], F.length(b["path"]) - F.length(F.substring_index(b["path"], "/", -1)))
    folder = F.when((b["path"] == "") & (b["netloc"] != ""), "/").otherwise(folder)
    return F.when(F.startswith(h["path"], F.lit("/")), h["path"]).otherwise(
        F.regexp_replace(F.concat(folder, h["path"]), "/{2,}", "/"))


def _without_dots(merged: Column) -> Column:
    """Remove dot segments; paths without any, nearly all, take the short way."""
    kept = F.aggregate(
        F.split(merged, "/"),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg == ".", acc)
        .otherwise(F.array_append(acc, seg)),
    )
    tail = F.when(merged.rlike(r"(^|/)\.\.?\z"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    path = F.when(merged.rlike(_DOT_SEGMENT), F.array_join(F.concat(kept, tail), "/")).otherwise(merged)
    return F.coalesce(F.nullif(path, F.lit("")), F.lit("/"))


def with_resolved_url(df: DataFrame, base: str, href: str, out: str, normalized: bool = True) -> DataFrame:
    """Add ``out``: ``href`` made absolute on the page ``base``; NULL when a host cannot be parsed.

    ``normalized`` also drops the fragment and one trailing '?', and writes every URL from its
    parts; without it, references that are absolute already stay as they are.
    """
    n = lambda name: f"_{out}_{name}"
    b, h = F.col(n("b")), F.col(n("h"))
    parts = with_url_parts(with_url_parts(df, base, n("b")), href, n("h"))
    merged = parts.withColumn(n("merged"), _merged(b, h)).withColumn(n("relative"), _is_relative(b, h))
    paths = merged.withColumn(n("target"), _without_dots(F.col(n("merged"))))
    empty, relative = F.col(href) == "", F.col(n("relative"))
    inherit = relative & (h["netloc"] == "")
    same_page = (h["path"] == "") & (h["params"] == "")

    def pick(name: str, relative_value: Column) -> Column:
        return F.when(empty, b[name]).when(inherit, relative_value).otherwise(h[name]).alias(name)

    whole = paths.withColumns({
        n("scheme"): F.when(empty | relative, b["scheme"]).otherwise(h["scheme"]),
        n("netloc"): pick("netloc", b["netloc"]),
        n("path"): pick("path", F.when(same_page, b["path"]).otherwise(F.col(n("target")))),
        n("params"): pick("params", F.when(same_page, b["params"]).otherwise(h["params"])),
        n("query"): pick("query", F.when(same_page & (h["query"] == ""), b["query"]).otherwise(h["query"])),
        n("fragment"): F.when(empty, b["fragment"]).otherwise(h["fragment"]),
        n("error"): F.coalesce(h["error"], b["error"]),
    })
    j = {name: F.col(n(name)) for name in ("scheme", "netloc", "path", "params", "query", "fragment", "error")}
    if normalized:
        url = normalize_parts(j)
    else:
        url = F.when(j["error"].isNull(), F.when(F.col(base) == "", F.col(href)).when(empty, F.col(base))
                     .when(~relative, F.col(href)).otherwise(build_url(j)))
    return whole.select(*df.columns, url.alias(out))


def normalize_parts(u) -> Column:
    """URL without fragment and without one trailing '?'; NULL when the host cannot be parsed."""
    text = build_url(u, fragment=False)
    return F.when(u["error"].isNull(), F.regexp_replace(text, r"\?\z", ""))


def queue_shard(domain, shards: int = QUEUE_SHARDS) -> Column:
    """md5(domain) read as a 128-bit number, modulo ``shards``."""
    digest = F.md5(_col(domain))

    def word(start: int, size: int) -> Column:
        return F.conv(F.substring(digest, start, size), 16, 10).cast("bigint")

    if shards & (shards - 1) == 0 and shards <= 1 << 28:
        return (word(26, 7) % shards).cast("int")
    acc = word(1, 8) % shards
    for start in (9, 17, 25):
        acc = (acc * (1 << 32) + word(start, 8)) % shards
    return acc.cast("int")


def queue_name(shard) -> Column:
    return F.concat(F.lit("crawl."), _col(shard).cast("string"))


def url_hash(url) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(_col(url), 256), 1, 16)


def row_id(job_id, url) -> Column:
    """Deterministic id of a row keyed by (job, url); equal on every retry."""
    return F.sha2(F.concat_ws("\n", _col(job_id), _col(url)), 256)


def short_url(u: Column, n: int = SHORT_URL_PATH) -> Column:
    """Host and the first ``n`` characters of the path."""
    return F.concat(u["netloc"], F.substring(u["path"], 1, n))


def display_url(url, u: Column, n: int = 30, fallback: int = 40) -> Column:
    """Label of a URL in a graph: host name without port, path cut at ``n`` with an ellipsis."""
    host = F.lower(F.regexp_replace(F.substring_index(u["netloc"], "@", -1), r":[0-9]*\z", ""))
    full = F.concat(u["path"], F.when(u["params"] != "", F.concat(F.lit(";"), u["params"])).otherwise(""))
    path = F.when(full == "", "/").otherwise(full)
    cut = F.when(F.length(path) > n, F.concat(F.substring(path, 1, n), F.lit("…"))).otherwise(path)
    return F.when(u["error"].isNull() & (u["scheme"] != "") & (u["netloc"] != ""), F.concat(host, cut)).otherwise(
        F.substring(_col(url), 1, fallback))


def binary_extension(u: Column) -> Column:
    """Binary file extension that ends the path, NULL when there is none."""
    ext = F.regexp_extract(F.lower(u["path"]), r"(\.[a-z0-9]+)\z", 1)
    return F.when(ext.isin(*BINARY_EXTENSIONS), ext)


def registered_domain(u: Column, suffixes) -> Column:
    """``domain.suffix`` by a public-suffix list given as ``suffixes``.

    Rules may be plain (``co.uk``), wildcard (``*.ck``) or exceptions (``!www.ck``). The list is a
    bounded parameter and becomes hash-set literals, so no join is needed. A host without a known
    suffix, an address included, yields ``domain.`` with an empty suffix.
    """
    plain = [s for s in suffixes if s[:1] not in "*!"]
    wild = [s[2:] for s in suffixes if s.startswith("*.")]
    exceptions = [s[1:] for s in suffixes if s.startswith("!")]
    host = F.rtrim(F.substring_index(u["netloc"], "@", -1), F.lit("."))
    is_v6 = F.startswith(host, F.lit("["))
    host = F.when(is_v6, F.concat(F.substring_index(host, "]", 1), F.lit("]"))).otherwise(
        F.rtrim(F.substring_index(host, ":", 1), F.lit(".")))
    labels = F.split(host, r"\.")
    n = F.size(labels)

    def tail(i: Column) -> Column:
        return F.lower(F.array_join(F.slice(labels, i, F.greatest(n - i + 1, F.lit(0))), "."))

    def is_suffix(i: Column) -> Column:
        hit = tail(i).isin(*plain) if plain else F.lit(False)
        if wild:
            hit = hit | ((i < n) & tail(i + 1).isin(*wild))
        if exceptions:
            hit = (hit & ~tail(i).isin(*exceptions)) | ((i > 1) & tail(i - 1).isin(*exceptions))
        return hit

    first = F.try_element_at(F.filter(F.sequence(F.lit(1), n), is_suffix), F.lit(1))
    is_ip = is_v6 | host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}\z")
    domain = F.when(first > 1, F.get(labels, first - 2)).otherwise("")
    suffix = F.array_join(F.slice(labels, first, n - first + 1), ".")
    return (
        F.when(is_ip, F.concat(host, F.lit(".")))
        .when(first.isNull(), F.concat(F.element_at(labels, -1), F.lit(".")))
        .otherwise(F.concat(domain, F.lit("."), suffix))
    )
