"""Corpus-wide page extraction."""

from pyspark.sql import DataFrame, functions as F

from weblode.functions import html as H

FIELDS = {
    "title": lambda m, url: H.title(m),
    "description": lambda m, url: H.description(m),
    "canonical_url": lambda m, url: H.canonical(m),
    "lang": lambda m, url: H.language(m),
    "word_count": lambda m, url: F.coalesce(H.word_count(m), F.lit(0)),
    "links": lambda m, url: F.coalesce(H.links(m), F.array().cast("array<struct<href:string,anchor:string>>")),
    "base_href": lambda m, url: H.base_href(m, url),
}


def with_markup(df: DataFrame, html: str = "html", out: str = "markup") -> DataFrame:
    """Replace the page text by its markup, computed in two steps that each run once per row."""
    return df.withColumn(out, H.strip_hidden(F.col(html))).withColumn(out, H.expand_names(F.col(out)))


def extract_pages(pages: DataFrame, fields=tuple(FIELDS), html: str = "html", url: str = "url") -> DataFrame:
    """Add the wanted fields to each page and drop its text.

    A page without text (NULL) is kept, with ``error`` set, no title and no links. One narrow
    stage: no shuffle, and only the asked fields are computed.
    """
    text = with_markup(pages, html)
    m = F.col("markup")
    out = text.select(
        *[c for c in pages.columns if c != html],
        *[FIELDS[name](m, F.col(url)).alias(name) for name in fields],
        F.when(m.isNull(), "no content").alias("error"),
    )
    return out


def link_rows(extracted: DataFrame, keep: list) -> DataFrame:
    """One row per link: the ``keep`` columns, position, href and anchor text."""
    return extracted.select(*keep, F.posexplode("links").alias("pos", "link")).select(
        *keep, "pos", F.col("link.href").alias("href"), F.col("link.anchor").alias("anchor"))


def explode_links(pages: DataFrame, keep: list, html: str = "html") -> DataFrame:
    """``link_rows`` straight from page text.

    The link array is not a column of its own here: Spark would then filter on its size first and
    take every page apart twice.
    """
    rows = with_markup(pages.select(*keep, html), html).select(*keep, F.posexplode(H.links(F.col("markup"))).alias("pos", "link"))
    return rows.select(*keep, "pos", F.col("link.href").alias("href"), F.col("link.anchor").alias("anchor"))


def decode_pages(fetched: DataFrame, content: str = "content", out: str = "html") -> DataFrame:
    """Bytes of a fetch to text."""
    return fetched.withColumn(out, H.decode_content(content)).drop(content)
