"""Page extraction as native column expressions over the markup.

Every function takes ``markup``: the page text after ``strip_hidden`` and
``expand_names``, so that scripts, styles and comments are removed once. Regular expressions use possessive or single-character loops only, which
Java runs without recursion, so page size does not matter. Limits, by choice: markup is read as
text and not as a tree, so an unclosed <a> runs to the next <a> or to the end of the page.
"""

import json
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column, functions as F

from weblode.schema import ANCHOR_CHARS, SKIPPED_HREF_PREFIXES

# Unicode white space, as text and as a character class.
SPACES = "".join(chr(c) for c in [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
SPACE_CLASS = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

_HIDDEN = (r"(?is)<(?:!--.*?(?:-->|\z)|script(?=[\s/>]).*?(?:</script\s*+>|\z)"
           r"|style(?=[\s/>]).*?(?:</style\s*+>|\z)|template(?=[\s/>]).*?(?:</template\s*+>|\z))")
_TAG_REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_ANY_TAG = r"<[a-zA-Z/!?]" + _TAG_REST
_ATTRIBUTE = r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+"""
_ANCHOR = r"(?is)<a(?=\s)" + _TAG_REST + r".*?(?=</a\s*+>|<a\s|\z)"
_NAME = r"&([A-Za-z][A-Za-z0-9]*+);"
_RARE_NAME = r"&(?!(?:amp|lt|gt|quot|apos|nbsp);)[A-Za-z][A-Za-z0-9]*+;"
_ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.trim(text, F.lit(SPACES))


def strip_hidden(html: Column) -> Column:
    """Markup without comments, scripts, styles and templates."""
    return F.regexp_replace(html, _HIDDEN, " ")


@lru_cache(None)
def _names() -> str:
    return json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";") and not set(v) & set("<>&\"'")})


def expand_names(markup: Column) -> Column:
    """Named characters in their plain form, save those that could be read as markup.

    The latter keep their references; ``decode_entities`` resolves them once the markup has been
    taken apart. ``markup`` should be a plain column, it is named more than once.
    """
    table = F.from_json(F.lit(_names()), "map<string,string>")
    between = F.split(markup, _NAME)
    found = F.regexp_extract_all(markup, F.lit(_NAME), F.lit(1))
    expanded = F.array_join(F.zip_with(
        between, found, lambda t, r: F.when(r.isNull(), t).otherwise(F.concat(
            t, F.coalesce(F.try_element_at(table, r), F.concat(F.lit("&"), r, F.lit(";")))))), "")
    return F.when(markup.rlike(_RARE_NAME), expanded).otherwise(markup)


def decode_entities(text: Column) -> Column:
    """Replace the references left in the markup, each exactly once, from left to right."""
    def decode(ref: Column) -> Column:
        number = F.when(F.lower(F.substring(ref, 1, 2)) == "#x", F.substring(ref, 3, 8)).when(
            F.substring(ref, 1, 1) == "#", F.conv(F.substring(ref, 2, 8), 10, 16))
        point = F.conv(number, 16, 10).cast("bigint")
        name = F.lower(ref)
        return F.coalesce(
            F.when(name == "amp", "&").when(name == "lt", "<").when(name == "gt", ">")
            .when(name == "quot", '"').when(name == "apos", "'").when(name == "nbsp", "\u00a0")
            .when((point < 0x110000) & ~point.between(0xD800, 0xDFFF),
                  F.decode(F.unhex(F.lpad(number, 8, "0")), "UTF-32")),
            F.concat(F.lit("&"), ref, F.lit(";")))

    def decoded(t: Column) -> Column:
        between = F.split(t, _ENTITY)
        refs = F.regexp_extract_all(t, F.lit(_ENTITY), F.lit(1))
        return F.when(F.contains(t, F.lit("&")), F.array_join(F.zip_with(
            between, refs, lambda b, r: F.when(r.isNull(), b).otherwise(F.concat(b, decode(r)))), "")).otherwise(t)

    return _let(text, decoded)


def _first_tag(markup: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(markup, rf"(?is)<{name}(?=[\s/>])" + _TAG_REST, 0), F.lit(""))


def _tags(markup: Column, name: str) -> Column:
    return F.regexp_extract_all(markup, F.lit(rf"(?is)<{name}(?=[\s/>])" + _TAG_REST), F.lit(0))


def _raw_attribute(tag: Column, name: str) -> Column:
    def value(inner: Column) -> Column:
        names = F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(1))
        values = F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(2))
        at = F.array_position(F.transform(names, lambda n: F.lower(n)), F.lit(name))
        return F.get(values, F.nullif(at, F.lit(0)).cast("int") - 1)

    return _let(F.regexp_replace(tag, r"^<[a-zA-Z0-9:_-]+", ""), value)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag text; '' when it has no value, NULL when it is absent."""
    plain = _let(_raw_attribute(tag, name), lambda raw: F.when(
        raw.rlike("^[\"']"), F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw))
    return decode_entities(plain)


def title(markup: Column) -> Column:
    """Text of the first <title>, NULL without one."""
    found = F.nullif(F.regexp_extract(markup, r"(?is)<title(?:\s[^>]*+)?+>.*?</title\s*+>", 0), F.lit(""))
    return strip(decode_entities(F.regexp_replace(found, r"(?is)^<title[^>]*+>|</title\s*+>\z", "")))


def description(markup: Column) -> Column:
    """content of <meta name="description">; '' without content, NULL without the tag."""
    tag = F.get(F.filter(_tags(markup, "meta"), lambda t: attribute(t, "name") == "description"), F.lit(0))
    found = _let(tag, lambda t: F.when(t.isNotNull(), strip(F.coalesce(attribute(t, "content"), F.lit("")))))
    return F.when(F.contains(markup, F.lit("description")), found)


def canonical(markup: Column) -> Column:
    """href of the first <link rel=canonical>."""
    tag = F.get(F.filter(
        _tags(markup, "link"),
        lambda t: F.array_contains(F.split(attribute(t, "rel"), r"\s+"), "canonical")), F.lit(0))
    return F.when(F.contains(markup, F.lit("canonical")), attribute(tag, "href"))


def language(markup: Column) -> Column:
    """lang of <html>."""
    return attribute(_first_tag(markup, "html"), "lang")


def base_href(markup: Column, page_url: Column) -> Column:
    """href of the first <base href>, the page URL without one."""
    tag = F.get(F.filter(_tags(markup, "base"), lambda t: attribute(t, "href").isNotNull()), F.lit(0))
    return F.coalesce(attribute(tag, "href"), page_url)


def text_of(markup: Column) -> Column:
    """Visible text; a tag always separates words."""
    return F.regexp_replace(markup, _ANY_TAG, " ")


def word_count(markup: Column) -> Column:
    """White-space separated tokens of the visible text."""
    spaced = F.regexp_replace(text_of(markup), r"&(?:nbsp|ensp|emsp|thinsp|#160|#[xX][aA]0|#32|#10|#9);", " ")
    # The first branch covers the spaceless start of Unicode with two ranges, which is fast.
    word = r"(?:[\x21-\x7E\xA1-\u167F]++|[^" + SPACE_CLASS[1:] + ")++"
    return F.size(F.regexp_extract_all(spaced, F.lit(word), F.lit(0))).cast("bigint")


def links(markup: Column) -> Column:
    """Links in document order as ARRAY<STRUCT<href, anchor>>, non-page schemes left out.

    Anchor text: every text node trimmed, joined without separator, first 200 characters.
    """
    def entry(element: Column) -> Column:
        tag = F.regexp_extract(element, r"(?is)^<a(?=\s)" + _TAG_REST, 0)
        inner = F.regexp_replace(element, r"(?is)^<a(?=\s)" + _TAG_REST, "")
        nodes = F.transform(F.split(inner, _ANY_TAG), lambda t: strip(decode_entities(t)))
        return F.struct(
            strip(attribute(tag, "href")).alias("href"),
            F.substring(F.array_join(nodes, ""), 1, ANCHOR_CHARS).alias("anchor"),
        )

    def is_page_link(link: Column) -> Column:
        keep = link["href"].isNotNull()
        for prefix in SKIPPED_HREF_PREFIXES:
            keep = keep & ~F.startswith(link["href"], F.lit(prefix))
        return keep

    return F.filter(F.transform(F.regexp_extract_all(markup, F.lit(_ANCHOR), F.lit(0)), entry), is_page_link)


def decode_content(content) -> Column:
    """Bytes to text as UTF-8; a malformed sequence becomes U+FFFD."""
    return F.make_valid_utf8((F.col(content) if isinstance(content, str) else content).cast("string"))
