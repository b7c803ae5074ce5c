"""robots.txt text to disallowed path prefixes, inside the row that holds the text."""

from pyspark.sql import Column, functions as F

from weblode.functions.html import strip
from weblode.schema import ROBOTS_AGENTS

_LINE_BREAK = r"\r\n|[\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
_INDENT = r"[ \t\x1F\xA0]*+"


def disallowed_prefixes(robots_txt: Column, agents=ROBOTS_AGENTS) -> Column:
    """Disallow values of the groups addressed to ``agents``, as ARRAY<STRING>.

    A user-agent line replaces the agent before it, empty values are ignored, and Allow lines,
    wildcards and comments have no meaning. Splitting the text at its user-agent lines leaves one
    piece per agent, so the agent of each Disallow line is known without a window.
    """
    lines = F.regexp_replace(robots_txt, _LINE_BREAK, "\n")
    groups = F.split(lines, rf"(?imd)^{_INDENT}(?=user-agent:)")
    own = F.filter(groups, lambda g: g.rlike("(?i)^user-agent:")
                   & strip(F.regexp_extract(g, r"(?i)^user-agent:([^\n]*+)", 1)).isin(*agents))
    values = F.flatten(F.transform(own, lambda g: F.regexp_extract_all(
        g, F.lit(rf"(?imd)^{_INDENT}disallow:([^\n]*+)"), F.lit(1))))
    return F.filter(F.transform(values, strip), lambda p: p != "")


def blocked_by(path: Column, prefixes: Column) -> Column:
    """The path starts with one of the prefixes; no rules means not blocked."""
    return F.coalesce(F.exists(prefixes, lambda p: F.startswith(path, p)), F.lit(False))
