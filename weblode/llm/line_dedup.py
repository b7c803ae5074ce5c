"""Line deduplication by winnowing. DataFrame functions only.

Lines with a word are hashed; blank lines take no part and stay. A gram is ``GRAM`` lines in a row. In every
window of ``WINDOW`` grams the smallest gram hash is a fingerprint, so two copies of a run of at least
``GRAM + WINDOW - 1`` lines share one, wherever they stand. A line of ``LONG`` words or more is a fingerprint
by itself. Each fingerprint is joined with its first occurrence, by (doc_id, row key, line); the match is
extended line by line both ways, at most ``WINDOW - 1`` lines beyond the gram, since the next fingerprint of the
same run continues there; and the later run is deleted. The first occurrence of any line never goes, as a line
is deleted only for an equal line before it.

A fingerprint carries the hashes of its neighbours, so extension needs no second look at the texts, and only
the first occurrence is joined: a line in a third of all documents gives one row for each of them, not pairs.

Windows miss short runs of lines. With ``passages`` there are fingerprints of two more kinds, each of all the lines it
stands for: from every line on, the shortest run of lines with ``LONG`` words together, and every gram of a document that
has grams but fewer than ``WINDOW``. Both the query and the pipeline use them.
"""

from pyspark.sql import Column, DataFrame, functions as F

from weblode.llm.common import row_key
from weblode.operators.blocks import written

GRAM = 2
WINDOW = 3
LONG = 50

_HAS_WORD = r"[^\x20\x09-\x0D]"


def line_hash(line: Column) -> Column:
    """60 bits of MD5 as BIGINT, the same in any engine."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _gram(h: Column, i: Column) -> Column:
    """Hash of the lines i, i + 1, ... of array ``h``; every term stays below 2^60."""
    out = F.lit(0).cast("bigint")
    for k in range(GRAM):
        out = (out * 3 + F.get(h, i + k)) % (1 << 58)
    return out


def _fingerprint_rows(passages: bool) -> Column:
    """Array of structs (i, fp, need, more, left, right) of the fingerprints of one document.

    From ``_h`` (hashes) and ``_words`` (numbers of words) of its lines with a word. ``left`` holds the hashes before
    line i, nearest first, ``right`` those from line i on; ``need`` is how many must match. A passage has one hash of
    all its lines in ``right``, and ``more`` lines beyond the first that go with it.
    """
    h = F.col("_h")
    grams, windows = F.size("_g"), F.size("_g") - (WINDOW - 1)
    low = lambda j: F.when((j >= 0) & (j < windows), F.array_min(F.slice(F.col("_g"), j + 1, WINDOW)))

    def chosen(i):
        own = F.get("_g", i)
        hit = F.lit(False)
        for back in range(WINDOW):
            hit = hit | F.coalesce(low(i - back) == own, F.lit(False))
        return hit

    def row(i, fp, need):
        left = F.reverse(F.slice(h, F.greatest(i - (WINDOW - 1), F.lit(0)) + 1, F.least(i, F.lit(WINDOW - 1))))
        return F.struct(i.alias("i"), fp.alias("fp"), F.lit(need).alias("need"), F.lit(0).alias("more"), left.alias("left"),
                        F.slice(h, i + 1, GRAM + WINDOW - 1).alias("right"))

    def passage(i, n, kind):
        own = F.slice(h, i + 1, n)
        return F.struct(i.alias("i"), F.xxhash64(F.lit(kind), own).alias("fp"), F.lit(1).alias("need"), (n - 1).alias("more"),
                        F.array().cast("array<bigint>").alias("left"), F.array(F.xxhash64(own, F.lit(kind))).alias("right"))

    def shortest(i):
        """Struct of i and n, the number of lines from line i on that first hold LONG words; each has one at least."""
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"))
        got = F.aggregate(F.slice("_words", i + 1, LONG), start, lambda a, w: F.when(a["words"] >= LONG, a).otherwise(
            F.struct((a["n"] + 1).alias("n"), (a["words"] + w).alias("words"))))
        return F.struct(i.alias("i"), F.when(got["words"] >= LONG, got["n"]).alias("n"))

    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    of_grams = F.transform(F.filter(upto(grams), chosen), lambda i: row(i, F.get("_g", i), GRAM))
    of_lines = F.transform(F.filter(upto(F.size(h)), lambda i: F.get("_words", i) >= LONG), lambda i: row(i, -F.get(h, i) - 1, 1))
    if not passages:
        return F.concat(of_grams, of_lines)
    runs = F.filter(F.transform(upto(F.size(h)), shortest), lambda r: r["n"] > 1)
    of_short = F.transform(F.filter(upto(grams), lambda i: grams < WINDOW), lambda i: passage(i, F.lit(GRAM), "gram"))
    return F.concat(of_grams, of_lines, F.transform(runs, lambda r: passage(r["i"], r["n"], "run")), of_short)


def fingerprints(docs: DataFrame, passages: bool = False) -> DataFrame:
    """(doc_id, _key, i, fp, need, more, left, right) of all documents; i counts lines with a word."""
    upto = F.when(F.size("_h") >= GRAM, F.sequence(F.lit(0), F.size("_h") - GRAM)).otherwise(F.array().cast("array<int>"))
    lines = docs.select("doc_id", "_key", F.filter(F.split("text", "\n", -1), lambda line: line.rlike(_HAS_WORD)).alias("_lines"))
    count = lambda line: F.regexp_count(line, F.lit(_HAS_WORD + "+"))
    words = count if passages else lambda line: F.when(F.length(line) >= 2 * LONG - 1, count(line)).otherwise(0)
    hashed = lines.select("doc_id", "_key", F.transform("_lines", line_hash).alias("_h"), F.transform("_lines", words).alias("_words"))
    grams = hashed.withColumn("_g", F.transform(upto, lambda i: _gram(F.col("_h"), i)))
    return grams.select("doc_id", "_key", F.explode(_fingerprint_rows(passages)).alias("_f")).select("doc_id", "_key", "_f.*")


def _equal_from_start(a: str, b: str) -> Column:
    """Number of leading elements that two arrays share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    stop = F.array_position(same, F.lit(False))
    return F.when(stop > 0, stop - 1).otherwise(F.size(same)).cast("int")


def deletions(found: DataFrame) -> DataFrame:
    """(_key, start, stop): runs to delete, as ranges of lines with a word, ends included."""
    place = F.struct("doc_id", "_key", "i")
    first = (found.groupBy("fp").agg(F.count("*").alias("_n"), F.min(F.struct(place.alias("at"), "left", "right")).alias("_first"))
             .where("_n > 1").drop("_n"))
    later = found.join(first, "fp").where(place > F.col("_first.at"))
    ahead, back = _equal_from_start("right", "_first.right"), _equal_from_start("left", "_first.left")
    return (
        later.select("_key", "i", "need", "more", ahead.alias("_ahead"), back.alias("_back")).where(F.col("_ahead") >= F.col("need"))
        .select("_key", (F.col("i") - F.col("_back")).alias("start"), (F.col("i") + F.col("_ahead") - 1 + F.col("more")).alias("stop")).distinct()
    )


def deduplicate(docs: DataFrame, passages: bool = True) -> DataFrame:
    """All rows of ``docs`` as struct ``_row`` with doc_id, the remaining ``text``, n_lines, n_removed, had_words, has_words.

    Null texts stay null with no lines. Rows equal in id and text are one document: they lose the same lines
    and do not delete each other's. Blank lines stay. Other columns are carried along in ``_row``. ``passages``: also
    short runs of lines, see above.
    """
    known = docs.select("doc_id", "text", row_key().alias("_key"),
                        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))
    found = written(fingerprints(known.select("doc_id", "text", "_key"), passages), "fingerprints")
    cut = (deletions(found).select("_key", F.sequence("start", "stop").alias("_at"))
           .groupBy("_key").agg(F.array_distinct(F.flatten(F.collect_list("_at"))).alias("_gone")))
    lines = F.split("text", "\n", -1)
    worded = F.filter(F.transform(F.col("_lines"), lambda line, i: F.when(line.rlike(_HAS_WORD), i)), lambda i: i.isNotNull())
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.transform("_gone", lambda g: F.get("_worded", g)))
    joined = known.join(cut, "_key", "left").withColumn("_lines", lines).withColumn(
        "_worded", F.when(F.col("_gone").isNotNull(), worded)).withColumn("_left", F.when(F.col("_gone").isNotNull(), left))
    out = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform("_left", lambda i: F.get("_lines", i)), "\n"))
    return joined.select(
        "doc_id", "_row", out.alias("_out"), F.coalesce(F.size("_lines"), F.lit(0)).alias("_n"),
        F.coalesce(F.size("_gone"), F.lit(0)).alias("_removed"), F.coalesce(F.col("text").rlike(_HAS_WORD), F.lit(False)).alias("had_words"),
    ).select("doc_id", "_row", F.col("_out").alias("text"), F.greatest("_n", F.lit(0)).cast("bigint").alias("n_lines"),
             F.greatest("_removed", F.lit(0)).cast("bigint").alias("n_removed"), "had_words",
             F.coalesce(F.col("_out").rlike(_HAS_WORD), F.lit(False)).alias("has_words"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with the remaining text and, where there is one, its length in ``n_chars``; all other columns
    as they are. Documents of which no line with a word remains are dropped; those that had none stay."""
    rest = deduplicate(docs).where(F.col("has_words") | ~F.col("had_words"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(
        F.col("_row.n_chars")) if "n_chars" in docs.columns else None}
    return rest.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


ORACLE = f"""
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
w AS (
  SELECT *, CAST(row_number() OVER d - 1 AS BIGINT) AS i, CAST(('0x' || substr(md5(line), 1, 15)) AS BIGINT) AS h,
    length(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
g AS (
  SELECT doc_id, i, ((h % {1 << 58}) * 3 + n) % {1 << 58} AS g
  FROM (SELECT doc_id, i, h, lead(h) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM w) WHERE n IS NOT NULL),
m AS (
  SELECT *, CASE WHEN lead(g, 2) OVER o IS NOT NULL THEN min(g) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) END AS low
  FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (
  SELECT doc_id, i, g AS fp, {GRAM} AS need
  FROM (SELECT *, lag(low, 1) OVER o AS low1, lag(low, 2) OVER o AS low2 FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY i))
  WHERE g = low OR g = low1 OR g = low2
  UNION ALL SELECT doc_id, i, -h - 1, 1 FROM w WHERE words >= {LONG}),
pairs AS (
  SELECT f.*, q.doc_id AS qdoc, q.i AS qi FROM f JOIN (
    SELECT fp, min({{'doc_id': doc_id, 'i': i}}) AS q, count(*) AS n FROM f GROUP BY fp) USING (fp) WHERE n > 1 AND (doc_id, i) > (q.doc_id, q.i)),
near AS (
  SELECT p.doc_id, p.i, p.need, d, a.h = b.h AS same FROM pairs p, range(-2, 4) r(d)
  JOIN w a ON a.doc_id = p.doc_id AND a.i = p.i + d JOIN w b ON b.doc_id = p.qdoc AND b.i = p.qi + d),
ends AS (
  SELECT p.doc_id, p.i, p.need,
    bool_or(same) FILTER (d = 0) AS r0, bool_or(same) FILTER (d = 1) AS r1, bool_or(same) FILTER (d = 2) AS r2, bool_or(same) FILTER (d = 3) AS r3,
    bool_or(same) FILTER (d = -1) AS l1, bool_or(same) FILTER (d = -2) AS l2
  FROM pairs p JOIN near USING (doc_id, i, need) GROUP BY ALL),
runs AS (
  SELECT doc_id, i, need,
    CASE WHEN NOT coalesce(r0, false) THEN 0 WHEN NOT coalesce(r1, false) THEN 1 WHEN NOT coalesce(r2, false) THEN 2 WHEN NOT coalesce(r3, false) THEN 3 ELSE 4 END AS ahead,
    CASE WHEN NOT coalesce(l1, false) THEN 0 WHEN NOT coalesce(l2, false) THEN 1 ELSE 2 END AS back FROM ends),
ahead_of AS (
  SELECT doc_id, i, list(h) OVER o AS hs, list(words) OVER o AS ns, count(*) OVER (PARTITION BY doc_id) AS n_worded
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {LONG - 1} FOLLOWING)),
passages AS (
  SELECT 'run' AS kind, doc_id, i, hs[1:n] AS lines FROM (
    SELECT *, list_position(list_transform(range(1, len(ns) + 1), lambda k: list_sum(ns[1:k]) >= {LONG}), true) AS n FROM ahead_of) WHERE n > 1
  UNION ALL SELECT 'gram', doc_id, i, hs[1:{GRAM}] FROM ahead_of WHERE len(hs) >= {GRAM} AND n_worded - {GRAM - 1} < {WINDOW}),
later AS (
  SELECT doc_id, i, len(lines) AS n FROM (
    SELECT *, min({{'doc_id': doc_id, 'i': i}}) OVER (PARTITION BY kind, lines) AS q FROM passages) WHERE (doc_id, i) > (q.doc_id, q.i)),
gone AS (
  SELECT w.doc_id, w.pos FROM runs r JOIN w ON w.doc_id = r.doc_id AND w.i BETWEEN r.i - back AND r.i + ahead - 1 WHERE ahead >= need
  UNION SELECT w.doc_id, w.pos FROM later r JOIN w ON w.doc_id = r.doc_id AND w.i BETWEEN r.i AND r.i + n - 1)
SELECT doc_id, coalesce(max(n_lines), 0) AS n_lines, coalesce(max(removed), 0) AS n_removed,
  CASE WHEN max(n_lines) IS NULL THEN NULL ELSE coalesce(max(rest), '') END AS text
FROM documents LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(gone.pos) AS removed, string_agg(line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL) AS rest
  FROM l LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id) USING (doc_id)
GROUP BY doc_id
"""
