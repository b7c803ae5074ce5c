"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

Benchmark items and documents are cut into tokens. Numbers, units after a number and names (capitalised words
inside a sentence) become typed placeholders, so a question with other numbers or names has the same template.
Windows of ``WINDOW`` template tokens that keep enough literal words are joined by hash. Aligned windows of an
item that cover ``COVER`` of it make a candidate; it counts when its slots are consistent: wherever the item
repeats a value, the document repeats one too.

Besides the typed form, texts are compared in further forms (``FORMS``), and an item counts when it is found in any: names as
literal words in any case, so that copies in capitals or without any are found; runs of placeholders of a type as one, so that
a slot may be filled with another number of tokens; and, for items without literal windows, all their tokens as they stand.
"""

from pyspark.sql import Column, DataFrame, functions as F

from weblode.llm.common import row_key
from weblode.operators.blocks import written

WINDOW = 8
LITERALS = 0.6
"""Part of a window that must be literal words."""
COVER = 0.5
"""Part of an item's windows that must match at one alignment."""
BROADCAST_ROWS = 500_000
"""Benchmark windows up to which they are broadcast; beyond, documents are shuffled by window."""

FORMS = ("typed", "lower", "runs", "exact")

# Units of measurement.
UNITS = ["mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "min", "h", "hz", "khz", "mhz", "w", "kw", "v", "a",
         "j", "kj", "n", "pa", "kpa", "k", "c", "f", "mi", "ft", "in", "yd", "lb", "oz", "mph", "usd", "eur", "percent",
         "minutes", "hours", "days", "weeks", "months", "years", "meters", "metres", "miles", "dollars", "euros", "seconds"]

_SEP = r"^[^\p{L}\p{M}\p{N}]+"
PIECE = r"[^\p{L}\p{M}\p{N}]*(?:[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}\p{N}]+)"
NAME = r"^[,;:]? \p{Lu}"
NUMBER = r"^[^\p{L}\p{M}\p{N}]*[0-9]+(?:[.,][0-9]+)*$"
"""What tokens, names and numbers are, as the SQL twin has it: a token with the separators before it."""
_MARK = "\u0001"
_NAMES = r"(?=\p{Lu})(?<=(?:^|[\p{L}\p{M}\p{N}])[,;:]? )"
_TOKEN = _MARK + r"?(?:[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}\p{N}]+)"


def pieces(text: Column) -> Column:
    """Tokens of a text, names with a mark before them.

    Names are marked in the whole text first, and a token that begins with a digit is a number by its pattern,
    so no regular expression runs per token.
    """
    return F.coalesce(F.regexp_extract_all(F.regexp_replace(text, _NAMES, _MARK), F.lit(_TOKEN), F.lit(0)), F.array().cast("array<string>"))


def value(piece: Column) -> Column:
    """A lower-case token as it stands."""
    return F.when(piece.startswith(_MARK), F.substr(piece, F.lit(2))).otherwise(piece)


def kind(piece: Column) -> Column:
    """Type of a lower-case token that is a name or number, else the token."""
    return F.when(piece.startswith(_MARK), "<name>").when((piece >= "0") & (piece < ":"), "<number>").otherwise(piece)


def units(kinds: str) -> Column:
    """Column ``kinds`` of typed tokens with the units after numbers typed, too."""
    return F.transform(kinds, lambda own, i: F.when(own.isin(UNITS) & (F.get(kinds, i - 1) == "<number>"), "<unit>").otherwise(own))


def with_forms(df: DataFrame, text: str, forms, values: bool = False) -> DataFrame:
    """Adds per form the array ``_k_form`` of template tokens of a text and, with ``values``, ``_v_form`` of their values."""
    # Functions with a lambda compute what they are given anew for each mention of it, so what is mentioned twice is a column.
    out = df.withColumn("_p", F.transform(pieces(F.col(text)), F.lower))
    out = out.withColumn("_v", F.transform("_p", value)).withColumn("_typed", F.transform("_p", kind)).drop("_p")
    if "lower" in forms:
        out = out.withColumn("_lower", F.transform("_v", kind))
    out = out.withColumn("_k_typed", units("_typed"))
    # Position 0 and every position that does not go on with the placeholder before it.
    starts = lambda k, i: (i == 0) | ~(k.startswith("<") & (k == F.get("_k_typed", i - 1)))
    own = {"lower": lambda: units("_lower"), "exact": lambda: F.col("_v"), "runs": lambda: F.filter("_k_typed", starts)}
    out = out.select("*", *[own[f]().alias(f"_k_{f}") for f in forms if f != "typed"]).drop("_typed", "_lower")
    if not values:
        return out.drop("_v")
    if "runs" in forms:
        out = out.withColumn("_at", F.filter(F.transform("_k_typed", lambda k, i: F.when(starts(k, i), i)), lambda i: i.isNotNull()))
    run = F.transform("_at", lambda s, j: F.array_join(F.slice("_v", s + 1, F.coalesce(F.get("_at", j + 1), F.size("_v")) - s), " "))
    return out.select("*", *[(run if f == "runs" else F.col("_v")).alias(f"_v_{f}") for f in forms]).drop("_v", "_at")


def _windows(hashes: Column, width: int, form: str) -> Column:
    n = F.size(hashes) - width
    at = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    kind = [] if form == "typed" else [F.lit(form)]
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(hashes, i + 1, width), *kind).alias("fp")))


def _window_at(hashes: str, width: int, form: str) -> Column:
    """Hash of the window at position ``at``, that of ``_windows``; null beyond the last. Without functions on arrays, so
    that positions, hashes and the look-up of windows are one piece of generated code."""
    kind = [] if form == "typed" else [F.lit(form)]
    own = F.xxhash64(*[F.get(hashes, F.col("at") + k) for k in range(width)], *kind)
    return F.when(F.col("at") <= F.size(hashes) - width, own)


def item_windows(items: DataFrame, forms=FORMS[:1]) -> tuple[DataFrame, list[tuple[str, int]]]:
    """(item_id, _item, form, width, windows, at, fp) of the benchmark and the forms and widths in use: ``WINDOW``, and the
    whole length of shorter items. Items that are null or have no token give none; nor do windows of placeholders,
    save that an item with no other window is compared in form ``exact``, where that is asked for."""
    known = items.select("item_id", F.col("text").alias("_text"), row_key("item_id").alias("_item"))
    known = written(with_forms(known.dropDuplicates(["_item"]), "_text", forms).where(F.size("_k_typed") > 0).drop("_text"), "templates")
    parts, uses = None, []
    for form in forms:
        rest = known.withColumn("_t", F.col(f"_k_{form}")).withColumn("width", F.least(F.size("_t"), F.lit(WINDOW)))
        if form == "exact" and parts is not None:
            rest = rest.join(parts.select("_item").distinct(), "_item", "left_anti")
        for width in sorted(r["width"] for r in rest.select("width").distinct().collect()):  # at most WINDOW numbers
            literal = lambda w: F.size(F.filter(F.slice(F.col("_t"), w["at"] + 1, width), lambda t: ~t.startswith("<")))  # noqa: E731,B023
            own = rest.where(F.col("width") == width).withColumn("_w", F.filter(
                _windows(F.transform("_t", lambda t: F.xxhash64(t)), width, form), lambda w: literal(w) >= LITERALS * width))  # noqa: B023
            own = own.select("item_id", "_item", F.lit(form).alias("form"), "width", F.size("_w").alias("windows"), F.explode("_w").alias("_w")).select(
                "item_id", "_item", "form", "width", "windows", "_w.*")
            parts = own if parts is None else parts.unionByName(own)
            uses.append((form, width))
    if parts is None:
        parts = known.select("item_id", "_item", F.lit("typed").alias("form"), F.lit(0).alias("width"), F.lit(0).alias("windows"),
                             F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("fp")).limit(0)
    return written(parts, "item-windows"), uses


def candidates(docs: DataFrame, windows: DataFrame, uses: list[tuple[str, int]]) -> DataFrame:
    """(_key, item, form, shift, width, at list) where aligned windows cover enough of an item. ``docs``: _key, text."""
    small = windows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = windows.select("fp", "form", "width", "_item", "windows", F.col("at").alias("item_at"))
    forms = [f for f in FORMS if f in {form for form, _ in uses}]
    hashed = with_forms(docs.select("_key", "text"), "text", forms).select(
        "_key", *[F.transform(f"_k_{f}", lambda t: F.xxhash64(t)).alias(f"_h_{f}") for f in forms])
    last = F.greatest(F.lit(-1), *[F.size(f"_h_{form}") - width for form, width in uses])
    places = hashed.select("*", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("at"))
    rows = places.select("_key", "at", F.explode(F.array(*[_window_at(f"_h_{form}", width, form) for form, width in uses])).alias("fp"))
    found = rows.where("fp IS NOT NULL").join(F.broadcast(side) if small else side, "fp")
    return (
        found.groupBy("_key", "_item", "form", "width", "windows", (F.col("at") - F.col("item_at")).alias("shift"))
        .agg(F.collect_set("item_at").alias("_ats"))  # at most the windows of one item
        .where(F.size("_ats") >= F.when(F.col("form") == "exact", F.col("windows")).otherwise(COVER * F.col("windows"))).drop("windows")
    )


def _slots(form: str) -> Column:
    """(at, type, value) of the placeholders of ``with_forms``."""
    kinds = F.arrays_zip(F.col(f"_k_{form}").alias("kind"), F.col(f"_v_{form}").alias("value"))
    indexed = F.transform(kinds, lambda k, i: F.struct(i.alias("at"), k["kind"].alias("kind"), k["value"].alias("value")))
    return F.filter(indexed, lambda s: s["kind"].startswith("<"))


def consistent(found: DataFrame, docs: DataFrame, items: DataFrame, form: str = "typed") -> DataFrame:
    """The candidates of a form whose slots are consistent: (_key, _item)."""
    found = found.where(F.col("form") == form)
    if form == "exact":  # without slots
        return found.select("_key", "_item").distinct()
    own = with_forms(items.select(row_key("item_id").alias("_item"), "text"), "text", [form], values=True).select(
        "_item", _slots(form).alias("_slots"))
    texts = docs.join(found.select("_key").distinct(), "_key", "left_semi").dropDuplicates(["_key"])
    texts = with_forms(texts, "text", [form], values=True).select("_key", F.col(f"_v_{form}").alias("_values"))
    inside = lambda s: F.exists("_ats", lambda a: (s["at"] >= a) & (s["at"] < a + F.col("width")))
    pairs = F.transform(F.filter("_slots", inside), lambda s: F.struct(
        F.struct(s["kind"], s["value"]).alias("slot"), F.get("_values", s["at"] + F.col("shift")).alias("value")))
    mapped = (found.join(own.dropDuplicates(["_item"]), "_item").join(texts, "_key")
              .withColumn("_pairs", F.array_distinct(pairs)))
    # A mapping: as many distinct (slot, value) pairs as distinct slots.
    return mapped.where(F.size("_pairs") == F.size(F.array_distinct(F.transform("_pairs", lambda p: p["slot"])))).select("_key", "_item").distinct()


def scan(docs: DataFrame, items: DataFrame, forms=FORMS) -> DataFrame:
    """doc_id, n_items (benchmark items found in the document), first_item (smallest item_id), contaminated, _key.

    Null and empty texts hold no item. Null item ids count but give no ``first_item``. Repeated rows get the same
    verdict, repeated items count once, in whatever ``forms`` they are found. Other columns are ignored.
    """
    known = docs.select("doc_id", "text", row_key().alias("_key"))
    windows, uses = item_windows(items, forms)
    if uses:
        found = written(candidates(known.select("_key", "text"), windows, uses), "candidates")
        hits = None
        for form in forms:
            own = consistent(found, known, items, form)
            hits = own if hits is None else hits.unionByName(own)
        hits = hits.distinct() if len(forms) > 1 else hits
        names = windows.select("_item", "item_id").distinct()
        by_doc = hits.join(names, "_item").groupBy("_key").agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"))
    else:
        by_doc = known.select("_key", F.lit(0).cast("bigint").alias("n_items"), F.lit(None).cast("bigint").alias("first_item")).limit(0)
    return known.drop("text").join(by_doc, "_key", "left").select(
        "doc_id", F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), "first_item",
        F.col("n_items").isNotNull().alias("contaminated"), "_key")


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without benchmark items, with their columns as they are."""
    dirty = scan(docs, items).where("contaminated").select("_key").distinct()
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"),
                         row_key().alias("_key"))
    return packed.join(dirty, "_key", "left_anti").select("_row.*")


_UNIT_LIST = ", ".join(f"'{u}'" for u in UNITS)


def _sql_tokens(source: str, key: str) -> str:
    return f"""
  SELECT {key}, i, CASE WHEN kind IN ({_UNIT_LIST}) AND lag(kind) OVER (PARTITION BY {key} ORDER BY i) = '<number>' THEN '<unit>' ELSE kind END AS kind, value
  FROM (SELECT {key}, i, value, CASE WHEN regexp_matches(p, '{NUMBER}') THEN '<number>' WHEN regexp_matches(p, '{NAME}') THEN '<name>' ELSE value END AS kind
    FROM (SELECT {key}, i, p, lower(regexp_replace(p, '{_SEP}', '')) AS value
      FROM (SELECT {key}, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS i FROM (
        SELECT {key}, regexp_extract_all(text, '{PIECE}') AS ps FROM {source}))))"""


def _sql_forms(tokens: str, key: str) -> str:
    """Tokens of a table in every form: form, key, i, kind, value."""
    return f"""
  SELECT 'typed' AS form, {key}, i, kind, value FROM {tokens}
  UNION ALL SELECT 'exact', {key}, i, value, value FROM {tokens}
  UNION ALL SELECT 'lower', {key}, i, CASE WHEN kind IN ({_UNIT_LIST}) AND lag(kind) OVER (PARTITION BY {key} ORDER BY i) = '<number>' THEN '<unit>' ELSE kind END, value
  FROM (SELECT {key}, i, value, CASE WHEN regexp_matches(value, '^[0-9]') THEN '<number>' ELSE value END AS kind FROM {tokens})
  UNION ALL SELECT 'runs', {key}, run, any_value(kind), string_agg(value, ' ' ORDER BY i)
  FROM (SELECT *, sum(starts) OVER (PARTITION BY {key} ORDER BY i) - 1 AS run
    FROM (SELECT *, CASE WHEN kind[1] = '<' AND kind = lag(kind) OVER (PARTITION BY {key} ORDER BY i) THEN 0 ELSE 1 END AS starts FROM {tokens}))
  GROUP BY {key}, run"""


ORACLE = f"""
WITH dt AS ({_sql_tokens('documents', 'doc_id')}),
bt AS ({_sql_tokens('benchmark', 'item_id')}),
d AS ({_sql_forms('dt', 'doc_id')}),
b AS ({_sql_forms('bt', 'item_id')}),
w AS (
  SELECT form, item_id, i, list(kind) OVER o AS t, least(count(*) OVER (PARTITION BY form, item_id), {WINDOW}) AS width
  FROM b WINDOW o AS (PARTITION BY form, item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
lw AS (
  SELECT *, count(*) OVER (PARTITION BY form, item_id) AS windows FROM w
  WHERE len(t) = width AND len(list_filter(t, lambda x: x[1] <> '<')) >= {LITERALS} * width),
iw AS (SELECT * FROM lw WHERE form <> 'exact' OR item_id NOT IN (SELECT item_id FROM lw WHERE form <> 'exact')),
dw AS (
  SELECT form, doc_id, i, width, list(kind) OVER (PARTITION BY form, doc_id, width ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS t0
  FROM d JOIN (SELECT DISTINCT form, width FROM iw) USING (form)),
c AS (
  SELECT dw.form, doc_id, item_id, any_value(iw.width) AS width, dw.i - iw.i AS shift, list(DISTINCT iw.i) AS ats, any_value(windows) AS windows
  FROM dw JOIN iw ON iw.form = dw.form AND iw.t = dw.t0[1:iw.width] AND dw.width = iw.width AND len(dw.t0) >= iw.width
  GROUP BY dw.form, doc_id, item_id, dw.i - iw.i
  HAVING len(list(DISTINCT iw.i)) >= CASE WHEN dw.form = 'exact' THEN any_value(windows) ELSE {COVER} * any_value(windows) END),
p AS (
  SELECT DISTINCT c.form, c.doc_id, c.item_id, c.shift, b.kind, b.value, d.value AS got
  FROM c JOIN b ON b.form = c.form AND b.item_id = c.item_id AND b.kind[1] = '<' AND len(list_filter(c.ats, lambda a: b.i >= a AND b.i < a + c.width)) > 0
  LEFT JOIN d ON d.form = c.form AND d.doc_id = c.doc_id AND d.i = b.i + c.shift),
bad AS (
  SELECT DISTINCT form, doc_id, item_id, shift FROM (SELECT form, doc_id, item_id, shift, kind, value FROM p GROUP BY ALL HAVING count(*) > 1)),
hit AS (SELECT DISTINCT doc_id, item_id FROM c WHERE (form, doc_id, item_id, shift) NOT IN (SELECT (form, doc_id, item_id, shift) FROM bad))
SELECT doc_id, count(hit.item_id) AS n_items, min(hit.item_id) AS first_item, count(hit.item_id) > 0 AS contaminated
FROM documents LEFT JOIN hit USING (doc_id) GROUP BY doc_id
"""
