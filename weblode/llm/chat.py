"""Chat formatting with cumulative-snapshot collapse.

Loggers often store a conversation again after every turn. A rolling hash over the turns names every prefix of
every conversation; a conversation whose whole is a proper prefix of another one, or equals an earlier one, is a
snapshot and goes by an anti-join. What remains is rendered with a chat template.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from weblode.operators.blocks import written

# The template's control marks.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, place, n, a, b): turns in order of turn, role, text, equal rows once.

    ``a`` and ``b`` are two 64-bit hashes of the conversation up to this turn, each the running exclusive or of
    the hashes of (place, role, text); ``n`` is the number of turns. Rows are made distinct before they meet,
    so repeats of a row never gather in a task. Null roles and texts become empty; null conv_ids are one
    conversation of their own.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("place", F.row_number().over(order))
        .withColumn("a", F.bit_xor(F.xxhash64("place", "role", "text")).over(upto))
        .withColumn("b", F.bit_xor(F.xxhash64(F.lit(1), "text", "role", "place")).over(upto))
        .withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    )


def neutral(text: Column) -> Column:
    """Text in which the template's marks can no longer be read as marks."""
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def render(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(OPEN), neutral(t["role"]), F.lit("\n"), neutral(t["text"]), F.lit(CLOSE + "\n"))
    return F.array_join(F.transform(turns, one), "")


def collapse(known: DataFrame) -> DataFrame:
    """(conv_id, n_copies) of the maximal conversations of ``prefixes``. Of equal ones the smallest conv_id stays (a
    null one only if alone); n_copies counts them."""
    whole = known.where(F.col("place") == F.col("n")).groupBy("place", "a", "b").agg(
        F.min_by("conv_id", F.struct(F.col("conv_id").isNull(), "conv_id")).alias("conv_id"), F.count("*").alias("n_copies"))
    proper = known.where(F.col("place") < F.col("n")).select("place", "a", "b").distinct()
    return whole.join(proper, ["place", "a", "b"], "left_anti").select("conv_id", "n_copies")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, text: the maximal conversations, rendered. An empty table gives no rows; other
    columns are ignored."""
    known = written(prefixes(turns), "turns")
    kept = collapse(known).withColumnRenamed("conv_id", "_id")
    rows = known.join(kept, F.col("conv_id").eqNullSafe(F.col("_id")))
    said = F.sort_array(F.collect_list(F.struct("place", "role", "text")))
    return rows.groupBy("conv_id").agg(F.max("n").cast("bigint").alias("n_turns"), F.max("n_copies").alias("n_copies"), render(said).alias("text"))


ORACLE = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (
  SELECT conv_id, turn, role, text, count(*) OVER o AS n, string_agg(md5(role) || md5(text), '') OVER o AS prefix
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
w AS (SELECT conv_id, max(n) AS n, arg_max(prefix, n) AS whole FROM p GROUP BY conv_id),
k AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies FROM w GROUP BY whole),
m AS (
  SELECT k.conv_id, k.n_copies, w.n FROM k JOIN w USING (conv_id)
  WHERE w.whole NOT IN (SELECT p.prefix FROM p JOIN w USING (conv_id) WHERE p.n < w.n))
SELECT conv_id, n AS n_turns, n_copies,
  (SELECT string_agg('{OPEN}' || replace(role, '<|im_', '<| im_') || chr(10) || replace(text, '<|im_', '<| im_') || '{CLOSE}' || chr(10), '' ORDER BY turn, role, text)
   FROM t WHERE t.conv_id = m.conv_id) AS text
FROM m
"""
