"""Prefix trie of conversations, its subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns; its name is its smallest member and its depth. Totals over subtrees (childless
nodes, saved tokens) come from contracting the tree in rounds of joins:

* rake: childless nodes hand their total to their parents and leave;
* compress: of every unary chain, nodes drawn by a hash of their name and the round leave, if the child next to them stays;
  their parent adopts that child and takes over what they hold themselves.

Both shrink any tree, however deep or wide, by a constant factor a round. Then the rounds are undone in reverse: a raked
node's total is what it held, a compressed one's is what it held plus the total of the child it was cut from.

No group is gathered: turns are put in order by ranges of the whole table with a carry per (range, conversation), prefix
hashes are exclusive ors, and children meet their parents as sums that are combined before the shuffle.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weblode.llm.common import WORD
from weblode.operators.blocks import join_spread, written

FAMILY = 20
"""Conversations c with the same c - c % 20 share a head."""
CHUNK = 4096
"""Conversation numbers that are joined to one text at a time."""
ID = ["conv_id", "depth"]
UP = ["parent", "up"]
"""Name of the parent: its smallest member and its depth."""


def in_order(turns: DataFrame) -> DataFrame:
    """(conv_id, part, place, a, b, words): turns of each conversation numbered from 0 in order of turn (null first), role, text.

    The table is cut into ranges of that order, so a conversation may be longer than a task; numbers inside a range come from
    the place in it, what lies before from counts per (range, conversation). ``a`` and ``b`` are two hashes of (role, text).
    Equal rows are turns of their own. Rows without conv_id belong to no conversation.
    """
    given = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = given.withColumn("_same", F.monotonically_increasing_id())  # equal rows need not sit in one range
    order = ["conv_id", "turn", "role", "text", "_same"]
    lined = spread.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        "conv_id", F.monotonically_increasing_id().alias("_at"), F.xxhash64("role", "text").alias("a"),
        F.xxhash64(F.lit(1), "text", "role").alias("b"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"))
    lined = written(lined, "turns").withColumn("part", F.shiftright("_at", 33))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = lined.groupBy("conv_id", "part").agg(F.min("_at").alias("_from"), F.count("*").alias("_n")).withColumn(
        "_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).select("conv_id", "part", "_shift")
    return lined.join(carry, ["conv_id", "part"]).select(
        "conv_id", "part", (F.col("_at") + F.col("_shift")).alias("place"), "a", "b", "words")


def rebuilt(placed: DataFrame) -> DataFrame:
    """(conv_id, part, place, n, a, b, words): each conversation c with the first h turns of conversation c - c % 20 for its own
    first h, h = crc32(c) % 4; ``n`` turns in all, one row with a null place where there are none."""
    length = placed.groupBy("conv_id").agg(F.count("*").alias("_own"))
    convs = length.select("conv_id", "_own", F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(4)).alias("h"),
                          (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    lengths = length.select(F.col("conv_id").alias("base"), F.col("_own").alias("_base"))
    convs = convs.join(lengths, "base", "left").withColumn("head", F.least("h", F.coalesce("_base", F.lit(0)))).withColumn(
        "n", F.col("head") + F.greatest(F.col("_own") - F.col("h"), F.lit(0)))
    convs = written(convs.select("conv_id", "base", "h", "head", "n"), "conversations")
    start = placed.where(F.col("place") < 3).withColumnRenamed("conv_id", "base")
    heads = convs.join(start, "base").where(F.col("place") < F.col("head")).select(
        "conv_id", F.lit(-1).cast("bigint").alias("part"), "place", "n", "a", "b", "words")
    own = join_spread(placed, convs.select("conv_id", "h", "head", "n"), ["conv_id"], ["place"], "inner").where(
        F.col("place") >= F.col("h")).select("conv_id", "part", (F.col("place") - F.col("h") + F.col("head")).alias("place"), "n", "a", "b", "words")
    null = F.lit(None).cast("bigint")
    empty = convs.where(F.col("n") == 0).select("conv_id", null.alias("part"), null.alias("place"), "n", null.alias("a"), null.alias("b"), null.alias("words"))
    return heads.unionByName(own).unionByName(empty)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, n, a, b, pa, pb, words): every prefix of every rebuilt conversation by two 64-bit hashes, its own and that
    of the prefix one turn shorter. Running exclusive ors inside each range, with those of earlier ranges carried on."""
    rows = written(turns.where(F.col("place").isNotNull()).select(
        "conv_id", "part", "place", "n", "words", F.xxhash64("place", "a", "b").alias("x"), F.xxhash64("b", "a", "place").alias("y")), "rebuilt")
    upto = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy("conv_id", "part").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).select(
        "conv_id", "part", F.coalesce(F.bit_xor("x").over(before), F.lit(0)).alias("cx"), F.coalesce(F.bit_xor("y").over(before), F.lit(0)).alias("cy"))
    run = rows.withColumn("rx", F.bit_xor("x").over(upto)).withColumn("ry", F.bit_xor("y").over(upto)).join(carry, ["conv_id", "part"])
    a, b = F.col("rx").bitwiseXOR(F.col("cx")), F.col("ry").bitwiseXOR(F.col("cy"))
    return run.select("conv_id", (F.col("place") + 1).alias("depth"), "n", a.alias("a"), b.alias("b"),
                      a.bitwiseXOR(F.col("x")).alias("pa"), b.bitwiseXOR(F.col("y")).alias("pb"), "words")


def nodes(known: DataFrame) -> DataFrame:
    """(conv_id, depth, parent, up, n_convs, saved, a, b): the nodes below the root from ``prefixes``; ``saved`` counts a node's own
    tokens. Nodes of depth 1 have parent null and up 0."""
    made = written(known.groupBy("depth", "a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
        F.min("words").alias("words")), "nodes")
    above = made.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent"))
    deep = made.where(F.col("depth") > 1).join(above, ["depth", "pa", "pb"])
    flat = made.where(F.col("depth") == 1).withColumn("parent", F.lit(None).cast("bigint"))
    return deep.unionByName(flat, allowMissingColumns=True).select(
        "conv_id", "depth", "parent", (F.col("depth") - 1).alias("up"), "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), "a", "b")


def _drawn(number: int):
    """A coin per node and round."""
    return F.pmod(F.xxhash64(*ID, F.lit(number)), F.lit(2)) == 1


def _named_by_parent(sums: DataFrame) -> DataFrame:
    return sums.withColumnsRenamed(dict(zip(UP, ID)))


def _with_sums(tree: DataFrame, sums: DataFrame, *more) -> DataFrame:
    """``tree`` with the leaves and tokens of ``sums`` added to its own."""
    plus = lambda mine, given: (F.col(mine) + F.coalesce(given, F.lit(0))).alias(mine)
    return tree.join(_named_by_parent(sums), ID, "left").select(*ID, *UP, plus("leaves", "l"), plus("tokens", "t"), *more)


def _rake(now: DataFrame) -> DataFrame:
    """The tree without its childless nodes, whose totals their parents got."""
    handed = now.where(F.col("kids") == 0).groupBy(*UP).agg(F.count("*").alias("gone"), F.sum("leaves").alias("l"), F.sum("tokens").alias("t"))
    return _with_sums(now.where(F.col("kids") > 0), handed, (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids"))


def _chain_nodes(tree: DataFrame, number: int) -> DataFrame:
    """Unary nodes that leave in this round, each with its only child, which stays."""
    leaves = (F.col("kids") == 1) & _drawn(number)
    heard = _named_by_parent(tree.groupBy(*UP).agg(  # of use where the parent has one child
        F.min("conv_id").alias("child"), F.min("depth").alias("below"), F.max(leaves.cast("int")).alias("_goes")))
    return tree.where(leaves).join(heard.where(F.col("_goes") == 0).drop("_goes"), ID)


def _compress(tree: DataFrame, cut: DataFrame) -> DataFrame:
    """The tree without the nodes ``cut``: their parents adopt the children and what the nodes hold."""
    taken = cut.groupBy(*UP).agg(F.sum("leaves").alias("l"), F.sum("tokens").alias("t"))
    adopted = cut.select(F.col("child").alias("conv_id"), F.col("below").alias("depth"), F.struct(*UP).alias("_new"))
    kept = _with_sums(tree.join(cut.select(*ID), ID, "left_anti"), taken, "kids").join(adopted, ID, "left")
    moved = F.col("_new").isNotNull()
    return kept.select(*ID, *[F.when(moved, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in UP], "kids", "leaves", "tokens")


def contracted(tree: DataFrame) -> DataFrame:
    """(conv_id, depth, leaves, tokens): subtree totals of a forest (conv_id, depth, parent, up, kids, saved); the parents of its
    top nodes are no rows of it. Every round writes what is left, so a lost executor costs part of one round."""
    now = written(tree.select(*ID, *UP, "kids", (F.col("kids") == 0).cast("bigint").alias("leaves"), F.col("saved").alias("tokens")), "tree")
    done, cuts = [], []
    while True:
        done.append(now.where(F.col("kids") == 0).select(*ID, "leaves", "tokens"))
        rest = written(_rake(now), "raked")
        if rest.isEmpty():
            break
        cuts.append(written(_chain_nodes(rest, len(cuts)), "cut"))
        now = written(_compress(rest, cuts[-1]), "tree")
    # Backwards: below a node cut in a round is a child that left in a later one.
    total = done.pop()
    for cut, raked in zip(reversed(cuts), reversed(done)):
        below = total.select(F.col("conv_id").alias("child"), F.col("depth").alias("below"), F.col("leaves").alias("l"), F.col("tokens").alias("t"))
        whole = written(cut.join(below, ["child", "below"]).select(
            *ID, (F.col("leaves") + F.col("l")).alias("leaves"), (F.col("tokens") + F.col("t")).alias("tokens")), "expanded")
        total = total.unionByName(raked).unionByName(whole)
    return total


_NODE = ["depth", "a", "b"]
_LISTED = "depth bigint, a bigint, b bigint, first bigint, ids string"
_DIGEST = "depth bigint, a bigint, b bigint, ends_sha256 string"


def _chunks(reader):
    """Sorted (node, conv_id) to (node, first conv_id, up to ``CHUNK`` numbers joined by commas)."""
    node, ids, out = None, [], []

    def close():
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
            ids.clear()

    for batch in reader:
        for *key, conv_id in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "conv_id"))):
            if key != node or len(ids) == CHUNK:
                close()
                node = key
            ids.append(conv_id)
        yield _batch(out, _LISTED)
        out = []
    close()
    yield _batch(out, _LISTED)


def _digests(reader):
    """Sorted chunks of a node to the digest of its whole list, one chunk in memory at a time."""
    node, running, out = None, None, []
    for batch in reader:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids"))):
            if key != node:
                if node:
                    out.append((*node, running.hexdigest()))
                node, running = key, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield _batch(out, _DIGEST)
        out = []
    yield _batch(out + ([(*node, running.hexdigest())] if node else []), _DIGEST)


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64() if kind == "bigint" else pa.string()) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) from rows (depth, a, b, conv_id): SHA-256 of a node's numbers, ascending, joined by commas.

    Numbers are sorted in ranges of the whole table, which cut a large list; each range writes chunks of text, and only
    the chunks of a node pass through one task, one after the other, as the digest demands.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*_NODE, "conv_id"]
    listed = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_chunks, _LISTED)
    return listed.repartition(parts, *_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(_digests, _DIGEST)


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations, the root included: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 (see ``end_digests``).

    Turns are ordered by turn (null first), role and text; null roles and texts are empty; equal rows are turns of their own;
    rows without conv_id belong to no conversation, and without any there is no row. Other columns are ignored.
    """
    whole = written(rebuilt(in_order(turns)), "whole")
    known = written(prefixes(whole), "prefixes")
    below = written(nodes(known), "named")
    children = _named_by_parent(below.groupBy(*UP).agg(F.count("*").alias("kids")))
    forest = below.join(children, ID, "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    forest = written(forest, "forest")
    totals = contracted(forest)

    zero = F.lit(0).cast("bigint")
    ends = known.where(F.col("depth") == F.col("n")).select(*_NODE, "conv_id").unionByName(
        whole.where(F.col("n") == 0).select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id"))
    top = whole.agg(F.min("conv_id").alias("conv_id"), F.count_distinct("conv_id").alias("n")).first()
    root = forest.agg(F.count_if(F.col("depth") == 1).alias("kids"), F.count_if(F.col("kids") == 0).alias("leaves"), F.sum("saved").alias("tokens")).select(
        F.lit(top["conv_id"]).cast("bigint").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("bigint").alias("parent"), F.lit(top["n"]).cast("bigint").alias("n_convs"),
        "kids", F.greatest("leaves", F.lit(1)).cast("bigint").alias("leaves"), F.coalesce("tokens", zero).alias("tokens"), zero.alias("a"), zero.alias("b")).where(
        F.col("n_convs") > 0)
    rows = forest.join(totals, ID).withColumn("parent", F.coalesce("parent", F.lit(top["conv_id"]).cast("bigint")))
    rows = rows.select(*root.columns).unionByName(root).join(end_digests(ends), _NODE, "left")
    return rows.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.col("kids").alias("n_children"),
                       F.col("leaves").alias("n_leaves"), F.col("tokens").alias("saved_tokens"),
                       F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def _crc_table() -> list:
    table = range(256)
    for _ in range(8):
        table = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return table


ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS own, conv_id - conv_id % {FAMILY} AS base,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda x, y: xor(x >> 8, {_crc_table()}[1 + (xor(x, y) & 255)]))) % 4 AS h
  FROM t GROUP BY conv_id),
d AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.own, 0)) AS head FROM c LEFT JOIN c AS b ON b.conv_id = c.base),
r AS (
  SELECT d.conv_id, t.place + 1 AS depth, role, text FROM d JOIN t ON t.conv_id = d.base AND t.place < d.head
  UNION ALL SELECT d.conv_id, t.place - d.h + d.head + 1, role, text FROM d JOIN t ON t.conv_id = d.conv_id AND t.place >= d.h),
p AS (
  SELECT conv_id, depth, len(regexp_extract_all(text, '{WORD}')) AS words,
    string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM d),
n AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved FROM p GROUP BY prefix, depth),
k AS (SELECT left(prefix, 64 * (depth - 1)::INT) AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
e AS (
  SELECT prefix, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS digest
  FROM p JOIN (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id) USING (conv_id, depth) GROUP BY prefix),
u AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (prefix)),
s AS (
  SELECT left(prefix, 64 * i::INT) AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS i FROM u) GROUP BY 1)
SELECT u.conv_id, u.depth, above.conv_id AS parent_conv_id, u.n_convs, u.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens,
  coalesce(e.digest, sha256('')) AS ends_sha256
FROM u JOIN s USING (prefix) LEFT JOIN e USING (prefix) LEFT JOIN n AS above ON u.depth > 0 AND above.prefix = left(u.prefix, 64 * (u.depth - 1)::INT)
"""
