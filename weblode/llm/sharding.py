"""Sharding by rendezvous hashing.

Every (key, shard) pair has a pseudo-random draw ``u`` in (0, 1); a key goes to the shard with the smallest
``-ln(u) / weight``. Shares of the shards are in proportion to their weights, and a new shard only takes
keys for which its own draw wins, so no key moves between old shards. DataFrame functions only.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

SHARDS = 40
OVERHEAD = 16
BLOCKS = 256


def draw(key: Column, shard: int) -> Column:
    """Uniform draw in (0, 1) of a key for a shard, the same on every run and machine."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 12).cast("double")
    return (bits + F.lit(0.5)) * F.lit(2.0 ** -52)


def winner(key: Column, shards: list[int], weights: list[float]) -> Column:
    """Struct (score, shard) of the winning shard; equal scores go to the lower number."""
    costs = [F.struct((-F.log(draw(key, s)) / F.lit(float(w))).alias("score"), F.lit(s).alias("shard"))
             for s, w in zip(shards, weights)]
    return F.least(*costs) if len(costs) > 1 else costs[0]


def assign(rows: DataFrame, key: str, shards: int = SHARDS, weights: list[float] | None = None,
           grow_by: float | None = None) -> DataFrame:
    """Add ``shard`` and, with ``grow_by``, ``grown_shard``: where the row goes once one more shard of that
    weight exists. Weights must be positive and finite. A null key is a key of its own."""
    weights = [1.0] * shards if weights is None else [float(w) for w in weights]
    if shards < 1 or len(weights) != shards or not all(w > 0 and math.isfinite(w) for w in weights):
        raise ValueError("one positive weight for each of at least one shard")
    known = F.col(key).cast("string")
    out = rows.withColumn("_best", winner(known, list(range(shards)), weights))
    if grow_by is not None:
        out = out.withColumn("grown_shard", F.least("_best", winner(known, [shards], [grow_by]))["shard"])
    return out.withColumn("shard", F.col("_best")["shard"]).drop("_best")


def number_slots(groups: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """From groups of equal rows (``shard``, ``copies``, any other columns) one row per copy with its ``slot``:
    gapless from 0 in each shard.

    A shard is cut into blocks by a hash of the row; each block is numbered on its own and starts where the
    blocks before it end, so no task holds a whole shard.
    """
    rest = [c for c in groups.columns if c not in ("shard", "copies")]
    cut = groups.withColumn("_block", F.pmod(F.xxhash64(*rest), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (cut.groupBy("shard", "_block").agg(F.sum("copies").alias("_n"))
              .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inside = Window.partitionBy("shard", "_block").orderBy(*rest).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("_first", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
        .join(starts, ["shard", "_block"])
        .select(*rest, "shard", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"),
                (F.col("_start") + F.col("_first") - 1).alias("_base"))
        .withColumn("slot", F.col("_base") + F.col("_copy")).drop("_copy", "_base")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard, slot and grown shard of every document under law ``key``.

    The key is ``doc_id``; a null id is a key of its own. A null text counts no bytes. Rows equal in id and
    text, however many, are counted before the shuffle and unfolded at the end; they take neighbouring
    slots. No rows in, no rows out. Other columns are ignored.
    """
    known = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
                        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
                        F.pmod(F.spark_partition_id(), F.lit(64)).alias("_salt"))
    groups = known.groupBy("doc_id", "size", "text_crc32", "_salt").agg(F.count("*").alias("copies"))
    placed = number_slots(assign(groups, "doc_id", shards, grow_by=1.0))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
