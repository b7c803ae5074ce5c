"""Building blocks that keep hot groups out of one task.

A group (a job, a host, a URL) may hold a third of all rows. Three devices replace the plain
window over such a group:

* ``top_per_group``: the first rows of each salted slice of a group, then the first of those;
* ``first_per_key``: the same for "is this the first row of its key", with every row kept;
* blocks: a group is cut along its order column into blocks, a window works inside each block, and
  what flows from block to block comes from one summary row per (group, block);
* ranges: the same along a whole list of order columns, so that rows equal in the first ones are parted too.
"""

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SALTS = 64
BLOCKS = 128


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by the cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="weblode-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; two calls never share one."""
    return os.path.join(shared_dir(spark), "weblode", f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a result that several consumers read, and read it back.

    Costly work runs once, later scans prune columns and push filters, and the lineage ends in
    files that outlive executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salt_of(*columns, salts: int = SALTS) -> Column:
    """Slice number of a row, a pure function of the row and so equal on every retry."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def join_spread(rows: DataFrame, one_per_key: DataFrame, key: list, by: list, how: str = "left", salts: int = 16) -> DataFrame:
    """Attach one row per key to rows of which a single key may hold a large part.

    The small side is repeated once per slice and rows meet it by (key, slice), a slice being a hash of columns
    ``by``. No task gets a whole key when the join shuffles, and later windows on wider keys get an exchange of
    their own, since the result is not partitioned by the key alone.
    """
    sliced = one_per_key.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_spread", salt_of(*by, salts=salts)).join(sliced, [*key, "_spread"], how).drop("_spread")


def ordering(names) -> list:
    """Sort columns from names; a leading '-' means descending."""
    return [F.desc(n[1:]) if n.startswith("-") else F.asc(n) for n in names]


def top_per_group(df: DataFrame, by: list, order: list, n: int, salts: int = SALTS) -> DataFrame:
    """First ``n`` rows of each group; ``order`` (names, '-' for descending) must be total.

    Slices are ranked first, so no task sees more than its slice of a hot group and the last
    window ranks at most ``salts * n`` rows per group. Spark also limits each slice before the
    shuffle (WindowGroupLimit).
    """
    if not by:
        return df.orderBy(*ordering(order)).limit(n)
    inner = Window.partitionBy(*by, "_salt").orderBy(*ordering(order))
    outer = Window.partitionBy(*by).orderBy(*ordering(order))
    return (
        df.withColumn("_salt", salt_of(*[c.lstrip("-") for c in order], salts=salts))
        .withColumn("_rn", F.row_number().over(inner)).where(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(outer)).where(F.col("_rn") <= n)
        .drop("_salt", "_rn")
    )


def mark_first(df: DataFrame, key: list, order: list, out: str, eligible: Column,
               salts: int = SALTS) -> DataFrame:
    """Add ``out``: TRUE on the first eligible row of each key, FALSE on all others.

    Two windows: the first row of each slice of a key, then the first among those. A row that lost
    in its slice keeps its slice number in the second window, so a hot key stays spread out and
    every row is kept. Adds ``_slice`` (0 on rows that won their slice), by which the result is
    partitioned together with ``key``.
    """
    sliced = df.withColumn("_ok", F.coalesce(eligible, F.lit(False))).withColumn(
        "_salt", salt_of(*order, salts=salts))
    inner = Window.partitionBy(*key, "_ok", "_salt").orderBy(*order)
    outer = Window.partitionBy(*key, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_won", F.col("_ok") & (F.row_number().over(inner) == 1))
        .withColumn("_slice", F.when(F.col("_won"), 0).otherwise(F.col("_salt") + 1))
        .withColumn(out, F.col("_won") & (F.row_number().over(outer) == 1))
        .drop("_ok", "_salt", "_won")
    )


def cut_points(df: DataFrame, column: str, blocks: int = BLOCKS) -> list:
    """Up to ``blocks - 1`` ascending quantiles of a column; nulls do not count.

    A small job of its own, so that every reader of the cut uses the same numbers. Any cut gives right results;
    quantiles make blocks of like size whatever the values, outliers included.
    """
    shares = [i / blocks for i in range(1, blocks)]
    found = df.agg(F.percentile_approx(column, shares, 20 * blocks).alias("c")).first()["c"] if shares else None
    return sorted(set(found or []))


def block_number(column: str, cuts: list) -> Column:
    """How many cut points lie below the value; 0 for NULL, which sorts first too."""
    points = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    return F.size(F.filter(points, lambda c: c < F.col(column)))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list, how: str = "left") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the keys of ``left`` stay."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = None
    for k in keys:
        same = left[k].eqNullSafe(renamed[f"_right_{k}"])
        on = same if on is None else on & same
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


RANGE, PLACE = "_range", "_place"


def ranged(df: DataFrame, order: list, ranges: int | None = None) -> DataFrame:
    """``df`` written once in order of the columns ``order`` (names, '-' for descending), cut into ranges of like size wherever that falls.

    Adds ``_range`` and ``_place``, the place of the row in its range, both ascending. The cuts are sampled by the sort that
    deals the rows out, so nothing is read twice; rows equal in all of ``order`` share a range, so let it end in a
    unique column. Groups that begin ``order`` run from range to range: windows by (group, ``_range``) are bounded by the
    size of a range, and one summary row per (group, ``_range``) carries on what lies before (see ``carried``).
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ordering(order)
    lined = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    low = (1 << 33) - 1  # an id is the number of the partition, then 33 bits of the place in it
    return written(lined.withColumn(RANGE, F.shiftright("_id", 33).cast("int")).withColumn(PLACE, F.col("_id").bitwiseAND(F.lit(low))).drop("_id"), "ranged")


def before_range(group: list) -> Window:
    """Window over the summary rows of a group's ranges that come before."""
    return Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def carried(rows: DataFrame, summary: DataFrame, group: list) -> DataFrame:
    """Rows of ``ranged`` with the summary row of their (group, ``_range``); NULL equals NULL in the group."""
    return join_null_safe(rows, summary, [*group, RANGE])


def counted(rows: DataFrame, group: list) -> DataFrame:
    """Per (group, ``_range``): ``_from``, the least place, and ``_offset``, the number of the group's rows in ranges before,
    and ``_end``, with those of this range."""
    return (
        rows.groupBy(*group, RANGE).agg(F.min(PLACE).alias("_from"), F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before_range(group)), F.lit(0)))
        .withColumn("_end", F.col("_offset") + F.col("_n")).drop("_n")
    )


def rank_in_group(df: DataFrame, group: list, order: list, out: str, ranges: int | None = None) -> DataFrame:
    """Exact row number inside each group, ordered by ``order`` (names, '-' for descending); equal rows in any order.

    No window over rows: the number is the place in the range, less that of the group's first row there, plus the group's
    rows in ranges before. However long a group and its ties, no task sees more than a range. ``df`` is read once.
    """
    rows = ranged(df, [*group, *order], ranges)
    number = F.col(PLACE) - F.col("_from") + F.col("_offset") + 1
    return carried(rows, counted(rows, group), group).withColumn(out, number.cast("bigint")).select(*df.columns, out)


def mark_limit(df: DataFrame, group: list, order: list, limit: str, out: str, ranges: int | None = None) -> DataFrame:
    """Add ``out``: the row is among the first rows of its group in order of ``order``, as many as column ``limit`` says (NULL: all)."""
    ranked = rank_in_group(df, group, order, "_number", ranges)
    return ranked.withColumn(out, F.col(limit).isNull() | (F.col("_number") <= F.col(limit))).select(*df.columns, out)
