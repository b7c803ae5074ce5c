"""Helpers shared by the corpus operators."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"
"""A word, as every contract on words has it: a run of anything but ASCII white space."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identity of a document row. Rows equal in id and text share it and so share every decision.

    Hashes leave nulls out; the flag keeps a null id with the text '7' apart from the id 7 without a text.
    """
    return F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id).cast("string"), F.col(text))


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the whole row as struct ``_row``, so that helper columns cannot clash."""
    return docs.select(
        F.col("doc_id"), F.col("text"), row_key().alias("_key"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))


def batches(reader: Iterator[pa.RecordBatch], limit_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, each cut so that it holds about ``limit_bytes`` or one row."""
    for batch in reader:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * limit_bytes / max(batch.nbytes, 1)))
        for start in range(0, rows, step):
            yield batch.slice(start, step)
