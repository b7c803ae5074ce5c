"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all that the one before it kept and returns the columns of ``documents``; the last returns the
pieces of the packed sequences (see ``weblode.llm.packing.pack``). ``run`` writes every stage as Parquet under the
shared folder and goes on from there, so a lost executor costs part of one stage.
"""

from pyspark.sql import DataFrame, SparkSession

from weblode.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules
from weblode.llm.common import table
from weblode.operators.blocks import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave the perplexity band of their language go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go; so do documents of which nothing remains."""
    return line_dedup.drop_repeated_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id."""
    return near_dedup.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, placed in sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("decontamination", clean), ("packing", packed)]

ORACLE_SQL = None
"""The perplexity bands of the first stage come from a trained model, which SQL cannot express."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
