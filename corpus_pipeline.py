"""A corpus pipeline of five stages, each over all that the one before kept.

In every stage null ids and sources are values like others, texts are read whole whatever their length, an empty table gives no rows,
and columns that a stage doesn't read are passed on (but by the last, which returns pieces), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.common import Scratch
from loomgraph.llm.jaccard import drop_near_duplicates
from loomgraph.llm.mixing import resampled
from loomgraph.llm.packing import pack
from loomgraph.llm.quality import kept_documents
from loomgraph.llm.secrets import redact_column


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy keeps. Null and empty texts have no words and go; repeated rows share a fate."""
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class under links of five-word shingles and a likeness of 0.8 or more: that with the smallest id.

    Of repeated rows one stays; texts without words, null ones among them, link with nothing and stay.
    """
    return drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts. Null and empty texts have none; repeated rows are each read."""
    return redact_column(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Texts without words are never taken; repeated rows are taken as one document's copies add up."""
    return resampled(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens. A null or empty text is one piece, its end; repeated rows are packed each."""
    return pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mixture", mixture), ("packing", packing)]

#: Greedy packing, byte-pair ids and guess costs have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
