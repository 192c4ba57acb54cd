"""The corpus pipeline: stages over the documents table, each working on what its predecessor kept.

Quality rules drop what they reject; of equal texts one stays; of each group of near duplicates (five-word shingles, 80 %)
one stays; sources are mixed to their target weights, so documents appear as often as the mix takes them; the mix is
tokenised and packed into sequences. A mix takes documents whole: the one on a source's cut is in if at least half fits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import exact_dedup, mixing, near_dedup, packing, quality
from tidewatch.llm.common import bounded_batches


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base counts and the tokeniser's bands keep."""
    bounded_batches(spark)
    return quality.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    bounded_batches(spark)
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: where it stands in which sequence."""
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mix), ("best_fit_packing", pack)]

#: Tokenisation and shingle links cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
