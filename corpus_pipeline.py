"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

language ID -> exact dedup -> MinHash near-dedup -> mixing sources to target weights -> packing. All but the last return rows
of documents; the last returns the pieces of the packed sequences. The mix repeats the documents that it takes more than once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import exact_dedup, langid, mixing, near_dedup, packing
from gridloom.llm.common import fresh_path, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those without a letter or with a low score go."""
    return langid.in_known_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.distinct_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.near_distinct(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mixed), ("packing", packed)]

#: The first, third and last stage have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
