"""Corpus pipeline: quality, exact dedup, near-duplicate join, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm.common import read, saved
from tracelake.llm.decontaminate import drop_contaminated
from tracelake.llm.exact_dedup import drop_copies
from tracelake.llm.jaccard_join import keep_one
from tracelake.llm.packing import pack
from tracelake.llm.quality import keep_good


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    return keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per packed piece of the documents that are left."""
    return pack(docs)


STAGES = [("quality classifier", good), ("exact dedup", copies), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", clean), ("best-fit packing", sequences)]

#: The classifier is learned and the tokenizer is not a SQL function.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs)
    return docs
