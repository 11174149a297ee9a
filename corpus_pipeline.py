"""Training text from raw documents: quality, exact copies, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairforge.llm import decontam, exact_dedup, minhash, packing, quality
from pairforge.llm.registry import TOKENIZER, table
from pairforge.llm.shared import removed, scratch, tidy, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact copies."""
    return exact_dedup.kept(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by shingles of five words."""
    return minhash.kept(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, packed into sequences."""
    return packing.pack(docs, TOKENIZER())


STAGES = [("quality", good), ("exact_dedup", unique), ("near_dedup", distinct), ("decontamination", unseen), ("packing", packed)]

#: Boosted trees and a tokenizer are no SQL: the tests hold the stages against brute force, and the first against the classifier's query.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each result written to the shared folder and read by the next.

    What a stage needed is deleted when its result is written; the last one's tables stay, as its result is not computed yet.
    """
    docs, path, read = table(spark, sf_dir, "documents"), scratch(spark), None
    for name, stage in STAGES[:-1]:
        with tidy(spark):
            docs = written(stage(spark, docs, sf_dir), f"{path}/{name}")
        if read:
            removed(spark, read)
        read = f"{path}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
