"""Session plumbing of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge import session
from pairforge.session import HEAVY, join_groups, removed, scratch, tidy, written

__all__ = ["HEAVY", "as_text", "join_groups", "ready", "removed", "scratch", "tidy", "wrapped", "written"]


#: Settings of Python workers: one thread each, and blocks over 1 MB go back to the system as soon as they are free, as a worker outlives its stage.
WORKERS = {"OMP_NUM_THREADS": "1", "ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(1 << 20)}


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, with the settings of WORKERS where the session has none."""
    for name, value in WORKERS.items():
        spark.sparkContext.environment.setdefault(name, value)
    return session.ready(spark)


def as_text(documents: DataFrame, text: str = "text") -> DataFrame:
    """The text column as a string without nulls."""
    return documents.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))


def wrapped(documents: DataFrame) -> DataFrame:
    """doc_id, text, and whole rows as r: columns of any name can't clash with an operator's own."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct("*").alias("r"))
