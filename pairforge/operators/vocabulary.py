"""Vocabularies: tokens numbered by frequency, texts as lists of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Numbers of padding and of unknown tokens.
PAD, UNK = 0, 1


def build(docs: DataFrame, tokens: str, min_count: int = 2) -> DataFrame:
    """token, id, times of tokens that occur min_count times or more: the most frequent first, then by text.

    Two levels: frequencies are few, and tokens are numbered within a frequency.
    """
    n = docs.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= min_count)
    before = Window.partitionBy().orderBy(F.desc("times")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = n.groupBy("times").agg(F.count(F.lit(1)).alias("_n")).select("times", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("times").orderBy("token"))
    return n.join(offsets, "times").select("token", (F.col("_before") + within + UNK).alias("id"), "times")


def encode(docs: DataFrame, key: str, tokens: str, vocabulary: DataFrame, max_len: int) -> DataFrame:
    """key, ids of the first max_len tokens; an empty text is one unknown token."""
    long = docs.select(key, F.posexplode_outer(F.slice(tokens, 1, max_len)).alias("i", "token"))
    known = long.join(vocabulary.select("token", "id"), "token", "left")
    seq = F.array_sort(F.collect_list(F.struct(F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("id", F.lit(UNK)).alias("id"))))
    return known.groupBy(key).agg(seq.alias("s")).select(key, F.col("s.id").alias("ids"))
