"""Decisions on a stream of scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decide(stream: DataFrame, policy: DataFrame, global_threshold: float) -> DataFrame:
    """Adds pred to a stream with cluster and score: the policy, a row for each cluster, is joined as a static table."""
    known = policy.select("cluster", F.col("threshold").alias("_own"))
    return stream.join(F.broadcast(known), "cluster", "left").withColumn("pred", (F.col("score") >= F.coalesce("_own", F.lit(global_threshold))).cast("int")).drop("_own")


def windowed_rates(decided: DataFrame, time: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """start, cluster, n, positive_rate of decisions in each window of event time."""
    w = decided.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "cluster")
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg("pred").alias("positive_rate")).select(F.col("w.start").alias("start"), "cluster", "n", "positive_rate")
