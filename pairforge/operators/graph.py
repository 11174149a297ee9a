"""The graph of texts that pairs link, and its components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.text import identity_key
from pairforge.session import join_groups, removed, scratch, written


def edges(pairs: DataFrame, key: Callable[[Column], Column] = identity_key) -> DataFrame:
    """Adds key_a and key_b, hashes of the identity of both sides."""
    return pairs.withColumns({"key_a": F.md5(key(F.col("question1"))), "key_b": F.md5(key(F.col("question2")))})


def components(links: DataFrame, a: str = "key_a", b: str = "key_b") -> DataFrame:
    """key, component of all ends of links (a, b): component is the least key that can be reached.

    Large and small stars in turn (Kiveris et al., Connected components in MapReduce and beyond, 2014): each round links
    nodes to the least node around them, so the depth of the trees shrinks fast. Rounds are written to the shared folder
    and end when nothing changes. A hub's edges stay where they are when they meet its least neighbour.
    """
    spark = links.sparkSession
    path = scratch(spark)
    all_ = written(links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo <= hi").distinct(), f"{path}/links")
    loops, e = all_.where("lo = hi").select(F.col("lo").alias("key")), all_.where("lo < hi")
    before, n = None, e.count()
    for i in range(1, 80):
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_groups(both.where("v > u"), least, ["u"], "n", 2 * n).select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        large = written(large, f"{path}/large{i}")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_groups(large, least, ["hi"], "n", n).select(F.col("m").alias("lo"), F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"))
        e = written(small.where("lo < hi").distinct(), f"{path}/{i}")
        removed(spark, f"{path}/large{i}")
        if i > 1:
            removed(spark, f"{path}/{i - 1}")
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).head())
        if state == before:
            break
        before, n = state, state[0]
    out = e.select(F.col("hi").alias("key"), F.col("lo").alias("component")).unionByName(e.select(F.col("lo").alias("key"), F.col("lo").alias("component")).distinct())
    return out.unionByName(loops.join(out, "key", "left_anti").select("key", F.col("key").alias("component")))


def with_components(linked: DataFrame) -> DataFrame:
    """Adds component and size (its pairs) to pairs with key_a and key_b."""
    nodes = components(linked).withColumnRenamed("key", "key_a")
    out = linked.join(nodes, "key_a")
    return out.join(out.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component")
