"""Bootstrap intervals, permutation nulls and subsample studies, as grouped aggregations over replicates.

Draw i of replicate b takes the row whose place is a hash of (seed, b, i) modulo the rows of its group, which SQL can do
as well; it takes rows times replicates. For many replicates of many rows, replicates.py draws counts instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairforge.functions.text import ratio
from pairforge.operators.metrics import best_threshold, confusion, sweep


def uniform(seed: int, *parts: Column) -> Column:
    """48 hashed bits."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


RANGES = 1024


def numbered(df: DataFrame, by: list[str], place: Column, order: list, name: str) -> DataFrame:
    """Adds the row number from 1 on within by, in order; place in [0, 1] must rise with order.

    Two levels: rows of ranges of place are counted first and numbered within, so no task holds all rows.
    """
    df = df.withColumn("_b", F.least(F.floor(place * RANGES), F.lit(RANGES - 1)))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cells = df.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n")).select(*by, "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order))
    return df.join(cells, [*by, "_b"]).withColumn(name, F.col("_before") + within).drop("_b", "_before")


def by_key(df: DataFrame, by: list[str], key: str, name: str) -> DataFrame:
    """numbered in order of a numeric key."""
    bounds = df.groupBy(*by).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"), F.count(F.lit(1)).alias("size"))
    out = df.join(bounds, by) if by else df.crossJoin(F.broadcast(bounds))
    place = (F.col(key) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1)
    return numbered(out, by, place, [key], name).drop("_lo", "_hi")


def by_hash(df: DataFrame, by: list[str], h: Column, key: str, name: str) -> DataFrame:
    """numbered in order of 48 hashed bits."""
    out = df.withColumn("_u", h)
    return numbered(out, by, F.col("_u") / float(1 << 48), ["_u", key], name).drop("_u")


def placed(scored: DataFrame, group: str, key: str) -> DataFrame:
    """Adds place (0 on) of each row within its group in order of a numeric key, and size. Groups are few."""
    return by_key(scored, [group], key, "place").withColumn("place", F.col("place") - 1)


def draws(scored: DataFrame, replicates: int, seed: int, group: str, key: str) -> DataFrame:
    """boot and a row of scored for each draw: as many as a group has rows, with replacement within it."""
    rows = placed(scored, group, key)
    asked = rows.select(group, "place", "size").withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    asked = asked.select("boot", group, F.pmod(uniform(seed, F.col("boot"), F.col(group), F.col("place")), F.col("size")).cast("int").alias("place"))
    return asked.join(rows.drop("size"), [group, "place"]).drop("place")


def interval(metrics: DataFrame, columns: list[str], by: tuple[str, ...] = (), low: float = 0.025, high: float = 0.975) -> DataFrame:
    """low, high and std of columns over replicates, quantiles with linear interpolation."""
    out = [f for c in columns for f in (F.percentile(c, F.lit(low)).alias(f"{c}_low"), F.percentile(c, F.lit(high)).alias(f"{c}_high"), F.stddev_pop(c).alias(f"{c}_std"))]
    return metrics.groupBy(*by).agg(*out)


def cluster_bootstrap(scored: DataFrame, tau: float, replicates: int, seed: int = 1, key: str = "id") -> DataFrame:
    """By cluster, intervals of F1 at tau and of the optimal threshold."""
    rows = draws(scored, replicates, seed, "cluster", key)
    by = ("boot", "cluster")
    f1 = sweep(rows, by).where(F.col("k") == round(tau * 100)).select(*by, "f1")
    best = best_threshold(rows, by).select(*by, F.col("threshold").alias("tau"))
    return interval(f1.join(best, list(by)), ["f1", "tau"], ("cluster",))


def paired_bootstrap(scored: DataFrame, tau_a: float, tau_b: float, replicates: int, seed: int = 2, key: str = "id") -> DataFrame:
    """Interval of the gain in F1 of score_b at tau_b over score at tau_a on the same draws, and the chance of none."""
    rows = draws(scored.withColumn("_all", F.lit(0)), replicates, seed, "_all", key)
    a = confusion(rows, tau_a, ("boot",)).select("boot", F.col("f1").alias("fa"))
    b = confusion(rows.withColumn("score", F.col("score_b")), tau_b, ("boot",)).select("boot", F.col("f1").alias("fb"))
    gain = a.join(b, "boot").withColumn("gain", F.col("fb") - F.col("fa"))
    return gain.agg(F.avg("gain").alias("gain"), F.percentile("gain", F.lit(0.025)).alias("gain_low"), F.percentile("gain", F.lit(0.975)).alias("gain_high"), F.avg((F.col("gain") <= 0).cast("int")).alias("p_no_gain"))


def averaged_bootstrap(decided: DataFrame, replicates: int, seed: int = 3, key: str = "id") -> DataFrame:
    """Interval of F1 averaged over repetitions (rep, pred) within each resample of ids."""
    ids = decided.select(key).distinct().withColumn("_all", F.lit(0))
    drawn = draws(ids, replicates, seed, "_all", key).groupBy("boot", key).agg(F.count(F.lit(1)).alias("times"))
    rows = drawn.join(decided, key)
    w = lambda a, b: F.sum(F.when((F.col("y") == a) & (F.col("pred") == b), F.col("times")).otherwise(0))
    each = rows.groupBy("boot", "rep").agg(w(1, 1).alias("tp"), w(0, 1).alias("fp"), w(1, 0).alias("fn"))
    mean = each.groupBy("boot").agg(F.avg(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))
    return interval(mean, ["f1"])


def partition_null(scored: DataFrame, tau: float, replicates: int, seed: int = 4, key: str = "id") -> DataFrame:
    """observed range of F1 over clusters, the mean range when labels of clusters are dealt out anew, and the share of these at least as great.

    Replicate b gives the row of the i-th least hash the cluster of the i-th row, so sizes stay.
    """
    rows = scored.select(key, "y", "score", "cluster").withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    slots = by_key(scored.select(key, "cluster"), [], key, "slot").select("cluster", "slot")
    dealt = by_hash(rows.drop("cluster"), ["boot"], uniform(seed, F.col("boot"), F.col(key)), key, "slot")
    spread = lambda df, by: confusion(df, tau, (*by, "cluster")).groupBy(*by).agg((F.max("f1") - F.min("f1")).alias("spread"))
    seen = spread(scored, ()).withColumnRenamed("spread", "observed")
    null = spread(dealt.join(slots, "slot"), ("boot",))
    return null.crossJoin(F.broadcast(seen)).groupBy("observed").agg(F.avg("spread").alias("null_mean"), F.avg((F.col("spread") >= F.col("observed")).cast("int")).alias("p_value"))


def threshold_reliability(scored: DataFrame, sizes: list[int], replicates: int, seed: int = 5, key: str = "id") -> DataFrame:
    """n, std and 5/95 percentiles of the optimal threshold of subsamples of n rows, and their regret in F1 on all rows."""
    rows = scored.select(key, "y", "score").withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    rows = by_hash(rows, ["boot"], uniform(seed, F.col("boot"), F.col(key)), key, "rank")
    sub = rows.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where("rank <= size")
    best = best_threshold(sub, ("size", "boot"))
    full = sweep(scored).select(F.col("threshold"), F.col("f1").alias("full"))
    top = full.agg(F.max("full").alias("top"))
    out = best.drop("f1").join(F.broadcast(full), "threshold").crossJoin(F.broadcast(top))
    return out.groupBy("size").agg(F.stddev_pop("threshold").alias("tau_std"), F.percentile("threshold", F.lit(0.05)).alias("tau_p5"), F.percentile("threshold", F.lit(0.95)).alias("tau_p95"), F.avg(F.col("top") - F.col("full")).alias("regret_mean"), F.percentile(F.col("top") - F.col("full"), F.lit(0.95)).alias("regret_p95"))
