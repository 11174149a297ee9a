"""Decision thresholds: global, by cluster with fallback, cross-fitted over folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.operators.metrics import best_threshold, confusion, decision_metrics, sweep

MIN_PAIRS, MIN_POSITIVES = 1000, 100


def fit(scored: DataFrame, min_pairs: int = MIN_PAIRS, min_positives: int = MIN_POSITIVES, by: tuple[str, ...] = ()) -> DataFrame:
    """by, cluster, threshold, own: the optimal threshold of each cluster of enough pairs and positives, else the global one."""
    whole = best_threshold(scored, by).select(*by, F.col("threshold").alias("_all"))
    sizes = scored.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))
    own = best_threshold(scored, (*by, "cluster")).select(*by, "cluster", F.col("threshold").alias("_own"))
    enough = (F.col("n") >= min_pairs) & (F.col("p") >= min_positives)
    out = sizes.join(own, [*by, "cluster"])
    out = out.join(F.broadcast(whole), list(by)) if by else out.crossJoin(F.broadcast(whole))
    return out.select(*by, "cluster", F.when(enough, F.col("_own")).otherwise(F.col("_all")).alias("threshold"), enough.alias("own"))


def apply(scored: DataFrame, policy: DataFrame, fallback: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds pred: score against the cluster's threshold, or that of fallback (one row: threshold) for unseen clusters."""
    whole = fallback.select(*by, F.col("threshold").alias("_all"))
    rows = scored.join(F.broadcast(whole), list(by)) if by else scored.crossJoin(F.broadcast(whole))
    rows = rows.join(policy.select(*by, "cluster", F.col("threshold").alias("_own")), [*by, "cluster"], "left")
    return rows.withColumn("pred", (F.col("score") >= F.coalesce("_own", "_all")).cast("int")).drop("_own", "_all")


def cross_fit(scored: DataFrame, folds: int, min_pairs: int = MIN_PAIRS, min_positives: int = MIN_POSITIVES, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Decisions of rows with fold 0 to folds - 1, each by a policy of the other folds; and these policies. by: columns of repetitions.

    Each row is repeated for the folds that learn from it: folds - 1 copies, a fixed factor.
    """
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("_own_fold"))
    train = scored.withColumnRenamed("fold", "_own_fold").withColumn("fold", F.explode(others)).drop("_own_fold")
    by = (*by, "fold")
    policy = fit(train, min_pairs, min_positives, by)
    return apply(scored, policy, best_threshold(train, by), by), policy


def repetitions(scored: DataFrame, reps: int, folds: int, min_pairs: int = MIN_PAIRS, min_positives: int = MIN_POSITIVES, key: str = "id") -> DataFrame:
    """rep, f1 of cross-fitted decisions over shufflings of rows to folds, in one plan."""
    rows = scored.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    text = F.concat_ws("|", F.col("rep").cast("string"), F.col(key).cast("string"))
    rows = rows.withColumn("fold", F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), F.lit(folds)).cast("int"))
    return decision_metrics(cross_fit(rows, folds, min_pairs, min_positives, ("rep",))[0], ("rep",)).select("rep", "f1")


def stability(policies: DataFrame) -> DataFrame:
    """cluster, mean, std, min, max of its own thresholds over fits, and the share of fits that have one."""
    own = F.when(F.col("own"), F.col("threshold"))
    return policies.groupBy("cluster").agg(F.avg(own).alias("mean"), F.stddev_pop(own).alias("std"), F.min(own).alias("min"), F.max(own).alias("max"), F.avg(F.col("own").cast("int")).alias("own_share"))


def size_sensitivity(scored: DataFrame, sizes: list[int], min_positives: int) -> DataFrame:
    """min_pairs, own (clusters with their own threshold), f1 of each minimum size."""
    by_size = scored.withColumn("min_pairs", F.explode(F.array(*map(F.lit, sizes))))
    whole = best_threshold(scored).select(F.col("threshold").alias("_all"))
    own = best_threshold(scored, ("cluster",)).select("cluster", F.col("threshold").alias("_own"))
    n = scored.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))
    rows = by_size.join(own, "cluster").join(n, "cluster").crossJoin(F.broadcast(whole))
    has = (F.col("n") >= F.col("min_pairs")) & (F.col("p") >= min_positives)
    rows = rows.withColumn("pred", (F.col("score") >= F.when(has, F.col("_own")).otherwise(F.col("_all"))).cast("int"))
    clusters = rows.groupBy("min_pairs").agg(F.count_distinct(F.when(has, F.col("cluster"))).alias("own"))
    return decision_metrics(rows, ("min_pairs",)).select("min_pairs", "f1").join(clusters, "min_pairs")


def half_transfer(scored: DataFrame, key: str, seed: int) -> DataFrame:
    """half, threshold, f1: tuned on one half of the rows, scored on the other, both ways."""
    half = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), 1, 1), 16, 10).cast("int") % 2).cast("int")
    rows = scored.withColumn("half", half)
    tuned = best_threshold(rows, ("half",)).select((1 - F.col("half")).alias("half"), F.col("threshold"))
    out = confusion(rows.join(F.broadcast(tuned), "half"), F.col("threshold"), ("half", "threshold"))
    return out.select("half", "threshold", "f1")


def adopt(macro_low: float, f1_high: float) -> bool:
    """A policy is adopted if its macro F1 surely gains and its F1 does not surely lose."""
    return macro_low > 0 and f1_high >= 0


def choose(base: str, gains: dict[str, tuple[float, float]], least: float = 0.005) -> str:
    """The variant of the greatest gain of at least the least, with an interval above 0; else base. gains: gain and lower bound."""
    good = {k: g for k, (g, low) in gains.items() if g >= least and low > 0}
    return max(sorted(good), key=good.__getitem__) if good else base


def to_record(policy: DataFrame, fallback: DataFrame) -> dict:
    """A policy as plain data: few rows, one for each cluster."""
    rows = policy.orderBy("cluster").collect()
    return {
        "mode": "cluster", "global_threshold": fallback.head().threshold,
        "cluster_thresholds": {str(r.cluster): r.threshold for r in rows if r.own}, "fallback_clusters": [r.cluster for r in rows if not r.own],
    }


def curve(scored: DataFrame) -> DataFrame:
    return sweep(scored).select("threshold", "precision", "recall", "f1")


def choose_stepwise(first: str, simpler: str, richer: dict[str, tuple[str, ...]], gains: dict[tuple[str, str], tuple[float, float]], least: float = 0.005) -> str:
    """The pre-registered rule: the simpler variant unless the first clearly beats it, then each richer one of that if it clearly beats what is chosen.

    gains: gain and lower bound of (variant, over variant). Clearly: by the least gain, with an interval above 0.
    """
    clear = lambda a, b: gains[a, b][0] >= least and gains[a, b][1] > 0
    choice = base = first if clear(first, simpler) else simpler
    for name in richer[base]:
        if clear(name, choice):
            choice = name
    return choice
