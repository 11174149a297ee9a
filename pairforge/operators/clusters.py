"""Regions of texts and pairs by nearest centroid, and how good a clustering is."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairforge.functions.vectors import cosine, dot, doubles, midpoint, unit
from pairforge.operators import kmeans as lloyd
from pairforge.operators.resample import uniform
from pairforge.session import scratch, written

Centroids = list[tuple[int, list[float]]]


def from_rows(df: DataFrame, cluster: str, vector: str) -> Centroids:
    """A table of centroids, one row for each cluster, on the driver."""
    return sorted((r[0], [float(x) for x in r[1]]) for r in df.select(cluster, vector).collect())


def scores(x: Column, centroids: Centroids) -> Column:
    """(score, -cluster) of every centroid: x * c - |c|^2 / 2, which orders by distance. Centroids are literals of the plan."""
    each = [F.struct((dot(x, F.array(*map(F.lit, c))) - F.lit(sum(v * v for v in c) / 2)).alias("s"), F.lit(-i).alias("k")) for i, c in centroids]
    return F.sort_array(F.array(*each), asc=False)


def assign(df: DataFrame, vector: str, centroids: Centroids) -> DataFrame:
    """Adds cluster (the least on ties), second, margin and cos_assigned."""
    out = df.withColumn("_s", scores(F.col(vector), centroids))
    own = {i: c for i, c in centroids}
    cluster = -F.col("_s")[0]["k"]
    cos = reduce(lambda acc, i: acc.when(cluster == i, cosine(F.col(vector), F.array(*map(F.lit, own[i])))), own, F.when(F.lit(False), 0.0))
    return out.withColumns({"cluster": cluster, "second": -F.get("_s", F.lit(1))["k"], "margin": F.col("_s")[0]["s"] - F.get("_s", F.lit(1))["s"], "cos_assigned": cos}).drop("_s")


def assign_pairs(pairs: DataFrame, centroids: Centroids, rule: str = "pair_avg") -> DataFrame:
    """Adds cluster to pairs with vectors va and vb: of the first text, of the midpoint, or of both if they agree (else -1)."""
    best = lambda x: -scores(x, centroids)[0]["k"]
    if rule == "q1":
        return pairs.withColumn("cluster", best(F.col("va")))
    if rule == "pair_avg":
        return pairs.withColumn("cluster", best(midpoint(F.col("va"), F.col("vb"))))
    if rule == "same_only":
        return pairs.withColumns({"_a": best(F.col("va")), "_b": best(F.col("vb"))}).withColumn("cluster", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(-1)).drop("_a", "_b")
    raise ValueError(f"unknown rule: {rule}")


def size_stats(labelled: DataFrame, cluster: str = "cluster") -> DataFrame:
    """clusters, min_share, max_share, max_min_ratio, entropy (1 for equal sizes)."""
    n = labelled.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    shares = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    out = shares.agg(F.count(F.lit(1)).alias("clusters"), F.min("p").alias("min_share"), F.max("p").alias("max_share"), (F.max("n") / F.min("n")).alias("max_min_ratio"), (-F.sum(F.col("p") * F.log("p"))).alias("h"))
    return out.select("clusters", "min_share", "max_share", "max_min_ratio", F.when(F.col("clusters") > 1, F.col("h") / F.log(F.col("clusters").cast("double"))).otherwise(0.0).alias("entropy"))


def adjusted_rand(labelled: DataFrame, a: str, b: str) -> DataFrame:
    """ari of two labelings of the same rows."""
    two = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    cells = labelled.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    both = cells.agg(two("n").alias("ij"), F.sum("n").alias("all"))
    for s, c in (("i", a), ("j", b)):
        both = both.crossJoin(cells.groupBy(c).agg(F.sum("n").alias("n")).agg(two("n").alias(s)))
    total = F.col("all").cast("double") * (F.col("all") - 1) / 2
    expected = F.try_divide(F.col("i") * F.col("j"), total)
    return both.select(F.coalesce(F.try_divide(F.col("ij") - expected, (F.col("i") + F.col("j")) / 2 - expected), F.lit(1.0)).alias("ari"))


def mean_vectors(df: DataFrame, vector: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, n, mean: means by position, re-assembled in order."""
    long = df.select(*by, F.posexplode(doubles(F.col(vector))).alias("i", "x"))
    means = long.groupBy(*by, "i").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return means.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))


def separation(df: DataFrame, vector: str, cluster: str = "cluster") -> DataFrame:
    """davies_bouldin, calinski_harabasz, mean_cosine and worst_cosine (of a cluster) to the centroids. Clusters are few."""
    cents = mean_vectors(df, vector, (cluster,))
    rows = df.join(cents, cluster)
    dist2 = lambda a, b: F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, e: s + e)
    own = rows.groupBy(cluster).agg(F.avg(F.sqrt(dist2(F.col(vector), F.col("mean")))).alias("s"), F.sum(dist2(F.col(vector), F.col("mean"))).alias("w"), F.sum(cosine(F.col(vector), F.col("mean"))).alias("c"), F.count(F.lit(1)).alias("m"))
    own = own.join(cents.select(cluster, "mean"), cluster)
    i, j = own.alias("i"), own.alias("j")
    worst = i.join(j, F.col(f"i.{cluster}") != F.col(f"j.{cluster}")).groupBy(F.col(f"i.{cluster}").alias(cluster)).agg(F.max((F.col("i.s") + F.col("j.s")) / F.sqrt(dist2(F.col("i.mean"), F.col("j.mean")))).alias("r"))
    whole = mean_vectors(df, vector).select(F.col("mean").alias("g"))
    parts = own.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("m") * dist2(F.col("mean"), F.col("g"))).alias("b"), F.sum("w").alias("w"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum("c") / F.sum("m")).alias("mean_cosine"), F.min(F.col("c") / F.col("m")).alias("worst_cosine"))
    return parts.crossJoin(worst.agg(F.avg("r").alias("davies_bouldin"))).select("davies_bouldin", ((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"), "mean_cosine", "worst_cosine")


def sampled(df: DataFrame, key: str, sample: int, seed: int) -> DataFrame:
    """The rows that a sample of so many takes: those of the least hashes of their keys."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(sample)


def silhouette(df: DataFrame, vector: str, cluster: str, key: str, sample: int, seed: int) -> DataFrame:
    """silhouette of a sample of rows, by exact distances within it. The sample bounds the pairs; it is broadcast. A row without a vector counts 0; null for fewer than two rows."""
    rows = sampled(df, key, sample, seed).select(F.col(cluster).alias("c"), doubles(F.col(vector)).alias("v")).collect()
    own, found = [r for r in rows if r["v"] is not None], None
    if len(rows) > 1:
        _, labels = np.unique(np.array([r["c"] for r in own]), return_inverse=True)
        found = lloyd.mean_silhouettes(df.sparkSession, np.array([r["v"] for r in own], float), [labels])[0] * len(own) / len(rows) if own else 0.0
    return df.sparkSession.createDataFrame([(found,)], "silhouette double")


def kmeans(df: DataFrame, vector: str, k: int, seeds: range) -> Centroids:
    """Centroids of the cheapest of several runs, numbered by size, the largest first."""
    rows = lloyd.rows_of(df.withColumn("_k", F.xxhash64(vector)), vector, "_k").persist()
    try:
        best = lloyd.best(lloyd.fit_all(rows, [lloyd.Fit(k, s) for s in seeds]))
    finally:
        rows.unpersist()
    return list(enumerate(best.centres.tolist()))


def pca(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """Adds reduced: the leading principal components."""
    rows = df.withColumn("_f", array_to_vector(doubles(F.col(vector))))
    model = PCA(k=dims, inputCol="_f", outputCol="_r").fit(rows)
    return model.transform(rows).withColumn("reduced", vector_to_array("_r")).drop("_f", "_r")


def normal(seed: int, *parts: Column) -> Column:
    """A standard normal number from hashes of the seed and parts, by the polar form of Box and Muller."""
    one, two = ((uniform(seed, *parts, F.lit(k)) + F.lit(0.5)) / F.lit(2.0**48) for k in (0, 1))
    return F.sqrt(-2 * F.log(one)) * F.cos(2 * F.pi() * two)


def noise_stability(df: DataFrame, vector: str, key: str, centroids: Centroids, sigma: float, seed: int) -> DataFrame:
    """unchanged: the share of rows that keep their cluster when noise is added to their vector; noise hangs on key and dimension, not on partitions."""
    noisy = df.withColumn("_n", unit(F.transform(doubles(F.col(vector)), lambda x, i: x + normal(seed, F.col(key), i) * sigma)))
    noisy = written(noisy.select(key, vector, "_n"), scratch(df.sparkSession))  # else drawn again for each centroid
    both = assign(noisy, vector, centroids).withColumnRenamed("cluster", "_a").drop("second", "margin", "cos_assigned")
    return assign(both, "_n", centroids).agg(F.avg((F.col("_a") == F.col("cluster")).cast("int")).alias("unchanged"))


def nearest_members(assigned: DataFrame, key: str, n: int) -> DataFrame:
    """cluster, key, cos_assigned of the n rows nearest to each centroid."""
    w = Window.partitionBy("cluster").orderBy(F.desc("cos_assigned"), key)
    return assigned.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select("cluster", key, "cos_assigned")
