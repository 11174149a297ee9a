"""Exact quantiles by group without a buffer of a group's values.

Rows are counted by distinct value once. Then the ranks asked for are found by counts of ranges: each range that holds
one is cut into CELLS cells, and the cell that holds the rank is the next range, until its least and greatest value are
the same. A round takes one job for all groups and ranks; two or three rounds are enough but for values that lie very
unevenly, and every round tells the ends of a range apart. The driver holds a number of ranges that hangs on groups and ranks alone.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pairforge.session import scratch, written

CELLS = 1024


def quantiles(df: DataFrame, x: str, shares: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """by, and for each name the quantile of x at its share, with linear interpolation.

    Null and NaN are left out, and groups that have nothing else (without by: nulls); infinite values are an error. Groups are few.
    """
    spark = df.sparkSession
    value = F.col(x).cast("double")
    counts = df.select(*by, value.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x")).groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_n"))
    counts = written(counts, scratch(spark))
    groups = counts.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.sum("_n").alias("_all")).where("_all > 0").collect()
    if bad := [g for g in groups if g["_lo"] == float("-inf") or g["_hi"] == float("inf")]:
        raise ValueError(f"{x} is infinite in {len(bad)} groups")
    at = {(i, name): (g["_all"] - 1) * p for i, g in enumerate(groups) for name, p in shares.items()}
    open_ = {(i, rank): (groups[i]["_lo"], groups[i]["_hi"], 0) for (i, _), p in at.items() for rank in {floor(p), ceil(p)}}
    found: dict[tuple[int, int], float] = {}
    keys = [T.StructField(f"_k{j}", counts.schema[c].dataType) for j, c in enumerate(by)]
    ranges_schema = T.StructType([*keys, T.StructField("_g", T.IntegerType()), T.StructField("_lo", T.DoubleType()), T.StructField("_hi", T.DoubleType()), T.StructField("_before", T.LongType()), T.StructField("_ranks", T.ArrayType(T.LongType()))])
    while True:
        found |= {k: lo for k, (lo, hi, _) in open_.items() if lo == hi}
        open_ = {k: r for k, r in open_.items() if r[0] != r[1]}
        if not open_:
            break
        ranks: dict[tuple[int, float, float, int], list[int]] = {}
        for (i, rank), r in open_.items():
            ranks.setdefault((i, *r), []).append(rank)
        table = spark.createDataFrame([(*[groups[i][c] for c in by], i, lo, hi, before, asked) for (i, lo, hi, before), asked in ranks.items()], ranges_schema)
        inside = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{j}")) for j, c in enumerate(by)], F.col("_x").between(F.col("_lo"), F.col("_hi")))
        # Halves, as the width of a range may be over the greatest number; the ends never share a cell.
        part = F.try_divide(F.col("_x") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2)
        cell = F.when(F.col("_x") == F.col("_hi"), CELLS).otherwise(F.coalesce(F.floor(part * (CELLS - 1)), F.lit(0)))
        cut = counts.join(F.broadcast(table), inside).groupBy("_g", "_lo", "_hi", "_before", "_ranks", cell.alias("_c")).agg(F.sum("_n").alias("_n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
        w = Window.partitionBy("_g", "_lo", "_hi").orderBy("_c")
        cut = cut.withColumn("_to", F.sum("_n").over(w) + F.col("_before")).withColumn("_rank", F.explode("_ranks"))
        hits = cut.where((F.col("_to") - F.col("_n") <= F.col("_rank")) & (F.col("_rank") < F.col("_to"))).collect()
        open_ = {(r["_g"], r["_rank"]): (r["_min"], r["_max"], r["_to"] - r["_n"]) for r in hits}
    between = lambda i, p: found[i, floor(p)] if p == floor(p) else (ceil(p) - p) * found[i, floor(p)] + (p - floor(p)) * found[i, ceil(p)]
    rows = [(*[g[c] for c in by], *[between(i, at[i, name]) for name in shares]) for i, g in enumerate(groups)]
    rows = rows or ([] if by else [(None,) * len(shares)])
    return spark.createDataFrame(rows, T.StructType([*[counts.schema[c] for c in by], *[T.StructField(name, T.DoubleType()) for name in shares]]))


def with_quantiles(table: DataFrame, df: DataFrame, x: str, shares: dict[str, float], by: tuple[str, ...]) -> DataFrame:
    """Adds quantiles to a table of the groups of df; a group without a value has nulls."""
    q = quantiles(df, x, shares, by).withColumnsRenamed({c: f"_{c}" for c in by})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return table.join(F.broadcast(q), same, "left").drop(*[f"_{c}" for c in by])  # few groups
