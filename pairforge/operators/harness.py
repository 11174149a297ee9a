"""Probes, recorded results and timings of a scorer: a function from pairs (id, question1, question2) to a table with score."""

from __future__ import annotations

import time
from collections.abc import Callable
from statistics import median, quantiles

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Scorer = Callable[[DataFrame], DataFrame]


def probe(spark: SparkSession, pairs: list[tuple[str, str]], systems: dict[str, tuple[Scorer, float]]) -> DataFrame:
    """id, question1, question2, system, score, decision of hand-written pairs under each system and its threshold."""
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id long, question1 string, question2 string")
    out = None
    for name, (score, tau) in systems.items():
        r = rows.join(score(rows).select("id", "score"), "id").withColumns({"system": F.lit(name), "decision": F.col("score") >= tau})
        out = r if out is None else out.unionByName(r)
    return out.select("id", "question1", "question2", "system", "score", "decision")


def record(df: DataFrame, keys: list[str]) -> list[dict]:
    """A small table as plain data in order of its keys, to be kept and compared later."""
    return [r.asDict(recursive=True) for r in df.orderBy(*keys).collect()]


def differences(now: list[dict], kept: list[dict], keys: list[str], tolerance: float = 1e-5) -> list[str]:
    """What differs between two records: rows on one side only, and values; numbers by more than the tolerance."""
    by = lambda rows: {tuple(r[k] for k in keys): r for r in rows}
    a, b = by(now), by(kept)
    out = [f"{k}: missing" for k in b.keys() - a.keys()] + [f"{k}: new" for k in a.keys() - b.keys()]
    for k in sorted(a.keys() & b.keys()):
        for c in b[k]:
            x, y = a[k].get(c), b[k][c]
            same = abs(x - y) <= tolerance if isinstance(x, float) and isinstance(y, float) else x == y
            if not same:
                out.append(f"{k}: {c} {x} for {y}")
    return out


def latency(pairs: DataFrame, score: Scorer, warm: int = 2, single: int = 10, batch: int = 2000) -> dict[str, float]:
    """Milliseconds of single pairs (median, 95 %), and for each pair of a batch, after some that are not counted."""
    spark, rows = pairs.sparkSession, pairs.limit(max(warm + single, batch)).collect()
    schema = pairs.schema

    def took(some: list) -> float:
        began = time.perf_counter()
        score(spark.createDataFrame(some, schema)).write.format("noop").mode("overwrite").save()
        return 1000 * (time.perf_counter() - began)

    for r in rows[:warm]:
        took([r])
    each = [took([r]) for r in rows[warm : warm + single]]
    return {"median_ms": median(each), "p95_ms": quantiles(each, n=20)[-1] if len(each) > 1 else each[0], "batch_ms_per_pair": took(rows[:batch]) / len(rows[:batch])}
