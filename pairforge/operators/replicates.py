"""Resampling studies on counts: what metrics on a grid need of a table of any size.

A replicate draws counts of cells, not rows: a bootstrap of N rows is a multinomial draw over the cells, a deal of rows
to groups of fixed sizes and a subsample are multivariate hypergeometric draws. Cells are groups of rows with the same
cluster, decisions, grid cells of the scores and label; their number is bounded by the grid, not by the rows, and is
checked before they reach the driver. Replicates are dealt over tasks, each with a generator of its own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.operators.metrics import GRID, cell
from pairforge.operators.resample import interval

#: Cells that may reach the driver, and the grid of scores that areas of paired systems are taken on.
MOST_CELLS, BINS = 2_000_000, 200
#: Rows of which numpy can draw without replacement.
MOST_ROWS = 10**9


def cells_of(scored: DataFrame, **by: Column | str) -> pd.DataFrame:
    """The cells of a table, and n, their rows; an error if they are too many."""
    cells = scored.groupBy(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in by.items()]).agg(F.count(F.lit(1)).alias("n"))
    found = cells.limit(MOST_CELLS + 1).toPandas()
    if len(found) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of {', '.join(by)}")
    return found.sort_values(list(by), ignore_index=True)


def run(spark, replicates: int, seed: int, f: Callable[[np.random.Generator], list[tuple]], schema: str) -> DataFrame:
    """Rows of f for each replicate, whose number comes first."""
    tasks = min(replicates, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2)
    names = ["boot", *[c.split()[0] for c in schema.split(", ")]]

    def each(batches):
        for ids in batches:
            rows = [(int(b), *r) for b in ids["id"] for r in f(np.random.default_rng([seed, int(b)]))]
            yield pd.DataFrame(rows, columns=names)

    return spark.range(0, replicates, 1, tasks).mapInPandas(each, f"boot long, {schema}")


def on_grid(k: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Histogram (cell -1 to GRID, label) of counts."""
    return np.bincount((k + 1) * 2 + y, n, (GRID + 2) * 2).reshape(GRID + 2, 2)


def curve(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds k / GRID and F1 of score >= threshold."""
    above = hist[::-1].cumsum(0)[::-1][1:]
    predicted, tp, positives = above.sum(1), above[:, 1], hist[:, 1].sum()
    return np.arange(GRID + 1) / GRID, np.divide(2 * tp, predicted + positives, out=np.zeros(GRID + 1), where=predicted + positives > 0)


def best(hist: np.ndarray) -> float:
    """The threshold of the greatest F1, the lowest on ties."""
    taus, f1 = curve(hist)
    return float(taus[f1.argmax()])


def areas(hist: np.ndarray) -> tuple[float, float]:
    """ROC area and average precision of counts (cell, label); scores of one cell are tied. NaN without both labels."""
    pos, neg = hist[:, 1].astype(float), hist[:, 0].astype(float)
    if not pos.sum() or not neg.sum():
        return float("nan"), float("nan")
    roc = (pos * (neg.cumsum() - neg / 2)).sum() / pos.sum() / neg.sum()
    tp, all_ = pos[::-1].cumsum(), (pos + neg)[::-1].cumsum()
    return float(roc), float((pos[::-1] * np.divide(tp, all_, out=np.zeros(len(tp)), where=all_ > 0)).sum() / pos.sum())


def decisions(y: np.ndarray, pred: np.ndarray, cluster: np.ndarray, n: np.ndarray, clusters: int) -> dict[str, float]:
    """The seven metrics of hard decisions; clusters are numbered from 0, one without rows has F1 0."""
    by = np.bincount((cluster * 2 + y) * 2 + pred, n, clusters * 4).reshape(clusters, 2, 2)
    (tn, fp), (fn, tp) = by.sum(0)
    share = lambda a, b: float(a / b) if b else 0.0
    f1 = [share(2 * c[1, 1], 2 * c[1, 1] + c[0, 1] + c[1, 0]) for c in by]
    return {
        "f1": share(2 * tp, 2 * tp + fp + fn), "precision": share(tp, tp + fp), "recall": share(tp, tp + fn),
        "macro_cluster_f1": float(np.mean(f1)), "worst_cluster_f1": float(np.min(f1)), "fpr": share(fp, fp + tn), "fnr": share(fn, fn + tp),
    }


def cluster_bootstrap(scored: DataFrame, tau: float, replicates: int, seed: int = 1) -> DataFrame:
    """By cluster, intervals of F1 at tau and of the optimal threshold. Clusters are few."""
    cells = cells_of(scored, cluster="cluster", k=cell(F.col("score")), y=F.col("y").cast("int"))
    parts = [(c, g.k.to_numpy(), g.y.to_numpy(), g.n.to_numpy()) for c, g in cells.groupby("cluster")]

    def f(rng):
        out = []
        for c, k, y, n in parts:
            hist = on_grid(k, y, rng.multinomial(n.sum(), n / n.sum()))
            out.append((int(c), float(curve(hist)[1][round(tau * GRID)]), best(hist)))
        return out

    made = run(scored.sparkSession, replicates, seed, f, "cluster int, f1 double, tau double")
    return interval(made, ["f1", "tau"], ("cluster",))


def paired_bootstrap(scored: DataFrame, tau_a: float, tau_b: float, replicates: int, seed: int = 2) -> DataFrame:
    """metric, gain, its 2.5 and 97.5 % quantiles and the share of replicates without gain, of score_b at tau_b over score at tau_a on the same draws.

    The seven decision metrics, and the areas on a grid of 1 / BINS.
    """
    at = lambda c: F.least(F.floor(F.col(c) * BINS), F.lit(BINS - 1)).cast("int")
    cells = cells_of(scored, cluster="cluster", pa=(F.col("score") >= tau_a).cast("int"), pb=(F.col("score_b") >= tau_b).cast("int"), ka=at("score"), kb=at("score_b"), y=F.col("y").cast("int"))
    names, number = np.unique(cells.cluster.to_numpy(), return_inverse=True)
    pa, pb, ka, kb, y, n = (cells[c].to_numpy() for c in ("pa", "pb", "ka", "kb", "y", "n"))

    def f(rng):
        w = rng.multinomial(n.sum(), n / n.sum())
        a, b = decisions(y, pa, number, w, len(names)), decisions(y, pb, number, w, len(names))
        for system, k in ((a, ka), (b, kb)):
            system["roc_auc"], system["pr_auc"] = areas(np.bincount(k * 2 + y, w, BINS * 2).reshape(BINS, 2))
        return [(m, b[m] - a[m]) for m in a]

    made = run(scored.sparkSession, replicates, seed, f, "metric string, gain double")
    return made.groupBy("metric").agg(F.avg("gain").alias("gain_mean"), F.percentile("gain", F.lit(0.025)).alias("gain_low"), F.percentile("gain", F.lit(0.975)).alias("gain_high"), F.avg((F.col("gain") <= 0).cast("int")).alias("p_no_gain"))


def averaged_bootstrap(decided: DataFrame, replicates: int, seed: int = 3, key: str = "id") -> DataFrame:
    """Interval of F1 averaged over repetitions (rep, pred) within each resample of ids. A cell is a label with the decisions of all repetitions."""
    each = decided.groupBy(key).agg(F.first("y").cast("int").alias("y"), F.array_sort(F.collect_list(F.struct("rep", F.col("pred").cast("int").alias("pred")))).alias("p"))
    cells = cells_of(each, y="y", preds=F.array_join(F.transform("p", lambda x: x["pred"].cast("string")), ""))
    y, n = cells.y.to_numpy(), cells.n.to_numpy()
    pred = np.array([[int(c) for c in p] for p in cells.preds], dtype=np.int64).reshape(len(cells), -1)

    def f(rng):
        w = rng.multinomial(n.sum(), n / n.sum())
        tp, predicted, positives = (w * y) @ pred, w @ pred, (w * y).sum()
        return [(float(np.mean(np.divide(2 * tp, predicted + positives, out=np.zeros(pred.shape[1]), where=predicted + positives > 0))),)]

    return interval(run(decided.sparkSession, replicates, seed, f, "f1 double"), ["f1"])


def dealt(rng: np.random.Generator, n: np.ndarray, size: int) -> np.ndarray:
    """Counts of size rows drawn without replacement from cells of n rows."""
    return rng.multivariate_hypergeometric(n, size, method="marginals")


def checked(n: np.ndarray) -> np.ndarray:
    if n.sum() >= MOST_ROWS:
        raise ValueError(f"draws without replacement are limited to {MOST_ROWS} rows")
    return n


def partition_null(scored: DataFrame, tau: float, replicates: int, seed: int = 4) -> DataFrame:
    """metric, observed, null_mean, p_value: how far F1 at tau, the optimal threshold and the ROC area (on the grid) range over clusters,
    and over groups of the same sizes that rows are dealt to by chance."""
    cells = cells_of(scored, cluster="cluster", k=cell(F.col("score")), y=F.col("y").cast("int"))
    whole = cells.groupby(["k", "y"], as_index=False).n.sum()
    k, y, n = whole.k.to_numpy(), whole.y.to_numpy(), checked(whole.n.to_numpy())
    sizes = cells.groupby("cluster").n.sum().to_numpy()

    def spread(hists) -> dict[str, float]:
        marks = [(curve(h)[1][round(tau * GRID)], best(h), areas(h)[0]) for h in hists]
        return {m: float(np.nanmax(v) - np.nanmin(v)) if not np.isnan(v).all() else float("nan") for m, v in zip(("f1", "tau", "roc_auc"), np.array(marks).T, strict=True)}

    observed = spread([on_grid(g.k.to_numpy(), g.y.to_numpy(), g.n.to_numpy()) for _, g in cells.groupby("cluster")])

    def f(rng):
        left, hists = n.copy(), []
        for size in sizes:
            drawn = dealt(rng, left, size)
            left = left - drawn
            hists.append(on_grid(k, y, drawn))
        return [(m, observed[m], v) for m, v in spread(hists).items()]

    made = run(scored.sparkSession, replicates, seed, f, "metric string, observed double, spread double")
    return made.groupBy("metric", "observed").agg(F.avg("spread").alias("null_mean"), F.avg((F.col("spread") >= F.col("observed")).cast("int")).alias("p_value"))


def threshold_reliability(scored: DataFrame, sizes: list[int], replicates: int, seed: int = 5) -> DataFrame:
    """cluster (null: all rows), n, and the deviation and 5/95 % quantiles of the optimal threshold of subsamples of n rows, with their regret in F1 on the whole. Sizes over a group's rows are left out."""
    cells = cells_of(scored, cluster="cluster", k=cell(F.col("score")), y=F.col("y").cast("int"))
    groups = [(None, cells.groupby(["k", "y"], as_index=False).n.sum()), *((int(c), g) for c, g in cells.groupby("cluster"))]
    parts = []
    for c, g in groups:
        k, y, n = g.k.to_numpy(), g.y.to_numpy(), checked(g.n.to_numpy())
        parts.append((c, k, y, n, curve(on_grid(k, y, n))[1], [s for s in sizes if s <= n.sum()]))

    def f(rng):
        out = []
        for c, k, y, n, full, fitting in parts:
            for size in fitting:
                tau = best(on_grid(k, y, dealt(rng, n, size)))
                out.append((c, size, tau, float(full.max() - full[round(tau * GRID)])))
        return out

    made = run(scored.sparkSession, replicates, seed, f, "cluster int, size int, tau double, regret double")
    q = lambda c, p: F.percentile(c, F.lit(p))
    return made.groupBy("cluster", "size").agg(F.stddev_pop("tau").alias("tau_std"), q("tau", 0.05).alias("tau_p5"), q("tau", 0.95).alias("tau_p95"), F.avg("regret").alias("regret_mean"), q("regret", 0.95).alias("regret_p95"))
