"""Poisson bootstraps against plain sums over the same weights."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.operators import poisson

SCHEMA = "id long, cluster int, y int, score double, score_b double"


def table(spark, n=400, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        s = 0.5 if rng.random() < 0.4 else round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.2))), 2)  # one score of a third of all rows
        rows.append((i, rng.randrange(3), y, s, round(rng.random() * 0.6 + 0.3 * y, 3)))
    rows += [rows[3], rows[3], (900, 7, 1, 0.3, 0.2), (901, 7, 1, 0.4, 0.2), (902, 0, None, 0.3, 0.1), (903, 1, 1, None, 0.1), (904, None, 1, 0.5, 0.1), (905, 2, 0, float("nan"), 0.1)]
    return spark.createDataFrame(rows, SCHEMA)


def brute_areas(y, s, w):
    pos, neg = w[y == 1].sum(), w[y == 0].sum()
    if not pos or not neg:
        return None, None
    below = sum(w[i] * w[j] * (s[i] > s[j] or (s[i] == s[j]) / 2) for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0))
    ap = sum(w[(y == 1) & (s == v)].sum() * w[(y == 1) & (s >= v)].sum() / max(1, w[s >= v].sum()) for v in set(s.tolist()))
    return below / pos / neg, ap / pos


def brute_f1(y, s, w, tau):
    predicted = s >= tau
    both = w[predicted].sum() + w[y == 1].sum()
    return 2 * w[predicted & (y == 1)].sum() / both if both else 0.0


def keyed(df, replicates, seed):
    rows = df.withColumn("h", F.xxhash64("id")).collect()
    return rows, poisson.weights(np.array([r.h for r in rows]), np.arange(replicates + 1), seed)


def test_weights_are_poisson():
    w = poisson.weights(np.arange(20_000), np.arange(1, 21), 3)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs((w == 0).mean() - np.exp(-1)) < 0.003 and abs((w == 3).mean() - np.exp(-1) / 6) < 0.003
    assert abs(np.corrcoef(w.T) - np.eye(20)).max() < 0.04
    assert (poisson.weights(np.arange(5), np.arange(3), 1)[:, 0] == 1).all()


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_areas_equal_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(poisson, "TOGETHER", 4)  # several rounds of replicates
    df = table(spark)
    rows, w = keyed(df, 9, 4)
    got = {(r.cluster, r.boot): r for r in poisson.replicate_areas(df.repartition(parts), 0.45, 9, 4, "cluster", parts=parts).collect()}
    assert len(got) == 4 * 10
    for (cluster, boot), r in got.items():
        at = [i for i, x in enumerate(rows) if x.cluster == cluster and x.y is not None and x.score is not None and x.score == x.score]
        y, s = np.array([rows[i].y for i in at]), np.array([rows[i].score for i in at])
        roc, ap = brute_areas(y, s, w[at, boot])
        assert r.f1 == pytest.approx(brute_f1(y, s, w[at, boot], 0.45))
        f1 = [brute_f1(y, s, w[at, boot], k / 100) for k in range(101)]
        assert r.tau == pytest.approx(int(np.argmax(np.round(f1, 12))) / 100)
        if roc is None:
            assert r.roc_auc is None and r.pr_auc is None
        else:
            assert r.roc_auc == pytest.approx(roc) and r.pr_auc == pytest.approx(ap)


def test_ties_over_many_blocks_and_parts(spark, monkeypatch):
    df = spark.range(0, 3000).select("id", F.lit(1).alias("cluster"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.lit(0.5).alias("score"))
    for r in poisson.replicate_areas(df, 0.5, 2, parts=7).collect():
        assert r.roc_auc == pytest.approx(0.5) and abs(r.pr_auc - 1 / 3) < 0.05
    assert poisson.replicate_areas(df.where("id < 0"), 0.5, 2).count() == 0
    assert poisson.replicate_areas(df.where("id < 0"), 0.5, 2, by="cluster").count() == 0


def test_paired_gains_equal_brute_force(spark):
    df = table(spark).where("score IS NOT NULL AND NOT isnan(score) AND y IS NOT NULL AND cluster IS NOT NULL")
    rows, w = keyed(df, 6, 2)
    y, a, b = (np.array([r[c] for r in rows]) for c in ("y", "score", "score_b"))
    gains = [brute_f1(y, b, w[:, i], 0.6) - brute_f1(y, a, w[:, i], 0.5) for i in range(7)]
    areas = [brute_areas(y, b, w[:, i])[1] - brute_areas(y, a, w[:, i])[1] for i in range(7)]
    for parts in (1, 6):
        got = {r.metric: r for r in poisson.paired_intervals(df.repartition(parts), 0.5, 0.6, 6, parts=parts).collect()}
        assert set(got) == {"f1", "precision", "recall", "macro_cluster_f1", "worst_cluster_f1", "fpr", "fnr", "roc_auc", "pr_auc"}
        for name, want in (("f1", gains), ("pr_auc", areas)):
            r = got[name]
            assert r.gain == pytest.approx(want[0]) and r.gain_mean == pytest.approx(np.mean(want[1:]))
            assert r.gain_low == pytest.approx(np.quantile(want[1:], 0.025)) and r.gain_high == pytest.approx(np.quantile(want[1:], 0.975))
            assert r.p_no_gain == pytest.approx(np.mean(np.array(want[1:]) <= 0))


def test_intervals_do_not_depend_on_layout(spark):
    df = table(spark)
    one, many = (sorted(map(str, poisson.cluster_intervals(df.repartition(p), 0.5, 5, parts=p).select("cluster", *[F.round(f"{c}{e}", 9) for c in ("f1", "tau", "roc_auc", "pr_auc") for e in ("", "_low", "_high", "_std")]).collect())) for p in (1, 9))
    assert one == many
