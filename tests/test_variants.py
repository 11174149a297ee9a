"""Choice among variants against a plain recomputation with the same weights."""

import threading

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pairforge.functions import constraints as C
from pairforge.functions.lexical import FEATURES
from pairforge.operators import metrics as M
from pairforge.operators import models, poisson, thresholds, variants
from pairforge.plans import catalog

RICHER = {"a": ("c",), "b": ("d",)}
PAIRS = [("a", "b"), ("c", "a"), ("d", "b")]


def precision(y, s, w):
    total = (w * y).sum()
    if not total or not (w * (1 - y)).sum():
        return None
    out = seen = hit = 0.0
    for v in sorted(set(s), reverse=True):
        at = s == v
        new = (w * y)[at].sum()
        seen, hit = seen + w[at].sum(), hit + new
        out += hit / seen * new / total if seen else 0.0
    return out


def test_gains_and_choice_equal_a_recomputation(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 150)
    scores = {n: np.round(np.clip(0.5 + power * (y - 0.5) + rng.normal(0, 0.3, 150), 0, 1), 2) for n, power in (("a", 0.35), ("b", 0.2), ("c", 0.9), ("d", 0.1))}
    rows = [(i, int(y[i]), *(float(scores[n][i]) for n in scores)) for i in range(150)]
    d = spark.createDataFrame([*rows, (900, None, 0.1, 0.1, 0.1, 0.1), (901, 1, None, 0.9, 0.9, 0.9)], "id long, y int, a double, b double, c double, d double")
    taus = variants.tuned(d.dropna(), list(scores))
    found = {(r.variant, r.over): r for r in variants.gains(d, taus, PAIRS, 60, seed=4).collect()}
    keys = {r.id: r.k for r in d.selectExpr("id", "xxhash64(id) as k").collect()}
    tried = poisson.weights(np.array([keys[i] for i in range(150)]), np.arange(61), 4).astype(float)
    w = {p: [precision(y, scores[p[0]], tried[:, k]) - precision(y, scores[p[1]], tried[:, k]) for k in range(61)] for p in PAIRS}
    for p in PAIRS:
        r = found[p]
        assert np.allclose([r.pr_auc_gain, r.pr_auc_mean, r.pr_auc_low, r.pr_auc_high], [w[p][0], np.mean(w[p][1:]), *np.percentile(w[p][1:], [2.5, 97.5])])
    table = spark.createDataFrame([tuple(r) for r in found.values()], "variant string, over string, pr_auc_gain double, pr_auc_mean double, pr_auc_low double, pr_auc_high double, f1_gain double, f1_mean double, f1_low double, f1_high double")
    want = thresholds.choose_stepwise("a", "b", RICHER, {p: (np.mean(v[1:]), np.percentile(v[1:], 2.5)) for p, v in w.items()})
    assert variants.chosen(table, "a", "b", RICHER) == want == "c"


def test_a_loaded_bundle_scores_as_the_fitted_one(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    rows = [(i, int(a + b > 0), float(a), float(b), "kept") for i, (a, b) in enumerate(x)]
    d = spark.createDataFrame(rows, "id long, y int, u double, v double, features string")
    for kind in ("lr", "trees"):
        b = variants.Bundle(variants.fit(d.drop("features"), kind, ["u", "v"]), kind, ["u", "v"], 0.4)
        b.save(str(tmp_path / kind))
        again = variants.Bundle.load(spark, str(tmp_path / kind))
        got, kept = again.score(d).orderBy("id").collect(), b.score(d).orderBy("id").collect()
        assert got == kept and (again.name, again.threshold) == (kind, 0.4) and all(r.features == "kept" and r.pred == (r.score >= 0.4) for r in got)
        assert sum(r.pred == bool(r.y) for r in got) > 70


def test_variants_are_fitted_side_by_side_and_measured_in_one_plan(spark, monkeypatch):
    """One after the other, each with a plan of its own, twenty variants took the time of all their jobs."""
    rng = np.random.default_rng(2)
    names = list(dict.fromkeys([*FEATURES, *(c for g in C.GROUPS.values() for c in g)]))
    rows = [(i, i % 3, int(rng.integers(0, 2)), i % 4, *map(float, rng.random(len(names) + 1)), *(float(i % 4 == k) for k in range(4))) for i in range(120)]
    schema = "id long, fold int, y int, cluster int, base_logit double, " + ", ".join(f"{c} double" for c in [*names, *(f"cluster_{k}" for k in range(4))])
    f = spark.createDataFrame(rows, schema).repartition(9)
    running, most, lock, parts = [0], [0], threading.Lock(), []

    class Chance:
        def __init__(self, kind):
            self.kind = kind

        def transform(self, d):
            p = F.round(F.pmod(F.xxhash64("id", F.lit(self.kind)), F.lit(20)) / 20, 2)
            return d.withColumn("probability", array_to_vector(F.array(1 - p, p)))

    def fitted(train, kind):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        parts.append(models.gathered(train, train.count()).rdd.getNumPartitions())
        with lock:
            running[0] -= 1
        return Chance(kind)

    monkeypatch.setattr(models, "fitted", fitted)
    got = {r.variant: r for r in catalog.variant_areas(f).collect()}
    made = models.variants(["base_logit"], C.GROUPS, FEATURES, ["cluster_0"])
    assert got.keys() == made.keys() and most[0] > 1 and set(parts) == {1}
    for kind in ("lr", "trees"):
        r = models.score(Chance(kind), f.where("fold = 0")).select("y", "score", "cluster").cache()
        best, area = M.best_threshold(r).head(), M.auc(r).head()
        by = [x.f1 for x in M.confusion(r, best.threshold, ("cluster",)).collect()]
        for g in (g for g in got.values() if g.kind == kind):
            assert made[g.variant][0] == kind
            assert np.allclose([g.roc_auc, g.pr_auc, g.threshold, g.f1, g.macro_f1, g.worst_f1], [*area, best.threshold, best.f1, np.mean(by), min(by)])
