"""Units of pair features, metrics, splits and thresholds on inline tables."""

import math

import pytest
from pyspark.sql import functions as F

from pairforge.functions import constraints as C
from pairforge.functions import text as X
from pairforge.functions import vectors as V
from pairforge.functions.lexical import FEATURES, lexical_features
from pairforge.operators import audit, clusters, explain, graph, harness, models, replicates, resample, splits, tfidf, thresholds
from pairforge.operators import metrics as M
from pairforge.sources import tables

Y, S = [1, 1, 0, 0, 1, 0], [0.9, 0.6, 0.55, 0.2, 0.4, 0.1]


def one(df):
    return df.head().asDict()


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "t string")


@pytest.fixture(scope="module")
def ys(spark):
    return spark.createDataFrame(list(zip(range(6), Y, S, [0, 0, 0, 1, 1, 1], strict=True)), "id int, y int, score double, cluster int")


@pytest.mark.parametrize(("raw", "want"), [
    ("I can't", "i can not"), ("I can’t", "i can not"), ("cannot go", "can not go"), ("won't", "will not"), ("shan't", "shall not"), ("isn't it", "is not it"),
    (None, ""), ("a\n  b ", "a b"), ("[math]x^2[/math] y", "x^2 y"), ("ﬁne", "fine"),
])
def test_normalize(spark, raw, want):
    assert texts(spark, raw).select(X.normalize(F.col("t"))).head()[0] == want


@pytest.mark.parametrize(("raw", "want"), [("3.5 and 1,000!", ["3.5", "and", "1,000"]), ("what's café?", ["what's", "café"]), ("", [])])
def test_tokens(spark, raw, want):
    assert texts(spark, raw).select(X.tokenize(F.col("t"))).head()[0] == want


def test_punctuation_is_kept_on_request(spark):
    assert texts(spark, "a, b?").select(X.tokenize(F.col("t"), True)).head()[0] == ["a", ",", "b", "?"]


def test_keys(spark):
    row = texts(spark, " How  ARE\tyou? ").select(X.identity_key(F.col("t")), X.loose_key(F.col("t")), X.cleaned(F.col("t"))).head()
    assert tuple(row) == ("how are you?", "how are you", "How ARE you?")




@pytest.mark.parametrize(("raw", "want"), [("the U.S. and u.s.a. or 3.5", "the US and usa or 3.5"), ("B.C.D. x", "BCD x"), ("end. A b", "end. A b")])
def test_undotted(spark, raw, want):
    assert texts(spark, raw).select(X.undotted(F.col("t"))).head()[0] == want


def pair(spark, a, b):
    return spark.createDataFrame([(1, a, b)], "id long, question1 string, question2 string")


def test_lexical(spark):
    same = one(lexical_features(pair(spark, "How are you?", "how are  you")))
    assert same["word_jaccard"] == 1 and same["char3_jaccard"] < 1 and same["length_ratio"] == 1
    swap = one(lexical_features(pair(spark, "visit paris today", "visit london today")))
    assert swap["word_jaccard"] == 0.5 and swap["common_ratio_min"] == pytest.approx(2 / 3)
    assert all(math.isfinite(one(lexical_features(pair(spark, "", None)))[f]) for f in FEATURES)


def annotated(spark, t):
    return texts(spark, t).transform(lambda d: C.annotate(d, "t")).head().ann


def test_annotations(spark):
    assert set(annotated(spark, "1,000 of 2.5k and two thousand, not one").numbers) == {"1000", "2.5", "2"} | {"1000"}
    assert set(annotated(spark, "in 1999 or the 1980s, on Monday in may").dates) == {"1999", "1980", "monday", "may"}
    a = annotated(spark, "Why is NASA in Paris not a non-profit?")
    assert set(a.entities) == {"nasa", "paris"} and a.wh == "why" and a.negation == 2
    assert annotated(spark, "WHY IS NASA HERE").entities == []


@pytest.mark.parametrize(("a", "b", "name"), [
    ("is 5 good", "is 6 good", "num_mismatch"), ("in 1999 ok", "in 2000 ok", "dateh_mismatch"), ("do I like Paris", "do I like London", "enth_mismatch"),
    ("is it good", "is it not good", "neg_xor"), ("why go home", "how go home", "wh_mismatch"), ("buy red cars", "buy red cars quickly", "content_subset"),
])
def test_signals_fire_and_are_symmetric(spark, a, b, name):
    names = [c for g in C.GROUPS.values() for c in g]
    x, y = (one(C.constraint_features(pair(spark, *p)).select(*names)) for p in ((a, b), (b, a)))
    assert x[name] == 1 and x == y
    assert one(C.constraint_features(pair(spark, a, a)).select(name))[name] == 0


def test_metrics(ys):
    m = one(M.confusion(ys, 0.5))
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (2, 1, 2, 1)
    a = one(M.auc(ys))
    assert a["roc_auc"] == pytest.approx(8 / 9) and a["pr_auc"] == pytest.approx(0.916667, abs=1e-6)
    best = one(M.best_threshold(ys))
    assert best["f1"] == pytest.approx(6 / 7) and best["threshold"] == pytest.approx(0.21)
    curve = {r.k: r.f1 for r in M.sweep(ys).collect()}
    assert curve[50] == pytest.approx(m["f1"]) and len(curve) == 101


def test_areas_need_both_classes(spark):
    df = spark.createDataFrame([(1, 0.5, 0), (1, 0.7, 0), (0, 0.1, 1), (1, 0.1, 1)], "y int, score double, g int")
    got = {r.g: (r.roc_auc, r.pr_auc) for r in M.auc(df, ("g",)).collect()}
    assert got == {0: (None, None), 1: (0.5, 0.5)}


@pytest.mark.parametrize(("y", "p", "ece"), [([0, 1, 0, 1], [0.05, 0.95, 0.05, 0.95], 0.05), ([0, 0, 1, 1], [0.0, 0.0, 0.99, 0.99], 0.005)])
def test_calibration(spark, y, p, ece):
    assert one(M.calibration(spark.createDataFrame(list(zip(y, p, strict=True)), "y int, score double")))["ece"] == pytest.approx(ece)


def test_grid_cells(spark):
    xs = [k / 100 for k in range(101)] + [0.29, 0.57, -0.1, 1.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(M.cell(F.col("x"))).collect()]
    assert got == [*range(101), 29, 57, -1, 100]


def test_decisions_by_cluster(ys):
    out = one(M.decisions_by_cluster(ys.withColumn("pred", F.col("y")), 3))
    assert out["macro_f1"] == pytest.approx(2 / 3) and out["worst_group"] == 2 and out["f1"] == 1


def test_policies(spark):
    rows = [(i, int(i % 2), 0.9 if i % 2 else 0.2, 0) for i in range(40)] + [(100 + i, int(i % 2), 0.95 if i % 2 else 0.6, 1) for i in range(40)] + [(200 + i, 0, 0.1, 2) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, y int, score double, cluster int")
    policy = thresholds.fit(df, 10, 5)
    got = {r.cluster: (r.threshold, r.own) for r in policy.collect()}
    glob = M.best_threshold(df).head().threshold
    assert got[2] == (glob, False) and got[0][1] and got[1][0] > got[0][0]
    unseen = spark.createDataFrame([(1, 1, glob, 9)], "id int, y int, score double, cluster int")
    assert thresholds.apply(unseen, policy, M.best_threshold(df)).head().pred == 1
    assert thresholds.to_record(policy, M.best_threshold(df))["fallback_clusters"] == [2]


def test_cross_fit_does_not_leak(spark):
    rows = [(i, int((i * 7) % 3 == 0), ((i * 37) % 100) / 100, i % 2, i % 4) for i in range(200)]
    cols = "id int, y int, score double, cluster int, fold int"
    a = thresholds.cross_fit(spark.createDataFrame(rows, cols), 4, 10, 3)[0].where("fold = 1")
    flipped = [(i, 1 - y if f == 1 else y, s, c, f) for i, y, s, c, f in rows]
    b = thresholds.cross_fit(spark.createDataFrame(flipped, cols), 4, 10, 3)[0].where("fold = 1")
    assert {r.id: r.pred for r in a.collect()} == {r.id: r.pred for r in b.collect()}


def test_rules():
    assert thresholds.adopt(0.01, 0.0) and not thresholds.adopt(0.0, 1.0)
    assert thresholds.choose("b", {"x": (0.006, 0.001), "y": (0.01, -0.1)}) == "x"
    assert thresholds.choose("b", {"x": (0.004, 0.001)}) == "b"


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(i, "hub", f"spoke {i}", i % 2) for i in range(30)] + [(100 + i, f"left {i}", f"right {i}", i % 2) for i in range(200)]
    e = graph.edges(spark.createDataFrame(rows, "id long, question1 string, question2 string, is_duplicate int"))
    return graph.with_components(e).cache()


def test_components(toy):
    assert toy.select("component").distinct().count() == 201 and toy.where("id = 3").head()["size"] == 30


@pytest.mark.parametrize("strategy", ["component", "node", "hybrid"])
def test_group_splits_share_no_text(toy, strategy):
    s = splits.hybrid_split(toy, 7, 10) if strategy == "hybrid" else splits.make_split(toy, strategy, 7)
    assert splits.leaked_texts(s).head().leaked == 0 and s.count() == 230
    again = splits.hybrid_split(toy, 7, 10) if strategy == "hybrid" else splits.make_split(toy, strategy, 7)
    assert {r.split: r.checksum for r in splits.id_checksum(s).collect()} == {r.split: r.checksum for r in splits.id_checksum(again).collect()}
    if strategy == "hybrid":
        assert s.where("split = 'dropped_cross_split' and size <= 10").count() == 0


def test_split_strategies(toy):
    assert splits.leaked_texts(splits.random_split(toy, 1)).head().leaked > 0
    p = splits.node_probabilities()
    assert p["train"] ** 2 / p["val"] ** 2 == pytest.approx(8)
    with pytest.raises(ValueError):
        splits.make_split(toy, "none")


def test_group_folds_equal_one_group_after_another(spark):
    from hashlib import md5

    for sizes in ([1 + i % 5 for i in range(300)], [900, 40, 40, *[3] * 50, *[1] * 200], [7], [10**6, 1, 1], [5] * 23):
        groups = [(str(i), n) for i, n in enumerate(sizes)]
        got = {r.component: r.fold for r in splits.group_folds(spark.createDataFrame(groups, "component string, pairs long"), 5, 1).collect()}
        load = [0] * 5
        for g, n in sorted(groups, key=lambda x: (-x[1], md5(f"1|{x[0]}".encode()).hexdigest())):
            f = load.index(min(load))
            assert got[g] == f
            load[f] += n
    assert splits.group_folds(spark.createDataFrame([], "component string, pairs long"), 5, 1).count() == 0
    segments = splits.fold_segments([(10**9, 1), (1, 10**10)], 5)  # few, however many groups there are
    assert sum(map(len, segments.values())) < 20 and segments[1][-1][1] == 10**10


def test_audit(spark):
    df = spark.createDataFrame([(1, "  Hi there? ", "x", 0), (2, "", "y", 0), (3, "n/a", "z", 1), (4, "NA", "w", 1), (5, "w", "NA", 0), (6, None, "q", 0)], "id long, question1 string, question2 string, is_duplicate int")
    assert [r.id for r in audit.clean(df).orderBy("id").collect()] == [1, 4, 5]
    d = one(audit.duplicate_rows(df))
    assert d["same_pair"] == 1 and d["conflicting"] == 1
    assert {r.issue: r.texts for r in audit.text_issues(df).collect()}["null_like"] == 3
    assert {r.column: r.nulls for r in audit.missing(df).collect()}["question1"] == 1


def test_centroids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7])], "id int, v array<double>")
    cents = [(0, [1.0, 0.0]), (1, [0.0, 1.0])]
    got = {r.id: (r.cluster, r.second, r.margin) for r in clusters.assign(df, "v", cents).collect()}
    assert got[1][:2] == (0, 1) and got[2][:2] == (1, 0) and got[3][0] == 0 and got[3][2] == 0
    p = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "va array<double>, vb array<double>")
    assert clusters.assign_pairs(p, cents, "same_only").head().cluster == -1
    with pytest.raises(ValueError):
        clusters.assign_pairs(p, cents, "other")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    x, y, z = df.select(V.pair_vector(F.col("a"), F.col("b")), V.pair_vector(F.col("b"), F.col("a")), V.norm(V.midpoint(F.col("a"), F.col("b")))).head()
    assert x == y == [1, 1, 12, 12, 24] and z == pytest.approx(1)


def test_tfidf_cosine(spark):
    d = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["c", "d"]), (4, ["c", "x"])], "key int, t array<string>")
    terms = F.col("t")
    w = tfidf.weights(d, "key", terms, tfidf.idf(d, "key", terms, 1))
    p = spark.createDataFrame([(1, 1, 2), (2, 1, 3)], "id int, key_a int, key_b int")
    assert {r.id: round(r.cosine, 9) for r in tfidf.pair_cosine(p, w).collect()} == {1: 1.0, 2: 0.0}


def test_bootstrap_covers(spark):
    rows = [(i, int(i % 3 == 0), 0.3 + 0.4 * (i % 3 == 0) + 0.2 * ((i * 31) % 10) / 10, i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, y int, score double, cluster int")
    for r in resample.cluster_bootstrap(df, 0.5, 20).collect():
        f1 = M.confusion(df.where(F.col("cluster") == r.cluster), 0.5).head().f1
        assert r.f1_low <= f1 <= r.f1_high
    assert 0.0 <= resample.partition_null(df, 0.5, 10).head().p_value <= 1.0


def test_registered_with_the_reference_replicates(spark, monkeypatch):
    from pairforge.plans import catalog

    asked = {}
    frame = spark.createDataFrame([(i, 1, 0.5, 0.5, 0) for i in range(40)], "id int, y int, score double, score_b double, cluster int")
    for name in ("cluster_bootstrap", "paired_bootstrap", "averaged_bootstrap", "partition_null", "threshold_reliability"):
        monkeypatch.setattr(catalog.replicates, name, lambda df, *a, n=name: asked.update({n: a}) or df)
    monkeypatch.setattr(catalog.clusters, "silhouette", lambda df, *a: asked.update(silhouette=a) or df)
    monkeypatch.setattr(catalog, "scored", lambda *a: frame)
    monkeypatch.setattr(catalog, "labelled", lambda *a: frame)
    for name in ("cluster_bootstrap_1000", "paired_bootstrap_1000", "averaged_bootstrap_1000", "random_partition_null_500", "threshold_reliability_300", "silhouette_sample_20000"):
        catalog.QUERIES[name](spark, "")
    assert asked == {
        "cluster_bootstrap": (0.5, 1000), "paired_bootstrap": (0.5, 0.51, 1000), "averaged_bootstrap": (1000,), "partition_null": (0.5, 500),
        "threshold_reliability": ([100, 250, 500, 1000, 2000, 4000], 300), "silhouette": ("embedding", "cluster", "vec_id", 20000, 1),
    }
    made = models.variants(["base_logit"], C.GROUPS, ["word_jaccard"], ["c0", "c1"])
    assert len(made) == 7 + 2 * len(C.GROUPS) and made["recal"] == ("lr", ["base_logit"]) and "neg_xor" not in made["minus_negation"][1] and made["trees_minus_number"][0] == "trees"
    assert set(made["constraints"][1]) - set(made["no_specificity"][1]) == set(C.GROUPS["specificity"])


def test_counts_draw_as_rows_do(spark):
    """Replicates of counts have the distribution of replicates of rows; metrics of counts are those of the rows they stand for."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(i, int(y), float(np.clip(0.3 + 0.3 * y + s, 0, 1)), float(np.clip(0.25 + 0.4 * y + t, 0, 1)), i % 3) for i, (y, s, t) in enumerate(zip(rng.integers(0, 2, 900), rng.normal(0, 0.2, 900), rng.normal(0, 0.2, 900), strict=True))]
    df = spark.createDataFrame(rows, "id int, y int, score double, score_b double, cluster int").cache()
    a, b = (sorted(m.cluster_bootstrap(df, 0.5, 300).collect(), key=lambda r: r.cluster) for m in (resample, replicates))
    for x, y in zip(a, b, strict=True):
        assert x.cluster == y.cluster and all(abs(x[c] - y[c]) < 0.04 for c in ("f1_low", "f1_high", "f1_std"))
    x, y = resample.paired_bootstrap(df, 0.5, 0.51, 300).head(), {r.metric: r for r in replicates.paired_bootstrap(df, 0.5, 0.51, 300).collect()}
    assert abs(x.gain - y["f1"].gain_mean) < 0.01 and abs(x.gain_low - y["f1"].gain_low) < 0.03 and set(y) == {"f1", "precision", "recall", "macro_cluster_f1", "worst_cluster_f1", "fpr", "fnr", "roc_auc", "pr_auc"}
    whole = M.auc(df).head().pr_auc, M.auc(df.withColumn("score", F.col("score_b"))).head().pr_auc
    assert abs(y["pr_auc"].gain_mean - (whole[1] - whole[0])) < 0.02
    x, y = resample.partition_null(df, 0.5, 200).head(), {r.metric: r for r in replicates.partition_null(df, 0.5, 200).collect()}
    assert abs(x.observed - y["f1"].observed) < 1e-9 and abs(x.null_mean - y["f1"].null_mean) < 0.01 and abs(x.p_value - y["f1"].p_value) < 0.15 and set(y) == {"f1", "tau", "roc_auc"}
    x, y = ({(r.size): r for r in got.collect()} for got in (resample.threshold_reliability(df, [200, 600], 200), replicates.threshold_reliability(df, [200, 600, 5000], 200).where("cluster is null")))
    assert set(x) == set(y) and all(abs(x[n].tau_std - y[n].tau_std) < 0.03 and abs(x[n].regret_mean - y[n].regret_mean) < 0.01 for n in x)
    k, y_, n = np.array([-1, 3, 50, 50, 100]), np.array([1, 0, 1, 0, 1]), np.array([2, 3, 4, 1, 2])
    hist = replicates.on_grid(k, y_, n)
    tall = [(int(a), int(b)) for a, b, c in zip(k, y_, n, strict=True) for _ in range(c)]
    taus, f1 = replicates.curve(hist)
    for t in (0, 3, 4, 50, 51, 100):
        tp, said = sum(b for a, b in tall if a >= t), sum(a >= t for a, _ in tall)
        assert f1[t] == pytest.approx(2 * tp / (said + 8))
    roc, pr = replicates.areas(hist)
    pairs = [(p, q) for p, l in tall if l for q, m in tall if not m]
    assert roc == pytest.approx(sum((p > q) + (p == q) / 2 for p, q in pairs) / len(pairs)) and replicates.best(hist) == taus[f1.argmax()]
    want = sum(sum(b for a, b in tall if a == t) * sum(b for a, b in tall if a >= t) / sum(a >= t for a, _ in tall) for t in {a for a, _ in tall}) / 8
    assert pr == pytest.approx(want)
    got = replicates.averaged_bootstrap(df.select("id", "y", F.explode(F.array(*[F.struct(F.lit(i).alias("rep"), (F.col("score") >= t).cast("int").alias("pred")) for i, t in enumerate((0.4, 0.6))])).alias("r")).select("id", "y", "r.*"), 200).head()
    assert got.f1_low < np.mean([M.confusion(df, t).head().f1 for t in (0.4, 0.6)]) < got.f1_high
    monkeypatch = pytest.MonkeyPatch()
    monkeypatch.setattr(replicates, "MOST_CELLS", 3)
    with pytest.raises(ValueError):
        replicates.cluster_bootstrap(df, 0.5, 2)
    monkeypatch.undo()


def test_repetitions_equal_one_cross_fit_after_another(spark):
    rows = [(i, int(i * 7 % 5 < 2), (i * 37 % 101) / 101, i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, y int, score double, cluster int")
    got = {r.rep: r.f1 for r in thresholds.repetitions(df, 3, 4, 40, 5).collect()}
    for rep in range(3):
        folded = df.withColumn("fold", F.pmod(resample.uniform(rep, F.col("id")), F.lit(4)).cast("int"))
        assert got[rep] == pytest.approx(M.decision_metrics(thresholds.cross_fit(folded, 4, 40, 5)[0]).head().f1)


def test_choices(spark):
    gains = {("all", "less"): (0.01, 0.001), ("all+", "all"): (0.004, 0.001), ("all trees", "all"): (0.02, 0.01), ("less+", "less"): (0.01, -0.001), ("less trees", "less"): (0.01, -0.1)}
    richer = {"all": ("all+", "all trees"), "less": ("less+", "less trees")}
    assert thresholds.choose_stepwise("all", "less", richer, gains) == "all trees"
    assert thresholds.choose_stepwise("all", "less", richer, gains | {("all", "less"): (0.01, 0.0)}) == "less"


def test_half_precision(spark):
    import numpy as np

    xs = [0.0, -0.0, 1.0, -1.0, 1 / 3, 2**-14, 2**-24, 2**-25, 3 * 2.0**-25, 1e-9, 65504.0, 65519.0, 65520.0, 1e30, 2049.0, 2051.0, 0.1, -123.456, 2**-14 - 2**-25, 1 - 2**-12, *np.random.default_rng(1).normal(size=400).tolist()]
    got = [r.h for r in spark.createDataFrame(list(enumerate(xs)), "i int, x double").select("i", V.half(F.col("x")).alias("h")).orderBy("i").collect()]
    with np.errstate(over="ignore"):
        assert got == [float(np.float16(x)) for x in xs]


def test_error_reports(spark):
    df = spark.createDataFrame([(1, 0, 0.9), (2, 0, 0.6), (3, 0, 0.2), (4, 1, 0.1), (5, 1, 0.4), (6, 1, 0.8), (7, 0, 0.6)], "id int, y int, score double")
    assert [(r.kind, r["rank"], r.id) for r in M.confident_errors(df, 0.5, 2).collect()] == [("FP", 1, 1), ("FP", 2, 2), ("FN", 1, 4), ("FN", 2, 5)]
    t = spark.createDataFrame([(0, 0, 1, "FP", 0.7, True), (0, 0, 0, "TN", 0.9, False), (0, 1, 0, "FN", 0.1, True), (1, 1, 1, "TP", 0.2, False)], "cluster int, y int, pred int, outcome string, jaccard double, tag boolean")
    got = {r.cluster: r for r in M.cluster_tag_rates(t, ["tag"]).collect()}
    assert tuple(got[0])[1:] == (3, 1.0, 1.0, 1.0, 0.5, 1.0) and got[1].fp_with_tag is None and got[1].fnr_low_overlap == 0.0
    assert {r.feature: r.rate for r in M.rate_profile(spark.createDataFrame([(1.0, 0.0, 9.0), (0.0, 0.0, 9.0)], "neg_xor double, num_mismatch double, num_any double")).collect()} == {"neg_xor": 0.5, "num_mismatch": 0.0}
    assert audit.repeated_id_pairs(spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "qid1 int, qid2 int")).head() == (3, 1)


def test_split_reports(toy):
    made = splits.node_split(toy, 7)
    rows = {r.split: r for r in splits.profile_report(made).collect()}
    assert sum(r.pairs for r in rows.values()) == made.count() and rows[splits.DROPPED].share_of_retained is None
    for r in rows.values():
        assert r.isolated + r.small + r.medium + r.large == pytest.approx(1) and r.retention == pytest.approx(1 - rows[splits.DROPPED].pairs / made.count())
    both = made.withColumns({"loose_a": F.col("key_a"), "loose_b": F.col("key_b")})
    assert {(r.key, r.split, r.reference): r.shared for r in splits.overlap_report(both).collect()} == {(k, s, r): 0 for k in ("strict", "loose") for s, r in (("val", "train"), ("test", "train"), ("test", "val"))}


def test_full_resampling_equals_brute_force(spark):
    from hashlib import md5

    import numpy as np

    h = lambda *parts: int(md5("|".join(map(str, parts)).encode()).hexdigest()[:12], 16)
    rows = [(i, int(i % 3 == 0), (i * 37 % 101) / 101, (i * 53 % 97) / 97, i % 2) for i in range(24)]
    df = spark.createDataFrame(rows, "id int, y int, score double, score_b double, cluster int")

    def f1(some, at, tau):
        tp, said, true = sum(r[1] and r[at] >= tau for r in some), sum(r[at] >= tau for r in some), sum(r[1] for r in some)
        return 2 * tp / (said + true) if said + true else 0.0

    gains = []
    for b in range(1000):
        some = [rows[h(2, b, 0, i) % 24] for i in range(24)]
        gains.append(f1(some, 3, 0.51) - f1(some, 2, 0.5))
    got = resample.paired_bootstrap(df, 0.5, 0.51, 1000).head()
    assert np.allclose([got.gain, got.gain_low, got.gain_high, got.p_no_gain], [np.mean(gains), *np.percentile(gains, [2.5, 97.5]), np.mean(np.array(gains) <= 0)])
    for r in resample.cluster_bootstrap(df, 0.5, 1000).collect():
        own = [x for x in rows if x[4] == r.cluster]
        each = [f1([own[h(1, b, r.cluster, i) % 12] for i in range(12)], 2, 0.5) for b in range(1000)]
        assert np.allclose([r.f1_low, r.f1_high, r.f1_std], [*np.percentile(each, [2.5, 97.5]), np.std(each)])
    spread = lambda dealt: abs(f1([r for r, c in dealt if c], 2, 0.5) - f1([r for r, c in dealt if not c], 2, 0.5))
    null = [spread(list(zip(sorted(rows, key=lambda r: h(4, b, r[0])), (r[4] for r in rows), strict=True))) for b in range(500)]
    seen = spread([(r, r[4]) for r in rows])
    got = resample.partition_null(df, 0.5, 500).head()
    assert np.allclose([got.observed, got.null_mean, got.p_value], [seen, np.mean(null), np.mean([x >= seen - 1e-12 for x in null])])


def test_explanations(spark):
    p = spark.createDataFrame([(1, "is 5 good", "is 6 good"), (2, "same text", "same text")], "id long, question1 string, question2 string")
    got = {r.id: [s.type for s in r.signals] for r in explain.signals(C.constraint_features(p)).collect()}
    assert "numbers mismatch" in got[1] and got[2] == []
    with pytest.raises(ValueError):
        explain.what_if(C.constraint_features(p), lambda d: d.withColumn("score", F.lit(0.5)), ["specificity"])
    w = explain.what_if(C.constraint_features(p), lambda d: d.withColumn("score", F.col("num_mismatch") / 2), ["number"]).collect()
    assert [(r.id, r.effect) for r in w] == [(1, 0.5)]
    f = explain.extracted(explain.signals(C.constraint_features(p))).join(explain.strong_effects(explain.what_if(C.constraint_features(p), lambda d: d.withColumn("score", F.col("num_mismatch") / 2), ["number"])), "id", "left")
    f = f.withColumns({"score": F.col("num_mismatch") / 2, "base": F.lit(0.2), "cosine": F.lit(0.7), "margin": F.lit(0.01)})
    said = {r.id: r for r in explain.rationale(explain.decide(f, 0.48, 0.1), 0.48, 0.1).collect()}
    assert len(said[1].rationale) == 5 and "0.00, not 0.50" in said[1].rationale[2] and "but close" in said[1].rationale[3] and said[1].decision and said[1].items_a.numbers == ["5"]
    assert len(said[2].rationale) == 4 and said[2].rationale[1] == "There is no signal." and not said[2].decision and said[2].near_boundary


def test_sources(spark, tmp_path):
    f = tmp_path / "pairs.csv"
    f.write_text('id,qid1,qid2,question1,question2,is_duplicate\n1,1,2,"a ""b"", c",NA,1\n2,3,4,,null,0\n')
    rows = tables.read_pairs_csv(spark, str(f)).orderBy("id").collect()
    assert (rows[0].question1, rows[0].question2, rows[1].question1, rows[1].question2) == ('a "b", c', "NA", None, "null")
    (tmp_path / "bad.csv").write_text("id,question1\n1,a\n")
    with pytest.raises(ValueError):
        tables.read_pairs_csv(spark, str(tmp_path / "bad.csv"))
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id long, split string")
    tables.write_splits(df, str(tmp_path / "s"))
    assert tables.read_split(spark, str(tmp_path / "s"), "train").count() == 1
    with pytest.raises(PermissionError):
        tables.read_split(spark, str(tmp_path / "s"), "test")
    with pytest.raises(ValueError):
        tables.cover(df, df.where("id = 1"))
    manifest = tmp_path / "m.json"
    tables.freeze([str(f)], str(manifest))
    assert tables.verify(str(manifest)) == {"changed": [], "missing": []}
    tables.once(str(tmp_path / "once"))
    with pytest.raises(FileExistsError):
        tables.once(str(tmp_path / "once"))


def test_stream(spark, tmp_path):
    from pairforge.streaming.decisions import decide

    spark.createDataFrame([(1, 0, 0.5), (2, 9, 0.5)], "id int, cluster int, score double").write.parquet(str(tmp_path / "in"))
    policy = spark.createDataFrame([(0, 0.6)], "cluster int, threshold double")
    stream = decide(spark.readStream.schema("id int, cluster int, score double").parquet(str(tmp_path / "in")), policy, 0.4)
    q = stream.writeStream.format("memory").queryName("decided").start()
    q.processAllAvailable()
    q.stop()
    assert {r.id: r.pred for r in spark.table("decided").collect()} == {1: 0, 2: 1}


def test_sinks_records_and_vector_store(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"", [1.0, 2.0]), (2, None, [])], "id int, t string, x array<double>")
    for kind in ("parquet", "csv", "json"):
        tables.write_table(df, str(tmp_path / kind), kind)
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"')
    assert sorted((r.id, r.t, r.x) for r in back.collect()) == [("1", 'a,"b"', "[1.0,2.0]"), ("2", None, "[]")] and spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    tables.write_record({"a": {"f1": 0.5}}, str(tmp_path / "r.json"))
    assert tables.read_record(str(tmp_path / "r.json"), "a", "f1") == 0.5
    texts_ = spark.createDataFrame([("x",), ("y",), ("x",)], "text string")
    encode = lambda d: d.withColumn("vector", F.array(F.lit(1 / 3), F.length("text").cast("double")))
    v = tables.cached_vectors(texts_, encode, str(tmp_path / "v"), half=True)
    assert v.count() == 2 and v.head().vector[0] == pytest.approx(0.333251953125, abs=0) and tables.vector_info(v, "e")["dims"] == 2
    assert tables.cached_vectors(texts_.limit(1), lambda d: encode(d.where("false")), str(tmp_path / "v")).count() == 1


def test_harness(spark):
    score = lambda d: d.withColumn("score", (F.length("question1") / 10).cast("double"))
    got = harness.probe(spark, [("abc", "x"), ("abcdefgh", "y")], {"one": (score, 0.5), "two": (score, 0.1)})
    kept = harness.record(got.drop("question1"), ["system", "id"])
    assert [(r["system"], r["decision"]) for r in kept] == [("one", False), ("one", True), ("two", True), ("two", True)]
    again = [dict(r) for r in kept]
    again[0]["score"] += 1e-7
    assert harness.differences(again, kept, ["system", "id"]) == []
    again[1]["decision"] = False
    assert len(harness.differences(again[:-1], kept, ["system", "id"])) == 2
    pairs = spark.createDataFrame([(i, "a", "b") for i in range(6)], "id long, question1 string, question2 string")
    assert set(harness.latency(pairs, score, 1, 2, 5)) == {"median_ms", "p95_ms", "batch_ms_per_pair"}


def test_command_line(tmp_path, capsys):
    from pairforge import __main__ as cli

    assert cli.main(["--list"]) == 0 and "best_threshold" in capsys.readouterr().out.split()
    names = ["a", "b", "c", "d"]
    assert cli.chosen(names, ["c", "a"], None, None) == ["a", "c"] and cli.chosen(names, [], "b", None) == ["b", "c", "d"] and cli.chosen(names, [], None, "b") == ["a", "b"]
    with pytest.raises(SystemExit):
        cli.chosen(names, ["x"], None, None)
    (tmp_path / "f.txt").write_text("x")
    tables.freeze([str(tmp_path / "f.txt")], str(tmp_path / "m.json"))
    assert cli.main(["--verify", str(tmp_path / "m.json")]) == 0
    (tmp_path / "f.txt").write_text("y")
    assert cli.main(["--verify", str(tmp_path / "m.json")]) == 1
