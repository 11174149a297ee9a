"""Joint K-Means against plain Lloyd rounds, and its measures against the operators on tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.operators import clusters, kmeans
from pairforge.plans import catalog


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(m, 0.4, (n, 5)) for m, n in ((0, 120), (2, 60), (-2, 60))])
    x = np.vstack([x, x[:20]])  # repeated rows
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "id long, v array<double>").repartition(5).cache()


def lloyd(x, centres, limit):
    for _ in range(300):
        label = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[label == c].mean(0) if (label == c).any() else centres[c] for c in range(len(centres))])
        moved, centres = ((new - centres) ** 2).sum(), new
        if moved <= limit:
            break
    return centres


def test_all_fits_equal_single_ones(spark, points):
    x, df = points
    fits = [kmeans.Fit(k, s) for k in (1, 3, 6) for s in (1, 2)] + [kmeans.Fit(4, 5, 0, 1)]
    for parts in (1, 7):
        rows = kmeans.rows_of(df.repartition(parts), "v", "id", (11,))
        part = {r.key: r.parts[0] for r in rows.collect()}
        draws = [r.key for r in rows.orderBy("draw", "key").collect()]
        for f, got in zip(fits, kmeans.fit_all(rows, fits), strict=True):
            mine = [i for i in draws if f.split < 0 or part[i] == f.part]
            want = lloyd(x[mine], kmeans.first_centres(x[mine], f.k, f.seed), kmeans.REST * x.var(0).mean())
            assert np.allclose(got.centres, want, atol=1e-9)
            d = ((x[mine][:, None] - want[None]) ** 2).sum(2)
            assert got.n.tolist() == np.bincount(d.argmin(1), minlength=f.k).tolist()
            assert got.inertia == pytest.approx(d.min(1).sum())


def test_measures_equal_those_of_tables(spark, points):
    x, df = points
    rows = kmeans.rows_of(df, "v", "id", (11,))
    a, b = (f.by_size() for f in kmeans.fit_all(rows, [kmeans.Fit(3, 1), kmeans.Fit(5, 2)]))
    table = df.where("v IS NOT NULL")
    one, two = (clusters.assign(table, "v", [(i, c.tolist()) for i, c in enumerate(f.centres)]) for f in (a, b))
    for f, labelled, made, shape in zip((a, b), (one, two), kmeans.separations(rows, [a, b]), kmeans.silhouettes(rows, [a, b], 150, 1), strict=True):
        want = clusters.separation(labelled, "v").first().asDict()
        assert made == pytest.approx(want)
        assert shape == pytest.approx(clusters.silhouette(labelled, "v", "cluster", "id", 150, 1).first()[0], abs=1e-6)
        assert sorted(f.n.tolist(), reverse=True) == f.n.tolist()
    both = one.select("id", F.col("cluster").alias("p")).join(two.select("id", F.col("cluster").alias("q")), "id")
    assert kmeans.agreement(rows, [(a.centres, b.centres, -1), (a.centres, a.centres, 0)]) == pytest.approx([clusters.adjusted_rand(both, "p", "q").first()[0], 1.0])


def test_sweep_and_edges(spark, points):
    x, df = points
    got = [kmeans.sweep(df.repartition(p), "v", "id", [1, 3], restarts=2, again=4, sample=100).orderBy("k").toPandas().round(9) for p in (1, 6)]
    assert got[0].equals(got[1])
    first, second = got[0].to_dict("records")
    assert first["clusters"] == 1 and first["davies_bouldin"] != first["davies_bouldin"] and first["silhouette"] == 0
    assert second["seed_ari"] > 0.95 and second["split_half_ari"] > 0.95 and second["silhouette"] > 0.5
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, v array<double>")  # fewer distinct rows than centres
    assert kmeans.best(kmeans.fit_all(kmeans.rows_of(same, "v", "id"), [kmeans.Fit(3, 1)])).n.tolist() == [5, 0, 0]
    with pytest.raises(ValueError, match="no row"):
        kmeans.fit_all(kmeans.rows_of(same.where("id < 0"), "v", "id"), [kmeans.Fit(2, 1)])


def test_silhouette_equals_brute_force_and_assigns_the_sample_alone(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(120, 3)), np.zeros((4, 3))])
    label = [*rng.integers(0, 3, 120).tolist(), 7, 7, 8, 0]  # two equal rows of one cluster, and one alone
    df = spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, label, strict=True))], "id long, v array<double>, cluster int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i, c in enumerate(label):
        mean = {k: d[i, [j for j in range(len(x)) if j != i and label[j] == k]] for k in set(label)}
        inner, outer = mean.pop(c), min(m.mean() for m in mean.values())
        want.append((outer - inner.mean()) / max(outer, inner.mean()) if len(inner) and max(outer, inner.mean()) > 0 else 0.0)
    assert clusters.silhouette(df, "v", "cluster", "id", 1000, 1).first()[0] == pytest.approx(np.mean(want), abs=1e-7)
    assert clusters.silhouette(df.limit(1), "v", "cluster", "id", 1000, 1).first()[0] is None
    e = df.select(F.col("id").alias("vec_id"), F.col("v").alias("embedding"), F.col("cluster").alias("label"))
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    taken = catalog.labelled(spark, str(tmp_path), 50)
    assert taken.count() == 50 and taken.join(catalog.labelled(spark, str(tmp_path)), ["vec_id", "label", "cluster"]).count() == 50


def test_nearest_centre_is_the_first_on_ties():
    part = np.array([[1.0, 2.0, np.nan, 0.0], [1.0, 3.0, 0.0, 0.0], [0.0, 3.0, 1.0, 1.0]])
    hot, far = kmeans.nearest(part)
    assert hot.sum(0).tolist() == [1] * 4 and hot.argmax(0).tolist() == part.argmax(0).tolist() and far[[0, 1, 3]].tolist() == [1.0, 3.0, 1.0]
