"""Sparse pair regression against a dense fit, and data-parallel training against one process."""

import os
import pickle
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairforge.functions.lexical import FEATURES, lexical_features
from pairforge.operators import network, sparse

DATA = "/root/testdata/sf0.01"
SCHEMA = "id long, question1 string, question2 string, y int"


def pair_rows(n, seed=3):
    rng = random.Random(seed)
    topics = [[f"{t}{k}" for k in range(12)] for t in "abc"]
    text = lambda t: " ".join(rng.choice(topics[t]) if rng.random() < 0.8 else f"w{rng.randrange(40)}" for _ in range(rng.randrange(2, 12)))
    rows = []
    for i in range(n):
        a, b = rng.randrange(3), rng.randrange(3)
        rows.append((i, text(a), text(b), int((a == b) != (rng.random() < 0.1))))
    return rows + [(n, "", None, 0), (n + 1, "never seen words", "other ones", 1), (n + 2, "a1 a2", "a1 a2", 1), (n + 3, "a1 a2", "a1 a2", 1)]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(pair_rows(150), SCHEMA).repartition(4).cache()


def terms_of(text):
    w = (text or "").split()
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def dense_fit(x, y, c):
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(60):  # Newton's method
        p = 1 / (1 + np.exp(-(x @ w + b)))
        full = np.hstack([x, np.ones((len(x), 1))])
        g = full.T @ (p - y) + np.append(w / c, 0)
        h = (full * (p * (1 - p))[:, None]).T @ full + np.diag(np.append(np.full(len(w), 1 / c), 0))
        step = np.linalg.solve(h, g)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def test_sparse_regression_equals_a_dense_one(spark, pairs):
    rows = pair_rows(150)
    train, dev = [r for r in rows if r[0] % 4], [r for r in rows if r[0] % 4 == 0]
    texts = [t for t in {(r[k]) for r in train for k in (1, 2)}]
    df = {}
    for t in texts:
        for x in set(terms_of(t)):
            df[x] = df.get(x, 0) + 1
    names = sorted(x for x, k in df.items() if k >= 2)
    idf = {x: np.log((1 + len(texts)) / (1 + df[x])) + 1 for x in names}
    place = {x: k for k, x in enumerate(names)}

    def vector(t):
        v = np.zeros(len(names))
        for x in terms_of(t):
            if x in place:
                v[place[x]] += 1
        v = np.where(v > 0, (1 + np.log(np.maximum(v, 1))) * np.array([idf[x] for x in names]), 0)
        return v / (np.linalg.norm(v) or 1)

    dense = lambda rs: np.array([np.concatenate([abs(vector(r[1]) - vector(r[2])), vector(r[1]) * vector(r[2])]) for r in rs])
    lex = {r.id: [round(r[f], 6) for f in FEATURES] for r in lexical_features(pairs).collect()}
    stats = np.array([lex[r[0]] for r in train])
    scale = np.where(stats.std(0) > 0, stats.std(0), np.inf)
    wide = lambda rs: np.hstack([dense(rs), (np.array([lex[r[0]] for r in rs]) - stats.mean(0)) / scale])
    a, b = pairs.where("id % 4 > 0"), pairs.where("id % 4 = 0")
    for lexical, x, z, grid in ((False, dense(train), dense(dev), sparse.GRID), (True, wide(train), wide(dev), [1.0])):
        model, marks = sparse.fit(a, b, grid, 2, lexical, 1e-9)
        assert [c for c, _ in marks] == grid and model.c in grid and model.size == len(names)
        w, i = dense_fit(x, np.array([r[3] for r in train]), model.c)
        got = {r.id: r.score for r in model.score(b).collect()}
        want = {r[0]: 1 / (1 + np.exp(-(v @ w + i))) for r, v in zip(dev, z, strict=True)}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-6


def test_sides_may_change_places_and_saved_models_score_the_same(spark, pairs, tmp_path):
    model, _ = sparse.fit(pairs.where("id % 3 > 0"), pairs.where("id % 3 = 0"), [1.0])
    turned = pairs.select("id", F.col("question2").alias("question1"), F.col("question1").alias("question2"))
    scores = lambda m, p: {r.id: round(r.score, 12) for r in m.score(p).collect()}
    want = scores(model, pairs)
    assert len(want) == pairs.count() and scores(model, turned) == want
    model.save((tmp_path / "m").as_uri())
    loaded = sparse.TfidfPairModel.load(spark, (tmp_path / "m").as_uri())
    assert scores(loaded, pairs.repartition(1)) == want and loaded.c == 1.0
    new = spark.createDataFrame([(1, "a1 a3 brand new", "a3 a1")], "id long, question1 string, question2 string")
    assert 0 < loaded.score(new).head().score < 1


def test_no_vector_of_the_vocabulary_reaches_the_driver(spark):
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(10**7)}" for _ in range(1500))
    rows = spark.createDataFrame([(i, text(), text(), i % 2) for i in range(40)], SCHEMA).repartition(4).cache()
    rows.count()
    tracemalloc.start()
    model, marks = sparse.fit(rows.where("id < 30"), rows.where("id >= 30"), [1.0], min_df=1, lexical=False, most=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.size > 170_000 and marks[0][0] == 1.0
    assert peak < 2 * 8 * 2 * model.size  # two vectors; L-BFGS has twenty and more


def test_numbers_do_not_depend_on_the_layout(spark):
    terms = [f"t{k * 7919 % 5003}" for k in range(5003)]
    df = spark.createDataFrame([(t,) for t in terms], "term string")
    made = [{r.term: r.number for r in sparse.numbered(df.repartition(n), "term").collect()} for n in (1, 7)]
    assert made[0] == made[1] and sorted(made[0].values()) == list(range(5003))


def vectors(n=240, d=5, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=n) > 0).astype(int)
    return [(int(i * 3), x[i].tolist(), int(y[i]), int(i % 3)) for i in range(n)]


def test_gradient_is_the_slope_of_the_loss():
    rows = vectors(40)
    ids, x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    w = network.initial(5, 7, 3)
    for dropout in (0.0, 0.4):
        def loss(w, dropout=dropout):
            h = np.maximum(x @ w[0] + w[1], 0) * (network.mask(ids, 7, 2, dropout, 9) if dropout else 1)
            z = (h @ w[2] + w[3])[:, 0]
            return np.sum(np.logaddexp(0, z) - y * z)

        g = network.gradient(w, ids, x, y, 2, dropout, 9)
        for k in range(4):
            for at in np.ndindex(*w[k].shape):
                up, down = [a.copy() for a in w], [a.copy() for a in w]
                up[k][at] += 1e-6
                down[k][at] -= 1e-6
                assert abs((loss(up) - loss(down)) / 2e-6 - g[k][at]) < 1e-4


def test_masks_drop_their_share_and_differ_between_passes():
    ids = np.arange(4000)
    a, b = network.mask(ids, 16, 0, 0.2, 1), network.mask(ids, 16, 1, 0.2, 1)
    assert abs((a == 0).mean() - 0.2) < 0.01 and set(np.unique(a)) == {0.0, 1.25} and 0.25 < (a != b).mean() < 0.4


def test_training_equals_one_process_on_any_layout(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "id long, x array<double>, y int, fold int")
    at = {r.id: r.b for r in df.select("id", F.pmod(F.xxhash64(F.lit(5), F.col("id")), F.lit(4)).alias("b")).collect()}
    want = {}
    for k in range(3):
        adam = network.Adam(network.initial(5, 8, 5), 0.01, 1e-4)
        for turn in range(4):
            for b in network.batch_order(4, turn, 5):
                mine = [r for r in rows if at[r[0]] == b and r[3] != k]
                g = network.gradient(adam.w, np.array([r[0] for r in mine]), np.array([r[1] for r in mine]), np.array([r[2] for r in mine], float), turn, 0.2, 5)
                adam.step([a / len(mine) for a in g])
        want[k] = adam.w
    for parts in (1, 7):
        net = network.train(df.repartition(parts), 3, hidden=8, epochs=4, batch=60, rate=0.01, decay=1e-4, seed=5)
        assert all(np.allclose(a, b, atol=1e-10) for k in range(3) for a, b in zip(net.folds[k], want[k], strict=True))
        got = {r.id: r.score for r in net.score(df).collect()}
        assert all(abs(got[i] - network.forward(want[f], np.array([x]))[0]) < 1e-9 for i, x, _, f in rows)


def test_training_learns_and_stops(spark):
    df = spark.createDataFrame(vectors(1200), "id long, x array<double>, y int, fold int").repartition(4)
    net = network.train(df.where("fold > 0"), dev=df.where("fold = 0"), hidden=32, epochs=12, batch=200, rate=0.03, patience=2)
    assert max(net.curve) > 0.85 and (len(net.curve) == 12 or len(net.curve) - 1 - int(np.argmax(net.curve)) == 2)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the supplied tables are not here")
def test_no_vector_is_in_two_folds(spark):
    from pairforge.plans import reports

    p = reports.folded_vector_pairs(spark, DATA.replace("0.01", "0.1")).select("fold", F.explode(F.array("a", "b")).alias("v"))
    assert p.groupBy("v").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty() and p.select("fold").distinct().count() > 1


def test_rows_are_dealt_to_batches_in_one_scan(spark, tmp_path):
    """Jobs read the rows of their batch: dealing does not read the table once for each batch."""
    seen = spark.sparkContext.accumulator(0)

    def count(i):
        seen.add(1)
        return i

    read = F.udf(count, "long").asNondeterministic()
    d = spark.range(400).select(read("id").alias("id"), F.array(F.rand(1), F.rand(2)).alias("x"), (F.col("id") % 2).alias("y"))
    network.train(d, hidden=2, epochs=2, batch=20)
    assert seen.value <= 4 * 400


def test_a_job_makes_the_steps_of_many_small_batches(spark, monkeypatch):
    """As many jobs as there are steps would take the time of a job for each; batches too large for a run are shared by tasks, to the same weights."""
    df = spark.createDataFrame(vectors(), "id long, x array<double>, y int, fold int").repartition(3)
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    kwargs = {"hidden": 4, "epochs": 3, "batch": 12, "seed": 5}
    try:
        sc.setJobGroup("many small batches", "")
        net = network.train(df, 3, **kwargs)
        assert len(tracker.getJobIdsForGroup("many small batches")) < 3 * 20  # one for each step and more, before
    finally:
        sc.setJobGroup("others", "")
    monkeypatch.setattr(network, "RUN_CELLS", 5 * 12 * 3)
    runs = network.train(df, 3, **kwargs)
    monkeypatch.setattr(network, "RUN_CELLS", 1)
    shared = network.train(df, 3, **(kwargs | {"epochs": 1}))
    monkeypatch.setattr(network, "RUN_CELLS", 1 << 23)
    once = network.train(df, 3, **(kwargs | {"epochs": 1}))
    same = lambda a, b: all(np.allclose(p, q, atol=1e-10) for k in range(3) for p, q in zip(a.folds[k], b.folds[k], strict=True))
    assert same(net, runs) and same(once, shared)


def test_pieces_of_the_matrix_hold_columns_together(monkeypatch):
    """Every step reads all cells again, so a cell does not carry the number of its column: 12 bytes in place of 16."""
    monkeypatch.setattr(sparse.TaskContext, "get", staticmethod(lambda: type("Context", (), {"partitionId": lambda self: 0})()))
    rng = np.random.default_rng(4)
    n, rows = 20_000, 50
    number, row, diff = np.sort(rng.integers(5, 400, n)), rng.integers(0, rows, n), rng.normal(size=n)
    product = np.where(np.arange(n) < 100, rng.normal(size=n), 0.0)
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 3000]) for c in (row, number, diff, product)], names=["id", "number", "diff", "product"]) for i in range(0, n, 3000)]
    found = [p for b in sparse._pieces(iter(batches), 7000) for p in b.column(1).to_pylist()]
    assert len(found) > 1 and sum(map(len, found)) < 14 * n + 20_000
    a, pieces = rng.normal(size=rows), [pickle.loads(p) for p in found]
    for k, values in enumerate((diff, product)):
        dense = np.zeros((rows, 400))
        np.add.at(dense, (row, number), values)
        got = np.zeros(400)
        for p in pieces:
            got[p[k].numbers] += p[k].onto(a)
        assert np.allclose(got, a @ dense) and np.allclose(sum(p[k].back(p[k].onto(a), rows) for p in pieces), dense @ (dense.T @ a))
