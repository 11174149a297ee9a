"""A network of one hidden layer on pair vectors, trained by mini-batches.

Rows fall in batches by a hash of the seed and their id, and dropout masks are hashes of the seed, the pass, the row and the
unit: so training does not depend on how rows are dealt. Steps follow each other, and a small batch is less work than a job
for it: so a job takes a run of batches, and its one task makes the steps of all of them for one network. Of batches too
large for that, each is a job whose tasks share its rows, and gradients are summed by a tree. Networks of all folds learn
side by side. The driver holds the weights, never rows; a network reads each batch once in a pass.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from pairforge.operators.metrics import auc
from pairforge.session import removed, scratch, side_by_side

SEED, HIDDEN, DROPOUT, RATE, DECAY, BATCH, EPOCHS, PATIENCE = 42, 256, 0.2, 1e-3, 1e-5, 512, 25, 3
#: Rows of a block, the unit that a task works on at once.
BLOCK = 4096
#: Rows of a batch that a task of a step takes, counted once for each network.
BATCH_ROWS = 2048
#: Numbers in the vectors of a run of batches: what a task of a run holds at a time, of 8 bytes each.
RUN_CELLS = 1 << 23

Weights = list[np.ndarray]


def initial(inputs: int, hidden: int = HIDDEN, seed: int = SEED) -> Weights:
    """Uniform weights within the root of a layer's inputs."""
    rng = np.random.default_rng(seed)
    layer = lambda a, b: [rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)]
    return layer(inputs, hidden) + layer(hidden, 1)


def hashed(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1) from unsigned integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


def mask(ids: np.ndarray, units: int, turn: int, dropout: float, seed: int) -> np.ndarray:
    """Which units of which rows stay in a pass, scaled by the share that stays."""
    with np.errstate(over="ignore"):
        row = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + turn) * 0xD6E8FEB86659FD93 % 2**64)
        cell = row[:, None] ^ (np.arange(units, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))[None, :]
    return (hashed(cell) >= dropout) / (1 - dropout)


def forward(w: Weights, x: np.ndarray) -> np.ndarray:
    """Scores of rows."""
    z = np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]
    return 1 / (1 + np.exp(-np.clip(z[:, 0], -500, 500)))


def gradient(w: Weights, ids: np.ndarray, x: np.ndarray, y: np.ndarray, turn: int, dropout: float, seed: int) -> Weights:
    """Gradient of the cross entropy summed over rows."""
    before = x @ w[0] + w[1]
    kept = (before > 0) * (mask(ids, len(w[1]), turn, dropout, seed) if dropout else 1.0)
    h = before * kept
    z = np.clip((h @ w[2] + w[3])[:, 0], -500, 500)
    d = (1 / (1 + np.exp(-z)) - y)[:, None]
    back = (d @ w[2].T) * kept
    return [x.T @ back, back.sum(0), h.T @ d, d.sum(0)]


class Adam:
    """Adam with L2 decay."""

    def __init__(self, w: Weights, rate: float, decay: float):
        self.w, self.rate, self.decay, self.t = w, rate, decay, 0
        self.m, self.v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]

    def step(self, grad: Weights) -> None:
        self.t += 1
        for i, g in enumerate(grad):
            g = g + self.decay * self.w[i]
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.w[i] = self.w[i] - self.rate * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)


def batch_order(batches: int, turn: int, seed: int) -> list[int]:
    return np.random.default_rng([seed, turn]).permutation(batches).tolist()


def _blocks(rows: Iterator) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of ids, vectors, labels and folds."""
    held = []
    for r in rows:
        held.append(r)
        if len(held) == BLOCK:
            yield _block(held)
            held = []
    if held:
        yield _block(held)


def _block(held: list) -> tuple[np.ndarray, ...]:
    return np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.float64), np.array([r[2] for r in held], np.float64), np.array([r[3] for r in held], np.int64)


@dataclass
class Network:
    """Weights for each fold (one entry with key None if there are no folds) and, with a dev table, its PR area after each pass."""

    folds: dict[int | None, Weights]
    curve: list[float]

    def score(self, df: DataFrame, x: str = "x") -> DataFrame:
        """Adds score: of the network that did not see the row's fold."""
        fold = F.col("fold") if None not in self.folds else F.lit(None).cast("int")
        held, cols = df.sparkSession.sparkContext.broadcast(self.folds), [F.col(c) for c in df.columns]

        def scan(batches):
            for b in batches:
                n = b.num_columns
                vectors = b.column(n - 2)
                width = len(next(iter(held.value.values()))[0])
                xs = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                f = b.column(n - 1).to_pylist()
                out = np.zeros(len(f))
                for k, w in held.value.items():
                    own = np.array([v == k for v in f], bool)
                    if own.any():
                        out[own] = forward(w, xs[own])
                yield pa.RecordBatch.from_arrays([*b.columns[: n - 2], pa.array(out)], names=[*b.schema.names[: n - 2], "score"])

        rows = df.select(*cols, F.col(x).cast("array<double>").alias("_x"), fold.cast("int").alias("_fold"))
        schema = df.withColumn("score", F.lit(0.0)).schema
        return rows.mapInArrow(scan, schema)


def _run(stored: DataFrame, key: int | None, adam: Adam, run: list[int], turn: int, dropout: float, seed: int) -> Adam:
    """The network of the rows out of fold key after a step for each batch of run: one task reads the run's rows and goes from batch to batch."""
    held = stored.sparkSession.sparkContext.broadcast(adam)

    def learn(batches):
        parts = [[*(t.column(c).to_numpy() for c in ("_b", "id", "y")), t.column("x").flatten().to_numpy().reshape(t.num_rows, -1)] for t in batches if t.num_rows]
        if not parts:
            return
        b, ids, y, x = (np.concatenate(c) for c in zip(*parts, strict=True))
        adam = deepcopy(held.value)  # a task that runs again begins where the first began
        for step in run:
            at, sums = np.flatnonzero(b == step), None
            for lo in range(0, len(at), BLOCK):
                i = at[lo : lo + BLOCK]
                g = gradient(adam.w, ids[i], x[i], y[i], turn, dropout, seed)
                sums = g if sums is None else [p + q for p, q in zip(sums, g, strict=True)]
            if sums is not None:
                adam.step([a / len(at) for a in sums])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(adam)], pa.binary())], names=["state"])

    rows = stored.where(F.col("_b").isin(run) & (F.lit(key is None) | (F.col("fold") != F.lit(key))))
    found = rows.coalesce(1).mapInArrow(learn, "state binary").collect()
    held.destroy()
    return pickle.loads(bytes(found[0].state)) if found else adam


def _step(dealt: RDD, nets: dict[int | None, Adam], turn: int, dropout: float, seed: int) -> None:
    """A step of all networks on one batch, whose rows tasks share."""
    weights = dealt.context.broadcast({k: a.w for k, a in nets.items()})

    def add(sums, block):
        ids, x, y, fold = block
        for k, w in weights.value.items():
            own = slice(None) if k is None else fold != k
            g = [*gradient(w, ids[own], x[own], y[own], turn, dropout, seed), np.float64(len(y[own]))]
            sums[k] = g if k not in sums else [p + q for p, q in zip(sums[k], g, strict=True)]
        return sums

    def merge(a, c):
        for k, g in c.items():
            a[k] = g if k not in a else [p + q for p, q in zip(a[k], g, strict=True)]
        return a

    for k, g in dealt.treeAggregate({}, add, merge).items():
        if g[-1]:
            nets[k].step([a / g[-1] for a in g[:-1]])
    weights.destroy()


def train(
    df: DataFrame, folds: int | None = None, dev: DataFrame | None = None, hidden: int = HIDDEN, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE,
    dropout: float = DROPOUT, decay: float = DECAY, patience: int = PATIENCE, seed: int = SEED,
) -> Network:
    """Trains on df (id, x, y and, with folds, fold from 0 on): one network, or one for each fold, from the rows of the others.

    With dev (x, y), for one network: training ends after patience passes without a greater PR area there, and the best weights stay.
    Without, it takes so many passes. batch: rows of a batch, about. An empty df is an error; a fold that holds all rows keeps its initial weights.
    """
    spark = df.sparkSession
    rows = df.select(F.col("id").cast("long"), F.col("x").cast("array<double>"), F.col("y").cast("double"), (F.col("fold") if folds else F.lit(-1)).cast("int").alias("fold"))
    n, inputs = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).head()
    if not n:
        raise ValueError("no rows to train on")
    batches = -(-n // batch)
    which = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(batches))
    keys = list(range(folds)) if folds else [None]
    # Rows are dealt to a folder for each batch in one shuffle, not by a scan of all rows for each; a step reads its batch alone.
    path, run = scratch(spark), RUN_CELLS // (batch * max(inputs, 1))
    rows.withColumn("_b", which).repartition("_b").write.partitionBy("_b").parquet(path)
    stored = spark.read.schema(rows.withColumn("_b", which).schema).parquet(path)
    dealt = [] if run else [stored.where(F.col("_b") == b).drop("_b").coalesce(-(-batch * len(keys) // BATCH_ROWS)).rdd.mapPartitions(_blocks).persist(StorageLevel.MEMORY_AND_DISK) for b in range(batches)]
    nets = {k: Adam(initial(inputs, hidden, seed), rate, decay) for k in keys}
    curve, best, bad = [], None, 0
    try:
        for turn in range(epochs):
            order = batch_order(batches, turn, seed)
            if run:

                def learnt(key, order=order, turn=turn):
                    adam = nets[key]
                    for lo in range(0, batches, run):
                        adam = _run(stored, key, adam, order[lo : lo + run], turn, dropout, seed)
                    return adam

                nets = dict(zip(keys, side_by_side(spark, learnt, keys), strict=True))
            for b in () if run else order:
                _step(dealt[b], nets, turn, dropout, seed)
            if dev is not None:
                now = Network({None: [w.copy() for w in nets[None].w]}, curve)
                curve.append(auc(now.score(dev.select("y", "x")).select("y", "score")).head().pr_auc or 0.0)
                if best is None or curve[-1] > best[0]:
                    best, bad = (curve[-1], now.folds), 0
                else:
                    bad += 1
                    if bad >= patience:
                        break
    finally:
        for d in dealt:
            d.unpersist()
        removed(spark, path)
    return Network(best[1] if best else {k: a.w for k, a in nets.items()}, curve)
