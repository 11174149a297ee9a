"""K-Means for many fits at once: all K, restarts, seeds and halves learn in the same scans.

A round is one Spark job: tasks multiply blocks of rows with the centres of all fits and emit sums for each centre,
which Spark adds up. The driver holds centres and sums, never rows, but for a sample of bounded size that the first
centres are drawn from. A fit that has come to rest is left out of later rounds, so all take as long as the slowest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.vectors import doubles

#: Rows that first centres are drawn from, rows of a block, most rounds, and the shift (in mean variances) at which a fit rests.
SEEDING, BLOCK, ROUNDS, REST = 10_000, 2048, 300, 1e-4


@dataclass(frozen=True)
class Fit:
    """One fit: of all rows, or of those that lie in a part of a split (see rows_of)."""

    k: int
    seed: int
    split: int = -1
    part: int = -1


@dataclass
class Fitted:
    """Centres, with the rows, their sum and the squared distances of each."""

    centres: np.ndarray
    n: np.ndarray
    sums: np.ndarray
    cost: np.ndarray

    @property
    def inertia(self) -> float:
        return float(self.cost.sum())

    def by_size(self) -> Fitted:
        """Numbered by size, the largest first."""
        order = sorted(range(len(self.n)), key=lambda i: (-self.n[i], i))
        return Fitted(*(getattr(self, f)[order] for f in ("centres", "n", "sums", "cost")))


def half_of(key: str, seed: int, held_out: float = 0.2) -> Column:
    """0 or 1 for the halves of a split, 2 for rows that neither half has."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return F.when(draw < held_out, 2).when(draw < held_out + (1 - held_out) / 2, 0).otherwise(1)


def rows_of(df: DataFrame, vector: str, key: str, splits: tuple[int, ...] = ()) -> DataFrame:
    """key, v, parts (one for each split seed), draw. Rows without a vector are left out; all vectors have one length."""
    parts = F.array(*[half_of(key, s) for s in splits]).cast("array<int>")
    draw = F.md5(F.concat(F.lit("seeding|"), F.col(key).cast("string")))
    return df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), doubles(F.col(vector)).alias("v"), parts.alias("parts"), draw.alias("draw"))


def _matrix(column: pa.Array, kind: type = float) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors and parts."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            b = batch.slice(lo, BLOCK)
            yield _matrix(b.column("v")), _matrix(b.column("parts"), int)


def scores(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """x * c - |c|^2 / 2, which orders centres by distance."""
    return x @ centres.T - (centres * centres).sum(1) / 2


def nearest(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of scores (centres, rows): whether a centre is the row's nearest, the first on ties, and the score of that one."""
    far = part.max(0)
    hot = part == far
    if np.count_nonzero(hot) != part.shape[1]:  # ties, or scores that are no numbers
        hot = np.arange(len(part))[:, None] == part.argmax(0)
    return hot, far


def first_centres(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Rows drawn one after the other with the square of the distance to those drawn before; of fewer distinct rows than k, some twice."""
    rng = np.random.default_rng([seed, k])
    chosen = [x[rng.integers(len(x))]]
    near = ((x - chosen[0]) ** 2).sum(1)
    for _ in range(k - 1):
        total = near.sum()
        chosen.append(x[rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))])
        near = np.minimum(near, ((x - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def _offsets(centres: list[np.ndarray]) -> list[tuple[int, int]]:
    ends = np.cumsum([len(c) for c in centres]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def scan(rows: DataFrame, fits: list[Fit], centres: list[np.ndarray]) -> list[Fitted]:
    """Rows, sums and squared distances of each centre of each fit, by one job."""
    sent = rows.sparkSession.sparkContext.broadcast((np.vstack(centres), fits, _offsets(centres)))

    def each(batches):
        stack, fits, at = sent.value
        n, sums, cost = np.zeros(len(stack), int), np.zeros(stack.shape), np.zeros(len(stack))
        for x, parts in _blocks(batches):
            s, own = scores(x, stack).T.copy(), (x * x).sum(1)
            for f, (lo, hi) in zip(fits, at, strict=True):
                part = s[lo:hi]
                hot, far = nearest(part)
                if f.split >= 0:
                    hot &= parts[:, f.split] == f.part
                n[lo:hi] += np.count_nonzero(hot, axis=1)
                part[:] = hot  # scores give way to a row's share in each sum
                cost[lo:hi] += part @ np.maximum(own - 2 * far, 0)
            sums += s @ x
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used], pa.int64()), pa.array(cost[used]), pa.array(list(sums[used]), pa.list_(pa.float64()))], names=["c", "n", "cost", "s"])

    found = rows.select("v", "parts").mapInArrow(each, "c int, n long, cost double, s array<double>")
    found = found.groupBy("c").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), Summarizer.sum(array_to_vector(F.col("s"))).alias("s")).collect()
    total, width = sum(map(len, centres)), centres[0].shape[1]
    n, sums, cost = np.zeros(total, int), np.zeros((total, width)), np.zeros(total)
    for r in found:
        n[r["c"]], sums[r["c"]], cost[r["c"]] = r["n"], r["s"].toArray(), r["cost"]
    sent.unpersist()
    return [Fitted(c, n[lo:hi], sums[lo:hi], cost[lo:hi]) for c, (lo, hi) in zip(centres, _offsets(centres), strict=True)]


def fit_all(rows: DataFrame, fits: list[Fit], rounds: int = ROUNDS, rest: float = REST) -> list[Fitted]:
    """Lloyd's rounds for all fits of rows_of. A centre without rows stays where it is. A fit without any row is an error."""
    some = rows.orderBy("draw", "key").limit(SEEDING).select("v", "parts").toPandas()
    if not len(some):
        raise ValueError("no row has a vector")
    x, parts = np.array(some["v"].tolist(), float), np.array(some["parts"].tolist(), int).reshape(len(some), -1)
    limit = rest * float(x.var(0).mean())
    centres = []
    for f in fits:
        mine = x if f.split < 0 else x[parts[:, f.split] == f.part]
        if not len(mine):
            raise ValueError(f"no row in part {f.part} of split {f.split}")
        centres.append(first_centres(mine, f.k, f.seed))
    moving = list(range(len(fits)))
    for _ in range(rounds):
        if not moving:
            break
        still = []
        for i, r in zip(moving, scan(rows, [fits[i] for i in moving], [centres[i] for i in moving]), strict=True):
            new = np.where(r.n[:, None] > 0, r.sums / np.maximum(r.n, 1)[:, None], r.centres)
            if ((new - centres[i]) ** 2).sum() > limit:
                still.append(i)
            centres[i] = new
        moving = still
    return scan(rows, fits, centres)


def best(fitted: list[Fitted]) -> Fitted:
    """The cheapest, the first on ties, numbered by size."""
    return min(fitted, key=lambda f: f.inertia).by_size()


def rand_index(table: np.ndarray) -> float:
    """Adjusted Rand index of a table of counts; 1 where there is nothing to agree on."""
    two = lambda n: float((n * (n - 1.0) / 2).sum())
    both, a, b, all_ = two(table), two(table.sum(1)), two(table.sum(0)), two(table.sum())
    expected = a * b / all_ if all_ else 0.0
    return float((both - expected) / ((a + b) / 2 - expected)) if (a + b) / 2 != expected else 1.0


def agreement(rows: DataFrame, pairs: list[tuple[np.ndarray, np.ndarray, int]]) -> list[float]:
    """Adjusted Rand index of two sets of centres on all rows (split -1) or on those that neither half of a split has, for all pairs by one job."""
    sent = rows.sparkSession.sparkContext.broadcast(pairs)

    def each(batches):
        tables = [np.zeros((len(a), len(b)), int) for a, b, _ in sent.value]
        for x, parts in _blocks(batches):
            for t, (a, b, split) in zip(tables, sent.value, strict=True):
                mine = x if split < 0 else x[parts[:, split] == 2]
                np.add.at(t, (scores(mine, a).argmax(1), scores(mine, b).argmax(1)), 1)
        for i, t in enumerate(tables):
            a, b = np.nonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), i), pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(t[a, b], pa.int64())], names=["i", "a", "b", "n"])

    tables = [np.zeros((len(a), len(b))) for a, b, _ in pairs]
    for r in rows.select("v", "parts").mapInArrow(each, "i int, a int, b int, n long").groupBy("i", "a", "b").agg(F.sum("n").alias("n")).collect():
        tables[r["i"]][r["a"], r["b"]] = r["n"]
    sent.unpersist()
    return [rand_index(t) for t in tables]


def _cos(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    return np.divide((a * b).sum(1), length, out=np.zeros(len(a)), where=length > 0)


def separations(rows: DataFrame, fitted: list[Fitted]) -> list[dict[str, float | None]]:
    """For each fit of all rows: davies_bouldin, calinski_harabasz (null for one cluster), mean_cosine, worst_cosine to the mean of a cluster's rows, by one job."""
    means = [f.sums / np.maximum(f.n, 1)[:, None] for f in fitted]
    sent = rows.sparkSession.sparkContext.broadcast([(f.centres, m) for f, m in zip(fitted, means, strict=True)])

    def each(batches):
        made = [np.zeros((3, len(m))) for _, m in sent.value]
        for x, _ in _blocks(batches):
            for out, (centres, mean) in zip(made, sent.value, strict=True):
                label = scores(x, centres).argmax(1)
                d = ((x - mean[label]) ** 2).sum(1)
                for j, v in enumerate((np.sqrt(d), d, _cos(x, mean[label]))):
                    out[j] += np.bincount(label, v, len(mean))
        for i, out in enumerate(made):
            for c in range(out.shape[1]):
                yield pa.RecordBatch.from_pylist([{"i": i, "c": c, "s": out[0, c], "w": out[1, c], "cos": out[2, c]}], kinds)

    kinds = pa.schema([("i", pa.int32()), ("c", pa.int32()), ("s", pa.float64()), ("w", pa.float64()), ("cos", pa.float64())])
    sums = rows.select("v", "parts").mapInArrow(each, "i int, c int, s double, w double, cos double").groupBy("i", "c").agg(*[F.sum(c).alias(c) for c in ("s", "w", "cos")]).toPandas()
    sent.unpersist()
    out = []
    for i, (f, mean) in enumerate(zip(fitted, means, strict=True)):
        mine = sums[sums.i == i].sort_values("c")
        used = f.n > 0
        n, mean = f.n[used], mean[used]
        s, w, cos = (mine[c].to_numpy()[used] for c in ("s", "w", "cos"))
        k, whole = len(n), f.sums.sum(0) / f.n.sum()
        between = float((n * ((mean - whole) ** 2).sum(1)).sum())
        apart = np.sqrt(((mean[:, None] - mean[None, :]) ** 2).sum(2))
        ratio = np.divide(s[:, None] / n[:, None] + (s / n)[None, :], apart, out=np.zeros((k, k)), where=apart > 0)
        within = float(w.sum())
        out.append({
            "davies_bouldin": float(ratio.max(1).mean()) if k > 1 else None,
            "calinski_harabasz": float(between / (k - 1) / (within / (n.sum() - k))) if k > 1 and n.sum() > k and within > 0 else None,
            "mean_cosine": float(cos.sum() / n.sum()), "worst_cosine": float((cos / n).min()),
        })
    return out


def silhouettes(rows: DataFrame, fitted: list[Fitted], sample: int, seed: int) -> list[float]:
    """For each fit, the silhouette of one sample of rows, by exact distances within it, each taken once for all fits. The sample is broadcast; a row alone in its cluster counts 0."""
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.col("key").cast("string")))
    taken = np.array([r["v"] for r in rows.select("v", draw.alias("d"), "key").orderBy("d", "key").limit(sample).collect()], float)
    return mean_silhouettes(rows.sparkSession, taken, [scores(taken, f.centres).argmax(1) for f in fitted])


def mean_silhouettes(spark: SparkSession, taken: np.ndarray, labels: list[np.ndarray]) -> list[float]:
    """The silhouette of a sample of vectors for each array of labels 0, 1, ... of them."""
    sent = spark.sparkContext.broadcast((taken, labels))
    tasks = max(1, -(-len(taken) // 256))

    def each(frames):
        x, labels = sent.value
        own = (x * x).sum(1)
        for frame in frames:
            at = frame["id"].to_numpy()
            for lo in range(0, len(at), 256):
                mine = at[lo : lo + 256]
                d = np.sqrt(np.maximum(own[mine][:, None] + own[None, :] - 2 * x[mine] @ x.T, 0))
                d[np.arange(len(mine)), mine] = 0.0
                for i, label in enumerate(labels):
                    size = np.bincount(label)
                    sums = d @ (label[:, None] == np.arange(len(size))).astype(float)
                    here = (np.arange(len(mine)), label[mine])
                    inner = sums[here] / np.maximum(size[label[mine]] - 1, 1)
                    mean = np.divide(sums, size, out=np.full(sums.shape, np.inf), where=size > 0)
                    mean[here] = np.inf
                    outer = mean.min(1)
                    top = np.maximum(inner, outer)
                    value = np.where((size[label[mine]] > 1) & np.isfinite(outer) & (top > 0), np.divide(outer - inner, top, out=np.zeros(len(mine)), where=np.isfinite(top) & (top > 0)), 0.0)
                    yield pd.DataFrame({"i": [i], "s": [value.sum()]})

    made = spark.range(0, len(taken), 1, min(tasks, 1024)).mapInPandas(each, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    sums = {r["i"]: r["s"] for r in made}
    return [float(sums.get(i, 0.0) / len(taken)) for i in range(len(labels))]


def sweep(df: DataFrame, vector: str, key: str, ks: list[int], restarts: int = 5, again: int = 3, sample: int = 20_000, seed: int = 42) -> DataFrame:
    """k, and the quality of its best clustering: inertia, sizes, separation, silhouette of a sample, agreement of two seeds and of two halves on rows that neither has."""
    rows = rows_of(df, vector, key, (seed,)).persist()
    try:
        runs = {"own": (restarts, seed, -1, -1), "half_0": (again, seed, 0, 0), "half_1": (again, seed + 1, 0, 1), "seed_0": (again, seed + 2, -1, -1), "seed_1": (again, seed + 3, -1, -1)}
        fits = {(k, run): [Fit(k, s * 1000 + i, split, part) for i in range(n)] for k in ks for run, (n, s, split, part) in runs.items()}
        flat = iter(fit_all(rows, [f for group in fits.values() for f in group]))
        found = {at: best([next(flat) for _ in group]) for at, group in fits.items()}
        own = [found[k, "own"] for k in ks]
        pairs = [(found[k, f"{kind}_0"].centres, found[k, f"{kind}_1"].centres, split) for k in ks for kind, split in (("seed", -1), ("half", 0))]
        agree, apart, shape = agreement(rows, pairs), separations(rows, own), silhouettes(rows, own, sample, seed)
    finally:
        rows.unpersist()
    out = []
    for i, (k, f) in enumerate(zip(ks, own, strict=True)):
        n = f.n[f.n > 0]
        p = n / n.sum()
        sizes = {"clusters": len(n), "min_share": float(p.min()), "max_share": float(p.max()), "max_min_ratio": float(n.max() / n.min()), "entropy": float(-(p * np.log(p)).sum() / np.log(len(n))) if len(n) > 1 else 0.0}
        out.append({"k": k, **sizes, **apart[i], "silhouette": shape[i], "seed_ari": agree[2 * i], "split_half_ari": agree[2 * i + 1], "inertia": f.inertia})
    names = list(out[0])
    return df.sparkSession.createDataFrame([tuple(r[c] for c in names) for r in out], ", ".join(f"{c} {'long' if c in ('k', 'clusters') else 'double'}" for c in names))


def fit_agreement(df: DataFrame, vector: str, key: str, k: int, seeds: list[int], halves: list[int]) -> DataFrame:
    """kind, first, second, ari: each two of the fits of seeds on all rows, and for each seed of halves, two fits of disjoint halves on rows that neither has."""
    rows = rows_of(df, vector, key, tuple(halves)).persist()
    try:
        fits = [Fit(k, s) for s in seeds] + [Fit(k, s + h, i, h) for i, s in enumerate(halves) for h in (0, 1)]
        centres = [f.centres for f in fit_all(rows, fits)]
        named = [("seeds", a, b, centres[i], centres[j], -1) for i, a in enumerate(seeds) for j, b in enumerate(seeds) if i < j]
        named += [("halves", s, s + 1, centres[len(seeds) + 2 * i], centres[len(seeds) + 2 * i + 1], i) for i, s in enumerate(halves)]
        found = agreement(rows, [(a, b, split) for *_, a, b, split in named])
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame([(*n[:3], r) for n, r in zip(named, found, strict=True)], "kind string, first int, second int, ari double")
