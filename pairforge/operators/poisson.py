"""Bootstraps of tables of any size: every row has a Poisson weight in every replicate, and areas are exact, ties too.

A weight is a function of the seed, the row's key and the replicate, so no draw is stored and none depends on how rows
are dealt; rows of one key are drawn together. Areas need rows in order of their scores. Rows are ranged by group and
score, ties by key, so a hot score is many parts. A first pass sums weights of each part; from these the driver knows
what stands before each part; a second pass adds up areas from there. A task reads its rows in blocks and holds sums
only. Number 0 is no replicate but the table itself: all its weights are 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.functions.text import ratio
from pairforge.operators.metrics import GRID, cell
from pairforge.operators.network import hashed
from pairforge.operators.replicates import curve, decisions
from pairforge.session import scratch, written

#: Replicates that are computed at once, rows of a block, and most parts of a table: they bound what tasks and driver hold.
TOGETHER, BLOCK, PARTS = 250, 1024, 1024
_SHARES = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1.0, 18.0)]))

Sums = tuple[np.ndarray, np.ndarray]


def weights(keys: np.ndarray, numbers: np.ndarray, seed: int) -> np.ndarray:
    """Poisson weights of mean 1, a row for each key and a column for each replicate; ones in number 0."""
    with np.errstate(over="ignore"):
        row = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD6E8FEB86659FD93 % 2**64)
        at = row[:, None] ^ (numbers.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))[None, :]
    drawn = np.searchsorted(_SHARES, hashed(at), side="right")
    drawn[:, numbers == 0] = 1
    return drawn


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            yield [c.to_numpy(zero_copy_only=False) for c in batch.slice(lo, BLOCK).columns]


@dataclass
class Runs:
    """Runs of rows of one part, group and score, in order, with weights summed by label: a row for each run."""

    part: np.ndarray
    group: np.ndarray
    score: np.ndarray
    k: np.ndarray
    pos: np.ndarray
    neg: np.ndarray

    def cut(self, rows: slice) -> Runs:
        return Runs(*(getattr(self, f)[rows] for f in ("part", "group", "score", "k", "pos", "neg")))

    def segments(self) -> Iterator[tuple[tuple[int, int], Runs]]:
        """Stretches of one part and group."""
        edges = np.flatnonzero((np.diff(self.part) != 0) | (np.diff(self.group) != 0)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(self.part)], strict=True):
            yield (int(self.part[lo]), int(self.group[lo])), self.cut(slice(lo, hi))


def _runs(batches: Iterator[pa.RecordBatch], numbers: np.ndarray, seed: int) -> Iterator[Runs]:
    """Whole runs of sorted rows; one may reach over many blocks."""
    held: Runs | None = None
    for part, group, score, k, y, key in _blocks(batches):
        starts = np.r_[0, np.flatnonzero((np.diff(part) != 0) | (np.diff(group) != 0) | (np.diff(score) != 0)) + 1]
        w = weights(key, numbers, seed)
        pos = np.add.reduceat(w * y[:, None].astype(np.int64), starts)
        now = Runs(part[starts], group[starts], score[starts], k[starts], pos, np.add.reduceat(w, starts) - pos)
        if held is not None:
            if (held.part[0], held.group[0], held.score[0]) == (part[0], group[0], score[0]):
                now.pos[0] += held.pos[0]
                now.neg[0] += held.neg[0]
            else:
                yield held
        if len(starts) > 1:
            yield now.cut(slice(0, -1))
        held = now.cut(slice(-1, None))
    if held is not None:
        yield held


@dataclass
class Segment:
    """What the first pass finds of the rows of a part and group: weights by grid cell, and the ties at its ends."""

    first: float
    last: float = 0.0
    runs: int = 0
    tie: Sums | None = None
    cells: dict[int, list[np.ndarray]] = field(default_factory=dict)

    def add(self, r: Runs) -> None:
        self.last, self.tie, self.runs = float(r.score[-1]), (r.pos[-1], r.neg[-1]), self.runs + len(r.score)
        starts = np.r_[0, np.flatnonzero(np.diff(r.k)) + 1]
        for i, pos, neg in zip(r.k[starts].tolist(), np.add.reduceat(r.pos, starts), np.add.reduceat(r.neg, starts), strict=True):
            had = self.cells.setdefault(i, [0, 0])
            had[0], had[1] = had[0] + pos, had[1] + neg


#: ties and cells are whole numbers of 64 bits: replicates of positives, then of negatives, for each cell in turn.
_FIRST = "part int, grp int, first double, last double, runs long, tie binary, k array<int>, cells binary"
_SECOND = "grp int, ap array<double>, roc array<double>"
_SECOND_ARROW = pa.schema([("grp", pa.int32()), ("ap", pa.list_(pa.float64())), ("roc", pa.list_(pa.float64()))])


def _first_pass(rows: DataFrame, numbers: np.ndarray, seed: int) -> dict[tuple[int, int], Segment]:
    def each(batches):
        found: dict[tuple[int, int], Segment] = {}
        for r in _runs(batches, numbers, seed):
            for at, s in r.segments():
                found.setdefault(at, Segment(float(s.score[0]))).add(s)
        for (part, group), s in found.items():
            out = (part, group, s.first, s.last, s.runs, np.array(s.tie, np.int64).tobytes(), list(s.cells), np.array(list(s.cells.values()), np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, kinds, strict=True)], names=[c.split()[0] for c in _FIRST.split(", ")])

    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary()]
    out = {}
    for r in rows.mapInArrow(each, _FIRST).collect():
        tie = np.frombuffer(r["tie"], np.int64).reshape(2, -1)
        cells = np.frombuffer(r["cells"], np.int64).reshape(len(r["k"]), 2, -1)
        out[r["part"], r["grp"]] = Segment(r["first"], r["last"], r["runs"], (tie[0], tie[1]), dict(zip(r["k"], map(list, cells), strict=True)))
    return out


@dataclass
class Before:
    """What stands before a segment: all weights of its group, those of a tie that reaches into it; and whether its last tie goes on."""

    pos: np.ndarray
    neg: np.ndarray
    tie: Sums
    last: float
    goes_on: bool = False


def _before(found: dict[tuple[int, int], Segment], size: int) -> dict[tuple[int, int], Before]:
    zero, out, latest = np.zeros(size, np.int64), {}, {}
    for at in sorted(found, key=lambda x: (x[1], x[0])):
        s, prior = found[at], latest.get(at[1])
        b = Before(zero, zero, (zero, zero), s.last)
        if prior:
            p, before = found[prior], out[prior]
            b.pos, b.neg = (before_ + sum(c[i] for c in p.cells.values()) for i, before_ in enumerate((before.pos, before.neg)))
            if p.last == s.first:  # a tie of one run alone may come from further up
                before.goes_on = True
                b.tie = tuple(p.tie[i] + (before.tie[i] if p.runs == 1 else 0) for i in (0, 1))
        out[at], latest[at[1]] = b, at
    return out


def _second_pass(rows: DataFrame, numbers: np.ndarray, seed: int, before: dict[tuple[int, int], Before], groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of precision over positives and of positives above negatives, by group and replicate."""
    sent = rows.sparkSession.sparkContext.broadcast(before)

    def each(batches):
        ahead: dict[tuple[int, int], list[np.ndarray]] = {}
        sums: dict[int, list[np.ndarray]] = {}
        for r in _runs(batches, numbers, seed):
            for at, s in r.segments():
                b = sent.value[at]
                start = at not in ahead
                tp, fp = ahead.setdefault(at, [b.pos, b.neg])
                tp, fp = tp + s.pos.cumsum(0), fp + s.neg.cumsum(0)
                ahead[at] = [tp[-1], fp[-1]]
                if start:
                    s.pos[0] += b.tie[0]
                    s.neg[0] += b.tie[1]
                n = len(s.score) - (b.goes_on and s.score[-1] == b.last)  # the part that ends a tie counts it
                pos, neg, tp, fp = s.pos[:n], s.neg[:n], tp[:n], fp[:n]
                had = sums.setdefault(at[1], [np.zeros(len(numbers)), np.zeros(len(numbers))])
                had[0] += (pos * np.divide(tp, tp + fp, out=np.zeros(tp.shape), where=tp + fp > 0)).sum(0)
                had[1] += (neg * (tp - pos / 2)).sum(0)
        for g, (ap, roc) in sums.items():
            yield pa.RecordBatch.from_pylist([{"grp": g, "ap": ap.tolist(), "roc": roc.tolist()}], _SECOND_ARROW)

    ap, roc = np.zeros((groups, len(numbers))), np.zeros((groups, len(numbers)))
    for r in rows.mapInArrow(each, _SECOND).collect():
        ap[r["grp"]] += r["ap"]
        roc[r["grp"]] += r["roc"]
    return ap, roc


def _hists(found: dict[tuple[int, int], Segment], groups: int, size: int) -> np.ndarray:
    """Weights by group, replicate, grid cell (from -1) and label."""
    hist = np.zeros((groups, size, GRID + 2, 2))
    for (_, g), s in found.items():
        for k, (pos, neg) in s.cells.items():
            hist[g, :, k + 1, 1] += pos
            hist[g, :, k + 1, 0] += neg
    return hist


def replicate_areas(scored: DataFrame, tau: float | dict[str, float], replicates: int, seed: int = 1, by: str | None = None, key: str = "id", score: str = "score", parts: int | None = None) -> DataFrame:
    """by, boot (0: the table itself), f1 at tau, tau (the optimal threshold of the grid, the lowest on ties), roc_auc, pr_auc.

    Areas are null where one label has no weight. Rows without score, label or group are left out; a table without rows
    gives none. tau may be a table of one for each group. Groups are few: the driver holds their sums for each grid cell and part, TOGETHER replicates at a time.
    """
    spark = scored.sparkSession
    rows = scored.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col("y").isNotNull())
    kind = None
    if by:
        kind = scored.schema[by].dataType.simpleString()
        names = [r[0] for r in rows.where(F.col(by).isNotNull()).select(by).distinct().orderBy(by).collect()]
        table = spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{by} {kind}, grp int")
        rows = rows.join(F.broadcast(table), by)
    else:
        names, rows = [None], rows.withColumn("grp", F.lit(0))
    # Each pass is a job over all parts, so few rows make few parts.
    parts = parts or max(min(PARTS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BLOCK)), 1)
    rows = rows.select("grp", F.col(score).cast("double").alias("score"), cell(F.col(score)).alias("k"), F.col("y").cast("int").alias("y"), F.xxhash64(key).alias("key"))
    rows = rows.repartitionByRange(parts, "grp", F.desc("score"), "key").withColumn("part", F.spark_partition_id())
    rows = written(rows, scratch(spark))  # parts stay what they are if a task is run again
    rows = rows.select("part", "grp", "score", "k", "y", "key").repartition(parts, "part").sortWithinPartitions("part", "grp", F.desc("score"))
    out = []
    for lo in range(0, replicates + 1, TOGETHER):
        numbers = np.arange(lo, min(lo + TOGETHER, replicates + 1))
        found = _first_pass(rows, numbers, seed)
        hists = _hists(found, len(names), len(numbers))
        ap, roc = _second_pass(rows, numbers, seed, _before(found, len(numbers)), len(names))
        for g, name in enumerate(names):
            for i, b in enumerate(numbers.tolist()):
                neg, pos = hists[g, i].sum(0)
                if not found:
                    continue
                taus, f1 = curve(hists[g, i])
                both = bool(pos and neg)
                out.append((name, b, float(f1[round((tau[name] if isinstance(tau, dict) else tau) * GRID)]), float(taus[f1.argmax()]), float(roc[g, i] / pos / neg) if both else None, float(ap[g, i] / pos) if both else None))
    made = spark.createDataFrame(out, f"grp {kind or 'string'}, boot long, f1 double, tau double, roc_auc double, pr_auc double")
    return made.withColumnRenamed("grp", by) if by else made.drop("grp")


def replicate_decisions(scored: DataFrame, taus: dict[str, float], replicates: int, seed: int = 1, by: str = "cluster", key: str = "id") -> DataFrame:
    """boot, score (its column), metric, value: the seven decision metrics of each system, score >= its threshold. Rows without group, label or a score are left out."""
    names = list(taus)
    code = sum(((F.col(c) >= t).cast("int") * 2**i for i, (c, t) in enumerate(taus.items())), F.lit(0))
    kept = scored.dropna(subset=[by, "y", *names])
    rows = kept.select(F.col(by).cast("string").alias("grp"), F.col("y").cast("int").alias("y"), code.alias("code"), F.xxhash64(key).alias("key"))
    numbers = np.arange(replicates + 1)

    def each(batches):
        sums: dict[tuple[str, int, int], np.ndarray] = {}
        for group, y, pred, keys in _blocks(batches):
            w = weights(keys, numbers, seed)
            cells, at = np.unique(np.array([group.astype(str), y.astype(str), pred.astype(str)]), axis=1, return_inverse=True)
            for i, c in enumerate(cells.T.tolist()):
                cell_ = (c[0], int(c[1]), int(c[2]))
                sums[cell_] = sums.get(cell_, 0) + w[at.ravel() == i].sum(0)
        for (g, y, p), w in sums.items():
            yield pd.DataFrame({"grp": g, "y": y, "code": p, "boot": numbers, "w": w})

    def frames(batches):
        for f in each(batches):
            yield pa.RecordBatch.from_pandas(f, schema, preserve_index=False)

    schema = pa.schema([("grp", pa.string()), ("y", pa.int32()), ("code", pa.int32()), ("boot", pa.int64()), ("w", pa.int64())])
    sums = rows.mapInArrow(frames, "grp string, y int, code int, boot long, w long").groupBy("grp", "y", "code", "boot").agg(F.sum("w").alias("w"))

    def measured(cells: pd.DataFrame) -> pd.DataFrame:
        groups, number = np.unique(cells.grp.to_numpy().astype(str), return_inverse=True)
        found = [(int(cells.boot.iloc[0]), c, m, v) for i, c in enumerate(names) for m, v in decisions(cells.y.to_numpy(), cells.code.to_numpy() >> i & 1, number, cells.w.to_numpy(), len(groups)).items()]
        return pd.DataFrame(found, columns=["boot", "score", "metric", "value"])

    return sums.groupBy("boot").applyInPandas(measured, "boot long, score string, metric string, value double")


def _quantile(c: str, p: float):
    return F.percentile(F.when(F.col("boot") > 0, F.col(c)), F.lit(p))


def cluster_intervals(scored: DataFrame, tau: float, replicates: int, seed: int = 1, by: str = "cluster", key: str = "id", parts: int | None = None) -> DataFrame:
    """By cluster: f1 at tau, the optimal tau, roc_auc and pr_auc with their 2.5 and 97.5 % quantiles and deviation over replicates."""
    made = replicate_areas(scored, tau, replicates, seed, by, key, parts=parts)
    own = lambda c: [F.max(F.when(F.col("boot") == 0, F.col(c))).alias(c), _quantile(c, 0.025).alias(f"{c}_low"), _quantile(c, 0.975).alias(f"{c}_high"), F.stddev_pop(F.when(F.col("boot") > 0, F.col(c))).alias(f"{c}_std")]
    return made.groupBy(by).agg(*[e for c in ("f1", "tau", "roc_auc", "pr_auc") for e in own(c)])


def paired_intervals(scored: DataFrame, tau_a: float, tau_b: float, replicates: int, seed: int = 2, by: str = "cluster", key: str = "id", parts: int | None = None) -> DataFrame:
    """metric, gain (of the table itself), gain_mean, gain_low, gain_high, p_no_gain of score_b over score, on the same weights: seven decision metrics and both areas. Rows lacking one of them are left out."""
    rows = scored.dropna(subset=[by, "y", "score", "score_b"])
    taus = {"score": tau_a, "score_b": tau_b}
    made = replicate_decisions(rows, taus, replicates, seed, by, key)
    for c, t in taus.items():
        areas = replicate_areas(rows, t, replicates, seed, None, key, c, parts)
        made = made.unionByName(areas.select("boot", F.lit(c).alias("score"), F.explode(F.create_map(F.lit("roc_auc"), "roc_auc", F.lit("pr_auc"), "pr_auc")).alias("metric", "value")))
    gains = made.groupBy("boot", "metric").agg((F.max(F.when(F.col("score") == "score_b", F.col("value"))) - F.max(F.when(F.col("score") == "score", F.col("value")))).alias("gain"))
    drawn = F.when(F.col("boot") > 0, F.col("gain"))
    return gains.groupBy("metric").agg(
        F.max(F.when(F.col("boot") == 0, F.col("gain"))).alias("gain"), F.avg(drawn).alias("gain_mean"), _quantile("gain", 0.025).alias("gain_low"),
        _quantile("gain", 0.975).alias("gain_high"), ratio(F.count_if(drawn <= 0).cast("double"), F.count(drawn).cast("double")).alias("p_no_gain"),
    )
