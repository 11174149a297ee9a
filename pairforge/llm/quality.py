"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed for whole slices of rows on the Arrow buffers. Trees are grown level by level on a histogram
of binned values and flattened into arrays, which numpy walks for all rows of a batch at once.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.shared import as_text, ready, scratch, written
from pairforge.llm.vectext import FOLD, NOT_SPACE, grams, pieces, whole, words

#: At most about this many labelled rows, chosen by a hash of their id, reach the driver to fit the trees.
MAX_LABELLED = 40_000
BINS, TREES, DEPTH, RATE, L2, LEAST = 64, 120, 4, 0.1, 1.0, 5.0
THRESHOLD = 0.3

STATS = [
    "log_bytes", "log_words", "log_lines", "word_bytes", "word_bytes_sd", "longest_word", "upper", "digits", "blanks", "not_ascii",
    "stops", "commas", "exclamations", "bars", "stars", "other_signs", "controls", "capitalised", "sign_ends", "short_words",
    "distinct_words", "top_word", "repeats", "distinct_fours", "line_words", "repeated_lines", "empty_lines",
]

_NOT_LINE = np.ones(256, bool)
_NOT_LINE[10] = False


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LOWER, _DIGIT = _set(bytes(range(65, 91))), _set(bytes(range(97, 123))), _set(b"0123456789")
_HIGH, _CONTROL = _set(bytes(range(128, 256))), _set(bytes([*range(9), *range(14, 32), 127]))
_SIGNS = ~(_UPPER | _LOWER | _DIGIT | _HIGH | _CONTROL | ~NOT_SPACE)
_OTHER = _SIGNS & ~_set(b".,!|*\"'():;?-")
_ODD_END = _SIGNS & ~_set(b".,;:?\"')")


def _share(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, its distinct hashes and the count of its most frequent one."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(h)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, row[at], counts)
    return np.bincount(row[at], minlength=n), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATS for each text of a slice."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)

    def count(table: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(table[data])])[offsets]).astype(np.float64)

    def per(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a / np.maximum(b, 1)

    s = words(FOLD[data], offsets, NOT_SPACE)
    m = np.diff(s.first).astype(np.float64)
    lens = (s.end - s.start).astype(np.float64)

    def by_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(s.row, values, n)

    mean = per(by_word(lens), m)
    longest = np.zeros(n)
    np.maximum.at(longest, s.row, lens)
    same = np.zeros(len(s.hash))
    same[1:] = (s.hash[1:] == s.hash[:-1]) & (s.row[1:] == s.row[:-1])
    distinct, top = _share(s.row, s.hash, n)
    four = grams(s.hash, 4)
    ok = whole(s.first, s.row, 4, len(four))
    fours, _ = _share(s.row[: len(four)][ok], four[ok], n)
    lines = words(data, offsets, _NOT_LINE)
    nl = np.diff(lines.first).astype(np.float64)
    distinct_lines, _ = _share(lines.row, lines.hash, n)
    breaks = count(~_NOT_LINE)
    letters = count(_UPPER) + count(_LOWER)
    ends = data[s.end - 1] if len(s.end) else data[:0]
    heads = data[s.start] if len(s.start) else data[:0]
    return np.column_stack([
        np.log1p(size), np.log1p(m), np.log1p(nl), mean, np.sqrt(np.maximum(per(by_word(lens * lens), m) - mean * mean, 0)), np.log1p(longest),
        per(count(_UPPER), letters), per(count(_DIGIT), size), per(count(~NOT_SPACE), size), per(count(_HIGH), size),
        per(count(_set(b".")), m), per(count(_set(b",")), m), per(count(_set(b"!")), m), per(count(_set(b"|")), m), per(count(_set(b"*")), m),
        per(count(_OTHER), m), per(count(_CONTROL), size), per(by_word(_UPPER[heads]), m), per(by_word(_ODD_END[ends]), m), per(by_word(lens <= 2), m),
        per(distinct, m), per(top, m), per(by_word(same), m), per(fours, m - 3), per(m, nl), 1 - per(distinct_lines, nl) * (nl > 0) - (nl == 0), per(breaks + 1 - nl, breaks + 1),
    ]).astype(np.float32)


class Trees(NamedTuple):
    """All trees in arrays; a leaf points at itself. Children stand at left and left + 1."""

    base: float
    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    step: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 of each row."""
        total = np.full(len(x), self.base)
        at = np.arange(len(x))
        for root in self.root.tolist():
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                node = self.left[node] + self.step[node] * (x[at, self.feature[node]] > self.threshold[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees of logistic loss. Without rows, or with one label only, there are none and scores are constant."""
    ones, n = float(y.sum()), len(y)
    base = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    feature, threshold, left, step, value, roots = [], [], [], [], [], []
    if 0 < ones < n:
        f = x.shape[1]
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1], method="lower")) for j in range(f)]
        binned = np.column_stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(f)])
        flat = binned + np.arange(f) * BINS
        score = np.full(n, base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)  # place in the present level
            level = [len(feature)]
            roots.append(level[0])
            feature.append(0), threshold.append(np.inf), left.append(level[0]), step.append(0), value.append(0.0)
            place = np.full(n, level[0])
            for depth in range(DEPTH + 1):
                live = node >= 0
                k = len(level)
                cells = (node[live, None] * (f * BINS) + flat[live]).ravel()
                hg = np.bincount(cells, np.repeat(g[live], f), k * f * BINS).reshape(k, f, BINS)
                hh = np.bincount(cells, np.repeat(h[live], f), k * f * BINS).reshape(k, f, BINS)
                sg, sh = hg[:, 0].sum(1), hh[:, 0].sum(1)
                for i, at in enumerate(level):
                    value[at] = -RATE * sg[i] / (sh[i] + L2)
                if depth == DEPTH:
                    break
                lg, lh = hg.cumsum(2), hh.cumsum(2)
                rg, rh = sg[:, None, None] - lg, sh[:, None, None] - lh
                gain = lg**2 / (lh + L2) + rg**2 / (rh + L2) - (sg**2 / (sh + L2))[:, None, None]
                gain = np.where((lh >= LEAST) & (rh >= LEAST), gain, -1)
                for j in range(f):
                    gain[:, j, len(edges[j]) :] = -1
                best = gain.reshape(k, -1).argmax(1)
                deeper, renumber = [], np.full((k, 2), -1)
                split_f, split_b = np.zeros(k, np.int64), np.zeros(k, np.int64)
                for i, at in enumerate(level):
                    if gain[i].ravel()[best[i]] <= 1e-6:
                        continue
                    split_f[i], split_b[i] = divmod(int(best[i]), BINS)
                    feature[at], threshold[at], left[at], step[at] = int(split_f[i]), float(edges[split_f[i]][split_b[i]]), len(feature), 1
                    for side in range(2):
                        renumber[i, side] = len(deeper)
                        deeper.append(len(feature))
                        feature.append(0), threshold.append(np.inf), left.append(deeper[-1]), step.append(0), value.append(0.0)
                if not deeper:
                    break
                at = np.flatnonzero(live)
                side = (binned[at, split_f[node[at]]] > split_b[node[at]]).astype(np.int64)
                node[at] = renumber[node[at], side]
                moved = at[node[at] >= 0]
                level = deeper
                place[moved] = np.asarray(level)[node[moved]]
            score += np.asarray(value)[place]
    return Trees(base, np.asarray(roots, np.int64), np.asarray(feature, np.int64), np.asarray(threshold), np.asarray(left, np.int64), np.asarray(step, np.int64), np.asarray(value))


def with_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and its statistics, row by row."""
    docs = as_text(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def scan(batches):
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(1)):
                x = statistics(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * len(STATS), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["doc_id", "stats"])

    return docs.mapInArrow(scan, "doc_id long, stats array<float>")


def sampled(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, y: about max_labelled labels at most of the documents whose crc32(doc_id as text) mod 5 is not 0, by a hash of their id."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    labels = labels.where(F.col("y").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    n = labels.count()
    return labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * (max_labelled / n))) if n > max_labelled else labels


def train(stats: DataFrame, labels: DataFrame) -> Trees:
    """Fits trees to sampled labels."""
    rows = stats.join(labels, "doc_id").select("doc_id", "y", "stats").toArrow()
    order = np.lexsort((rows.column("y").to_numpy(), rows.column("doc_id").to_numpy()))  # one result however rows arrive
    x = rows.column("stats").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))
    return fit(x[order], rows.column("y").to_numpy()[order].astype(np.float64))


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, held_out, score, predicted.

    Null texts are empty; these have statistics too and so a score. A row without doc_id is scored and not held out.
    Labels other than 0 and 1 are left out; without labels, or with one kind only, all scores are equal.
    Repeated rows are scored each, repeated labels count each; empty tables give empty results; texts are read whole,
    however long; other columns are ignored, whatever their names.
    """
    spark = ready(documents.sparkSession)
    stats = written(with_statistics(documents), f"{scratch(spark)}/stats")
    trees = spark.sparkContext.broadcast(train(stats, sampled(labels)))

    def scan(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.value.score(x))], names=["doc_id", "score"])

    scored = stats.mapInArrow(scan, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents, with all their columns, that are predicted 1.

    Rows are judged one by one by their text, null as empty, so ids may repeat or be null and columns may have any name.
    """
    spark = ready(documents.sparkSession)
    own = written(sampled(labels), f"{scratch(spark)}/labels")
    asked = F.broadcast(own.select("doc_id").distinct())  # about MAX_LABELLED ids at most
    learned = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).join(asked, "doc_id", "left_semi")
    trees = spark.sparkContext.broadcast(train(with_statistics(learned), own))
    at = [c.lower() for c in documents.columns].index("text")

    def scan(batches):
        for batch in batches:
            keep = [trees.value.score(statistics(data, offsets)) >= THRESHOLD for _, _, data, offsets in pieces(batch.column(at))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return documents.mapInArrow(scan, documents.schema)
