"""Periodic stretches of words by a suffix automaton and small-to-large merging of ordered end positions.

The suffix links of the automaton of a text form a tree; the end positions of a state are those of its children and its
own. Children are merged into their parent, the smaller set into the larger, kept in order. When two positions e - d
and e become neighbours in a state of length n, the n words before both are the same; if n >= d this is a square, and the
words e - d - n + 1 to e have period d. A run of exponent x and period d seeds such pairs with n >= (x - 1) * d, for between
e - d and e no further end of so long a string can lie without a shorter period. Seeds of one period that overlap by the
period are one run; its least start and greatest end are those of the longest seed.

Before that, texts are cut down to stretches that can hold a run at all: each of its words lies in a gram of so many words
that occurs again within the stretch, and not farther away than the greatest period that fits in it.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.text import let
from pairforge.llm.shared import as_text, ready
from pairforge.llm.vectext import grams, mix, pieces

#: Least words and least exponent of a run.
LEAST, POWER = 6, 4


def automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, link, end) of the states of the suffix automaton; end is -1 for states that end no prefix."""
    length, link, end, edges = [0], [-1], [-1], [{}]
    last = 0
    for i, c in enumerate(word):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        end.append(i)
        edges.append({})
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] != length[p] + 1:
                split = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                edges.append(edges[q].copy())
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = split
                    p = link[p]
                link[q] = q = split
            link[new] = q
        last = new
    return length, link, end


def seeds(word: list[int], least_length: int, power: int) -> np.ndarray:
    """Rows (period, start, end) of periodic stretches, from new neighbours in states of at least least_length words.

    Sets hold positions below zero, so that texts that repeat, whose earlier ends come last, append to them.
    """
    length, link, end = automaton(word)
    held: list[list[int] | None] = [[-e] if e >= 0 else None for e in end]
    found: list[tuple[int, int, int]] = []
    for v in np.argsort(-np.asarray(length), kind="stable").tolist():
        p = link[v]
        if p < 0 or length[p] < least_length:
            held[v] = None
            continue
        large, small, held[v] = held[p], held[v], None
        if large is None:
            held[p] = small
            continue
        if len(large) < len(small):
            large, small = small, large
        n = length[p]
        widest = n // (power - 1)
        for x in small:
            k = bisect_left(large, x)
            if k and x - large[k - 1] <= widest:
                d = x - large[k - 1]
                found.append((d, 1 - large[k - 1] - d - n, -large[k - 1]))
            if k < len(large) and large[k] - x <= widest:
                d = large[k] - x
                found.append((d, 1 - x - d - n, -x))
            large.insert(k, x)
        held[p] = large
    return np.array(found, np.int64).reshape(-1, 3)


def stretches(word: np.ndarray, k: int, power: int) -> list[tuple[int, int]]:
    """(start, end) of maximal stretches whose words all lie in k-grams that recur within the stretch, near enough."""
    todo, out = [(0, len(word))], []
    while todo:
        lo, hi = todo.pop()
        n = hi - lo
        g = grams(mix(word[lo:hi].astype(np.uint64)), k)
        if len(g) < 2:
            continue
        order = np.argsort(g, kind="stable")
        near = (g[order[1:]] == g[order[:-1]]) & (np.diff(order) <= n // power)
        if not near.any():
            continue
        step = np.zeros(n + 1, np.int64)
        for at in (order[1:][near], order[:-1][near]):
            np.add.at(step, at, 1)
            np.add.at(step, at + k, -1)
        inside = np.concatenate([[False], np.cumsum(step[:n]) > 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        cut = list(zip((edge[::2] + lo).tolist(), (edge[1::2] + lo).tolist(), strict=True))
        if cut == [(lo, hi)]:
            out.append((lo, hi))
        else:
            todo += [(a, b) for a, b in cut if b - a > k]
    return sorted(out)


def runs(word: np.ndarray, least: int = LEAST, power: int = POWER) -> np.ndarray:
    """Rows (start, length, period) of the runs of a list of numbered words, by start, then period."""
    # The shortest string that a run and its shift by a period share.
    k = min(max(least, power * q) - q for q in range(1, least + 1))
    rows = [seeds(word[lo:hi].tolist(), k, power) + [0, lo, lo] for lo, hi in (stretches(word, k, power) if len(word) >= least else [])]
    found = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
    if not len(found):
        return found
    period, start, end = found[np.lexsort((found[:, 1], found[:, 0]))].T
    _, rank = np.unique(period, return_inverse=True)
    reach = np.maximum.accumulate(end + rank * (len(word) + 1)) - rank * (len(word) + 1)
    fresh = np.ones(len(period), bool)
    fresh[1:] = (rank[1:] != rank[:-1]) | (reach[:-1] - start[1:] + 1 < period[1:])
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(period)]]) - 1
    start, length, period = start[first], reach[last] - start[first] + 1, period[first]
    long = (length >= least) & (length >= power * period)
    start, length, period = start[long], length[long], period[long]
    # A stretch whose first period repeats something shorter belongs to the run of that shorter period.
    own = np.array([_primitive(word[a : a + q]) for a, q in zip(start.tolist(), period.tolist(), strict=True)], bool)
    out = np.stack([start, length, period], axis=1)[own]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _primitive(block: np.ndarray) -> bool:
    """Whether a list of words is no repetition of a shorter one."""
    n, rest, p = len(block), len(block), 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            if (block[: n - n // p] == block[n // p :]).all():
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words stay: not those of a run after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, found[:, 0] + found[:, 2], 1)
    np.add.at(step, found[:, 0] + found[:, 1], -1)
    return np.cumsum(step[:n]) == 0


OUT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def detect(documents: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """Per row of documents: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are what ASCII white space separates. A run is a maximal stretch of words with smallest period q, of at least
    least and power * q words; collapsed is the text without the words of a run after its first q, joined by one blank.
    Null and empty texts have no words, no runs and an empty collapsed text. Every row stands for itself: repeated and
    null doc_ids are returned as they are. Runs that overlap or tie are all returned. Texts are read whole: a stretch
    with repeats takes about half a kilobyte of memory a word. An empty table gives an empty result; other columns are ignored.
    """
    ready(documents.sparkSession)

    def scan(batches):
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(1)):
                raw, ends = data.tobytes(), offsets.tolist()
                counts, found, texts = [], [], []
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    words = raw[a:b].split()
                    number: dict[bytes, int] = {}
                    r = runs(np.array([number.setdefault(w, len(number)) for w in words], np.int64), least, power)
                    counts.append(len(words))
                    found.append(r)
                    if len(r):
                        words = [words[i] for i in np.flatnonzero(kept(len(words), r)).tolist()]
                    texts.append(b" ".join(words))
                flat = np.concatenate(found)
                fields = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]), pa.int32()), fields)
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "runs", "collapsed"])

    docs = as_text(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return docs.mapInArrow(scan, OUT)


def echoed(doc_id: Column, text: Column) -> Column:
    """The text with a repeated tail, for one document in ten: from word a on, its next p words again and again.

    h is the crc32 of doc_id, g = h // 10; texts with h % 10 = 0 and words change, a = g % n, p = 1 + (n - a) // (3 + g % 8).
    Null: empty; a row without doc_id keeps its text.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), again), " ")).otherwise(text)

    changed = F.coalesce(h % 10 == 0, F.lit(False))
    return F.when(changed, let(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), tail)).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: least start, then period) and sha256 of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    length = -F.col("b.less")
    return rows.select(
        "doc_id", "n_runs", F.col("b.start").alias("start"), length.alias("length"), F.col("b.period").alias("period"),
        F.floor(1000 * length / F.col("b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
