"""Benchmark decontamination by winnowing.

Of the k-gram hashes of a text, winnowing keeps the least of every w consecutive ones (the last on ties), so two
texts that share k + w - 1 words share a kept hash. Here k = 5 and w = 6: every shared window of 10 words is met.
Kept hashes of documents are joined with those of the benchmark; hits are extended to the windows around them,
which are compared word by word. Items with fewer than 10 words are compared as one window of their own length.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.shared import as_text, ready, scratch, written
from pairforge.llm.vectext import ALNUM, FOLD, Spans, gram_at, grams, pieces, whole, words

WINDOW, K = 10, 5
W = WINDOW - K + 1
#: Bytes of benchmark text that one broadcast may hold, about 60 MB with its index; a larger benchmark is taken in blocks.
BLOCK_BYTES = 8 << 20

OUT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def winnowed(h: np.ndarray, spans: Spans) -> np.ndarray:
    """Places of the kept k-grams, of rows with a window."""
    g = grams(h, K)
    m = len(g) - W + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    best, place = g[:m].copy(), np.zeros(m, np.int64)
    for i in range(1, W):
        less = g[i : i + m] <= best
        best[less] = g[i : i + m][less]
        place[less] = i
    keep = np.zeros(len(g), bool)
    ok = whole(spans.first, spans.row, WINDOW, m)
    keep[(np.arange(m) + place)[ok]] = True
    return np.flatnonzero(keep)


class Index:
    """Fingerprints and windows of a block of items, in arrays: about 30 bytes for each word besides the text.

    text holds the words of all items in order, with a blank between; word i is text[start[i]:end[i]]. For each size k
    of a window, hash has the hashes of its distinct windows in ascending order and first a word where each begins;
    items[rank[j]:rank[j + 1]] are the numbers in names of the items with window j, in order of their names.
    """

    def __init__(self, items: list[tuple[str, str]]):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        texts, hashes, owner, prints, starts, ends = [], [], [], [], [], []
        at = 0
        by_size: dict[int, list[np.ndarray]] = {}
        words_before = 0
        for name, text in items:
            data = FOLD[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
            s = words(data, np.array([0, len(data)]), ALNUM)
            n = len(s.start)
            if not n:
                continue
            raw, size = data.tobytes(), s.end - s.start
            texts.append(b" ".join(raw[a:b] for a, b in zip(s.start.tolist(), s.end.tolist(), strict=True)))
            starts.append(at + np.cumsum(size + 1) - size - 1)
            ends.append(starts[-1] + size)
            hashes.append(s.hash)
            owner.append(np.full(n, number[name], np.int32))
            at += len(texts[-1]) + 1
            k = min(n, WINDOW)
            by_size.setdefault(k, []).append(words_before + np.arange(n - k + 1))
            words_before += n
            if n >= WINDOW:
                prints.append(np.unique(grams(s.hash, K)[winnowed(s.hash, s)]))
        self.text = b" ".join(texts)
        self.start, self.end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
        all_, owners = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (owner, np.int32)))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, places in by_size.items():
            first = np.concatenate(places)
            h = gram_at(all_, first, k)
            order = np.lexsort((owners[first], h))
            first, h = first[order], h[order]
            new = np.append(True, h[1:] != h[:-1])
            # Windows of one hash are told apart by their words; those of another than the first one are put apart.
            head = first[np.flatnonzero(new)[np.cumsum(new) - 1]]
            other = np.array([i for i in np.flatnonzero(~new).tolist() if self.window(first[i], k) != self.window(head[i], k)], np.int64)
            if len(other):
                label = np.zeros(len(h), np.int64)
                seen: dict[bytes, int] = {}
                for i in other.tolist():
                    label[i] = seen.setdefault(self.window(first[i], k), len(seen) + 1)
                order = np.lexsort((owners[first], label, h))
                first, h, label = first[order], h[order], label[order]
                new = np.append(True, (h[1:] != h[:-1]) | (label[1:] != label[:-1]))
            fresh = new | np.append(True, owners[first[1:]] != owners[first[:-1]])  # an item counts once for a window
            heads, items_ = np.flatnonzero(new), owners[first[fresh]]
            self.windows[k] = h[heads], first[heads], np.append(np.cumsum(fresh)[heads] - 1, len(items_)), items_
        self.coarse = {k: coarse(h) for k, h in [(0, self.prints), *((k, w[0]) for k, w in self.windows.items())]}

    def window(self, i: int, k: int) -> bytes:
        return self.text[self.start[i] : self.end[i + k - 1]]

    def hits(self, data: np.ndarray, s: Spans) -> list[tuple[int, int, list[int]]]:
        """(first word, words, items) of every occurrence of a window."""
        out, raw = [], None
        for k, (hashes, first, rank, owners) in self.windows.items():
            if k == WINDOW:
                at = winnowed(s.hash, s)
                at = at[member(gram_at(s.hash, at, K), self.prints, self.coarse[0])]
                at = np.unique((at[:, None] - np.arange(W)).ravel())
                row = s.row[np.minimum(np.maximum(at, 0), max(len(s.row) - 1, 0))] if len(at) else at
                ok = at >= 0
                at, row = at[ok], row[ok]
                at = at[at + k <= s.first[row + 1]]
            else:
                m = len(s.hash) - k + 1
                at = np.flatnonzero(whole(s.first, s.row, k, m)) if m > 0 else np.zeros(0, np.int64)
            g = gram_at(s.hash, at, k) if len(at) else np.zeros(0, np.uint64)
            found = member(g, hashes, self.coarse[k])
            for i, h, j in zip(at[found].tolist(), g[found].tolist(), np.searchsorted(hashes, g[found]).tolist(), strict=True):
                raw = data.tobytes() if raw is None else raw
                text = b" ".join(raw[a:b] for a, b in zip(s.start[i : i + k].tolist(), s.end[i : i + k].tolist(), strict=True))
                while j < len(hashes) and hashes[j] == h:
                    if self.window(first[j], k) == text:
                        out.append((i, k, owners[rank[j] : rank[j + 1]].tolist()))
                        break
                    j += 1
        return out


def coarse(hashes: np.ndarray) -> np.ndarray:
    """Which leading 20 bits occur."""
    out = np.zeros(1 << 20, bool)
    out[(hashes >> np.uint64(44)).astype(np.int64)] = True
    return out


def member(g: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places in g of members of the sorted hashes."""
    if not len(g) or not len(hashes):
        return np.zeros(0, np.int64)
    maybe = np.flatnonzero(first[(g >> np.uint64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(hashes, g[maybe]), len(hashes) - 1)
    return maybe[hashes[at] == g[maybe]]


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _rows(column: pa.Array, index: Index) -> Iterator[tuple[int, list[tuple[int, int, list[int]]]]]:
    """For each slice, the words of its rows and the hits by row."""
    for _, _, data, offsets in pieces(column):
        data = FOLD[data]
        s = words(data, offsets, ALNUM)
        by_row: dict[int, list] = defaultdict(list)
        for i, k, items in index.hits(data, s):
            r = int(s.row[i])
            by_row[r].append((i - int(s.first[r]), k, items))
        for r, n in enumerate(np.diff(s.first).tolist()):
            yield n, by_row.get(r, [])


def _covered(spans) -> int:
    """Words in a union of (start, length)."""
    total, to = 0, 0
    for a, k in sorted(spans):
        total += max(0, a + k - max(a, to))
        to = max(to, a + k)
    return total


def blocks_of(benchmark: DataFrame, block_bytes: int):
    """A function that broadcasts the index of a block, and the number of blocks of about block_bytes."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null")
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).head().n
    blocks = -(-total // block_bytes) or 1

    def indexed(b: int):
        rows = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        return benchmark.sparkSession.sparkContext.broadcast(Index([(r.item, r.text) for r in rows.toLocalIterator()]))

    return indexed, blocks


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of documents: its id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts have no words; items without id or words are left out, equal ids count once. Repeated document rows
    are reported each. Empty tables give empty results; texts are read whole, however long. Other columns are ignored,
    whatever their names. The benchmark is broadcast in blocks of at
    most block_bytes (an item longer than that is a block alone); each block reads the documents once.
    """
    spark = ready(documents.sparkSession)
    docs = as_text(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    indexed, blocks = blocks_of(benchmark, block_bytes)
    type_of = docs.schema["id"].dataType.simpleString()

    if blocks == 1:
        index = indexed(0)

        def scan(batches):
            for batch in batches:
                n_words, n_hit, n_items, sha, bad = [], [], [], [], []
                for n, hits in _rows(batch.column(1), index.value):
                    items = [index.value.names[x] for x in sorted({x for *_, owners in hits for x in owners})]
                    n_words.append(n)
                    n_hit.append(_covered({(i, k) for i, k, _ in hits}))
                    n_items.append(len(items))
                    sha.append(digest(items))
                    bad.append(bool(hits))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array(bad, pa.bool_())], names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

        return docs.mapInArrow(scan, f"id {type_of}, {OUT}").withColumnRenamed("id", id_col)

    docs = docs.withColumns({"row": F.xxhash64("id", "text"), "tag": F.xxhash64(F.lit(1), "text", "id")})
    parts = None
    for b in range(blocks):
        index = indexed(b)

        def spans(batches, index=index):
            for batch in batches:
                n_words, at, size, names = [], [], [], []
                for n, hits in _rows(batch.column(1), index.value):
                    n_words.append(n)
                    at.append([i for i, _, _ in hits])
                    size.append([k for _, k, _ in hits])
                    names.append([index.value.names[x] for x in sorted({x for *_, owners in hits for x in owners})])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(n_words, pa.int64()), pa.array(at, pa.list_(pa.int64())), pa.array(size, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], names=["id", "row", "tag", "n_words", "at", "size", "names"])

        out = docs.select("id", "text", "row", "tag").mapInArrow(spans, f"id {type_of}, row long, tag long, n_words long, at array<long>, size array<long>, names array<string>")
        out = out if b == 0 else out.where(F.size("at") > 0)
        parts = out if parts is None else parts.unionByName(out)
    merged = parts.groupBy("row", "tag").agg(
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("size")).alias("size"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"),
    )

    def merge(batches):
        for batch in batches:
            hit = [_covered(set(zip(a, k, strict=True))) for a, k in zip(batch.column("at").to_pylist(), batch.column("size").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("tag"), batch.column("n_words"), pa.array(hit, pa.int64()), batch.column("names")], names=["row", "tag", "n_words", "n_hit", "names"])

    done = docs.select("id", "row", "tag").join(merged.mapInArrow(merge, "row long, tag long, n_words long, n_hit long, names array<string>"), ["row", "tag"])
    return done.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of documents, with all their columns, that hold no benchmark window.

    Rows are judged one by one by their text, so ids may repeat or be null and columns may have any name; null texts
    stay. What one block of the benchmark leaves is written before the next, so each block reads less.
    """
    spark = ready(documents.sparkSession)
    indexed, blocks = blocks_of(benchmark, block_bytes)
    at = [c.lower() for c in documents.columns].index("text")
    for b in range(blocks):
        index = indexed(b)

        def keep(batches, index=index):
            for batch in batches:
                yield batch.filter(pa.array([not hits for _, hits in _rows(batch.column(at), index.value)], pa.bool_()))

        documents = documents.mapInArrow(keep, documents.schema)
        if b + 1 < blocks:
            documents = written(documents, f"{scratch(spark)}/clean")
    return documents


#: doc_id tells the rows of documents apart here.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b0 AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
b AS (SELECT item, w, least(len(w), {WINDOW}) AS k FROM b0 WHERE len(w) > 0), bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM b, unnest(range(1, len(w) - k + 2)) AS u(i)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM d, (SELECT DISTINCT k FROM b) AS s, unnest(range(1, len(w) - k + 2)) AS u(i)),
h AS (SELECT doc_id, k, i, item FROM dw JOIN bw USING (k, win)), p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + k)) AS u(j) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)
"""
