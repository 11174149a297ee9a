"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens. Window after window, the round takes a quantum from every queue in order: its share
of the window under the target proportions. What a quantum lacks of a whole token, or a queue of its quantum, stays
as deficit and is added in the next window, so after j windows a queue has given floor(j * share) tokens of a stretch.
This closed form needs nothing but a queue's own total: every task computes by itself the windows of its documents'
tokens, and deficits carry over partitions as they do over windows. Where a queue stands in a window is a table of
(queue, window), so sources may be as many as there are documents. The windows follow each other without gap and are
cut into sequences of SEQUENCE tokens; only the end of the corpus remains, cut into powers of two.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pairforge.llm.shared import as_text, ready, scratch, written
from pairforge.llm.vectext import Known, hashed, pieces

SEQUENCE, WINDOW_SEQUENCES = 1024, 256
#: Windows whose totals are added up in one group.
BLOCK = 4096
#: Pre-tokens that a worker keeps the ids of.
CACHE = 500_000

#: Code points with the White_Space property (fixed by Unicode).
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_LETTER, _NUMBER, _OTHER, _SPACE, _UNSURE = range(5)


def _classes() -> np.ndarray:
    """The class of each code point. Apostrophes can begin contractions, and unassigned code points can be letters to a newer library: rows with either are left to the tokenizer as a whole."""
    import unicodedata

    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kinds.get((c := unicodedata.category(chr(i)))[0], _UNSURE if c == "Cn" else _OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = _SPACE
    out[0x27] = _UNSURE
    return out


class Encoder:
    """Ids of whole slices of rows, with each distinct pre-token encoded once."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The tokenizer finds added tokens before it cuts pre-tokens: rows that hold one are left to it as a whole.
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.classes = _classes()
        self.clear()

    def clear(self) -> None:
        self.known = Known()
        self.flat, self.used = np.zeros(1 << 16, np.uint16), 0
        self.at, self.len = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def add(self, keys: np.ndarray, texts: list[str]) -> np.ndarray:
        numbers = self.known.add(keys)
        for i, e in zip(numbers.tolist(), self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            n = len(e.ids)
            if i >= len(self.at):
                self.at, self.len = np.resize(self.at, 2 * i), np.resize(self.len, 2 * i)
            while self.used + n > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.flat[self.used : self.used + n] = e.ids
            self.at[i], self.len[i] = self.used, n
            self.used += n
        return numbers

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each row."""
        n = len(offsets) - 1
        raw = data.tobytes()
        try:
            cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
        except UnicodeDecodeError:  # bytes that are no UTF-8 count as replacement characters
            return [np.asarray(self.tokenizer.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint16) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        kind = self.classes[cp]
        byte = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000), out=byte[1:])
        rows = np.searchsorted(byte, offsets)
        odd = np.zeros(n, bool)
        odd[np.searchsorted(rows, np.flatnonzero(kind == _UNSURE), "right") - 1] = True
        for text in self.added:
            at = raw.find(text)
            while at >= 0:
                i = int(np.searchsorted(offsets, at, "right")) - 1
                odd[i] = True
                at = raw.find(text, int(offsets[i + 1]))
        head = np.zeros(len(cp) + 1, bool)
        head[rows] = True
        space = kind == _SPACE
        fresh = np.ones(len(cp), bool)  # the character before is of another kind or another row
        fresh[1:] = kind[1:] != kind[:-1]
        fresh |= head[:-1]
        blank = np.zeros(len(cp), bool)  # the character before is a blank of this row
        blank[1:] = cp[:-1] == 32
        blank &= ~head[:-1]
        last = np.zeros(len(cp), bool)  # a space before another character of this row
        last[:-1] = space[:-1] & ~space[1:]
        last &= ~head[1:]
        start = np.flatnonzero(np.where(space, fresh | last, fresh & ~blank))
        first = np.searchsorted(start, rows)
        a = byte[start]
        b = np.append(a[1:], len(data)) if len(a) else a
        h, inverse = np.unique(hashed(data, a, b), return_inverse=True)
        if len(self.known) + len(h) > CACHE:
            self.clear()
        numbers = self.known.find(h)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            where = np.zeros(len(h), np.int64)
            where[inverse] = np.arange(len(inverse))
            w = where[missing]
            numbers[missing] = self.add(h[missing], [raw[x:y].decode("utf-8") for x, y in zip(a[w].tolist(), b[w].tolist(), strict=True)])
        index = numbers[inverse]
        lens = self.len[index]
        ends = np.concatenate([[0], np.cumsum(lens)])
        ids = self.flat[np.arange(int(ends[-1])) + np.repeat(self.at[index] - ends[:-1], lens)]
        cuts = ends[first].tolist()
        out = [ids[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in np.flatnonzero(odd).tolist():
            text = raw[int(offsets[i]) : int(offsets[i + 1])].decode("utf-8")
            out[i] = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)
        return out


def encoder(path: str) -> Encoder:
    """This process's encoder; a worker keeps it for its next tasks."""
    kept = sys.modules.setdefault("_pairforge_encoders", type(sys)("_pairforge_encoders"))
    if path not in kept.__dict__:
        setattr(kept, path, Encoder(path))
    return kept.__dict__[path]


#: Stretches of windows in which a queue takes part: (first window, windows, tokens of the queue before it, its tokens there).
Stretches = list[tuple[int, int, int, int]]


def schedule(totals: dict[str, int], weights: dict[str, float], window: int) -> tuple[dict[str, Stretches], int]:
    """The stretches of each queue with a weight, and the windows that they take.

    A queue that runs dry leaves its share to the rest in proportion.
    """
    want = {q: Fraction(w).limit_denominator(10**9) for q, w in sorted(weights.items()) if w > 0 and totals.get(q, 0) > 0}
    left = {q: totals[q] for q in want}
    out: dict[str, Stretches] = {q: [] for q in want}
    j = 0
    while live := [q for q in want if left[q]]:
        whole = sum(want[q] for q in live)
        quantum = {q: want[q] / whole * window for q in live}
        n = max(1, min(int(left[q] / quantum[q]) for q in live))
        for q in live:
            amount = min(left[q], max(1, int(quantum[q] * n)))
            out[q].append((j, n, totals[q] - left[q], amount))
            left[q] -= amount
        j += n
    return out, j


def shares(stretches: Stretches, x: int, to: int) -> Iterator[tuple[int, int, int]]:
    """(window, first token, end) of each window that takes tokens x to to of a queue, whole windows."""
    for first, n, base, amount in stretches:
        while base <= x < min(to, base + amount):
            k = ((x - base + 1) * n - 1) // amount
            start, end = base + k * amount // n, base + (k + 1) * amount // n
            yield first + k, start, end
            x = end


def cuts(place: int, n: int, total: int, sequence: int = SEQUENCE) -> Iterator[tuple[int, int, int]]:
    """(length, sequence, offset) of the pieces of n tokens from a place in the whole output of total tokens."""
    end, full = place + n, total // sequence
    while place < end:
        number, at = divmod(place, sequence)
        room = sequence
        if number == full:
            rest = total - full * sequence
            for bit in reversed(range(rest.bit_length())):
                if rest >> bit & 1:
                    room = 1 << bit
                    if at < room:
                        break
                    at, number = at - room, number + 1
        take = min(end - place, room - at)
        yield take, number, at
        place += take


def tokenised(documents: DataFrame, tokenizer: str, path: str) -> DataFrame:
    """Writes doc_id, queue, chunk, x, n, ids: x counts a chunk's tokens of the queue before the document."""
    spark = ready(documents.sparkSession)
    docs = as_text(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text"))
    docs = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("queue"), "text")

    def scan(batches):
        coder, chunk, before = encoder(tokenizer), TaskContext.get().partitionId(), {}
        for batch in batches:
            queues = batch.column(1).to_pylist()
            for lo, hi, data, offsets in pieces(batch.column(2)):
                ids = coder.encode(data, offsets)
                x, n = [], []
                for q, e in zip(queues[lo:hi], ids, strict=True):
                    x.append(before.get(q, 0))
                    n.append(len(e) + 1)
                    before[q] = x[-1] + n[-1]
                sizes = np.asarray(n, np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                short = np.zeros(int(ends[-1]), np.uint16)
                inside = np.ones(len(short), bool)
                inside[ends[1:] - 1] = False
                short[inside] = np.concatenate(ids)
                raw = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(short)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([chunk] * (hi - lo), pa.int32()), pa.array(x, pa.int64()), pa.array(sizes), raw], names=["doc_id", "queue", "chunk", "x", "n", "ids"])

    out = docs.mapInArrow(scan, "doc_id long, queue string, chunk int, x long, n long, ids binary")
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def pack(documents: DataFrame, tokenizer: str, weights: dict[str, float] | None = None, window_sequences: int = WINDOW_SEQUENCES) -> DataFrame:
    """Per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window.

    tokenizer: a tokenizers file of at most 65,536 ids. weights: target proportion by source; sources without one come
    after the others, in proportion to their tokens. A null text is empty, so its document is the final id 0 alone; null sources are one queue;
    rows that repeat are packed each; a null doc_id is kept. An empty table gives no pieces. Other columns are ignored.
    """
    spark = ready(documents.sparkSession)
    path = scratch(spark)
    tokens = tokenised(documents, tokenizer, f"{path}/tokens")
    chunks = written(tokens.groupBy("queue", "chunk").agg(F.sum("n").alias("n")), f"{path}/chunks")
    queues = chunks.groupBy("queue").agg(F.sum("n").alias("amount"))
    size = SEQUENCE * window_sequences
    asked = {f"={source}": weight for source, weight in (weights or {}).items()}
    named, first = schedule({r.queue: r.amount for r in queues.where(F.col("queue").isin(*asked)).collect()}, asked, size) if asked else ({}, 0)
    total = chunks.agg(F.sum("n")).head()[0] or 0
    rest = total - sum(amount for stretches in named.values() for *_, amount in stretches)
    windows = -(-rest // size)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("queue").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    amount = F.sum("n").over(Window.partitionBy("queue"))
    bases = written(chunks.select("queue", "chunk", "n", before.alias("before"), amount.alias("amount")), f"{path}/bases")

    def stretched(queue: str, amount: int) -> Stretches:
        return named.get(queue) or [(first, windows, 0, amount)]

    def cells(batches):
        """The windows whose first token of a queue is in a chunk, so each (queue, window) comes from one chunk."""
        for batch in batches:
            for queue, n, x, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = (s for s in shares(stretched(queue, held), x, x + n) if s[1] >= x)
                while some := list(islice(found, 1 << 16)):
                    window, a, b = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([queue] * len(some), pa.string()), pa.array(window, pa.int64()), pa.array(np.subtract(b, a), pa.int64())], names=["queue", "window", "n"])

    taken = written(bases.repartition("queue", "chunk").select("queue", "n", "before", "amount").mapInArrow(cells, "queue string, window long, n long"), f"{path}/cells")
    # Where a window begins: tokens of the blocks of windows before its own, and of the windows before it in its block.
    block = F.floor(F.col("window") / BLOCK).alias("block")
    preceding = (Window.unboundedPreceding, -1)
    by_window = taken.groupBy("window").agg(F.sum("n").alias("n")).select("window", "n", block)
    by_block = by_window.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(*preceding)), F.lit(0)).alias("base"))
    begins = by_window.select("window", "block", F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("window").rowsBetween(*preceding)), F.lit(0)).alias("within")).join(by_block, "block").select("window", (F.col("base") + F.col("within")).alias("begin"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("window").orderBy("queue").rowsBetween(*preceding)), F.lit(0))  # a window has at most as many queues as tokens
    places = written(taken.select("queue", "window", inside.alias("inside")).join(begins, "window").select("queue", "window", (F.col("begin") + F.col("inside")).alias("place")), f"{path}/places")

    def divided(batches):
        for batch in batches:
            doc, out = [], []
            for i, (queue, x, n, ids, held) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("queue", "x", "n", "ids", "amount")), strict=True)):
                for window, a, b in shares(stretched(queue, held), x, x + n):
                    lo, hi = max(a, x), min(b, x + n)
                    doc.append(i)
                    out.append((window, lo - a, lo - x, n, ids[2 * (lo - x) : 2 * (hi - x)]))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            at = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("queue").take(at), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names=["doc_id", "queue", "window", "at", "start", "doc_tokens", "ids"])

    # Without hints: broadcast while the tables of chunks and of cells are under the session's threshold, shuffled beyond. A cell holds at most a window of tokens.
    based = tokens.join(bases.drop("n"), ["queue", "chunk"]).select("doc_id", "queue", (F.col("before") + F.col("x")).alias("x"), "n", "ids", "amount")
    placed = based.mapInArrow(divided, "doc_id long, queue string, window long, at long, start long, doc_tokens long, ids binary").join(places, ["queue", "window"]).select("doc_id", "window", (F.col("place") + F.col("at")).alias("place"), "start", "doc_tokens", "ids")

    def cut(batches):
        for batch in batches:
            doc, rows = [], []
            for i, (window, place, start, n, ids) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                long, at = np.frombuffer(ids, np.uint16).astype("<u4"), 0
                for length, sequence, offset in cuts(place, len(long), total):
                    doc.append(i)
                    rows.append((start + at, length, zlib.crc32(long[at : at + length]), n, sequence, offset, window))
                    at += length
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names=NAMES)

    return placed.mapInArrow(cut, T.StructType([T.StructField(c, T.LongType()) for c in NAMES]))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window"]
