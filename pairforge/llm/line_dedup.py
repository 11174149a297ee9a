"""Line dedup over overlapping chunks of two lines.

A hash rolls over the line hashes and every two neighbouring lines make a chunk, so what stands around a repeated
passage moves none of its chunks and its first and last lines are in chunks of their own; a long line is also a chunk
by itself. Chunks that occur before, in order of (doc_id, row, chunk), are removed: hashes that occur more than once are
counted first, then their chunks are compared byte by byte. Thus each line of a passage of two lines or more that
occurs before is removed, and the first copy of a line always stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm import bitfilter
from pairforge.llm.shared import as_text, ready, scratch, written
from pairforge.llm.vectext import NOT_SPACE, grams, pieces, words

#: Lines of a chunk.
ROLL = 2
#: A line of so many words is long and counts alone.
LONG_WORDS = 40
_NOT_BREAK = np.ones(256, bool)
_NOT_BREAK[10] = False


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, line, start, end, hash) in bytes of the chunks of each row, by row and line. Lines without a word do not count; a chunk holds those between its lines."""
    lines, spans = words(data, offsets, _NOT_BREAK), words(data, offsets, NOT_SPACE)
    held = np.searchsorted(spans.start, lines.end) - np.searchsorted(spans.start, lines.start)
    some = held > 0
    row, start, end, h, held = lines.row[some], lines.start[some], lines.end[some], lines.hash[some], held[some]
    line = np.arange(len(row)) - np.searchsorted(row, row)
    pair = np.flatnonzero(row[1:] == row[:-1])
    long = np.flatnonzero(held >= LONG_WORDS)
    first, last = np.concatenate([pair, long]), np.concatenate([pair + ROLL - 1, long])
    h = np.concatenate([grams(h, ROLL)[pair], h[long]])
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    return row[first], line[first], start[first], end[last], h[order]


def keyed(documents: DataFrame) -> DataFrame:
    docs = as_text(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return docs.withColumns({"row": F.xxhash64("doc_id", "text"), "tag": F.xxhash64(F.lit(1), "text", "doc_id")})


def repeats(documents: DataFrame) -> DataFrame:
    """Chunks to be removed: row, tag, doc_id, chunk, start, end (bytes of the UTF-8 text), and first_row, first_tag, first_chunk, where they stay.

    row and tag are a hash of a document's id and text, so rows that repeat are one document here. The chunk of the
    least (doc_id, row, tag, chunk) stays, and so does one that begins within it; null ids come last. Chunks overlap.
    """
    spark, path = ready(documents.sparkSession), scratch(documents.sparkSession)
    docs = keyed(documents)

    def hashes(batches):
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                *_, h = chunked(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    counted = written(docs.select("text").mapInArrow(hashes, "h long").groupBy("h").count().where("count > 1").select("h"), f"{path}/counted")
    filter_ = bitfilter.made(counted, counted.count())

    def texts(batches):
        for batch in batches:
            for lo, _, data, offsets in pieces(batch.column(1)):
                row, line, start, end, h = chunked(data, offsets)
                keep = np.flatnonzero(bitfilter.passes(filter_.value, h))
                raw = data.tobytes()
                at = pa.array(row[keep] + lo)
                base = offsets[row[keep]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), batch.column(3).take(at), pa.array(line[keep]), pa.array(start[keep] - base), pa.array(end[keep] - base), pa.array(h[keep].view(np.int64)), pa.array([raw[a:b] for a, b in zip(start[keep].tolist(), end[keep].tolist(), strict=True)], pa.binary())], names=["doc_id", "row", "tag", "chunk", "start", "end", "h", "bytes"])

    found = docs.select("doc_id", "text", "row", "tag").mapInArrow(texts, "doc_id long, row long, tag long, chunk long, start long, end long, h long, bytes binary")
    found = written(found.withColumn("sha", F.sha2("bytes", 256)), f"{path}/found")
    # Equal bytes make a group, so texts whose hashes collide stay apart; copies meet before they move.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "tag", "chunk", "end")
    groups = written(found.groupBy("h", "bytes").agg(F.min(place).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", F.sha2("bytes", 256).alias("sha"), "keep.row", "keep.tag", "keep.chunk", "keep.end", "n").withColumnsRenamed({"row": "first_row", "tag": "first_tag", "chunk": "first_chunk", "end": "first_end"}), f"{path}/groups")
    total = found.count()
    heavy = max(total // 1024, 1)
    cells = found.drop("bytes")
    busy = F.broadcast(groups.where(F.col("n") > heavy))  # fewer than 1024
    hot = cells.join(busy, ["h", "sha"])
    cold = cells.join(F.broadcast(groups.where(F.col("n") > heavy).select("h", "sha")), ["h", "sha"], "left_anti").join(groups.where(F.col("n") <= heavy), ["h", "sha"])
    return hot.unionByName(cold).where("row != first_row or tag != first_tag or start >= first_end").select("row", "tag", "doc_id", "chunk", "start", "end", "first_row", "first_tag", "first_chunk").distinct()


def _merged(start: list[int], end: list[int]) -> tuple[list[int], list[int]]:
    """Sorted spans with those that overlap as one."""
    firsts: list[int] = []
    lasts: list[int] = []
    for a, b in zip(start, end, strict=True):
        if lasts and a < lasts[-1]:
            lasts[-1] = max(b, lasts[-1])
        else:
            firsts.append(a)
            lasts.append(b)
    return firsts, lasts


def dedup_lines(documents: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, text without repeated chunks, n_removed (passages), removed_bytes, removed (spans start:end in bytes of the UTF-8 text).

    Chunks that overlap are one passage. A passage is removed with the line break after it, or at the end of a text the one before it. A null text is empty,
    as may be what stays of a text; rows that repeat with id and text are one document and keep and lose the same
    chunks. Empty tables give empty results; texts are read whole, however long; other columns are ignored, whatever their names.
    """
    ready(documents.sparkSession)
    docs = keyed(documents)
    spans = repeats(documents).groupBy("row", "tag").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    joined = docs.join(spans, ["row", "tag"], "left").select("doc_id", "text", F.col("spans.start").alias("start"), F.col("spans.end").alias("end"))

    def cut(batches):
        for batch in batches:
            texts, n, gone, said = [], [], [], []
            for text, start, end in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                raw, out, at = text.encode(), [], 0
                start, end = _merged(start or [], end or [])
                for a, b in zip(start, end, strict=True):
                    out.append(raw[at:a])
                    at = b + 1
                out.append(raw[at:])
                kept = b"".join(out)
                if start and at > len(raw):
                    kept = kept.removesuffix(b"\n")
                texts.append(kept.decode())
                n.append(len(start))
                gone.append(len(raw) - len(kept))
                said.append(",".join(f"{a}:{b}" for a, b in zip(start, end, strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(said, pa.string())], names=["doc_id", "text", "n_removed", "removed_bytes", "removed"])

    return joined.mapInArrow(cut, "doc_id long, text string, n_removed long, removed_bytes long, removed string")
