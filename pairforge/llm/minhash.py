"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has T coordinates. In round i < T each element of a set falls in a hashed bin with value (i, hash); in round
i >= T every element falls in bin i - T. A coordinate keeps its least value, so after 2T rounds all are filled, and
for a set of many elements a few rounds do; the share of equal coordinates of two sketches estimates the Jaccard
similarity of their sets with the concentration of T independent samples. (Dahlgaard, Knudsen, Thorup: Fast
similarity sketching, FOCS 2017.)

Documents with one set (equal in size and in a digest of 128 bits over all its elements) form a class, and one of them
stands for it. Classes that agree on all R coordinates of a band share a bucket. Each member of a bucket is verified
against the bucket's leader on full sets; groups that links to leaders leave in several components are then verified
pair by pair between these components, in blocks.
Two sets of similarity 0.8 share no bucket with a chance of (1 - 0.8^R)^(T/R) < 5e-8.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm import bitfilter
from pairforge.llm.shared import as_text, join_groups, ready, removed, scratch, wrapped, written
from pairforge.llm.vectext import FOLD, NOT_SPACE, gram_at, mix, pieces, words
from pairforge.operators import graph

T, R = 128, 4
#: Words of a shingle unless a caller says otherwise, and the least similarity of a link.
SHINGLE, PERCENT = 5, 80
#: Elements of the sets that one block of a group may hold, and cells of one matrix.
BLOCK_ELEMENTS, CELLS = 1_000_000, 1 << 23
#: Members of a leader that one task verifies.
SALTED = 5000


def shingled(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, ascending; a row of fewer words has one for all of them."""
    s = words(FOLD[data], offsets, NOT_SPACE)
    n = np.diff(s.first)
    at = np.arange(len(s.start))
    full = at + shingle <= s.first[s.row + 1] if len(at) else np.zeros(0, bool)
    row, h = [s.row[full]], [gram_at(s.hash, at[full], shingle)]
    for k in range(1, shingle):
        short = np.flatnonzero(n == k)
        row.append(short)
        h.append(gram_at(s.hash, s.first[short], k))
    row, h = np.concatenate(row), np.concatenate(h)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def sketches(row: np.ndarray, h: np.ndarray, n: int, t: int = T) -> np.ndarray:
    """The n x t sketches of the sets of rows 0 to n - 1, which (row, h) list; 0 where a set is empty."""
    out = np.full(n * t, np.iinfo(np.uint64).max, np.uint64)
    round_of = np.full(n * t, 2 * t, np.int16)
    left = np.bincount(row, minlength=n) > 0
    for i in range(2 * t):
        live = left[row]
        if not live.any():
            break
        if not live.all():
            row, h = row[live], h[live]
        v = mix(h + np.uint64((i + 1) * 0xA24BAED4963EE407 % 2**64))
        at = row * t + ((v >> np.uint64(40)) % np.uint64(t)).astype(np.int64) if i < t else row * t + (i - t)
        fresh = round_of[at] >= i
        at, v = at[fresh], mix(v[fresh])
        np.minimum.at(out, at, v)
        round_of[at] = i
        if i % 2 or i < 4 or i >= t:
            left = left & (round_of.reshape(n, t) == 2 * t).any(axis=1)
    return np.where(round_of == 2 * t, 0, mix(out + round_of.astype(np.uint64))).reshape(n, t)


def _sketch(batches, shingle: int):
    for batch in batches:
        sizes, one, two, bands = [], [], [], []
        for lo, hi, data, offsets in pieces(batch.column(1)):
            n = hi - lo
            row, h = shingled(data, offsets, shingle)
            size = np.bincount(row, minlength=n)
            sizes.append(size)
            raw, ends = memoryview(h.tobytes()), (8 * np.cumsum(size)).tolist()
            digest = b"".join(blake2b(raw[a:b], digest_size=16).digest() for a, b in zip([0, *ends[:-1]], ends, strict=True))
            one.append(np.frombuffer(digest, np.int64)[::2])
            two.append(np.frombuffer(digest, np.int64)[1::2])
            sk = sketches(row, h, n)
            b = np.zeros((n, T // R), np.uint64)
            for i in range(R):
                b = mix(b * np.uint64(31) + sk[:, i::R])
            bands.append(mix(b + np.arange(T // R, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        if not sizes:
            continue
        size, b = np.concatenate(sizes), np.concatenate(bands)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, T // R, 0))]), pa.int32()), pa.array(b[size > 0].ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(np.concatenate(one)), pa.array(np.concatenate(two)), lists], names=["doc_id", "n_shingles", "one", "two", "bands"])


def sets_of(docs: DataFrame, ids: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, items) of the documents of ids: a filter of bounded size leaves out most others before rows move."""
    filter_ = bitfilter.made(ids.select("doc_id"), ids.count())

    def scan(batches):
        for batch in batches:
            batch = batch.filter(pa.array(bitfilter.passes(filter_.value, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))))
            for lo, hi, data, offsets in pieces(batch.column(1)):
                row, h = shingled(data, offsets, shingle)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64)))], names=["doc_id", "items"])

    return docs.mapInArrow(scan, "doc_id long, items array<long>").join(ids, "doc_id", "left_semi")


def _between(table):
    """Links between components of a block, or of its two sides, on full sets."""
    ids, side, part = (table.column(c).to_numpy() for c in ("doc_id", "side", "component"))
    items = table.column("items").combine_chunks()
    offsets = items.offsets.to_numpy().astype(np.int64)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(ids)), size)
    token, code, df = np.unique(items.values.to_numpy()[offsets[0] : offsets[-1]], return_inverse=True, return_counts=True)
    shared = df[code] > 1
    row, code = row[shared], np.searchsorted(np.flatnonzero(df > 1), code[shared])
    wide = int((df > 1).sum())
    diagonal = side.min() == side.max()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    order = np.argsort(code, kind="stable")
    by_code, starts = row[order], np.searchsorted(code[order], np.arange(wide + 1))
    heads = np.searchsorted(row, np.arange(len(ids) + 1))
    step = max(1, CELLS // max(len(ids), wide, 1))
    dense = len(ids) * wide <= CELLS
    if dense:
        all_ = np.zeros((len(ids), wide), np.float32)
        all_[row, code] = 1
    _, c = np.unique(part, return_inverse=True)
    most = np.bincount(c).argmax()
    # Of two documents in different components one at least is outside the largest component of the block.
    lead = np.flatnonzero(c != most)
    for lo in range(0, len(lead), step):
        mine = lead[lo : lo + step]
        if dense:
            inter = all_[mine] @ all_.T
        else:
            inter = np.zeros((len(mine), len(ids)), np.float32)
            for k, i in enumerate(mine.tolist()):
                own = code[heads[i] : heads[i + 1]]
                lens = starts[own + 1] - starts[own]
                at = np.arange(int(lens.sum())) + np.repeat(starts[own] - (np.cumsum(lens) - lens), lens)
                inter[k] = np.bincount(by_code[at], minlength=len(ids))
        union = size[mine][:, None] + size[None, :] - inter
        link = (100 * inter >= PERCENT * union) & (part[mine][:, None] != part[None, :]) & (inter > 0)
        if not diagonal:
            link &= side[mine][:, None] != side[None, :]
        i, j = np.nonzero(link)
        found.append((ids[mine[i]], ids[j]))
    a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component_id) of all ends of links (a, b): the least id reachable."""
    return graph.components(links, "a", "b").withColumnsRenamed({"key": "doc_id", "component": "component_id"})


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row of documents: doc_id, n_shingles, component_id, kept, by sets of so many words in a row.

    Null and empty texts and texts without words have an empty set and are linked with nothing. A row without doc_id
    is linked with nothing either: component_id is null and kept true. Rows that repeat a doc_id are one document
    with several sets: they share a component. Empty tables give empty results; texts are read whole, however long.
    Other columns are ignored, whatever their names.
    """
    spark, path = ready(documents.sparkSession), scratch(documents.sparkSession)
    docs = as_text(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = written(docs.mapInArrow(lambda batches: _sketch(batches, shingle), "doc_id long, n_shingles long, one long, two long, bands array<long>"), f"{path}/sketches")
    real = base.where("doc_id is not null and n_shingles > 0")
    total = real.count()
    keys = ["n_shingles", "one", "two"]
    classes = written(real.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members")), f"{path}/classes")
    own = written(join_groups(real.select("doc_id", *keys), classes, keys, "members", total).select("doc_id", "rep", *keys), f"{path}/own")

    reps = real.join(own.where("doc_id = rep").select("doc_id", *keys).distinct(), ["doc_id", *keys], "left_semi").dropDuplicates(["doc_id", *keys])
    banded = reps.select("doc_id", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "leader")
    met = written(banded.join(buckets, "band").select("leader", "doc_id").distinct(), f"{path}/met")
    docs = docs.where("doc_id is not null")
    # Sets of the representatives that share a bucket; a document of several sets has a row for each.
    sets = written(sets_of(docs, written(met.select("doc_id").distinct(), f"{path}/asked"), shingle).where(F.size("items") > 0).distinct(), f"{path}/sets")
    pairs = met.where("doc_id != leader")
    salts = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / SALTED).cast("int").alias("salts"))
    leaders = sets.join(salts, sets.doc_id == salts.leader).select("leader", F.col("items").alias("other"), F.explode(F.sequence(F.lit(1), "salts")).alias("salt"), "salts")
    asked = pairs.join(F.broadcast(salts.where("salts > 1")) if total * (T // R) // SALTED < 1_000_000 else salts.where("salts > 1"), "leader", "left")
    asked = asked.select("leader", "doc_id", (F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))) + 1).cast("int").alias("salt"))
    both = asked.join(sets, "doc_id").join(leaders.drop("salts"), ["leader", "salt"])
    inter = F.size(F.array_intersect("items", "other"))
    linked = both.select("leader", "doc_id", inter.alias("i"), (F.size("items") + F.size("other")).alias("n")).where(f"i > 0 and 100 * i >= {PERCENT} * (n - i)")
    links = written(linked.select(F.least("leader", "doc_id").alias("a"), F.greatest("leader", "doc_id").alias("b")).distinct(), f"{path}/links")

    stars = components(links.unionByName(own.where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))
    placed = met.join(stars, "doc_id", "left").withColumn("component", F.coalesce("component_id", "doc_id")).drop("component_id")
    sized = sets.select("doc_id", F.size("items").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"))
    placed = written(placed.join(sized, "doc_id"), f"{path}/placed")
    open_ = placed.groupBy("leader").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("x"), F.max("component").alias("y"), F.sum("n").alias("n"))
    open_ = open_.where("m > 2 and x != y").select("leader", F.ceil(F.col("n") / BLOCK_ELEMENTS).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    spread = placed.join(open_, "leader").withColumn("block", block).select("leader", "doc_id", "component", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("leader", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block").alias("side"), "doc_id", "component")
    more = spread.join(sets, "doc_id").groupBy("leader", "i", "j").applyInArrow(_between, "a long, b long").distinct()
    links = stars.where("doc_id != component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).unionByName(more)
    final = components(links)
    for used in ("classes", "own", "met", "asked", "sets", "links", "placed"):
        removed(spark, f"{path}/{used}")
    out = base.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def kept(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of documents, with all their columns, that stay: one of each component, that of the least doc_id.

    Rows are told apart by their place where ids repeat or are null, so a row goes only if its own text is linked; the
    first row of a component stays then. Rows without words all stay; columns may have any name.
    """
    spark = ready(documents.sparkSession)
    rows = wrapped(documents)
    if not documents.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        rows = written(rows.withColumn("doc_id", F.monotonically_increasing_id()), f"{scratch(spark)}/rows")
    gone = near_duplicates(rows.select("doc_id", "text"), shingle).where("not kept").select("doc_id").distinct()
    return rows.join(gone, "doc_id", "left_anti").select("r.*")
