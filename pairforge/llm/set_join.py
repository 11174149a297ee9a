"""N-gram Jaccard self-join by a token-group matrix: similar documents form groups, a group is known by the union of its tokens.

For sets Q and S of similarity s or more, Q shares at least s * |Q| tokens with S, so with the union of any group that holds S.
A group whose union has fewer tokens of Q is not opened for Q (Li et al., LES3: Learning-based exact set similarity search, 2021).

1. Tokens are ordered by how often they occur, frequent ones last (counts of hashed slots: any order common to all sets is right,
   this one is fast). The first |Q| - ceil(s |Q|) + 1 + e tokens of Q are its prefix, e = EXTRA + |Q| / PART: two similar sets
   share more tokens of their prefixes than the lesser e, or all if they have fewer to share (Wang et al., Can we beat the prefix filtering?, 2012).
2. Equal sets are one class. A class joins the group of the leader (the least class with a token) that shares most of its prefix;
   groups are cut into blocks of bounded size. Classes of a block that share enough with their leader for a link, and the leader
   itself, are linked exactly; those linked with the leader are one component in all blocks.
3. The matrix holds (token, block) for the tokens of prefixes. A class meets the blocks that have enough of its prefix and a
   size that fits, but not those whose members all are in its component already; its own one only if step 2 left it out.
4. Its whole set is bounded against the union of each block it meets. Blocks that pass are opened: all members are compared.

Links within a component are not listed, so a group of very many near copies costs its size, not its square.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm import bitfilter
from pairforge.llm.minhash import shingled
from pairforge.llm.shared import as_text, join_groups, ready, removed, scratch, written
from pairforge.llm.vectext import mix, pieces
from pairforge.operators import graph

SHINGLE, PERCENT = 3, 90
#: Tokens of a prefix beyond those that must meet one: so many, and one of so many of the set. Passages that texts share then don't suffice.
EXTRA, PART = 7, 20
#: Tokens of the members of a block, tokens of the queries that one task bounds against it, and cells of one matrix.
BLOCK_TOKENS, QUERY_TOKENS, CELLS = 128_000, 128_000, 1 << 22
#: Least and most slots of the counts that order tokens, as powers of two, and slots of a page of them. A slot takes one byte.
LEAST_SLOTS, MOST_SLOTS, PAGE = 18, 24, 1 << 15


def token_order(docs: DataFrame, shingle: int):
    """Broadcasts one byte for each slot of hashed tokens: the logarithm of how often its tokens occur, in eighths of an octave.

    Tasks count into bytes, which stop at 255, and send the counts that stand out from what chance puts in a slot, so what
    they send is small and what is frequent shows at every size. The driver gets at most 2**MOST_SLOTS bytes.
    """
    letters = docs.agg(F.sum(F.length("text"))).head()[0] or 0
    slots = 1 << min(MOST_SLOTS, max(LEAST_SLOTS, (letters // 4).bit_length()))

    def count(batches):
        held, total = np.zeros(slots, np.uint8), 0
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(1)):
                at, n = np.unique(_slot(shingled(data, offsets, shingle)[1], slots), return_counts=True)
                held[at] = np.minimum(held[at] + n, 255)
                total += int(n.sum())
        held[held <= 1 + 4 * total / slots] = 0
        for page in np.flatnonzero(held.reshape(-1, PAGE).any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([held[page * PAGE : (page + 1) * PAGE].tobytes()], pa.binary())], names=["page", "counts"])

    def merge(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(data, np.uint8).astype(np.uint32)
                found[page] = found[page] + got if page in found else got
        for page, got in found.items():
            byte = np.minimum(8 * np.log2(1 + got), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([byte.tobytes()], pa.binary())], names=["page", "counts"])

    order = np.zeros(slots, np.uint8)
    schema = "page int, counts binary"
    for r in docs.mapInArrow(count, schema).repartition(16, "page").mapInArrow(merge, schema).collect():  # at most 2**MOST_SLOTS bytes
        order[r.page * PAGE : (r.page + 1) * PAGE] = np.frombuffer(r.counts, np.uint8)
    return docs.sparkSession.sparkContext.broadcast(order)


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    return (mix(h ^ np.uint64(0x5DEECE66D)) & np.uint64(slots - 1)).astype(np.int64)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a similar set must share with a set of n."""
    return -(-percent * n // 100)


def _digests(h: np.ndarray, size: np.ndarray) -> list[bytes]:
    raw, ends = memoryview(h.tobytes()), (8 * np.cumsum(size)).tolist()
    return [blake2b(raw[a:b], digest_size=16).digest() for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _lists(values: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values.view(np.int64)))


def prefixes(docs: DataFrame, order, shingle: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, cid (a digest of the set), prefix of each row."""

    def scan(batches):
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(1)):
                row, h = shingled(data, offsets, shingle)
                size = np.bincount(row, minlength=hi - lo)
                rank = (order.value[_slot(h, len(order.value))].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
                best = np.lexsort((rank, row))
                place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
                length = np.minimum(size - needed(size, percent) + 1 + EXTRA + size // PART, size)
                head = best[place < length[row]]
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(_digests(h, size), pa.binary()), _lists(h[head], length)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "cid", "prefix"])

    return docs.mapInArrow(scan, "doc_id long, n_shingles long, cid binary, prefix array<long>")


def shared_tokens(base: DataFrame, least: int) -> DataFrame:
    """token, leader (the least c with it), size (rows) of the tokens in the prefixes of two different sets of at least so many tokens."""
    each = base.where(F.col("n_shingles") >= least).select(F.xxhash64("cid").alias("c"), F.explode("prefix").alias("token"))
    return each.groupBy("token").agg(F.min("c").alias("leader"), F.max("c").alias("y"), F.count(F.lit(1)).alias("size")).where("leader != y").drop("y")


def meeting(base: DataFrame, tokens: DataFrame, n: int, total: int, least: int) -> DataFrame:
    """c, token, leader of the n tokens given: a filter of bounded size leaves out most others of the total before rows move."""
    filter_ = bitfilter.made(tokens.select("token"), n)

    def scan(batches):
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            use = np.flatnonzero(bitfilter.passes(filter_.value, values)) if len(values) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[use])), pa.array(values[use])], names=["c", "token"])

    rows = base.where(F.col("n_shingles") >= least).select(F.xxhash64("cid").alias("c"), "prefix")
    return join_groups(rows.mapInArrow(scan, "c long, token long"), tokens, ["token"], "size", total).select("token", "c", "leader").distinct()


def sets_of(docs: DataFrame, asked: DataFrame, shingle: int, repeats: bool) -> DataFrame:
    """asked (cid, doc_id and more) with the items of its sets: a filter of bounded size leaves out most other rows before they are cut.

    repeats: whether several rows may have the doc_id and the set of one class.
    """
    filter_ = bitfilter.made(asked.select("doc_id"), asked.count())

    def scan(batches):
        for batch in batches:
            batch = batch.filter(pa.array(bitfilter.passes(filter_.value, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))))
            for lo, hi, data, offsets in pieces(batch.column(1)):
                row, h = shingled(data, offsets, shingle)
                size = np.bincount(row, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(_digests(h, size), pa.binary()), _lists(h, size)], names=["doc_id", "cid", "items"])

    found = docs.mapInArrow(scan, "doc_id long, cid binary, items array<long>")
    return (found.dropDuplicates(["cid", "doc_id"]) if repeats else found).join(asked, ["cid", "doc_id"]).drop("doc_id")


class _Sets:
    """Sets of a block: items of set i are flat[first[i]:first[i + 1]]."""

    def __init__(self, column):
        items = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
        offsets = items.offsets.to_numpy().astype(np.int64)
        self.flat = items.values.to_numpy()[offsets[0] : offsets[-1]]
        self.first = offsets - offsets[0]
        self.size = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.size)


def similar(queries: _Sets, members: _Sets, percent: int):
    """Yields arrays (query, member) of similar sets, after the bound: queries that share too little with all members together are left out."""
    token, code = np.unique(members.flat, return_inverse=True)
    by_code = np.repeat(np.arange(len(members)), members.size)[np.argsort(code, kind="stable")]
    start = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(token)))])
    at = np.minimum(np.searchsorted(token, queries.flat), max(len(token) - 1, 0))
    hit = token[at] == queries.flat if len(token) else np.zeros(len(queries.flat), bool)
    row = np.repeat(np.arange(len(queries)), queries.size)
    shared = np.bincount(row[hit], minlength=len(queries))
    opened = (shared >= needed(queries.size, percent)) & (queries.size > 0)
    use = hit & opened[row]
    row, at = row[use], at[use]
    width = start[at + 1] - start[at]
    load = np.cumsum(np.bincount(row, weights=width, minlength=len(queries)) + len(members) * opened)
    lo = 0
    while lo < len(queries):
        done = load[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(load, done + CELLS, "right")))
        a, b = np.searchsorted(row, [lo, hi])
        w = width[a:b]
        posts = by_code[np.arange(int(w.sum())) + np.repeat(start[at[a:b]] - (np.cumsum(w) - w), w)]
        mine = np.flatnonzero(opened[lo:hi])  # rows of the matrix
        place = np.full(hi - lo, -1)
        place[mine] = np.arange(len(mine))
        inter = np.bincount(np.repeat(place[row[a:b] - lo], w) * len(members) + posts, minlength=len(mine) * len(members)).reshape(len(mine), -1) if len(mine) else np.zeros((0, len(members)), np.int64)
        union = queries.size[lo + mine][:, None] + members.size[None, :] - inter
        q, m = np.nonzero((100 * inter >= percent * union) & (inter > 0))
        yield lo + mine[q], m
        lo = hi


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that links lead to from each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _within(percent: int):
    def links(table):
        """The component of each set of a block: the name of the head if it is connected with that, else of the first it is connected with."""
        sets, cid = _Sets(table.column("items")), table.column("cid").combine_chunks()
        head = table.column("head").to_numpy(zero_copy_only=False).astype(bool)
        a, b = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 2, *similar(sets, sets, percent), strict=True))
        to = _spanning(len(sets), a, b)
        name = np.arange(len(sets))
        name[to[head]] = np.flatnonzero(head)
        own = np.flatnonzero(~head)
        return pa.table({"cid": cid.take(pa.array(own)), "component": cid.take(pa.array(name[to[own]]))})

    return links


def _across(percent: int):
    def links(table):
        """Components of queries and of members of a block that are linked."""
        asks = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
        _, part = np.unique(np.array(table.column("component").to_pylist(), object), return_inverse=True)
        names = table.column("component").combine_chunks()
        pick = lambda rows: _Sets(table.column("items").take(pa.array(rows)).combine_chunks())
        q_rows, m_rows = np.flatnonzero(asks), np.flatnonzero(~asks)
        found = []
        for q, m in similar(pick(q_rows), pick(m_rows), percent):
            q, m = q_rows[q], m_rows[m]
            apart = part[q] != part[m]
            pair = np.stack([q[apart], m[apart]], axis=1)
            _, first = np.unique(part[pair[:, 0]] * len(part) + part[pair[:, 1]], return_index=True)
            found.append(pair[first])
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": names.take(pa.array(pairs[:, 0])), "b": names.take(pa.array(pairs[:, 1]))})

    return links


def _components(links: DataFrame) -> DataFrame:
    return graph.components(links, "a", "b").withColumnRenamed("key", "cid")


def join(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of documents: doc_id, n_shingles, component_id (the least doc_id that links lead to, its own included).

    A set is the distinct shingles of so many words, compared by 64-bit hashes; rows of equal sets (by a digest of 128 bits) are
    linked. Null and empty texts and texts without words have an empty set and are linked with nothing. Every row stands for
    itself, so rows that repeat a doc_id are linked by their texts alone. A row without doc_id is linked with nothing and has no
    component_id. A pair at exactly percent is linked. An empty table gives an empty result; texts are read whole, however
    long; other columns are ignored, whatever their names.
    """
    spark, path = ready(documents.sparkSession), scratch(documents.sparkSession)
    docs = as_text(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = written(prefixes(docs, token_order(docs, shingle), shingle, percent), f"{path}/prefixes")
    real = base.where("doc_id is not null and n_shingles > 0")
    rows = real.groupBy("cid", "doc_id").agg(F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("k"))
    classes = rows.groupBy("cid").agg(F.min(F.struct("doc_id", "n", "k")).alias("r"), F.sum("k").alias("members"))
    # c finds the classes of candidates: two classes with one c, should there be any, are candidates together.
    classes = written(classes.select("cid", F.xxhash64("cid").alias("c"), "r.*", "members"), f"{path}/classes")
    n_classes, repeats = classes.count(), not classes.where("k > 1").isEmpty()

    # A set of fewer tokens than this is similar to equal ones only.
    least = -(-percent // max(100 - percent, 1))
    common = written(shared_tokens(real, least), f"{path}/common")
    total = base.agg(F.sum(F.size("prefix"))).head()[0] or 0
    shared = written(meeting(real, common, common.count(), total, least), f"{path}/shared")
    own_share = F.ceil(F.lit(percent) * F.col("n") / 100)
    enough = F.least(EXTRA + 1 + F.floor(own_share / PART), own_share)
    found = shared.repartition("c").groupBy("c", "leader").agg(F.count(F.lit(1)).alias("k")).groupBy("c").agg(F.sum("k").alias("found"), F.max(F.struct("k", "leader")).alias("top"))
    placed = found.join(classes.select("cid", "c", "n"), "c").where(F.col("found") >= enough)
    placed = written(placed.select("cid", "c", "n", F.col("top.leader").alias("leader"), (F.col("top.k") < enough).alias("weak")), f"{path}/able")
    blocks = placed.groupBy("leader").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks"))
    placed = placed.join(blocks.where("blocks > 1"), "leader", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = written(placed.withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int")), f"{path}/placed")

    # Members of groups, and the leader in each block of its group.
    led = placed.where("leader != c and not weak")
    heads = led.select("leader", "blocks").distinct().select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    heads = heads.join(classes.select("cid", F.col("c").alias("leader")), "leader").select("cid", "leader", "block", F.lit(True).alias("head"))
    named = classes.select("cid", "doc_id")
    asked = written(led.select("cid", "leader", "block", F.lit(False).alias("head")).unionByName(heads).join(named, "cid"), f"{path}/asked")
    docs = docs.where("doc_id is not null")
    near = sets_of(docs, asked, shingle, repeats).groupBy("leader", "block").applyInArrow(_within(percent), "cid binary, component binary")
    inner = written(near, f"{path}/inner")

    own = placed.join(inner, "cid", "left").withColumn("component", F.coalesce("component", "cid")).drop("blocks")
    own = written(own, f"{path}/own")
    tokens = shared.select("c", "token").join(own, "c").drop("c")
    cell = F.struct("leader", "block")
    open_ = tokens.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min(cell).alias("p"), F.max(cell).alias("q"), F.max("weak").alias("weak"), F.count(F.lit(1)).alias("size"))
    open_ = open_.where("x != y and (p != q or weak)").select("token", "size")
    tokens = written(join_groups(tokens, open_, ["token"], "size", total).drop("size").withColumn("cell", cell), f"{path}/tokens")
    matrix = tokens.groupBy("token", F.col("cell").alias("to")).agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("n").alias("least"), F.max("n").alias("most"))
    fits = ((F.col("cell") > F.col("to")) | (F.col("weak") & (F.col("cell") == F.col("to")))) & ~((F.col("x") == F.col("y")) & (F.col("x") == F.col("component")))
    fits &= (100 * F.col("most") >= percent * F.col("n")) & (percent * F.col("least") <= 100 * F.col("n"))
    meets = tokens.join(matrix, "token").where(fits).groupBy("cid", "to").agg(F.count(F.lit(1)).alias("found"), F.first("n").alias("n"), F.first("component").alias("component"))
    meets = written(meets.where(F.col("found") >= enough).drop("found"), f"{path}/meets")

    salts = meets.groupBy("to").agg(F.ceil(F.sum("n") / QUERY_TOKENS).cast("int").alias("salts"))
    asking = meets.join(salts.where("salts > 1"), "to", "left").select("to", F.pmod(F.xxhash64("cid"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), "cid", "component", F.lit(True).alias("query"))
    there = own.select("cid", "component", F.struct("leader", "block").alias("to")).join(salts, "to")
    there = there.select("to", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "cid", "component", F.lit(False).alias("query"))
    again = written(asking.unionByName(there).join(named, "cid").select(F.col("to.leader").alias("to"), F.col("to.block").alias("at"), "salt", "cid", "component", "query", "doc_id"), f"{path}/again")
    more = sets_of(docs, again, shingle, repeats).groupBy("to", "at", "salt").applyInArrow(_across(percent), "a binary, b binary")
    final = _components(more.unionByName(inner.where("cid != component").select(F.col("component").alias("a"), F.col("cid").alias("b"))))

    named = classes.join(final, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    ids = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    named = join_groups(named, ids, ["component"], "size", n_classes).select("cid", "members", "component_id")
    named = written(named, f"{path}/named")
    for used in ("common", "shared", "able", "placed", "asked", "inner", "own", "tokens", "meets", "again"):
        removed(spark, f"{path}/{used}")
    found = join_groups(real.select("doc_id", "n_shingles", "cid"), named, ["cid"], "members", base.count()).select("doc_id", "n_shingles", "component_id")
    alone = base.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)


_TEXT = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle(shingle: int, percent: int, more: str = "") -> str:
    """DuckDB SQL for joins of this kind: classes of equal sets, pairs of classes that share a token, and what they reach."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_TEXT}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {shingle} + 2), lambda i: array_to_string(w[i:i + {shingle - 1}], ' ')) END)) AS s FROM d),
c AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s), t AS (SELECT rep, n, unnest(s) AS token FROM c),
l AS (SELECT a.rep AS x, b.rep AS y FROM t AS a JOIN t AS b USING (token) WHERE a.rep < b.rep GROUP BY x, y, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l), r AS (SELECT rep AS x, rep AS y FROM c UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
m AS (SELECT x AS rep, min(y) AS component FROM r GROUP BY x)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(m.component, s.doc_id) AS component_id{more} FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN m ON m.rep = c.rep
"""


ORACLE = oracle(SHINGLE, PERCENT)
#: The same for near duplicates by four words.
NEAR_ORACLE = oracle(4, 80, ", s.doc_id = coalesce(m.component, s.doc_id) AS kept")
