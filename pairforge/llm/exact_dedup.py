"""Exact deduplication by an extendible-hash index on shared files, in DataFrame operations only.

A key is a 64-bit hash of the normalised text; its leading bits choose a slot of the directory. The directory starts
with one bucket and doubles until none is overfull: a bucket of more keys than its capacity splits by its next bit,
the others keep their shorter prefix and are pointed at by several slots. It is made from the keys alone, which are
written once, before any text moves.

Texts then go to the owner tasks of their buckets. An owner inserts what it gets into its buckets: texts of one key
chain, and a text is a copy if its bytes equal those of an entry of the chain. The entries (the row that stays, the
number of copies) are written as files of the shared folder, bucket by bucket; rows look theirs up by bucket and key,
and by digest where a chain has several entries. A key with very many rows is dealt over all owners, and what they
found for it is put together afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairforge.llm.shared import HEAVY, as_text, join_groups, ready, removed, scratch, wrapped, written

SPACES = " \t\n\x0b\x0c\r"
#: Keys that a bucket may hold before it splits: so many, or one of 2**LARGEST parts of all keys if that is more.
CAPACITY, LARGEST = 200, 17
#: Bits that one level of the directory takes at most; a bucket that is deeper has levels below.
LEVEL = 20
_TOP = 9223372036854775807
_BIG = "100000000000000000000"


def normalised(text: Column) -> Column:
    """text without the ASCII white space 0x20, 0x09-0x0D."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def directory(slots: Callable[[int, list[int], int], dict[int, int]], capacity: int | None = None) -> dict[tuple[int, int], int]:
    """Keys of each bucket, by its prefix and the bits of that.

    slots(bits, prefixes, of) counts keys by their leading bits, of those keys whose leading `of` bits are among prefixes.
    """
    buckets = {(0, 0): sum(slots(0, [0], 0).values())}
    capacity = capacity or max(CAPACITY, buckets[0, 0] >> LARGEST)
    while over := [b for b, n in buckets.items() if n > capacity and b[1] < 64]:
        # One count serves all splits of the shallowest overfull buckets that their sizes ask for.
        bits = min(b for _, b in over)
        over = [b for b in over if b[1] == bits]
        depth = min(64, bits + min(LEVEL, (max(buckets[b] for b in over) // capacity).bit_length() + 1))
        counts = slots(depth, [p for p, _ in over], bits)
        for bucket in over:
            del buckets[bucket]
            halves = [(2 * bucket[0], bits + 1), (2 * bucket[0] + 1, bits + 1)]
            while halves:
                prefix, b = halves.pop()
                held = sum(counts.get(i, 0) for i in range(prefix << (depth - b), (prefix + 1) << (depth - b)))
                if held > capacity and b < depth:
                    halves += [(2 * prefix, b + 1), (2 * prefix + 1, b + 1)]
                else:
                    buckets[prefix, b] = held
    return buckets


def bucket_of(key: Column, buckets: list[tuple[int, int]]) -> Column:
    """The number of the bucket that the directory has for a 64-bit key: its place in the order of prefixes."""
    order = sorted(buckets, key=lambda b: b[0] << (64 - b[1]))
    return _level(key, [(p, b, i) for i, (p, b) in enumerate(order)])


def _level(key: Column, found: list[tuple[int, int, int]]) -> Column:
    """found: (prefix, bits, number) of buckets, of which key has passed the bits before already."""
    if len(found) == 1:
        return F.lit(found[0][2])
    depth = min(LEVEL, max(b for _, b, _ in found))
    table, below = [0] * (1 << depth), {}
    for p, b, i in found:
        if b <= depth:
            width = 1 << (depth - b)
            table[p * width : (p + 1) * width] = [i] * width
        else:
            below.setdefault(p >> (b - depth), []).append((p & ((1 << (b - depth)) - 1), b - depth, i))
    slot = F.shiftrightunsigned(key, 64 - depth).cast("int")
    out = F.element_at(F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>"), slot + 1)
    for s, deeper in below.items():
        out = F.when(slot == s, _level(F.shiftleft(key, depth), deeper)).otherwise(out)
    return out


def counted(keys: DataFrame) -> Callable[[int, list[int], int], dict[int, int]]:
    """slots of directory() for a table of distinct keys."""
    lead = lambda n: F.shiftrightunsigned("key", 64 - n) if n else F.lit(0).cast("long")

    def slots(bits: int, prefixes: list[int], of: int) -> dict[int, int]:
        some = keys.where(lead(of).isin(prefixes)) if of else keys
        return {r.slot % 2**64: r.n for r in some.groupBy(lead(bits).alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()}

    return slots


def hashed(norm: Column) -> Column:
    return F.xxhash64(norm)


def rows_of(documents: DataFrame, hashing: Callable[[Column], Column], *more: str) -> DataFrame:
    """doc_id, norm, key, rank and more columns of each row; the greatest rank of a group stays: most code points, then the least id, a row without id last."""
    docs = as_text(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more))
    order = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.lit(_TOP).cast("decimal(20,0)") - F.col("doc_id") + 1)
    rank = (F.length("text").cast("decimal(11,0)") * F.lit(_BIG).cast("decimal(21,0)") + order.cast("decimal(21,0)")).cast("decimal(38,0)")
    docs = docs.select("doc_id", normalised(F.col("text")).alias("norm"), rank.alias("rank"), *more)
    return docs.select("doc_id", "norm", hashing(F.col("norm")).alias("key"), "rank", *more)


def index(rows: DataFrame, keys: DataFrame, path: str, capacity: int | None = None) -> tuple[DataFrame, list[tuple[int, int]], int]:
    """Inserts rows (norm, key, rank) and writes the entries to path: bucket, key, chain, text_sha256, rank, group_size. Also the buckets and the number of rows.

    keys: key and n, its rows. chain: how many texts have the key; rank: the greatest of a text's rows.
    """
    spark = rows.sparkSession
    buckets = list(directory(counted(keys), capacity))
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head().n
    owners = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Fewer than HEAVY keys have over total / HEAVY rows, so they can be broadcast whatever the input.
    hot = F.broadcast(keys.where(F.col("n") > max(total // HEAVY, 1)).select("key", F.lit(True).alias("hot")))
    placed = rows.select("key", "norm", "rank").withColumn("bucket", bucket_of(F.col("key"), buckets)).join(hot, "key", "left")
    owner = F.when(F.col("hot"), F.pmod(F.monotonically_increasing_id(), F.lit(owners))).otherwise(F.col("bucket") + owners)
    # An owner has its buckets whole, so comparing the bytes of a key's texts there moves nothing more.
    owned = placed.withColumn("owner", owner).repartition("owner").groupBy("owner", "bucket", "key", "norm")
    found = owned.agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("group_size"), F.first("hot").alias("hot"))
    found = written(found.select("bucket", "key", F.sha2("norm", 256).alias("text_sha256"), "rank", "group_size", "hot"), f"{path}/found")
    parts = found.where("hot").groupBy("bucket", "key", "text_sha256").agg(F.max("rank").alias("rank"), F.sum("group_size").alias("group_size"))
    entries = found.where("hot is null").drop("hot").unionByName(parts).repartition("bucket")
    entries = entries.withColumn("chain", F.count(F.lit(1)).over(Window.partitionBy("bucket", "key")))
    entries = written(entries.select("bucket", "key", "chain", "text_sha256", "rank", "group_size"), f"{path}/index")
    removed(spark, f"{path}/found")
    return entries, buckets, total


def dedup(documents: DataFrame, capacity: int | None = None, hashing: Callable[[Column], Column] = hashed) -> DataFrame:
    """Per row of documents: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. The row with the most code points stays, then that with the least doc_id; a row
    without doc_id comes last, and a group of such rows only has a null keep_id and keeps none of them by id, so
    kept is true for each. Rows that repeat a kept doc_id are all marked as kept: they can't be told apart by id.
    Empty tables give empty results; texts count whole, however long; other columns are ignored, whatever their names.
    """
    path = scratch(ready(documents.sparkSession))
    rows = rows_of(documents, hashing)
    places = written(rows.select("doc_id", "key"), f"{path}/places")
    keys = written(places.groupBy("key").agg(F.count(F.lit(1)).alias("n")), f"{path}/keys")
    entries, buckets, total = index(rows, keys, path, capacity)
    place = (F.col("rank") % F.lit(_BIG).cast("decimal(21,0)")).cast("decimal(20,0)")
    keep = F.when(place > 0, (F.lit(_TOP).cast("decimal(20,0)") - place + 1).cast("long")).alias("keep_id")
    entries = entries.select("bucket", "key", "chain", "text_sha256", "group_size", keep)
    at = bucket_of(F.col("key"), buckets).alias("bucket")
    out = join_groups(places.select("doc_id", at, "key"), entries.where("chain = 1"), ["bucket", "key"], "group_size", total)
    if not entries.where("chain > 1").isEmpty():
        chained = rows.join(entries.where("chain > 1").select("key").distinct(), "key", "left_semi").select("doc_id", at, "key", F.sha2("norm", 256).alias("text_sha256"))
        out = out.unionByName(join_groups(chained, entries.where("chain > 1"), ["bucket", "key", "text_sha256"], "group_size", total))
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")


def kept(documents: DataFrame, hashing: Callable[[Column], Column] = hashed) -> DataFrame:
    """The rows of documents, with all their columns, that stay: exactly one of each group of equal texts.

    It is the row that dedup() keeps; of rows with that id and text, any one. Rows are judged by their text, so rows
    that share an id or have none are told apart. Null texts are empty; empty tables stay empty; other columns may have any name.
    """
    path = scratch(ready(documents.sparkSession))
    rows = rows_of(wrapped(documents), hashing, "r")
    keys = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), f"{path}/keys")
    entries, _, total = index(rows, keys, path)
    several, limit = entries.where("group_size > 1"), max(total // HEAVY, 1)
    digest = F.sha2(normalised(F.coalesce(F.col("r.text").cast("string"), F.lit(""))), 256)
    # Rows meet the entry of their text, if it has several rows: of large groups, fewer than HEAVY, where they are.
    large = F.broadcast(several.where(F.col("group_size") > limit).select(F.col("key").alias("large_key"), F.col("chain").alias("a"), F.col("text_sha256").alias("b"), F.col("rank").alias("large")))
    small = several.where(F.col("group_size") <= limit).select(F.col("key").alias("small_key"), F.col("chain").alias("c"), F.col("text_sha256").alias("d"), F.col("rank").alias("small"))
    met = rows.join(large, (F.col("key") == F.col("large_key")) & ((F.col("a") == 1) | (F.col("b") == digest)), "left")
    met = met.withColumn("dealt", F.when(F.col("large").isNull(), F.col("key")).otherwise(F.xxhash64(F.monotonically_increasing_id())))
    met = met.join(small, (F.col("dealt") == F.col("small_key")) & F.col("large").isNull() & ((F.col("c") == 1) | (F.col("d") == digest)), "left")
    met = met.withColumn("best", F.coalesce("large", "small"))
    if documents.groupBy("doc_id").count().where("count > 1").isEmpty():
        return met.where("best is null or rank = best").select("r.*")
    first = met.where("rank = best").withColumn("digest", digest).dropDuplicates(["key", "digest"])
    return met.where("best is null").select("r.*").union(first.select("r.*"))


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, arg_min(doc_id, {'a': -n, 'b': doc_id}) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
"""
