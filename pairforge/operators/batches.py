"""Plans of training batches of similar length, as tables that any pass can be resumed in.

A pass shuffles the rows, cuts them into chunks of FACTOR batches, sorts each chunk by length, cuts it into batches and
shuffles these. The order comes from hashes of the seed, the pass and the row's key, so it is the same for any layout of
the rows, and a plan can be made again in place of being kept: a cursor needs the pass and the number of batches done.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairforge.session import scratch, written
from pairforge.sources import tables

SIZE, FACTOR = 256, 50
#: Hexadecimal digits of a hash by which rows are numbered in parts.
DIGITS = 4


def order_of(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def numbered(rows: DataFrame, group: str, order: str, tie: str, name: str, digits: int = DIGITS) -> DataFrame:
    """Adds the place of each row within its group by a hash, from 0. Rows meet by the first digits of the hash only, whose counts are at most 16^digits a group."""
    part = F.substring(order, 1, digits)
    rows = rows.withColumn("_part", part)
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n")).select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy(order, tie))
    return rows.join(offsets, [group, "_part"]).withColumn(name, F.col("_before") + within - 1).drop("_part", "_before")


def plan(rows: DataFrame, key: str, length: str, passes: Iterable[int], seed: int, size: int = SIZE, factor: int = FACTOR) -> DataFrame:
    """Per row and pass: pass, place (of its batch in the pass), at (of the row in its batch), the key, length, width (greatest length of the batch).

    Places and at count from 0. Each key is in exactly one batch of a pass; keys must be distinct and not null. A null length counts as 0.
    An empty table has no batches.
    """
    path = scratch(rows.sparkSession)
    all_ = rows.select(F.col(key).alias("_key"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("_length"), F.explode(F.array(*[F.lit(p) for p in passes])).alias("pass"))
    shuffled = numbered(all_.withColumn("_order", order_of(seed, F.col("pass"), F.col("_key"))), "pass", "_order", "_key", "_rank")
    chunk = F.floor(F.col("_rank") / (size * factor))
    sorted_ = F.row_number().over(Window.partitionBy("pass", "_chunk").orderBy("_length", "_rank")) - 1
    cut = shuffled.withColumn("_chunk", chunk).withColumn("_at", sorted_)
    cut = written(cut.select("pass", "_key", "_length", (F.col("_chunk") * factor + F.floor(F.col("_at") / size)).alias("_batch"), F.pmod("_at", F.lit(size)).alias("at")), f"{path}/cut")
    batches = cut.groupBy("pass", "_batch").agg(F.max("_length").alias("width")).withColumn("_order", order_of(seed, F.col("pass"), F.lit("batch"), F.col("_batch")))
    batches = written(numbered(batches, "pass", "_order", "_batch", "place", 2).select("pass", "_batch", "place", "width"), f"{path}/batches")
    return cut.join(batches, ["pass", "_batch"]).select("pass", "place", F.col("at").cast("long").alias("at"), F.col("_key").alias(key), F.col("_length").alias(length), "width")


def padding(planned: DataFrame, length: str) -> DataFrame:
    """Per pass: batches, rows, tokens, and the padded tokens, to the width of each batch and to the greatest width of all."""
    each = planned.groupBy("pass").agg(F.countDistinct("place").alias("batches"), F.count(F.lit(1)).alias("rows"), F.sum(length).alias("tokens"), F.sum("width").alias("padded"), F.max("width").alias("_width"))
    return each.select("pass", "batches", "rows", "tokens", "padded", (F.col("rows") * F.col("_width")).alias("padded_without_plan"))


def fingerprint(rows: DataFrame, key: str, length: str) -> str:
    """What a plan depends on but for its parameters; the same for any layout of the rows."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(key, F.coalesce(F.col(length), F.lit(0)).cast("long")).cast("decimal(38,0)")).alias("s")).head()
    return f"{r.n}:{r.s or 0}"


def save_cursor(path: str, rows: DataFrame, key: str, length: str, at_pass: int, done: int, seed: int, size: int = SIZE, factor: int = FACTOR) -> None:
    """Records that so many batches of a pass are done. The weights of a model are kept by the caller, under the same step."""
    tables.write_record({"pass": at_pass, "done": done, "seed": seed, "size": size, "factor": factor, "rows": fingerprint(rows, key, length)}, path)


def resume(path: str, rows: DataFrame, key: str, length: str, passes: int) -> DataFrame:
    """The plan from the cursor's batch on, to the end of so many passes. Rows that differ from those of the cursor are an error."""
    cursor = tables.read_record(path)
    if cursor["rows"] != fingerprint(rows, key, length):
        raise ValueError("the rows are not those of the cursor")
    rest = plan(rows, key, length, range(cursor["pass"], passes), cursor["seed"], cursor["size"], cursor["factor"])
    return rest.where((F.col("pass") > cursor["pass"]) | (F.col("place") >= cursor["done"]))
