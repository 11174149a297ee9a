"""Importance resampling towards a target: hashed n-gram counts of a corpus and a target give each document a weight.

Features of a text are its runs of consecutive words; each falls in a bucket by its crc32. A bucket's gain is the smoothed log
ratio of its share in the target to that in the corpus, a document's weight the mean gain of its features. A Gumbel draw
from the hash of its id is added, so the greatest scores are a sample without replacement in proportion to exp(weight / 1000).

All of it is joins, groupings and one sort in the JVM. Only the gains are broadcast, one row for each bucket. The sort deals
score ranges to tasks; a task's ranks begin after the rows of the tasks before it, of which there is one number each.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairforge.llm.decontam import _WORDS
from pairforge.llm.shared import ready, scratch, written

BUCKETS, SEED, LEAST_WORDS = 10_000, 2024, 20
#: What separates words: all ASCII but digits and small letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: monotonically_increasing_id() numbers the rows of each partition in so many bits.
ROW_BITS = 33


def words(text: Column) -> Column:
    """Words of a text in small ASCII letters. Letters outside ASCII stay as they are; null has none."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    small = F.when(t.rlike(r"[^\x00-\x7F]"), F.translate(t, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(t))
    return F.array_remove(F.split(small, GAP), "")


def features(w: Column, most: int) -> Column:
    """All runs of 1 to most consecutive words, repeats included."""

    def of(k: int) -> Column:
        at = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(w, i, k), " "))

    return F.concat(w, *[of(k) for k in range(2, most + 1)]) if most > 1 else w


def bucket(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def bucket_counts(texts: DataFrame, most: int, buckets: int) -> DataFrame:
    """bucket, n: features of all texts by bucket; tasks add up their own before rows move."""
    w = texts.select(words(F.col("text")).alias("w")).select(F.explode(features(F.col("w"), most)).alias("f"))
    return w.groupBy(bucket(F.col("f"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def gains(documents: DataFrame, target: DataFrame, most: int, buckets: int) -> DataFrame:
    """bucket, gain of every bucket: floor(1000 * ln(share in the target / share in the corpus)), each count plus one."""
    own, aim = bucket_counts(documents, most, buckets), bucket_counts(target, most, buckets)
    rows = documents.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    rows = rows.join(own.withColumnRenamed("n", "s"), "bucket", "left").join(aim.withColumnRenamed("n", "t"), "bucket", "left")
    rows = rows.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    sums = rows.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    rows = rows.crossJoin(F.broadcast(sums))  # one row
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return rows.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weighted(documents: DataFrame, table: DataFrame, most: int, buckets: int) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row: the floored mean of its features' gains, 0 without features."""
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    each = rows.select("row", "doc_id", F.size("w").alias("n_words"), F.explode_outer(features(F.col("w"), most)).alias("f"))
    each = each.select("row", "doc_id", "n_words", bucket(F.col("f"), buckets).alias("bucket"))
    sums = each.join(F.broadcast(table), "bucket", "left").groupBy("row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("g"))
    return sums.select("row", "doc_id", "n_words", "n_features", F.expr("(g - pmod(g, greatest(n_features, 1))) div greatest(n_features, 1)").alias("weight"))


def ranked(rows: DataFrame, order: list[Column], path: str) -> DataFrame:
    """Adds rank, from 1 in this order, and n, the number of rows: a distributed sort, then offsets of its partitions.

    order must tell rows apart, so that no value fills a partition by itself.
    """
    at = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    dealt = dealt.withColumns({"_part": F.shiftright("_at", ROW_BITS), "_place": F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)}).drop("_at")
    dealt = written(dealt, path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition of the sort
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("n"))
    out = dealt.join(F.broadcast(sizes), "_part")
    return out.withColumn("rank", F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def resample(documents: DataFrame, target: DataFrame, percent: int = 10, most: int = 1, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """Per row of documents: doc_id, n_features, weight, score, rank (null for those that are not drawn), all long.

    Of the rows with a doc_id and at least least_words words, percent of 100 are drawn, rounded down: the greatest scores, ties
    to the smaller doc_id. Null and empty texts have no features and weight 0. A row without doc_id has a weight, but no
    score and no rank, as its draw hangs on its id. Rows that repeat a doc_id share its draw and are ranked each for itself
    (more features first). An empty target has only smoothed counts; an empty table gives an empty result. Texts are read whole,
    other columns ignored, whatever their names.
    """
    spark = ready(documents.sparkSession)
    path = scratch(spark)
    docs, aim = documents.select("doc_id", "text"), target.select("text")
    table = written(gains(docs, aim, most, buckets), f"{path}/gains")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = written(weighted(docs, table, most, buckets).withColumn("score", F.col("weight") + gumbel), f"{path}/scored")
    able = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    drawn = ranked(scored.where(able), [F.desc("score"), F.asc("doc_id"), F.desc("n_features"), F.asc("row")], f"{path}/sorted")
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= F.expr(f"{percent} * n div 100"), F.col("rank")))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(*out).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")).select(*out))


# The table of the CRC of each byte from its rule, then the CRC of each distinct word's bytes.
_CRC = """step AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i)),
tab AS (SELECT list(c ORDER BY i) AS tab FROM step),
hexed AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM (SELECT unnest(w) AS f FROM d UNION ALL SELECT unnest(w) FROM b))),
bytes AS (SELECT f, list_transform(range(1, len(x) // 2 + 1), lambda i: 16 * (instr('0123456789ABCDEF', x[2 * i - 1]) - 1) + instr('0123456789ABCDEF', x[2 * i]) - 1) AS v FROM hexed),
crc AS (SELECT f, xor(list_reduce(list_prepend(4294967295, v), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295) AS crc FROM bytes, tab)"""
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark), {_CRC},
own AS (SELECT crc % {BUCKETS} AS k, count(*) AS s FROM (SELECT unnest(w) AS f FROM d) JOIN crc USING (f) GROUP BY k), aim AS (SELECT crc % {BUCKETS} AS k, count(*) AS t FROM (SELECT unnest(w) AS f FROM b) JOIN crc USING (f) GROUP BY k),
cells AS (SELECT k, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t FROM range({BUCKETS}) AS r(k) LEFT JOIN own USING (k) LEFT JOIN aim USING (k)),
gains AS (SELECT k, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM cells) + {BUCKETS}) / ((s + 1) * ((SELECT sum(t) FROM cells) + {BUCKETS}))))::BIGINT AS gain FROM cells),
sums AS (SELECT doc_id, sum(gain) AS g FROM (SELECT doc_id, unnest(w) AS f FROM d) JOIN crc USING (f) JOIN gains ON k = crc % {BUCKETS} GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) AS n_features, coalesce(floor(g::DOUBLE / len(w)), 0)::BIGINT AS weight, ('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT AS h FROM d LEFT JOIN sums USING (doc_id)),
final AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM scored),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM final WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM final LEFT JOIN ranked USING (doc_id)
"""
