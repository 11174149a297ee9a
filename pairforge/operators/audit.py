"""Audit of a labelled pair table (id, question1, question2, is_duplicate)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairforge.functions.text import text_of
from pairforge.operators.quantiles import with_quantiles
from pairforge.session import scratch, written

# Patterns of text issues.
ISSUES = {
    "non_ascii": r"[^\x00-\x7f]",
    "mojibake_like": r"Ã.|â€|Â",
    "html_entity": r"&(?:amp|lt|gt|quot|#\d+);",
    "latex_math_tag": r"\[math\]",
    "url": r"https?://|www\.",
    "control_char": r"[\x00-\x08\x0b\x0c\x0e-\x1f]",
    "newline": r"[\r\n]",
    "no_letters": r"^[^A-Za-z]*$",
}
# Texts that look like a missing value.
NULL_LIKE = ["NA", "N/A", "n/a", "nan", "NaN", "null", "None", "none"]
SIDES = ("question1", "question2")


def invalid(df: DataFrame) -> Column:
    """Whether a side is empty or n/a."""
    a, b = (F.lower(F.trim(text_of(F.col(c)))).isin("", "n/a") for c in SIDES)
    return a | b


def clean(df: DataFrame) -> DataFrame:
    return df.where(~invalid(df))


def missing(df: DataFrame) -> DataFrame:
    """column, nulls."""
    row = F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in df.columns])
    return df.agg(row.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def texts(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """text: both sides of each pair, from one scan."""
    return df.select(*extra, F.explode(F.array(*SIDES)).alias("text"))


def text_issues(df: DataFrame) -> DataFrame:
    """issue, texts over both sides."""
    t = text_of(F.col("text"))
    flags = {k: F.count_if(t.rlike(p)) for k, p in ISSUES.items()}
    flags |= {"no_question_mark": F.count_if(~t.contains("?")), "multiple_question_marks": F.count_if(F.regexp_count(t, F.lit(r"\?")) > 1), "null_like": F.count_if(t.isin(NULL_LIKE))}
    row = F.array(*[F.struct(F.lit(k).alias("issue"), c.alias("texts")) for k, c in flags.items()])
    return texts(df).agg(row.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def unordered(df: DataFrame, a: str = "question1", b: str = "question2") -> list[Column]:
    return [F.md5(F.least(text_of(F.col(a)), text_of(F.col(b)))).alias("lo"), F.md5(F.greatest(text_of(F.col(a)), text_of(F.col(b)))).alias("hi")]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """rows, repeats of whole rows but the id, of ids, of unordered text pairs, and of these the ones with both labels."""
    lo, hi = unordered(df)
    rows = df.select("id", "is_duplicate", lo, hi, F.md5(text_of(F.col("question1"))).alias("a"), F.md5(text_of(F.col("question2"))).alias("b"))
    pairs = rows.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("is_duplicate").alias("labels"))
    whole = rows.agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.count_distinct("a", "b", "is_duplicate")).alias("same_but_id"), (F.count(F.lit(1)) - F.count_distinct("id")).alias("same_id"))
    return whole.crossJoin(pairs.agg(F.sum(F.col("n") - 1).alias("same_pair"), F.count_if(F.col("labels") > 1).alias("conflicting")))


def repeated_id_pairs(df: DataFrame, a: str = "qid1", b: str = "qid2") -> DataFrame:
    """rows, repeated: rows beyond the first of each unordered pair of ids."""
    n = df.groupBy(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("repeated"))


def repeated_pairs(df: DataFrame) -> DataFrame:
    """The rows whose unordered pair of texts occurs more than once, with its count."""
    keyed = df.withColumns(dict(zip(("lo", "hi"), unordered(df), strict=True)))
    n = keyed.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    return keyed.join(n, ["lo", "hi"]).drop("lo", "hi")


def frequencies(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("times"))


def frequency_quantiles(df: DataFrame, key: str) -> DataFrame:
    """keys, once, most, and the quantiles of appearances."""
    qs = {"q50": 0.5, "q90": 0.9, "q99": 0.99, "q999": 0.999}
    return frequencies(df, key).agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("times") == 1).alias("once"), F.max("times").alias("most"), *[F.percentile("times", F.lit(q)).alias(n) for n, q in qs.items()])


def top_keys(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    return frequencies(df, key).orderBy(F.desc("times"), key).limit(n)


def word_count(t: Column) -> Column:
    w = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(w == "", 0).otherwise(F.size(F.split(w, " ")))


def length_stats(df: DataFrame) -> DataFrame:
    """unit, mean, median, min, p1, p99, max of characters and words over both sides."""
    t = text_of(F.col("text"))
    rows = texts(df).select(F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.length(t).alias("n")), F.struct(F.lit("words").alias("unit"), word_count(t).alias("n")))).alias("r")).select("r.*")
    rows = written(rows, scratch(df.sparkSession))  # two numbers for each text, read more than once
    out = rows.groupBy("unit").agg(F.avg("n").alias("mean"), F.min("n").alias("min"), F.max("n").alias("max"))
    return with_quantiles(out, rows, "n", {"median": 0.5, "p1": 0.01, "p99": 0.99}, ("unit",)).select("unit", "mean", "median", "min", "p1", "p99", "max")


def describe(df: DataFrame, x: str, by: str) -> DataFrame:
    """by, count, mean, std (of a sample), min, quartiles, max."""
    rows = written(df.select(by, x), scratch(df.sparkSession))
    out = rows.groupBy(by).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return with_quantiles(out, rows, x, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, (by,)).select(by, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def extremes(df: DataFrame, n: int) -> DataFrame:
    """end, rank, length, key of the shortest and longest distinct texts."""
    t = texts(df).select(text_of(F.col("text")).alias("text")).distinct().select(F.length("text").alias("length"), F.md5("text").alias("key"))
    out = []
    for end, order in (("shortest", F.asc("length")), ("longest", F.desc("length"))):
        top = t.orderBy(order, "key").limit(n)
        out.append(top.select(F.lit(end).alias("end"), F.row_number().over(Window.partitionBy().orderBy(order, "key")).alias("rank"), "length", "key"))
    return out[0].unionByName(out[1])


def shares(df: DataFrame, c: str) -> DataFrame:
    """c, n, share."""
    n = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def first_rows(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in order; no task gathers a key's rows."""
    cols = [c for c in df.columns if c != key]
    low = F.min(F.struct(*order, *[c for c in cols if c not in order])).alias("r")
    return df.groupBy(key).agg(low).select(key, *[F.col(f"r.{c}").alias(c) for c in cols])
