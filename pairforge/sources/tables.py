"""Reading and writing pair tables, splits, vectors and policies."""

from __future__ import annotations

import hashlib
import inspect
import json
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.functions.vectors import halves
from pairforge.operators.splits import encoded

PAIRS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("qid1", T.LongType()), T.StructField("qid2", T.LongType()),
    T.StructField("question1", T.StringType()), T.StructField("question2", T.StringType()), T.StructField("is_duplicate", T.IntegerType()),
])


def read_pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    """A labelled pair table. Only an empty cell is null; a missing column is an error, further columns stay out."""
    head = spark.read.csv(path, header=True, multiLine=True, escape='"').limit(0).columns
    if missing := [c for c in PAIRS.names if c not in head]:
        raise ValueError(f"missing columns: {missing}")
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', nullValue="", encoding="utf-8", inferSchema=False)
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PAIRS])


def write_splits(split: DataFrame, path: str) -> None:
    """One folder for each split, so that readers of one never open another."""
    split.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, name: str, allowed: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """A split; test can only be read by a caller that allows it."""
    if name not in allowed:
        raise PermissionError(f"split {name} may not be read here")
    return spark.read.parquet(path).where(F.col("split") == name)


def cover(left: DataFrame, right: DataFrame, key: str = "id") -> None:
    """Raises unless both tables have the same keys."""
    for a, b in ((left, right), (right, left)):
        if n := a.join(b, key, "left_anti").count():
            raise ValueError(f"{n} rows have no counterpart by {key}")


def complete(df: DataFrame, columns: list[str]) -> None:
    """Raises if a number is null or NaN."""
    row = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in columns]).head()
    if bad := [c for c in columns if row[c]]:
        raise ValueError(f"missing values in {bad}")


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Scores, sweeps, assignments and reports as Parquet, CSV (with a header) or lines of JSON. Lists and structs go to CSV as JSON."""
    if kind == "csv":
        df = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    writer = df.write.mode("overwrite")
    writer = writer.option("header", True).option("escape", '"') if kind == "csv" else writer
    writer.format(kind).save(path)


def write_record(record: dict | list, path: str) -> None:
    """A result, policy or configuration as JSON, on the driver."""
    Path(path).write_text(json.dumps(record, indent=1, sort_keys=isinstance(record, dict)))


def read_record(path: str, *keys: str) -> Any:
    """A JSON file, or a value within it: an expected figure is read from where it was recorded."""
    found = json.loads(Path(path).read_text())
    for k in keys:
        found = found[k]
    return found


def cached_vectors(texts: DataFrame, encode, path: str, key: str = "text", half: bool = False) -> DataFrame:
    """Vectors of distinct texts: those at path are kept, new ones are encoded and added.

    encode: DataFrame to DataFrame with a vector. half: vectors are kept at half precision, as single-precision numbers.
    """
    spark = texts.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = spark.read.parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None
    new = texts.select(key).distinct()
    new = new if known is None else new.join(known, key, "left_anti")
    made = encode(new)
    made = made.withColumn("vector", halves(F.col("vector")).cast("array<float>")) if half else made
    made.write.mode("append").parquet(path)
    return spark.read.parquet(path).join(texts.select(key).distinct(), key, "left_semi")


def vector_info(vectors: DataFrame, encoder: str, key: str = "text") -> dict:
    """What a store of vectors holds: encoder, texts, dims, and a checksum of its keys that does not depend on their order."""
    r = vectors.agg(F.count(F.lit(1)).alias("texts"), F.max(F.size("vector")).alias("dims"), F.sum(F.xxhash64(key).cast("decimal(38,0)")).alias("keys")).head()
    return {"encoder": encoder, "texts": r.texts, "dims": r.dims, "keys": str(r["keys"])}


def version_of(*functions: Callable) -> str:
    """A name for what functions do: it changes with their source."""
    return hashlib.sha256("\n".join(inspect.getsource(f) for f in functions).encode()).hexdigest()[:16]


def stored_features(rows: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, version: str, texts: tuple[str, ...] = ("question1", "question2"), key: str = "id") -> tuple[DataFrame, int]:
    """key and the features of each row, and the number of different texts that were computed for it.

    Features are kept by the hash of their texts under a folder for the version, so other versions are never read, rows
    with the same texts share one entry and a second run computes nothing. compute: texts to texts and features, row by
    row. Null texts are texts of their own. Raises if a row is left without features.
    """
    spark = rows.sparkSession
    place = f"{path.rstrip('/')}/version={version}"
    p = spark._jvm.org.apache.hadoop.fs.Path(place)
    hashed = rows.select(key, *texts).withColumn("text_hash", F.sha2(encoded(*texts), 256))
    new = hashed.select("text_hash", *texts).dropDuplicates(["text_hash"])
    known = spark.read.parquet(place) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None
    if known is not None:
        new = new.join(known, "text_hash", "left_anti")
    if made := new.count():
        compute(new).drop(*texts).write.mode("append").parquet(place)
        known = spark.read.parquet(place)
    if known is None:
        raise ValueError("there are no rows to compute features of")
    # Two runs at once may both have added a text.
    found = hashed.select(key, "text_hash").join(known.dropDuplicates(["text_hash"]), "text_hash").drop("text_hash")
    cover(rows.select(key), found.select(key), key)
    return found, made


def extract_archive(archive: str, member: str, to: str) -> Path:
    """A file of a zip archive, or of a zip archive within it. A driver-side step before data reach the shared store."""
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if name.endswith(member):
                return Path(z.extract(name, to))
            if name.endswith(".zip"):
                inner = z.extract(name, to)
                return extract_archive(inner, member, to)
    raise FileNotFoundError(member)


def content_hash(path: str | Path) -> str:
    """SHA-256 of a file; text files have their line ends as LF."""
    data = Path(path).read_bytes()
    if Path(path).suffix in {".py", ".md", ".json", ".csv", ".yaml", ".yml", ".txt", ".ini"}:
        data = data.replace(b"\r\n", b"\n")
    return hashlib.sha256(data).hexdigest()


def freeze(paths: list[str], to: str) -> dict[str, str]:
    """Writes the hashes of files."""
    found = {p: content_hash(p) for p in sorted(paths)}
    Path(to).write_text(json.dumps(found, indent=1))
    return found


def verify(manifest: str) -> dict[str, list[str]]:
    """changed and missing files of a manifest."""
    want = json.loads(Path(manifest).read_text())
    return {"changed": [p for p, h in want.items() if Path(p).exists() and content_hash(p) != h], "missing": [p for p in want if not Path(p).exists()]}


def once(marker: str) -> None:
    """Raises at the second call with a marker file: a final evaluation runs once."""
    with open(marker, "x"):
        pass


def parity(a: DataFrame, b: DataFrame, tau: float, key: str = "id") -> DataFrame:
    """pairs, max_diff, flips of two tables of scores."""
    both = a.select(key, F.col("score").alias("s")).join(b.select(key, F.col("score").alias("t")), key)
    return both.agg(F.count(F.lit(1)).alias("pairs"), F.max(F.abs(F.col("s") - F.col("t"))).alias("max_diff"), F.count_if((F.col("s") >= tau) != (F.col("t") >= tau)).alias("flips"))
