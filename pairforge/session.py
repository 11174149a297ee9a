"""Session plumbing: the shared folder for tables between steps, and joins that hot keys do not slow."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import partial
from multiprocessing.pool import ThreadPool
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[1])


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package wherever the driver found it."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


#: Scratch folders of this process, for tidy().
_made: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; a local master without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = Path(tempfile.mkdtemp(prefix="pairforge-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base.rstrip('/')}/pairforge-{uuid.uuid4().hex}")
    return _made[-1]


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch folders that the block asked for: what it made must be written elsewhere by its end."""
    before = len(_made)
    yield
    for path in _made[before:]:
        removed(spark, path)
    del _made[before:]


#: Whether Spark deletes what a query shuffled at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Blocks of shuffles_dropped() that are open, and the setting before the first of them: writes may run side by side.
_open, _setting, _lock = 0, "false", threading.Lock()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What queries of the block shuffle is deleted as each ends, not when the driver next collects its garbage: for writes, whose plans nothing reads again."""
    global _open, _setting
    with _lock:
        if not _open:
            _setting = spark.conf.get(CLEANUP, "false")
        _open += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            _open -= 1
            if not _open:
                spark.conf.set(CLEANUP, _setting)


#: Fits that run at a time: the jobs of one are many and small, so alone they leave most cores waiting for the driver.
AT_A_TIME = 6


def side_by_side(spark: SparkSession, work: Callable, items: Iterable) -> list:
    """work of each item, in order, in threads of the driver."""
    items = list(items)
    with ThreadPool(max(min(AT_A_TIME, len(items)), 1)) as pool:
        return pool.map(lambda f: f(), [inheritable_thread_target(spark)(partial(work, i)) for i in items])


def written(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet and reads it back, which cuts its lineage."""
    with shuffles_dropped(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, path: str) -> DataFrame:
    """As written(), in as many buckets of key as shuffles have partitions: a join by key reads it in place."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    out = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).option("compression", "zstd")
    with shuffles_dropped(spark):
        out.saveAsTable(name)
    read = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, and the plan knows them
    return read


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path that is no longer read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Groups with more than this share of all rows are heavy: there are fewer than HEAVY of them.
HEAVY = 1024


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with one row per group, without moving the rows of heavy groups.

    size is a column of groups, total the rows. A group of over total / HEAVY rows is heavy, so fewer than HEAVY groups
    are broadcast whatever the input; the rows of the others are shuffled, at most total / HEAVY to a key.
    """
    limit = max(total // HEAVY, 1)
    heavy = F.broadcast(groups.where(F.col(size) > limit))
    light = groups.where(F.col(size) <= limit)
    there = rows.join(heavy, keys, "inner")
    rest = rows.join(F.broadcast(groups.where(F.col(size) > limit).select(*keys)), keys, "left_anti")
    return there.unionByName(rest.join(light, keys, "inner"))
