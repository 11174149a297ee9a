"""Checksum trees and the store of features."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pairforge.operators import splits
from pairforge.sources import tables

SCHEMA = "id long, split string, note string"


def rows_of(n=300):
    return [(i, ["train", "val"][i % 5 == 0], None if i % 7 == 0 else f"text {i % 11}") for i in range(n)] + [(5, "val", "text 5"), (5, "val", "text 5")]


def plain_tree(rows, depth):
    code = lambda v: "null" if v is None else f"{len(str(v))}:{v}"
    hashes = [hashlib.sha256(",".join(map(code, (r[0], r[2]))).encode()).hexdigest() for r in rows]
    out = {}
    for p in {h[:depth] for h in hashes}:
        mine = [h for h in hashes if h.startswith(p)]
        sums = [str(sum(int(h[8 * i : 8 * i + 8], 16) for h in mine)) for i in range(8)]
        out[p] = (len(mine), hashlib.sha256(",".join([str(len(mine)), *sums]).encode()).hexdigest())
    for d in range(depth - 1, -1, -1):
        for p in {x[:d] for x in out if len(x) == d + 1}:
            below = sorted(x for x in out if len(x) == d + 1 and x.startswith(p))
            out[p] = (sum(out[x][0] for x in below), hashlib.sha256(",".join(f"{x}:{out[x][1]}" for x in below).encode()).hexdigest())
    return out


def test_trees_equal_plain_ones_over_any_layout(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 6):
        tree = splits.checksum_tree(df.repartition(parts), ["id", "note"], ("split",), 2).collect()
        assert {r.split for r in tree} == {"train", "val"}
        for s in ("train", "val"):
            assert {r.prefix: (r.rows, r.digest) for r in tree if r.split == s} == plain_tree([r for r in rows if r[1] == s], 2)


def test_a_changed_row_names_its_range(spark):
    rows = rows_of()
    changed = [(i, s, "other") if i == 17 else (i, s, t) for i, s, t in rows]
    a, b = (splits.checksum_tree(spark.createDataFrame(r, SCHEMA), ["id", "note"], depth=3) for r in (rows, changed))
    want = {hashlib.sha256(f"2:17,{t}".encode()).hexdigest()[:3] for t in ("6:text 6", "5:other")}
    assert {r.prefix for r in splits.tree_differences(b, a).collect()} == want
    assert splits.tree_differences(a, a).count() == 0
    fewer = splits.checksum_tree(spark.createDataFrame(rows[:-1], SCHEMA), ["id", "note"], depth=3)  # a repeated row counts
    (r,) = splits.tree_differences(fewer, a).collect()
    assert r.rows == r.rows_kept - 1
    none = splits.checksum_tree(spark.createDataFrame([], SCHEMA), ["id", "note"], depth=3)
    assert none.count() == 0 and splits.tree_differences(none, a).agg(F.sum("rows_kept")).first()[0] == len(rows)
    with pytest.raises(ValueError, match="levels"):
        splits.checksum_tree(none, ["id"], depth=0)


def test_features_are_computed_once(spark, tmp_path):
    asked = []

    def compute(new):
        asked.append(new.count())
        return new.withColumn("both", F.length(F.concat(F.coalesce("question1", F.lit("")), F.lit("|"), F.coalesce("question2", F.lit("")))))

    schema = "id long, question1 string, question2 string, extra int"
    first = spark.createDataFrame([(1, "a", "b", 0), (2, "a", "b", 1), (3, None, "b", 2), (4, "null", "b", 3), (5, "a,1:b", "c", 4), (6, "a", "b,1:c", 5)], schema)
    path = str(tmp_path / "features")
    run = lambda df, v="one": tables.stored_features(df, compute, path, v)
    found, made = run(first)
    assert made == 5 and {r.id: r.both for r in found.collect()} == {1: 3, 2: 3, 3: 2, 4: 6, 5: 7, 6: 7}
    assert run(first.repartition(3))[1] == 0 and asked == [5]
    found, made = run(first.unionByName(spark.createDataFrame([(7, "new", "b", 0)], schema)))
    assert made == 1 and found.count() == 7 and asked == [5, 1]
    assert run(first, "two")[1] == 5 and asked == [5, 1, 5]
    assert run(first)[1] == 0
    with pytest.raises(ValueError, match="no rows"):
        run(first.where("id < 0"), "three")
    assert tables.version_of(plain_tree) == tables.version_of(plain_tree) != tables.version_of(rows_of)
