"""Train, validation and test splits that share no text, and what leaks when they do.

Draws are md5 hashes of a seed and an id, so a split depends on neither the order nor the partitions of its input.
"""

from __future__ import annotations

from functools import reduce
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairforge.functions.text import ratio
from pairforge.operators.graph import components
from pairforge.operators.metrics import band
from pairforge.operators.resample import by_hash, uniform
from pairforge.session import scratch, written

RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}
BUCKETS = [1, 2, 5, 10]
CAP = 500
DROPPED = "dropped_cross_split"


def order_key(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def draw(seed: int, key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the hash."""
    return F.conv(F.substring(order_key(seed, key), 1, 8), 16, 10).cast("double") / 4294967296.0


def by_share(share: Column, ratios: dict[str, float] = RATIOS) -> Column:
    return F.when(share < ratios["test"], "test").when(share < ratios["test"] + ratios["val"], "val").otherwise("train")


def size_bucket(size: Column, edges: list[int] = BUCKETS) -> Column:
    """How many edges lie below the size."""
    return sum(((size > e).cast("int") for e in edges), F.lit(0))


def before(df: DataFrame, by: list[str], key: str, weight: str, seed: int) -> DataFrame:
    """Adds share: the weight of rows before this one in hash order over that of all, within by.

    Prefix sums in two levels, over the leading byte of the hash and then within it.
    """
    h = order_key(seed, F.col(key))
    df = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 2))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cells = df.groupBy(*by, "_b").agg(F.sum(weight).alias("_w"))
    cells = cells.select(*by, "_b", F.coalesce(F.sum("_w").over(w), F.lit(0)).alias("_w"), F.sum("_w").over(Window.partitionBy(*by)).alias("_all"))
    w = Window.partitionBy(*by, "_b").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(cells, [*by, "_b"])
    return out.withColumn("share", (F.col("_w") + F.coalesce(F.sum(weight).over(w), F.lit(0))) / F.col("_all")).drop("_h", "_b", "_w", "_all")


def random_split(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Adds split by rows, stratified by label."""
    return before(pairs.withColumn("_one", F.lit(1)), ["is_duplicate"], "id", "_one", seed).withColumn("split", by_share(F.col("share"))).drop("share", "_one")


def component_labels(linked: DataFrame, seed: int) -> DataFrame:
    """component, split: whole components in hash order within buckets of their size."""
    comps = linked.groupBy("component").agg(F.count(F.lit(1)).alias("pairs")).withColumn("bucket", size_bucket(F.col("pairs")))
    return before(comps, ["bucket"], "component", "pairs", seed).select("component", by_share(F.col("share")).alias("split"))


def component_split(linked: DataFrame, seed: int = 42) -> DataFrame:
    """Adds split to pairs with their component: whole components."""
    return linked.join(component_labels(linked, seed), "component")


def node_probabilities(ratios: dict[str, float] = RATIOS) -> dict[str, float]:
    """Proportional to the root of the ratios, so that pairs that survive follow the ratios."""
    total = sum(sqrt(r) for r in ratios.values())
    return {k: sqrt(r) / total for k, r in ratios.items()}


def node_label(seed: int, key: Column) -> Column:
    p = node_probabilities()
    u = draw(seed, key)
    return F.when(u < p["train"], "train").when(u < p["train"] + p["val"], "val").otherwise("test")


def node_split(linked: DataFrame, seed: int = 42) -> DataFrame:
    """Adds split to pairs with key_a, key_b: a draw for each text; pairs across splits are dropped."""
    a, b = node_label(seed, F.col("key_a")), node_label(seed, F.col("key_b"))
    return linked.withColumn("split", F.when(a == b, a).otherwise(DROPPED))


def hybrid_split(linked: DataFrame, seed: int = 42, cap: int = CAP) -> DataFrame:
    """Components of at most cap pairs whole, larger ones by text. linked has key_a, key_b, component, size."""
    small, large = linked.where(F.col("size") <= cap), linked.where(F.col("size") > cap)
    return component_split(small, seed).unionByName(node_split(large, seed), allowMissingColumns=True)


def make_split(linked: DataFrame, strategy: str, seed: int = 42) -> DataFrame:
    made = {"random": random_split, "component": component_split, "node": node_split, "hybrid": hybrid_split}
    if strategy not in made:
        raise ValueError(f"unknown strategy: {strategy}")
    return made[strategy](linked, seed)


def split_report(split: DataFrame) -> DataFrame:
    """split, pairs, share, positive_rate."""
    w = Window.partitionBy()
    out = split.groupBy("split").agg(F.count(F.lit(1)).alias("pairs"), F.avg("is_duplicate").alias("positive_rate"))
    return out.select("split", "pairs", (F.col("pairs") / F.sum("pairs").over(w)).alias("share"), "positive_rate")


def seed_stability(linked: DataFrame, strategy: str, seeds: range) -> DataFrame:
    """split and the least and greatest share and positive rate over seeds."""
    reports = None
    for s in seeds:
        r = split_report(make_split(linked, strategy, s))
        reports = r if reports is None else reports.unionByName(r)
    return reports.groupBy("split").agg(*[f(c).alias(f"{n}_{c}") for c in ("share", "positive_rate") for n, f in (("min", F.min), ("max", F.max))])


def component_profile(linked: DataFrame, edges: list[int]) -> DataFrame:
    """band of component size, components, pairs, positive_rate of pairs."""
    cut = band(F.col("size"), edges)
    return linked.groupBy(cut.alias("band")).agg(F.count_distinct("component").alias("components"), F.count(F.lit(1)).alias("pairs"), F.avg("is_duplicate").alias("positive_rate"))


def sides(pairs: DataFrame) -> DataFrame:
    """split, key: both texts of each pair."""
    return pairs.select("split", F.explode(F.array("key_a", "key_b")).alias("key"))


def text_overlap(split: DataFrame, reference: str, other: str) -> DataFrame:
    """How many texts and pairs of the other split are seen in the reference split."""
    ref = sides(split).where(F.col("split") == reference).select("key").distinct()
    own = sides(split).where(F.col("split") == other).select("key").distinct()
    seen = own.join(ref, "key", "left_semi").agg(F.count(F.lit(1)).alias("shared")).crossJoin(own.agg(F.count(F.lit(1)).alias("texts")))
    rows = split.where(F.col("split") == other)
    for s in ("a", "b"):
        rows = rows.join(ref.select(F.col("key").alias(f"key_{s}"), F.lit(1).alias(f"seen_{s}")), f"key_{s}", "left")
    any_, both = F.col("seen_a").isNotNull() | F.col("seen_b").isNotNull(), F.col("seen_a").isNotNull() & F.col("seen_b").isNotNull()
    pairs = rows.agg(F.count_if(any_).alias("pairs_any"), F.count_if(both).alias("pairs_both"), F.count(F.lit(1)).alias("pairs"))
    return seen.crossJoin(pairs).withColumn("rate", ratio(F.col("shared"), F.col("texts")))


def transitive_leakage(split: DataFrame, other: str = "test") -> DataFrame:
    """A rule that knows training labels only: a pair is positive if training positives connect its texts."""
    train = split.where((F.col("split") == "train") & (F.col("is_duplicate") == 1))
    comp = components(train)
    rows = split.where(F.col("split") == other).select("is_duplicate", "key_a", "key_b")
    for s in ("a", "b"):
        rows = rows.join(comp.select(F.col("key").alias(f"key_{s}"), F.col("component").alias(f"c_{s}")), f"key_{s}", "left")
    fires = F.coalesce(F.col("c_a") == F.col("c_b"), F.lit(False))
    out = rows.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(fires).alias("fires"), F.count_if(fires & (F.col("is_duplicate") == 1)).alias("hits"), F.count_if(F.col("is_duplicate") == 1).alias("positives"))
    return out.select("pairs", "fires", ratio(F.col("fires"), F.col("pairs")).alias("firing_rate"), ratio(F.col("hits"), F.col("fires")).alias("precision"), ratio(F.col("hits"), F.col("positives")).alias("recovered"))


def dev_slice(linked: DataFrame, share: float = 0.05, seed: int = 7) -> DataFrame:
    """component, pairs of whole components that come before the share in hash order."""
    comps = linked.groupBy("component").agg(F.count(F.lit(1)).alias("pairs"))
    return before(comps, [], "component", "pairs", seed).where(F.col("share") < share).select("component", "pairs")


def leaked_texts(split: DataFrame) -> DataFrame:
    """leaked: texts in more than one of train, val and test."""
    kept = sides(split).where(F.col("split").isin(*RATIOS))
    return kept.groupBy("key").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("leaked"))


def sample(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """n rows without replacement, the first in hash order."""
    return df.orderBy(order_key(seed, F.col(key)), key).limit(n)


def id_checksum(split: DataFrame) -> DataFrame:
    """split, checksum: SHA-256 of the sorted ids; ids are gathered for each split, so use it to freeze results."""
    return split.groupBy("split").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ","), 256).alias("checksum"))


#: Hexadecimal digits of a row's hash that the leaves of a checksum tree stand for.
TREE_DEPTH = 3


def encoded(*columns: str) -> Column:
    """The values of a row as one string, so that different rows have different strings."""
    text = lambda c: F.col(c).cast("string")
    return F.concat_ws(",", *[F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("null")) for c in columns])


def checksum_tree(df: DataFrame, columns: list[str], by: tuple[str, ...] = (), depth: int = TREE_DEPTH) -> DataFrame:
    """by, prefix, rows, digest: SHA-256 of the rows whose hash begins with prefix, from leaves of depth digits up to the root ''.

    A leaf is the sums of its rows' hashes, word by word, and so needs no order and gathers no rows; repeated rows count.
    Nodes above are digests of their children, at most 16. Tables with equal rows have equal trees over any layout.
    """
    if not 1 <= depth <= 8:
        raise ValueError("a tree has 1 to 8 levels")
    rows = df.select(*by, F.sha2(encoded(*columns), 256).alias("h"))
    words = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"_{i}") for i in range(8)]
    leaves = rows.groupBy(*by, F.substring("h", 1, depth).alias("prefix")).agg(F.count(F.lit(1)).alias("rows"), *words)
    level = leaves.select(*by, "prefix", "rows", F.sha2(F.concat_ws(",", F.col("rows").cast("string"), *[f"_{i}" for i in range(8)]), 256).alias("digest"))
    level = out = written(level, scratch(df.sparkSession))  # 16 ** depth rows at most
    for d in range(depth - 1, -1, -1):
        children = F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda x: F.concat(x["prefix"], F.lit(":"), x["digest"]))
        level = level.groupBy(*by, F.substring("prefix", 1, d).alias("prefix")).agg(F.sum("rows").alias("rows"), F.sha2(F.array_join(children, ","), 256).alias("digest"))
        out = out.unionByName(level)
    return out


def tree_differences(now: DataFrame, kept: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, prefix, rows, rows_kept of the leaves in which two trees of one depth differ; a side without rows has 0."""
    at = [*by, "prefix"]
    leaf = lambda t: t.withColumn("_d", F.max(F.length("prefix")).over(Window.partitionBy())).where(F.length("prefix") == F.col("_d")).drop("_d")  # noqa: E731  nodes are few
    a, b = leaf(now), leaf(kept).withColumnsRenamed({"rows": "rows_kept", "digest": "_kept"})
    both = a.alias("a").join(b.alias("b"), reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in at]), "full")
    changed = both.where(~F.col("digest").eqNullSafe(F.col("_kept")))
    return changed.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in at], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "rows_kept")])


def fold_segments(sizes: list[tuple[int, int]], folds: int) -> dict[int, list[tuple[int, int, list[int]]]]:
    """For sizes of groups and how many have each, from the largest: segments (from, to, order) of the groups of a size.

    Each group goes to the lightest fold, the first on ties. Within a segment, folds take groups in turn in that order.
    """
    load, out = [0] * folds, {}
    for size, count in sorted(sizes, reverse=True):
        at, segments = 0, []
        while at < count:
            order = sorted(range(folds), key=lambda f: (load[f], f))
            turn = [f for f in order if load[f] < load[order[0]] + size]  # those that get one before the first gets two
            last, rest = turn[-1], order[len(turn) :]
            # Whole turns until another fold is as light; a turn that is cut short ends the groups of this size.
            turns = max(1, (load[rest[0]] - load[last]) // size) if rest else -(-(count - at) // len(turn))
            to = min(count, at + turns * len(turn))
            segments.append((at, to, turn))
            for i, f in enumerate(turn):
                load[f] += size * len(range(at + i, to, len(turn)))
            at = to
        out[size] = segments
    return out


def group_folds(groups: DataFrame, folds: int, seed: int, key: str = "component") -> DataFrame:
    """Adds fold to a table of groups (key, pairs): the largest first, in hash order among equals, each to the lightest fold.

    Only the number of groups of each size reaches the driver; groups find their fold by their place among equals.
    """
    spark = groups.sparkSession
    sizes = [(r.pairs, r.n) for r in groups.groupBy("pairs").agg(F.count(F.lit(1)).alias("n")).collect()]
    rows = [(size, [{"lo": a, "hi": b, "turn": t} for a, b, t in segments]) for size, segments in fold_segments(sizes, folds).items()]
    table = spark.createDataFrame(rows, "pairs long, segments array<struct<lo:long,hi:long,turn:array<int>>>")
    placed = by_hash(groups, ["pairs"], uniform(seed, F.col(key)), key, "_place").withColumn("_place", F.col("_place") - 1).join(table, "pairs")
    own = F.filter("segments", lambda s: (s["lo"] <= F.col("_place")) & (F.col("_place") < s["hi"]))[0]
    fold = F.get(own["turn"], ((F.col("_place") - own["lo"]) % F.size(own["turn"])).cast("int"))
    return placed.withColumn("fold", fold).drop("_place", "segments")


PROFILE = {"isolated": (0, 1), "small": (1, 10), "medium": (10, 500), "large": (500, None)}


def profile_report(split: DataFrame, size: str = "size") -> DataFrame:
    """split (also the dropped one), pairs, share_of_retained, positive_rate, retention, and the shares of its pairs by component size."""
    inside = {n: (F.col(size) > a) & (F.col(size) <= b if b else F.lit(True)) for n, (a, b) in PROFILE.items()}
    kept = F.col("split") != DROPPED
    out = split.groupBy("split").agg(F.count(F.lit(1)).alias("pairs"), F.avg("is_duplicate").alias("positive_rate"), *[F.avg(c.cast("int")).alias(n) for n, c in inside.items()])
    totals = split.agg(F.count_if(kept).alias("_kept"), F.count(F.lit(1)).alias("_all"))
    out = out.crossJoin(F.broadcast(totals))  # one row
    return out.select("split", "pairs", F.when(kept, ratio(F.col("pairs"), F.col("_kept"))).alias("share_of_retained"), "positive_rate", ratio(F.col("_kept"), F.col("_all")).alias("retention"), *PROFILE)


def overlap_report(split: DataFrame) -> DataFrame:
    """key (strict, loose), split, reference, and text_overlap of validation and test with what comes before; split has key_a, key_b, loose_a, loose_b."""
    out = None
    for name, (a, b) in {"strict": ("key_a", "key_b"), "loose": ("loose_a", "loose_b")}.items():
        rows = split.select("split", F.col(a).alias("key_a"), F.col(b).alias("key_b"))
        for other, reference in (("val", "train"), ("test", "train"), ("test", "val")):
            r = text_overlap(rows, reference, other).select(F.lit(name).alias("key"), F.lit(other).alias("split"), F.lit(reference).alias("reference"), "*")
            out = r if out is None else out.unionByName(r)
    return out
