"""Metrics of scored pairs (y 0/1, score), overall or by group, as aggregations over distinct scores or grid cells.

by: group columns, which may be none. Every metric is one plan for all groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairforge.functions.text import ratio
from pairforge.operators.quantiles import quantiles

GRID = 100
#: Scores are ranked within this many ranges of [0, 1], whose totals are few.
RANGES = 4096


def rates() -> dict[str, Column]:
    """Rates over the columns tn, fp, fn, tp; 0 where a denominator is 0."""
    c = {k: F.col(k).cast("double") for k in ("tn", "fp", "fn", "tp")}
    return {
        "accuracy": ratio(c["tp"] + c["tn"], c["tp"] + c["tn"] + c["fp"] + c["fn"]),
        "precision": ratio(c["tp"], c["tp"] + c["fp"]),
        "recall": ratio(c["tp"], c["tp"] + c["fn"]),
        "f1": ratio(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]),
        "fpr": ratio(c["fp"], c["fp"] + c["tn"]),
        "fnr": ratio(c["fn"], c["fn"] + c["tp"]),
    }


def counts(pred: Column, y: Column) -> list[Column]:
    return [F.count_if((y == a) & (pred == b)).alias(n) for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]


def confusion(scored: DataFrame, tau: float | Column = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """by, n, tn, fp, fn, tp and rates of score >= tau."""
    pred = (F.col("score") >= tau).cast("int")
    out = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *counts(pred, F.col("y")))
    return out.withColumns(rates())


def decision_metrics(decided: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, n, counts and rates of hard decisions pred."""
    return decided.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *counts(F.col("pred"), F.col("y"))).withColumns(rates())


def cell(score: Column) -> Column:
    """The greatest k with k / 100 <= score, -1 below the grid."""
    k = F.floor(score * GRID)
    k = F.when(score >= (k + 1) / GRID, k + 1).when(score < k / GRID, k - 1).otherwise(k)
    return F.greatest(F.least(k, F.lit(GRID)), F.lit(-1)).cast("int")


def sweep(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, k, threshold (k / 100), predicted, tp, positives, precision, recall, f1 for all of the grid."""
    hist = scored.groupBy(*by, cell(F.col("score")).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("p"))
    totals = hist.groupBy(*by).agg(F.sum("p").alias("positives"))
    frame = totals.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(GRID))))
    w = Window.partitionBy(*by).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    full = frame.join(hist, [*by, "k"], "left")
    out = full.withColumns({"predicted": F.sum(F.coalesce("n", F.lit(0))).over(w), "tp": F.sum(F.coalesce("p", F.lit(0))).over(w)})
    return out.select(
        *by, "k", (F.col("k") / GRID).alias("threshold"), "predicted", "tp", "positives",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("positives")).alias("recall"), ratio(2 * F.col("tp"), F.col("predicted") + F.col("positives")).alias("f1"),
    )


def best_threshold(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, threshold, f1 of the greatest F1, the lowest threshold on ties."""
    best = sweep(scored, by).groupBy(*by).agg(F.max(F.struct("f1", (-F.col("k")).alias("k"))).alias("best"))
    return best.select(*by, (-F.col("best.k") / GRID).alias("threshold"), F.col("best.f1").alias("f1"))


def ranked(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, score, n, p of each distinct score, and the n_below, p_below of lower ones.

    Two levels: totals of ranges first, then within a range, so no task holds all scores of a group.
    """
    hist = scored.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("p"))
    hist = hist.withColumn("range", F.greatest(F.least(F.floor(F.col("score") * RANGES), F.lit(RANGES)), F.lit(-1)))
    w = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = hist.groupBy(*by, "range").agg(F.sum("n").alias("_n"), F.sum("p").alias("_p"))
    ranges = ranges.select(*by, "range", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_n"), F.coalesce(F.sum("_p").over(w), F.lit(0)).alias("_p"))
    w = Window.partitionBy(*by, "range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = {f"{c}_below": F.col(f"_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0)) for c in ("n", "p")}
    return hist.join(ranges, [*by, "range"]).withColumns(below).drop("range", "_n", "_p")


def auc(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, roc_auc (ties count half), pr_auc (average precision over distinct scores); null unless both classes occur."""
    r = ranked(scored, by)
    totals = r.groupBy(*by).agg(F.sum("n").alias("all_n"), F.sum("p").alias("all_p"))
    r = r.join(F.broadcast(totals), list(by)) if by else r.crossJoin(F.broadcast(totals))  # one row without groups
    above_n, above_p = F.col("all_n") - F.col("n_below"), F.col("all_p") - F.col("p_below")
    wins = F.col("p") * ((F.col("n_below") - F.col("p_below")) + (F.col("n") - F.col("p")) / 2)
    step = F.col("p") * ratio(above_p, above_n)
    out = r.groupBy(*by).agg(F.sum(wins.cast("double")).alias("w"), F.sum(step).alias("s"), F.max("all_n").alias("all_n"), F.max("all_p").alias("all_p"))
    both = (F.col("all_p") > 0) & (F.col("all_p") < F.col("all_n"))
    return out.select(*by, F.when(both, F.try_divide(F.col("w"), (F.col("all_p") * (F.col("all_n") - F.col("all_p"))).cast("double"))).alias("roc_auc"), F.when(both, F.try_divide(F.col("s"), F.col("all_p").cast("double"))).alias("pr_auc"))


def curve_points(scored: DataFrame) -> DataFrame:
    """score, tp, fp of score >= each distinct score."""
    r = ranked(scored)
    totals = scored.agg(F.count(F.lit(1)).alias("all_n"), F.sum("y").cast("long").alias("all_p"))
    tp = F.col("all_p") - F.col("p_below")
    return r.crossJoin(F.broadcast(totals)).select("score", tp.alias("tp"), (F.col("all_n") - F.col("n_below") - tp).alias("fp"))


def calibration(scored: DataFrame, bins: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """by, ece, brier."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("bin")
    cells = scored.groupBy(*by, b).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("s"), F.avg("y").alias("p"), F.sum(F.pow(F.col("score") - F.col("y"), 2)).alias("q"))
    return cells.groupBy(*by).agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("s") - F.col("p"))), F.sum("n").cast("double")).alias("ece"), F.try_divide(F.sum("q"), F.sum("n").cast("double")).alias("brier"))


def group_metrics(scored: DataFrame, group: str, tau: float, taus: DataFrame | None = None, min_size: int = 1) -> DataFrame:
    """Metrics of each group of min_size rows or more, at its own threshold in taus (group, threshold) or else at tau."""
    if taus is None:
        out = confusion(scored, tau, (group,))
    else:
        out = confusion(scored.join(taus, group, "left"), F.coalesce("threshold", F.lit(tau)), (group,))
    return out.where(F.col("n") >= min_size)


def group_summary(metrics: DataFrame, group: str) -> DataFrame:
    """macro_f1, worst_f1, worst_group (the first on ties)."""
    return metrics.agg(F.avg("f1").alias("macro_f1"), F.min("f1").alias("worst_f1"), F.min(F.struct("f1", group)).alias("w")).select("macro_f1", "worst_f1", F.col(f"w.{group}").alias("worst_group"))


def cluster_table(scored: DataFrame, tau: float, group: str = "cluster") -> DataFrame:
    """A row for each group: metrics at tau, areas, scores, the optimal threshold and the plateau of F1 around it."""
    by = (group,)
    means = scored.groupBy(group).agg(F.avg("y").alias("prevalence"), F.avg("score").alias("mean_score"), F.avg(F.when(F.col("y") == 1, F.col("score"))).alias("mean_pos"), F.avg(F.when(F.col("y") == 0, F.col("score"))).alias("mean_neg"))
    curve = sweep(scored, by)
    best = best_threshold(scored, by).select(group, F.col("threshold").alias("optimal"), F.col("f1").alias("optimal_f1"))
    plateau = curve.join(best, group).where(F.col("f1") >= F.col("optimal_f1") - 0.01).groupBy(group).agg(F.min("threshold").alias("plateau_low"), F.max("threshold").alias("plateau_high"))
    out = confusion(scored, tau, by).join(means, group).join(auc(scored, by), group).join(best, group).join(plateau, group)
    return out.withColumn("pr_auc_lift", F.try_divide(F.col("pr_auc"), F.col("prevalence")))


def robustness(table: DataFrame) -> DataFrame:
    """How much F1 and optimal thresholds differ between the rows of cluster_table."""
    return table.agg(
        F.avg("f1").alias("macro_f1"), F.min("f1").alias("worst_f1"), F.max("f1").alias("best_f1"), (F.max("f1") - F.min("f1")).alias("f1_range"), F.stddev_pop("f1").alias("f1_std"),
        F.min("optimal").alias("tau_min"), F.max("optimal").alias("tau_max"), (F.max("optimal") - F.min("optimal")).alias("tau_range"), F.stddev_pop("optimal").alias("tau_std"), F.median("optimal").alias("tau_median"),
    )


def mean_ranks(table: DataFrame, key: str, columns: dict[str, bool]) -> DataFrame:
    """key and the mean of its average ranks in columns; True ranks the greatest first."""
    parts = []
    for c, desc in columns.items():
        w = Window.partitionBy().orderBy(F.desc(c) if desc else F.asc(c))
        parts.append(F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2)
    return table.select(key, (sum(parts[1:], parts[0]) / len(parts)).alias("mean_rank"))


def decisions_by_cluster(decided: DataFrame, clusters: int) -> DataFrame:
    """f1 of all decisions, macro and worst F1 over clusters 0 to clusters - 1; a cluster without rows has F1 0."""
    all_ = decided.sparkSession.range(clusters).select(F.col("id").cast("int").alias("cluster"))
    each = all_.join(decision_metrics(decided, ("cluster",)).select("cluster", "f1"), "cluster", "left").select("cluster", F.coalesce("f1", F.lit(0.0)).alias("f1"))
    return group_summary(each, "cluster").crossJoin(decision_metrics(decided).select("f1"))


def outcome(y: Column, pred: Column) -> Column:
    return F.when((y == 1) & (pred == 1), "TP").when((y == 0) & (pred == 1), "FP").when((y == 0) & (pred == 0), "TN").otherwise("FN")


def unpivoted(df: DataFrame, tags: list[str], keep: list[str]) -> DataFrame:
    """keep, tag, has: a row for each tag."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col(t).cast("int").alias("has")) for t in tags])).alias("t")).select(*keep, "t.tag", "t.has")


def tag_shares(tagged: DataFrame, tags: list[str]) -> DataFrame:
    """tag, TP, FP, TN, FN: the share of rows with the tag in each outcome."""
    return unpivoted(tagged, tags, ["outcome"]).groupBy("tag").pivot("outcome", ["TP", "FP", "TN", "FN"]).agg(F.avg("has"))


def tag_error_rates(tagged: DataFrame, tags: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """by, tag, and error rates of negatives and positives with and without it; null where there are none."""
    long = unpivoted(tagged, tags, ["outcome", *by])
    neg, has = F.col("outcome").isin("FP", "TN"), F.col("has") == 1
    fp, fn = (F.col("outcome") == "FP").cast("int"), (F.col("outcome") == "FN").cast("int")
    rate = lambda cond, x: F.avg(F.when(cond, x))
    return long.groupBy(*by, "tag").agg(
        F.count_if(neg & has).alias("negatives_with_tag"), rate(neg & has, fp).alias("fpr_with_tag"), rate(neg & ~has, fp).alias("fpr_without_tag"),
        F.count_if(~neg & has).alias("positives_with_tag"), rate(~neg & has, fn).alias("fnr_with_tag"), rate(~neg & ~has, fn).alias("fnr_without_tag"),
    )


def band(x: Column, edges: list[float]) -> Column:
    """The right-closed interval of edges that x is in, null outside."""
    out = F.when(F.lit(False), "")
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out = out.when((x > a) & (x <= b), f"({a}, {b}]")
    return out


def band_rates(df: DataFrame, x: str, edges: list[float]) -> DataFrame:
    """band of x, n, prevalence, fpr, fnr of decisions."""
    made = df.withColumn("band", band(F.col(x), edges)).where("band is not null")
    return decision_metrics(made, ("band",)).select("band", "n", ratio(F.col("tp") + F.col("fn"), F.col("n")).alias("prevalence"), "fpr", "fnr")


def slice_rates(df: DataFrame, slices: dict[str, Column], systems: dict[str, Column]) -> DataFrame:
    """slice, system, n, fpr, fnr: decisions of each system on each, possibly overlapping, slice."""
    flags = F.array(*[F.when(c, F.lit(k)) for k, c in slices.items()])
    preds = F.array(*[F.struct(F.lit(k).alias("system"), c.cast("int").alias("pred")) for k, c in systems.items()])
    long = df.select("y", F.explode(F.array_compact(flags)).alias("slice"), preds.alias("s")).select("y", "slice", F.explode("s").alias("s")).select("y", "slice", "s.*")
    return decision_metrics(long, ("slice", "system")).select("slice", "system", "n", "fpr", "fnr")


def transitions(df: DataFrame) -> DataFrame:
    """What the decisions new change in those of old."""
    y, old, new = F.col("y"), F.col("old"), F.col("new")
    move = lambda a, b, c: F.count_if((y == a) & (old == b) & (new == c))
    return df.agg(move(0, 1, 0).alias("fp_fixed"), move(1, 0, 1).alias("fn_fixed"), move(0, 0, 1).alias("new_fp"), move(1, 1, 0).alias("new_fn"))


def validation_report(scored: DataFrame, probability: bool = True) -> DataFrame:
    """kind ('tuned', '0.5'), threshold, counts and rates, areas, and ece and brier for chances."""
    best = best_threshold(scored).select("threshold").withColumn("kind", F.lit("tuned"))
    half = best.select(F.lit(0.5).alias("threshold"), F.lit("0.5").alias("kind"))
    both = scored.crossJoin(F.broadcast(best.unionByName(half)))  # two rows
    out = confusion(both, F.col("threshold"), ("kind", "threshold")).crossJoin(F.broadcast(auc(scored)))
    return out.crossJoin(F.broadcast(calibration(scored))) if probability else out


def quartile(df: DataFrame, x: str) -> DataFrame:
    """Adds quartile 0 to 3 of x, by exact percentiles."""
    found = quantiles(df, x, {"a": 0.25, "b": 0.5, "c": 0.75})
    cuts = found.select(F.array("a", "b", "c").alias("cuts"))
    marked = df.crossJoin(F.broadcast(cuts))
    return marked.withColumn("quartile", sum(((F.col(x) >= F.col("cuts")[i]).cast("int") for i in range(3)), F.lit(0))).drop("cuts")


def confident_errors(scored: DataFrame, tau: float, k: int, key: str = "id") -> DataFrame:
    """kind (FP, FN), rank, key, score: the k negatives of the greatest scores from tau on, and the k positives of the least below it."""
    out = []
    for kind, rows, order in (("FP", (F.col("y") == 0) & (F.col("score") >= tau), F.desc("score")), ("FN", (F.col("y") == 1) & (F.col("score") < tau), F.asc("score"))):
        top = scored.where(rows).orderBy(order, key).limit(k)
        out.append(top.select(F.lit(kind).alias("kind"), F.row_number().over(Window.partitionBy(F.lit(kind)).orderBy(order, key)).alias("rank"), key, "score"))
    return out[0].unionByName(out[1])


def cluster_tag_rates(tagged: DataFrame, tags: list[str], cluster: str = "cluster", overlap: str = "jaccard") -> DataFrame:
    """By cluster, of decisions pred with outcome: the shares of false positives with each tag and of great overlap, of false negatives
    of little overlap, and the error rates of negatives of great and positives of little overlap. Null where there are none."""
    high, low = F.col(overlap) > 0.6, F.col(overlap) <= 0.2
    share = lambda rows, x: F.avg(F.when(rows, x.cast("int")))
    fp, fn = F.col("outcome") == "FP", F.col("outcome") == "FN"
    return tagged.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), *[share(fp, F.col(t)).alias(f"fp_with_{t}") for t in tags], share(fp, high).alias("fp_high_overlap"), share(fn, low).alias("fn_low_overlap"),
        share((F.col("y") == 0) & high, F.col("pred") == 1).alias("fpr_high_overlap"), share((F.col("y") == 1) & low, F.col("pred") == 0).alias("fnr_low_overlap"),
    )


def rate_profile(features: DataFrame) -> DataFrame:
    """feature, rate: the mean of each column that tells of a difference (mismatch, one_sided, xor, subset)."""
    names = [c for c in features.columns if c.endswith(("_mismatch", "_one_sided", "_xor", "_subset"))]
    row = F.array(*[F.struct(F.lit(c).alias("feature"), F.avg(c).alias("rate")) for c in names])
    return features.agg(row.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def flip_report(errors: DataFrame, decisions: DataFrame, key: str = "id") -> DataFrame:
    """system, outcome, category, total, fixed: labelled errors (key, outcome FP or FN, category) under decisions (key, system, pred)."""
    rows = errors.join(decisions, key)
    right = F.when(F.col("outcome") == "FP", F.col("pred") == 0).otherwise(F.col("pred") == 1)
    return rows.groupBy("system", "outcome", "category").agg(F.count(F.lit(1)).alias("total"), F.count_if(right).alias("fixed"))
