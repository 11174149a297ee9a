"""Further queries of the library: reports on errors, splits, regions and stored vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import annotators
from pairforge.functions import constraints as C
from pairforge.functions import vectors as V
from pairforge.functions.lexical import FEATURES
from pairforge.functions.text import text_key
from pairforge.operators import audit, batches, clusters, graph, kmeans, network, sparse, splits, variants
from pairforge.operators import metrics as M
from pairforge.plans import catalog as K
from pairforge.plans.catalog import query, r6, six
from pairforge.plans.views import scored, table, text_pair_keys, text_pairs, vector_pairs
from pairforge.session import scratch, side_by_side, written


@query(f"""{K._VP}, e AS (SELECT 'FP' AS kind, id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM vp WHERE y = 0 AND score >= 0.5 UNION ALL SELECT 'FN', id, score, row_number() OVER (ORDER BY score, id) FROM vp WHERE y = 1 AND score < 0.5)
SELECT kind, rank::INT AS rank, id, round(score, 6) AS score FROM e WHERE rank <= 10""")
def confident_errors(spark: SparkSession, sf: str) -> DataFrame:
    return six(M.confident_errors(scored(spark, sf), 0.5, 10))


@query(f"""{K._TAGGED}, c AS (SELECT *, (id % 12)::INT AS cluster FROM o) SELECT cluster, count(*) AS n, """
       + ", ".join(f"round(avg({t}::INT) FILTER (outcome = 'FP'), 6) AS fp_with_{t}" for t in K.TAGS)
       + """, round(avg((jaccard > 0.6)::INT) FILTER (outcome = 'FP'), 6) AS fp_high_overlap, round(avg((jaccard <= 0.2)::INT) FILTER (outcome = 'FN'), 6) AS fn_low_overlap,
round(avg(pred::INT) FILTER (y = 0 AND jaccard > 0.6), 6) AS fpr_high_overlap, round(avg((NOT pred)::INT) FILTER (y = 1 AND jaccard <= 0.2), 6) AS fnr_low_overlap FROM c GROUP BY cluster""")  # fmt: skip
def cluster_tag_rates(spark: SparkSession, sf: str) -> DataFrame:
    return six(M.cluster_tag_rates(K.tagged(spark, sf).withColumn("cluster", F.pmod("id", F.lit(12)).cast("int")), K.TAGS))


_PROFILED = ["dateh_mismatch", "dateh_one_sided", "neg_xor", "wh_mismatch", "content_subset"]


@query(f"""{K._ANN}, s AS (SELECT id, {K._dates(1)} AS a, {K._dates(2)} AS b, ' ' || array_to_string(t1, ' ') || ' ' AS p1, ' ' || array_to_string(t2, ' ') || ' ' AS p2 FROM tok),
u AS (SELECT id, a, b, {K._unmatched('a', 'b', 'p2')} AS ua, {K._unmatched('b', 'a', 'p1')} AS ub FROM s),
f AS (SELECT (len(u.a) > 0 AND len(u.b) > 0 AND ua + ub > 0)::INT AS dateh_mismatch, ((len(u.a) > 0) <> (len(u.b) > 0) AND ua + ub > 0)::INT AS dateh_one_sided, ((g1 > 0) <> (g2 > 0))::INT AS neg_xor, (w1 <> '' AND w2 <> '' AND w1 <> w2)::INT AS wh_mismatch, (least(oa, ob) = 0 AND greatest(oa, ob) > 0)::INT AS content_subset FROM b JOIN u USING (id))
""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS rate FROM f" for c in _PROFILED))  # fmt: skip
def rate_profile(spark: SparkSession, sf: str) -> DataFrame:
    p, texts = text_pair_keys(spark, sf)
    groups = ("date_heuristic", "negation", "intent_word", "specificity")
    return six(M.rate_profile(C.constraint_features(p, texts=texts, groups=groups).select(*_PROFILED)))


@query(f"{K._VP}, e AS (SELECT id, CASE WHEN y = 0 THEN 'FP' ELSE 'FN' END AS outcome, 'c' || (id % 3) AS category FROM vp WHERE (y = 0) = (score >= 0.5)), d AS (SELECT id, 'first' AS system, score >= 0.5 AS pred FROM vp UNION ALL SELECT id, 'second', score_b >= 0.5 FROM vp) SELECT system, outcome, category, count(*) AS total, count(*) FILTER ((outcome = 'FP') <> pred) AS fixed FROM e JOIN d USING (id) GROUP BY ALL")
def manual_flips(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of score with a category, under two systems."""
    s = scored(spark, sf)
    errors = s.where((F.col("y") == 0) == (F.col("score") >= 0.5)).select("id", F.when(F.col("y") == 0, "FP").otherwise("FN").alias("outcome"), F.concat(F.lit("c"), F.col("id") % 3).alias("category"))
    systems = F.array(*[F.struct(F.lit(n).alias("system"), (F.col(c) >= 0.5).cast("int").alias("pred")) for n, c in (("first", "score"), ("second", "score_b"))])
    return M.flip_report(errors, s.select("id", F.explode(systems).alias("s")).select("id", "s.*"))


@query("SELECT count(*) AS rows, count(*) - count(DISTINCT (least(l_orderkey, l_partkey), greatest(l_orderkey, l_partkey))) AS repeated FROM lineitem")
def repeated_id_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return audit.repeated_id_pairs(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


# Splits ---------------------------------------------------------------------------------

_PROFILE_SQL = ", ".join(f"round(avg((size > {a}{f' AND size <= {b}' if b else ''})::INT), 6) AS {n}" for n, (a, b) in splits.PROFILE.items())
_STRATEGIES = {"random": K._RANDOM, "component": K._COMP, "node": K._NODE, "hybrid": K._HYBRID}


@query(f"{K._LK} " + " UNION ALL ".join(
    f"SELECT '{s}' AS strategy, split, count(*) AS pairs, round(CASE WHEN split <> '{splits.DROPPED}' THEN count(*)::DOUBLE / (SELECT count(*) FROM {src} WHERE split <> '{splits.DROPPED}') END, 6) AS share_of_retained, round(avg(is_duplicate), 6) AS positive_rate, round((SELECT avg((split <> '{splits.DROPPED}')::INT) FROM {src}), 6) AS retention, {_PROFILE_SQL} FROM {src} GROUP BY split"
    for s, src in _STRATEGIES.items()))
def split_profiles(spark: SparkSession, sf: str) -> DataFrame:
    lk, out = K.linked(spark, sf), None
    for s in _STRATEGIES:
        split = splits.hybrid_split(lk, K.SEED, K._CAP) if s == "hybrid" else splits.make_split(lk, s, K.SEED)  # components of the supplied data are small
        r = splits.profile_report(split).select(F.lit(s).alias("strategy"), "*")
        out = r if out is None else out.unionByName(r)
    return six(out)


def _overlap_sql(name: str, a: str, b: str, other: str, reference: str) -> str:
    sides = f"(SELECT {a} AS key, split FROM sp UNION ALL SELECT {b}, split FROM sp)"
    ref, own = f"(SELECT DISTINCT key FROM {sides} WHERE split = '{reference}')", f"(SELECT DISTINCT key FROM {sides} WHERE split = '{other}')"
    return f"""SELECT '{name}' AS key, '{other}' AS split, '{reference}' AS reference, (SELECT count(*) FROM {own} o SEMI JOIN {ref} r USING (key)) AS shared, (SELECT count(*) FROM {own}) AS texts, count(*) FILTER ({a} IN (SELECT key FROM {ref}) OR {b} IN (SELECT key FROM {ref})) AS pairs_any,
  count(*) FILTER ({a} IN (SELECT key FROM {ref}) AND {b} IN (SELECT key FROM {ref})) AS pairs_both, count(*) AS pairs, round((SELECT count(*) FROM {own} o SEMI JOIN {ref} r USING (key))::DOUBLE / nullif((SELECT count(*) FROM {own}), 0), 6) AS rate FROM sp WHERE split = '{other}'"""


@query(f"{K._LK}, sp AS (SELECT * FROM {K._RANDOM}) " + " UNION ALL ".join(_overlap_sql(n, a, b, o, r) for n, a, b in (("strict", "key_a", "key_b"), ("loose", "loose_a", "loose_b")) for o, r in (("val", "train"), ("test", "train"), ("test", "val"))))
def split_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    split = written(splits.random_split(K.linked(spark, sf), K.SEED), scratch(spark))
    return six(splits.overlap_report(split))


# Regions and vectors ------------------------------------------------------------------------


@query(f"{K._CENT}, w AS (SELECT id, va, vb, y, score FROM vp), q1 AS {K._best_sql('va', 'c1')}, q2 AS {K._best_sql('vb', 'c2')}, t AS (SELECT y, score, c1 <> c2 AS straddle FROM w JOIN q1 USING (id) JOIN q2 USING (id)), m AS (SELECT straddle, count(*) AS n, {K.counts_sql('score >= 0.5')} FROM t GROUP BY straddle), r AS (SELECT *, {K.RATES_SQL} FROM m) SELECT straddle, n, {K.CONF}, {r6(*K.RATES, 'roc_auc', 'pr_auc')} FROM r JOIN {K.auc_sql('straddle', 't')} USING (straddle)")
def straddling_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of pairs whose texts lie in one region, and of those whose texts do not."""
    cents = K.seeds_of(spark, sf)
    p = clusters.assign_pairs(vector_pairs(spark, sf), cents, "same_only").select("y", "score", (F.col("cluster") < 0).alias("straddle"))
    p = written(p, scratch(spark))
    return six(M.confusion(p, 0.5, ("straddle",)).join(M.auc(p, ("straddle",)), "straddle"))


@query("""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), h AS (SELECT vec_id, x, sign(x) * round_even(abs(x) / pow(2, greatest(floor(log2(CASE WHEN x = 0 THEN 1 ELSE abs(x) END)), -14) - 10), 0) * pow(2, greatest(floor(log2(CASE WHEN x = 0 THEN 1 ELSE abs(x) END)), -14) - 10) AS r FROM v)
SELECT vec_id, round(sum(r), 6) AS total, round(max(abs(x - r)) * 1e6, 3) AS most_lost FROM h GROUP BY vec_id""")
def half_precision(spark: SparkSession, sf: str) -> DataFrame:
    """What storing vectors at half precision changes."""
    e = table(spark, sf, "embeddings").select("vec_id", F.explode(V.doubles(F.col("embedding"))).alias("x")).withColumn("r", V.half(F.col("x")))
    return e.groupBy("vec_id").agg(F.round(F.sum("r"), 6).alias("total"), F.round(F.max(F.abs(F.col("x") - F.col("r"))) * 1e6, 3).alias("most_lost"))


@query()
def fit_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of each two of four fits, and of fits on halves."""
    return six(kmeans.fit_agreement(table(spark, sf, "embeddings"), "embedding", "vec_id", 10, [100, 200, 300, 400], [11, 22, 33]))


#: Vectors of one block share a fold.
VECTOR_BLOCK = 50


def folded_vector_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """id, y, fold, a, b (the vectors' ids) and x of vector pairs, so that no vector is in two folds.

    Blocks of neighbouring vectors are the groups that folds are made of. A chain of neighbours links all blocks, as a very
    large component does in the hybrid split: so, as there, a pair across two folds is in neither.
    """
    p = vector_pairs(spark, sf).withColumns({"a": F.floor(F.col("id") / 10), "b": F.floor(F.col("id") / 10) + F.col("id") % 10})
    block = lambda c: F.floor(F.col(c) / VECTOR_BLOCK).cast("string")
    groups = p.groupBy(block("a").alias("group")).agg(F.count(F.lit(1)).alias("pairs"))
    folds = written(splits.group_folds(groups, 5, K.SEED, "group").select("group", "fold"), scratch(spark))
    p = p.join(folds.withColumnRenamed("group", "_g"), F.col("_g") == block("a")).drop("_g")
    p = p.join(folds.select(F.col("group").alias("_g"), F.col("fold").alias("_f")), (F.col("_g") == block("b")) & (F.col("_f") == F.col("fold")), "left_semi")
    return p.select("id", "y", "fold", "a", "b", V.pair_vector(F.col("va"), F.col("vb")).alias("x"))


@query()
def mlp_out_of_fold_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of a network on pair vectors after a fixed number of passes, each from a network of the other folds; no vector is in two folds."""
    d = written(folded_vector_pairs(spark, sf).drop("a", "b"), scratch(spark))
    return network.train(d, 5, batch=2048, rate=4e-3).score(d).select("id", "y", "fold", "score")


@query()
def mlp_early_stop_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of held-out pairs by one network, trained on three folds until its area on a fourth no longer grows."""
    d = written(folded_vector_pairs(spark, sf).drop("a", "b"), scratch(spark))
    net = network.train(d.where("fold > 1"), dev=d.where("fold = 1"), batch=2048, rate=4e-3, epochs=30)
    return net.score(d.where("fold = 0")).select("id", "y", "score")


# Regression on TF-IDF vectors ------------------------------------------------------------------


def split_text_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """id, question1, question2, y (one language), split of text pairs, drawn by text: no text is in two splits."""
    p = text_pairs(spark, sf).select("id", "question1", "question2", F.col("same_lang").alias("y"))
    p = splits.node_split(graph.edges(p), K.SEED).where(F.col("split") != splits.DROPPED)
    return written(p.drop("key_a", "key_b"), scratch(spark))


def tfidf_pair_model(spark: SparkSession, sf: str, grid: list[float]) -> tuple[DataFrame, sparse.TfidfPairModel, list[tuple[float, float]]]:
    p = split_text_pairs(spark, sf)
    return p, *sparse.fit(p.where("split = 'train'"), p.where("split = 'val'"), grid)


@query()
def tfidf_pair_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Average precision on validation pairs of regressions on TF-IDF pair vectors and lexical features, for each strength."""
    return six(spark.createDataFrame(tfidf_pair_model(spark, sf, sparse.GRID)[2], "c double, pr_auc double"))


@query()
def tfidf_pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of validation and test pairs by the regression that does best on validation pairs, saved and loaded before it scores."""
    p, model, _ = tfidf_pair_model(spark, sf, sparse.GRID)
    path = scratch(spark)
    model.save(path)
    held = p.where("split != 'train'")
    return sparse.TfidfPairModel.load(spark, path).score(held).join(held.select("id", "split", "y"), "id").select("id", "split", "y", "score")


# Batches and annotators ---------------------------------------------------------------------------

_PLAN = f"""WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE doc_id IS NOT NULL), r AS (SELECT pass, doc_id, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY pass ORDER BY md5('{K.SEED}|' || pass || '|' || doc_id), doc_id) - 1 AS rank FROM d, range(0, 2) p(pass)),
c AS (SELECT *, rank // 1600 AS chunk, row_number() OVER (PARTITION BY pass, rank // 1600 ORDER BY n, rank) - 1 AS i FROM r), k AS (SELECT pass, doc_id, n, chunk * 50 + i // 32 AS batch, i % 32 AS "at" FROM c),
b AS (SELECT pass, batch, max(n) AS width, row_number() OVER (PARTITION BY pass ORDER BY md5('{K.SEED}|' || pass || '|batch|' || batch), batch) - 1 AS place FROM k GROUP BY pass, batch), bp AS (SELECT * FROM k JOIN b USING (pass, batch))"""


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("doc_id is not null").select("doc_id", F.length("text").cast("long").alias("n"))
    return batches.plan(d, "doc_id", "n", range(2), K.SEED, size=32)


@query(f"{_PLAN} SELECT pass::INT AS pass, place::BIGINT AS place, \"at\"::BIGINT AS \"at\", doc_id, n::BIGINT AS n, width::BIGINT AS width FROM bp")
def length_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The batches of two passes over all documents, those of similar length together, in the order of training."""
    return _batches(spark, sf)


@query(f"{_PLAN} SELECT pass::INT AS pass, count(DISTINCT place) AS batches, count(*) AS \"rows\", sum(n)::BIGINT AS tokens, sum(width)::BIGINT AS padded, (count(*) * max(width))::BIGINT AS padded_without_plan FROM bp GROUP BY pass")
def batch_padding(spark: SparkSession, sf: str) -> DataFrame:
    """What batches of similar length save of padding."""
    return batches.padding(_batches(spark, sf), "n")


#: An annotator by patterns, where no model is at hand: places after a preposition, names of two words, dates.
PATTERNS = [("GPE", r"\b(?:in|at|from)\s+([A-Z]\w+)"), ("PERSON", r"\b([A-Z]\w+ [A-Z]\w+)\b"), ("DATE", r"\b(\d{4}-\d\d-\d\d)\b"), ("TIME", r"\b(\d{1,2}:\d\d)\b")]


@query()
def named_pair_features(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of text pairs on named entities, places and dates, by an annotator that each worker loads once."""
    patterns = PATTERNS
    p, texts = text_pair_keys(spark, sf)
    made = annotators.named_features(p, "patterns", lambda: annotators.Rules(patterns), texts)
    return six(made.select("id", *[c for g in ("date", "entity_named", "location") for c in annotators.GROUPS[g]]))


# Choice among variants ----------------------------------------------------------------------------

#: Variants by the rule of thresholds.choose_stepwise: the first, the simpler one without entities, and the richer ones of each.
RICHER = {"all": ("all_lexical", "all_trees"), "less": ("less_lexical", "less_trees")}
NAMED_PAIRS = [("all", "less"), *[(f"{b}_{k}", b) for b in RICHER for k in ("lexical", "trees")], *[(f"{b}_trees", f"{b}_lexical") for b in RICHER], ("all_trees", "less_trees"), *[(v, "lexical") for b, r in RICHER.items() for v in (b, *r)]]
BOOTSTRAPS = 1000


def variant_columns() -> dict[str, tuple[str, list[str]]]:
    all_ = [c for g in C.GROUPS.values() for c in g]
    less = [c for k, g in C.GROUPS.items() if k != "entity_heuristic" for c in g]
    out = {"lexical": ("lr", list(FEATURES))}
    for name, columns in (("all", all_), ("less", less)):
        out |= {name: ("lr", columns), f"{name}_lexical": ("lr", [*columns, *[c for c in FEATURES if c not in columns]]), f"{name}_trees": ("trees", columns)}
    return out


def _variant_features(spark: SparkSession, sf: str) -> DataFrame:
    p, (_, texts) = split_text_pairs(spark, sf), text_pair_keys(spark, sf)
    keys = p.select("id", "y", "split", *[text_key(F.col(f"question{i}")).alias(f"_k{i}") for i in (1, 2)])
    return written(K.pair_features(keys, texts), scratch(spark))


def _variant_scores(f: DataFrame, names: list[str]) -> tuple[DataFrame, dict]:
    """Validation pairs with a column of scores for each variant, and the models, which know training pairs only."""
    spark, train, held, path = f.sparkSession, f.where("split = 'train'"), f.where("split = 'val'"), scratch(f.sparkSession)

    def scored(name: str) -> tuple[DataFrame, PipelineModel]:
        kind, columns = variant_columns()[name]
        model = variants.fit(train, kind, columns)
        made = variants.Bundle(model, name, columns, 0.5).score(held).select("id", F.col("score").alias(name))
        return written(made, f"{path}/{name}"), model

    fitted = dict(zip(names, side_by_side(spark, scored, names), strict=True))
    scores = reduce(lambda a, b: a.join(b, "id"), [s for s, _ in fitted.values()], held.select("id", "y"))
    return written(scores, scratch(spark)), {name: model for name, (_, model) in fitted.items()}


@query()
def variant_gains(spark: SparkSession, sf: str) -> DataFrame:
    """Gains of named pairs of variants on validation pairs, with intervals over one draw of weights for all variants."""
    scores, fitted = _variant_scores(_variant_features(spark, sf), list(variant_columns()))
    return six(variants.gains(scores, variants.tuned(scores, list(fitted)), NAMED_PAIRS, BOOTSTRAPS))


@query()
def chosen_variant_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores and decisions on test pairs of the variant that the rule chooses on validation pairs, saved and loaded before it scores."""
    f = _variant_features(spark, sf)
    scores, fitted = _variant_scores(f, ["all", "less"])
    taus = variants.tuned(scores, list(fitted))
    found = variants.gains(scores, taus, [("all", "less")], BOOTSTRAPS)
    base = variants.chosen(found, "all", "less", {"all": (), "less": ()})
    # Only the richer variants of what is chosen first are asked for, so no others are fitted.
    more, fitted_more = _variant_scores(f, list(RICHER[base]))
    fitted |= fitted_more
    taus |= variants.tuned(more, list(RICHER[base]))
    own = {n: taus[n] for n in (base, *RICHER[base])}
    pairs = [p for p in NAMED_PAIRS if set(p) <= set(own)]
    found = found.unionByName(variants.gains(scores.join(more.drop("y"), "id"), own, pairs, BOOTSTRAPS))
    name = variants.chosen(found, "all", "less", RICHER)
    path = scratch(spark)
    variants.Bundle(fitted[name], name, variant_columns()[name][1], taus[name]).save(path)
    made = variants.Bundle.load(spark, path).score(f.where("split = 'test'"))
    return made.select("id", "y", F.lit(name).alias("variant"), "score", "pred")
