"""The queries of the library by name, and the DuckDB SQL that they equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import constraints as C
from pairforge.functions import text as X
from pairforge.functions import vectors as V
from pairforge.functions.lexical import FEATURES, audit_jaccard, lexical_features, with_tokens
from pairforge.operators import audit, clusters, explain, graph, kmeans, models, poisson, quantiles, replicates, resample, splits, tfidf, thresholds, vocabulary
from pairforge.operators import metrics as M
from pairforge.plans.views import PAIRS_SQL, STOPS_SQL, TOKENS_SQL, VECTORS_SQL, except_sql, jaccard_sql, key_sql, norm_sql, q, scored, table, text_pair_keys, text_pairs, tokens_sql, vector_pairs, words_sql
from pairforge.session import ready, scratch, side_by_side, tidy, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(ready(spark), sf_dir)
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def six(df: DataFrame) -> DataFrame:
    """Doubles at six decimals."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def div(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"


RATES_SQL = f"""{div('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {div('tp', 'tp + fp')} AS precision, {div('tp', 'tp + fn')} AS recall, {div('2 * tp', '2 * tp + fp + fn')} AS f1, {div('fp', 'fp + tn')} AS fpr, {div('fn', 'fn + tp')} AS fnr"""


def counts_sql(pred: str) -> str:
    return ", ".join(f"count(*) FILTER (y = {a} AND ({pred}) = {str(b).lower()}) AS {n}" for n, a, b in (("tn", 0, False), ("fp", 0, True), ("fn", 1, False), ("tp", 1, True)))


RATES = ["accuracy", "precision", "recall", "f1", "fpr", "fnr"]
CONF = "tn, fp, fn, tp"

# Audit ------------------------------------------------------------------------


@query(f"WITH {PAIRS_SQL} SELECT * FROM (SELECT unnest(['id', 'question1', 'question2', 'is_duplicate', 'same_lang']) AS \"column\", unnest([count(*) FILTER (id IS NULL), count(*) FILTER (question1 IS NULL), count(*) FILTER (question2 IS NULL), count(*) FILTER (is_duplicate IS NULL), count(*) FILTER (same_lang IS NULL)]) AS nulls FROM pairs)")
def missing_counts(spark: SparkSession, sf: str) -> DataFrame:
    return audit.missing(text_pairs(spark, sf))


@query(f"WITH {PAIRS_SQL} SELECT count(*) FILTER (bad) AS invalid, count(*) FILTER (NOT bad) AS valid FROM (SELECT lower(trim(coalesce(question1, ''))) IN ('', 'n/a') OR lower(trim(coalesce(question2, ''))) IN ('', 'n/a') AS bad FROM pairs)")
def invalid_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = text_pairs(spark, sf)
    return p.agg(F.count_if(audit.invalid(p)).alias("invalid"), F.count_if(~audit.invalid(p)).alias("valid"))


@query(f"WITH {PAIRS_SQL}, t AS (SELECT unnest([coalesce(question1, ''), coalesce(question2, '')]) AS t FROM pairs) SELECT * FROM (SELECT unnest([" + ", ".join(q(k) for k in [*audit.ISSUES, "no_question_mark", "multiple_question_marks", "null_like"]) + "]) AS issue, unnest([" + ", ".join(f"count(*) FILTER (regexp_matches(t, {q(p)}))" for p in audit.ISSUES.values()) + f", count(*) FILTER (NOT contains(t, '?')), count(*) FILTER (len(t) - len(replace(t, '?', '')) > 1), count(*) FILTER (list_contains({words_sql(audit.NULL_LIKE)}, t))]) AS texts FROM t)")
def text_issue_counts(spark: SparkSession, sf: str) -> DataFrame:
    return audit.text_issues(text_pairs(spark, sf))


LOHI = "md5(least(coalesce(question1, ''), coalesce(question2, ''))) AS lo, md5(greatest(coalesce(question1, ''), coalesce(question2, ''))) AS hi"


@query(f"""WITH {PAIRS_SQL}, p AS (SELECT *, {LOHI} FROM pairs), g AS (SELECT count(*) AS n, count(DISTINCT is_duplicate) AS labels FROM p GROUP BY lo, hi)
SELECT count(*) AS rows, count(*) - count(DISTINCT (md5(question1), md5(question2), is_duplicate)) AS same_but_id, count(*) - count(DISTINCT id) AS same_id, (SELECT sum(n - 1)::BIGINT FROM g) AS same_pair, (SELECT count(*) FILTER (labels > 1) FROM g) AS conflicting FROM p""")
def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return audit.duplicate_rows(text_pairs(spark, sf))


@query(f"WITH {PAIRS_SQL}, p AS (SELECT *, {LOHI} FROM pairs), w AS (SELECT id, is_duplicate, count(*) OVER (PARTITION BY lo, hi) AS times FROM p) SELECT * FROM w WHERE times > 1")
def repeated_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return audit.repeated_pairs(text_pairs(spark, sf)).select("id", "is_duplicate", "times")


@query(f"WITH {PAIRS_SQL}, k2 AS (SELECT unnest([question1, question2]) AS t FROM pairs) SELECT count(DISTINCT md5(t)) AS texts, count(DISTINCT md5({key_sql('t')})) AS keys, count(DISTINCT md5(trim(regexp_replace(lower(t), '[^0-9a-z]+', ' ', 'g')))) AS loose_keys FROM k2")
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = audit.texts(text_pairs(spark, sf))
    return t.agg(F.count_distinct(F.md5("text")).alias("texts"), F.count_distinct(F.md5(X.identity_key(F.col("text")))).alias("keys"), F.count_distinct(F.md5(X.loose_key(F.col("text")))).alias("loose_keys"))


KEYS_SQL = f"WITH {PAIRS_SQL}, f AS (SELECT md5({key_sql('t')}) AS key, count(*) AS times FROM (SELECT unnest([question1, question2]) AS t FROM pairs) GROUP BY 1)"


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    return audit.texts(text_pairs(spark, sf)).select(F.md5(X.identity_key(F.col("text"))).alias("key"))


@query(f"{KEYS_SQL} SELECT count(*) AS keys, count(*) FILTER (times = 1) AS once, max(times) AS most, quantile_cont(times::DOUBLE, 0.5) AS q50, round(quantile_cont(times::DOUBLE, 0.9), 6) AS q90, round(quantile_cont(times::DOUBLE, 0.99), 6) AS q99, round(quantile_cont(times::DOUBLE, 0.999), 6) AS q999 FROM f")
def key_frequency_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return six(audit.frequency_quantiles(keyed(spark, sf), "key"))


@query(f"{KEYS_SQL} SELECT times, count(*) AS keys FROM f GROUP BY times")
def key_frequency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return audit.frequencies(keyed(spark, sf), "key").groupBy("times").agg(F.count(F.lit(1)).alias("keys"))


@query(f"{KEYS_SQL} SELECT key, times FROM f ORDER BY times DESC, key LIMIT 10")
def top_repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    return audit.top_keys(keyed(spark, sf), "key")


@query(rf"""WITH {PAIRS_SQL}, t AS (SELECT unnest([question1, question2]) AS t FROM pairs), l AS (SELECT 'chars' AS unit, len(t) AS n FROM t UNION ALL SELECT 'words', CASE WHEN trim(regexp_replace(t, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(t, '\s+', ' ', 'g')), ' ')) END FROM t)
SELECT unit, round(avg(n), 6) AS mean, round(quantile_cont(n::DOUBLE, 0.5), 6) AS median, min(n)::INT AS min, round(quantile_cont(n::DOUBLE, 0.01), 6) AS p1, round(quantile_cont(n::DOUBLE, 0.99), 6) AS p99, max(n)::INT AS max FROM l GROUP BY unit""")
def length_stats(spark: SparkSession, sf: str) -> DataFrame:
    return six(audit.length_stats(text_pairs(spark, sf)))


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    p = text_pairs(spark, sf)
    return p.withColumn("diff", F.abs(audit.word_count(F.col("question1")) - audit.word_count(F.col("question2"))))


def _wc(x: str) -> str:
    t = rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
    return f"(CASE WHEN {t} = '' THEN 0 ELSE len(string_split({t}, ' ')) END)"


@query(f"WITH {PAIRS_SQL} SELECT is_duplicate, quantile_cont(abs({_wc('question1')} - {_wc('question2')})::DOUBLE, 0.5) AS median FROM pairs GROUP BY is_duplicate")
def median_word_diff_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.quantiles(_diff(spark, sf), "diff", {"median": 0.5}, ("is_duplicate",))


@query(rf"WITH {PAIRS_SQL}, w AS (SELECT is_duplicate, list_distinct(regexp_extract_all(lower(question1), '[\p{{L}}\p{{N}}_]+')) AS a, list_distinct(regexp_extract_all(lower(question2), '[\p{{L}}\p{{N}}_]+')) AS b FROM pairs), j AS (SELECT is_duplicate, {jaccard_sql('a', 'b')} AS x FROM w) SELECT is_duplicate, count(*) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, round(max(x), 6) AS max FROM j GROUP BY is_duplicate")
def audit_jaccard_by_label(spark: SparkSession, sf: str) -> DataFrame:
    p = text_pairs(spark, sf).withColumn("x", audit_jaccard(F.col("question1"), F.col("question2")))
    return six(audit.describe(p, "x", "is_duplicate"))


@query(f"WITH {PAIRS_SQL}, t AS (SELECT DISTINCT t FROM (SELECT unnest([question1, question2]) AS t FROM pairs)), u AS (SELECT len(t) AS length, md5(t) AS key FROM t), r AS (SELECT 'shortest' AS \"end\", row_number() OVER (ORDER BY length, key)::INT AS rank, length::INT AS length, key FROM u UNION ALL SELECT 'longest', row_number() OVER (ORDER BY length DESC, key)::INT, length::INT, key FROM u) SELECT * FROM r WHERE rank <= 5")
def shortest_longest_texts(spark: SparkSession, sf: str) -> DataFrame:
    return audit.extremes(text_pairs(spark, sf), 5)


@query(f"WITH {PAIRS_SQL} SELECT is_duplicate, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM pairs GROUP BY is_duplicate")
def label_shares(spark: SparkSession, sf: str) -> DataFrame:
    return six(audit.shares(text_pairs(spark, sf), "is_duplicate"))


@query("SELECT lang, count(*) FILTER (quality = 0) AS q0, count(*) FILTER (quality = 1) AS q1 FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def crosstab(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return rows.groupBy("lang").pivot("quality", [0, 1]).agg(F.count(F.lit(1))).select("lang", F.coalesce("0", F.lit(0)).alias("q0"), F.coalesce("1", F.lit(0)).alias("q1"))


@query(f"WITH {PAIRS_SQL} SELECT id, is_duplicate FROM pairs ORDER BY md5('11|' || id), id LIMIT 50")
def control_sample(spark: SparkSession, sf: str) -> DataFrame:
    return splits.sample(text_pairs(spark, sf).select("id", "is_duplicate"), 50, 11)


@query("SELECT key, min(doc_id) AS doc_id FROM (SELECT doc_id, md5(" + key_sql("text") + ") AS key FROM documents) GROUP BY key")
def first_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return audit.first_rows(table(spark, sf, "documents").select("doc_id", F.md5(X.identity_key(F.col("text"))).alias("key")), "key", ["doc_id"])


# Text and pair features ---------------------------------------------------------


@query(rf"SELECT doc_id, md5({norm_sql('text')}) AS normalized, md5({key_sql('text')}) AS identity, md5(trim(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g'))) AS loose, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS cleaned FROM documents")
def normalized_texts(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(X.normalize(t)).alias("normalized"), F.md5(X.identity_key(t)).alias("identity"), F.md5(X.loose_key(t)).alias("loose"), F.md5(X.cleaned(t)).alias("cleaned"))


@query(f"WITH t AS (SELECT doc_id, {tokens_sql(norm_sql('text'))} AS t FROM documents) SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens, md5(array_to_string(t, ' ')) AS canon, len({except_sql('t', STOPS_SQL)}) AS content_tokens FROM t")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("n", X.normalize(F.col("text"))).select("doc_id", X.tokenize(F.col("n")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"), F.md5(F.array_join("t", " ")).alias("canon"), F.size(F.array_except("t", X.words_of(X.STOP_WORDS))).cast("long").alias("content_tokens"))


@query(f"WITH t AS (SELECT doc_id, {tokens_sql(norm_sql('text'))} AS t FROM documents), g AS (SELECT unnest(t) AS term FROM t UNION ALL SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM t) SELECT term, count(*) AS times FROM g GROUP BY term HAVING count(*) >= 20")
def frequent_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("t", X.tokenize(X.normalize(F.col("text"))))
    return d.select(F.explode(X.word_ngrams(F.col("t"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("times")).where("times >= 20")


_LEX = f"""WITH {TOKENS_SQL}, ch AS (SELECT *, string_split(' ' || n1 || ' ', '') AS h1, string_split(' ' || n2 || ' ', '') AS h2 FROM tok), s AS (SELECT *, list_distinct(t1) AS s1, list_distinct(t2) AS s2, {except_sql('t1', STOPS_SQL)} AS c1, {except_sql('t2', STOPS_SQL)} AS c2,
  list_distinct(list_transform(range(1, len(h1) - 1), lambda i: h1[i] || h1[i + 1] || h1[i + 2])) AS g1, list_distinct(list_transform(range(1, len(h2) - 1), lambda i: h2[i] || h2[i + 1] || h2[i + 2])) AS g2 FROM ch),
lex AS (SELECT id, is_duplicate, same_lang, {jaccard_sql('s1', 's2')} AS word_jaccard, {jaccard_sql('c1', 'c2')} AS content_jaccard, len(list_intersect(s1, s2))::DOUBLE AS common_word_count,
  {div('len(list_intersect(s1, s2))', 'least(len(s1), len(s2))')} AS common_ratio_min, {div('len(list_intersect(s1, s2))', 'greatest(len(s1), len(s2))')} AS common_ratio_max, {jaccard_sql('g1', 'g2')} AS char3_jaccard,
  abs(len(t1) - len(t2))::DOUBLE AS word_count_absdiff, abs(len(n1) - len(n2))::DOUBLE AS char_len_absdiff, {div('least(len(t1), len(t2))', 'greatest(len(t1), len(t2))')} AS length_ratio,
  coalesce(t1[1] = t2[1], false)::INT::DOUBLE AS first_word_equal, coalesce(t1[-1] = t2[-1], false)::INT::DOUBLE AS last_word_equal FROM s)"""


@query(f"{_LEX} SELECT id, {r6(*FEATURES)} FROM lex")
def lexical_pair_features(spark: SparkSession, sf: str) -> DataFrame:
    p, texts = text_pair_keys(spark, sf)
    return six(lexical_features(p, texts=texts).select("id", *FEATURES))


_ANN = f"""WITH {TOKENS_SQL}, a AS (SELECT *,
  {except_sql('t1', words_sql([*X.STOP_WORDS, *X.NEGATIONS]))} AS c1, {except_sql('t2', words_sql([*X.STOP_WORDS, *X.NEGATIONS]))} AS c2,
  len(list_filter(t1, lambda x: list_contains({words_sql(X.NEGATIONS)}, x))) + len(regexp_extract_all(n1, {q(chr(92) + 'bnon-?[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]')})) AS g1,
  len(list_filter(t2, lambda x: list_contains({words_sql(X.NEGATIONS)}, x))) + len(regexp_extract_all(n2, {q(chr(92) + 'bnon-?[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]')})) AS g2,
  CASE WHEN list_contains({words_sql(X.WH_WORDS)}, t1[1]) THEN t1[1] ELSE '' END AS w1, CASE WHEN list_contains({words_sql(X.WH_WORDS)}, t2[1]) THEN t2[1] ELSE '' END AS w2 FROM tok),
b AS (SELECT *, len({except_sql('c1', 'c2')}) AS oa, len({except_sql('c2', 'c1')}) AS ob FROM a)"""


@query(f"""{_ANN} SELECT id, ((g1 > 0) <> (g2 > 0))::INT::DOUBLE AS neg_xor, abs(g1 - g2)::DOUBLE AS neg_count_diff, (w1 <> '' AND w2 <> '' AND w1 <> w2)::INT::DOUBLE AS wh_mismatch, greatest(oa, ob)::DOUBLE AS extra_content_max,
least(oa, ob)::DOUBLE AS extra_content_min, (least(oa, ob) = 0 AND greatest(oa, ob) > 0)::INT::DOUBLE AS content_subset, round(abs(ln(len(t1) + 1) - ln(len(t2) + 1)), 6) AS log_len_ratio, abs(len(t1) - len(t2))::DOUBLE AS word_count_absdiff FROM b""")
def negation_scope_features(spark: SparkSession, sf: str) -> DataFrame:
    p, texts = text_pair_keys(spark, sf)
    groups = ("negation", "intent_word", "specificity")
    return six(C.constraint_features(p, texts=texts, groups=groups).select("id", *[c for g in groups for c in C.GROUPS[g]]))


_DATE = q(r"\b(" + "|".join(C.DATE_WORDS) + r")\b")
_YEAR = q(r"\b(1[89]\d\d|20\d\d)s?\b")


def _dates(i: int) -> str:
    return f"list_distinct(list_concat(regexp_extract_all(n{i}, {_YEAR}, 1), regexp_extract_all(n{i}, {_DATE}, 1)))"


def _unmatched(a: str, b: str, n: str) -> str:
    return f"len(list_filter({a}, lambda x: NOT list_contains({b}, x) AND NOT contains({n}, ' ' || x || ' ')))"


@query(f"""WITH {TOKENS_SQL}, s AS (SELECT id, {_dates(1)} AS a, {_dates(2)} AS b, ' ' || array_to_string(t1, ' ') || ' ' AS p1, ' ' || array_to_string(t2, ' ') || ' ' AS p2 FROM tok),
u AS (SELECT id, a, b, {_unmatched('a', 'b', 'p2')} AS ua, {_unmatched('b', 'a', 'p1')} AS ub FROM s)
SELECT id, (len(a) > 0 OR len(b) > 0)::INT::DOUBLE AS dateh_any, (len(a) > 0 AND len(b) > 0)::INT::DOUBLE AS dateh_both, (ua + ub)::DOUBLE AS dateh_unmatched_total, greatest(ua, ub)::DOUBLE AS dateh_unmatched_max_side,
(len(a) > 0 AND len(b) > 0 AND ua + ub > 0)::INT::DOUBLE AS dateh_mismatch, ((len(a) > 0) <> (len(b) > 0) AND ua + ub > 0)::INT::DOUBLE AS dateh_one_sided FROM u""")
def date_consistency(spark: SparkSession, sf: str) -> DataFrame:
    p, texts = text_pair_keys(spark, sf)
    return C.constraint_features(p, texts=texts, groups=("date_heuristic",)).select("id", *C.GROUPS["date_heuristic"])


@query()
def number_entity_consistency(spark: SparkSession, sf: str) -> DataFrame:
    p, texts = text_pair_keys(spark, sf)
    return C.constraint_features(p, texts=texts, groups=("number", "entity_heuristic")).select("id", *C.GROUPS["number"], *C.GROUPS["entity_heuristic"])


def _caps(i: int) -> str:
    """Capitalised words within sentences: the first of a text or sentence is passed over."""
    pattern = r"(?:^|[.?!]\s)[A-Z][\p{L}\p{N}_]*|[^\p{L}\p{N}_]([A-Z][\p{L}\p{N}_'-]*)"
    return f"regexp_extract_all(trim(question{i}), {q(pattern)}, 1)"


_ENTITY = f"len(list_filter(diff, lambda x: list_contains(caps, x) AND NOT list_contains({words_sql(C.PRONOUN)}, x))) > 0 AS entity_diff"
_CAPS = f"list_transform(list_concat({_caps(1)}, {_caps(2)}), lambda x: lower(x)) AS caps"


@query(f"""WITH {TOKENS_SQL}, e AS (SELECT id, list_concat({except_sql('t1', 't2')}, {except_sql('t2', 't1')}) AS diff, list_concat(t1, t2) AS both_, {jaccard_sql('t1', 't2')} AS jaccard, {_CAPS} FROM tok)
SELECT id, {_ENTITY}, len(list_filter(diff, lambda x: regexp_matches(x, '[0-9]'))) > 0 AS number_diff, len(list_filter(diff, lambda x: list_contains({words_sql(X.TAG_NEGATIONS)}, x) OR (starts_with(x, 'non') AND list_contains(both_, x[4:])))) > 0 AS negation_diff,
jaccard >= 0.6 AS high_overlap, jaccard < 0.2 AS low_overlap, len(list_filter(diff, lambda x: regexp_matches(x, '^(19|20)[0-9][0-9]$') OR list_contains({words_sql(C.DATE_WORDS[:19])}, x))) > 0 AS date_diff FROM e""")
def pair_error_tags(spark: SparkSession, sf: str) -> DataFrame:
    p, texts = text_pair_keys(spark, sf)
    t = C.error_tags(p, texts=texts)
    return t.select("id", "number_diff", "entity_diff", "negation_diff", "high_overlap", "low_overlap", "date_diff")


# Decisions on text pairs: same language, by overlap of words -----------------------

TAGS = ["number_diff", "entity_diff", "negation_diff", "high_overlap", "low_overlap"]
_TAGGED = f"""WITH {TOKENS_SQL}, e AS (SELECT id, same_lang AS y, list_concat({except_sql('t1', 't2')}, {except_sql('t2', 't1')}) AS diff, list_concat(t1, t2) AS both_, {jaccard_sql('t1', 't2')} AS jaccard, {_CAPS} FROM tok),
g AS (SELECT id, y, jaccard, jaccard >= 0.05 AS pred, jaccard >= 0.1 AS new_, {_ENTITY}, len(list_filter(diff, lambda x: regexp_matches(x, '[0-9]'))) > 0 AS number_diff, len(list_filter(diff, lambda x: list_contains({words_sql(X.TAG_NEGATIONS)}, x) OR (starts_with(x, 'non') AND list_contains(both_, x[4:])))) > 0 AS negation_diff,
  jaccard >= 0.6 AS high_overlap, jaccard < 0.2 AS low_overlap FROM e),
o AS (SELECT *, CASE WHEN y = 1 AND pred THEN 'TP' WHEN y = 0 AND pred THEN 'FP' WHEN y = 0 THEN 'TN' ELSE 'FN' END AS outcome FROM g)"""
_LONG = ", ".join(f"{{'tag': '{t}', 'has': {t}::INT}}" for t in TAGS)


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """id, y, jaccard, pred, new, tags, outcome."""
    p, texts = text_pair_keys(spark, sf)
    t = C.error_tags(p, texts=texts).withColumnRenamed("same_lang", "y")
    t = t.withColumns({"pred": (F.col("jaccard") >= 0.05).cast("int"), "new": (F.col("jaccard") >= 0.1).cast("int")})
    t = t.withColumn("outcome", M.outcome(F.col("y"), F.col("pred"))).select("id", "y", "jaccard", "pred", "new", "outcome", *TAGS)
    return t


@query(f"{_TAGGED}, l AS (SELECT outcome, unnest([{_LONG}]) AS t FROM o) SELECT t.tag AS tag, " + ", ".join(f"round(avg(t.has) FILTER (outcome = '{o}'), 6) AS \"{o}\"" for o in ("TP", "FP", "TN", "FN")) + " FROM l GROUP BY t.tag")
def tag_share_by_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return six(M.tag_shares(tagged(spark, sf), TAGS))


_RATE = ", ".join(f"{f} AS {n}" for n, f in {
    "negatives_with_tag": "count(*) FILTER (y = 0 AND has = 1)", "fpr_with_tag": "round(avg((outcome = 'FP')::INT) FILTER (y = 0 AND has = 1), 6)", "fpr_without_tag": "round(avg((outcome = 'FP')::INT) FILTER (y = 0 AND has = 0), 6)",
    "positives_with_tag": "count(*) FILTER (y = 1 AND has = 1)", "fnr_with_tag": "round(avg((outcome = 'FN')::INT) FILTER (y = 1 AND has = 1), 6)", "fnr_without_tag": "round(avg((outcome = 'FN')::INT) FILTER (y = 1 AND has = 0), 6)",
}.items())


@query(f"{_TAGGED}, l AS (SELECT outcome, y, unnest([{_LONG}]) AS t FROM o), m AS (SELECT outcome, y, t.tag AS tag, t.has AS has FROM l) SELECT tag, {_RATE} FROM m GROUP BY tag")
def tag_error_rates(spark: SparkSession, sf: str) -> DataFrame:
    return six(M.tag_error_rates(tagged(spark, sf), TAGS))


EDGES = [-0.001, 0.05, 0.1, 0.2, 0.5, 1.0]
_BAND = "CASE " + " ".join(f"WHEN jaccard > {a} AND jaccard <= {b} THEN '({a}, {b}]'" for a, b in zip(EDGES[:-1], EDGES[1:], strict=True)) + " END"


@query(f"{_TAGGED}, b AS (SELECT {_BAND} AS band, {counts_sql('pred')}, count(*) AS n FROM o GROUP BY 1) SELECT band, n, round({div('tp + fn', 'n')}, 6) AS prevalence, round({div('fp', 'fp + tn')}, 6) AS fpr, round({div('fn', 'fn + tp')}, 6) AS fnr FROM b WHERE band IS NOT NULL")
def overlap_band_rates(spark: SparkSession, sf: str) -> DataFrame:
    return six(M.band_rates(tagged(spark, sf), "jaccard", EDGES))


@query(f"{_TAGGED}, l AS (SELECT outcome, y, {_BAND} AS band, unnest([{_LONG}]) AS t FROM o), m AS (SELECT outcome, y, band, t.tag AS tag, t.has AS has FROM l WHERE band IS NOT NULL) SELECT band, tag, {_RATE} FROM m GROUP BY band, tag")
def band_by_tag_rates(spark: SparkSession, sf: str) -> DataFrame:
    t = tagged(spark, sf).withColumn("band", M.band(F.col("jaccard"), EDGES)).where("band is not null")
    return six(M.tag_error_rates(t, TAGS, ("band",)))


@query(f"""{_TAGGED}, s AS (SELECT y, pred, new_, unnest(list_filter([CASE WHEN jaccard > 0.6 THEN 'high' END, CASE WHEN jaccard <= 0.2 THEN 'low' END, CASE WHEN number_diff AND jaccard <= 0.2 THEN 'low_number' END], lambda x: x IS NOT NULL)) AS slice FROM o),
t AS (SELECT slice, 'old' AS system, y, pred AS p FROM s UNION ALL SELECT slice, 'new', y, new_ FROM s), c AS (SELECT slice, system, count(*) AS n, {counts_sql('p')} FROM t GROUP BY 1, 2)
SELECT slice, system, n, round({div('fp', 'fp + tn')}, 6) AS fpr, round({div('fn', 'fn + tp')}, 6) AS fnr FROM c""")
def slice_rates(spark: SparkSession, sf: str) -> DataFrame:
    j = F.col("jaccard")
    return six(M.slice_rates(tagged(spark, sf), {"high": j > 0.6, "low": j <= 0.2, "low_number": F.col("number_diff") & (j <= 0.2)}, {"old": F.col("pred"), "new": F.col("new")}))


@query(f"{_TAGGED} SELECT count(*) FILTER (y = 0 AND pred AND NOT new_) AS fp_fixed, count(*) FILTER (y = 1 AND NOT pred AND new_) AS fn_fixed, count(*) FILTER (y = 0 AND NOT pred AND new_) AS new_fp, count(*) FILTER (y = 1 AND pred AND NOT new_) AS new_fn FROM o")
def decision_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return M.transitions(tagged(spark, sf).withColumnRenamed("pred", "old"))


# Scored vector pairs --------------------------------------------------------------

_VP = f"WITH {VECTORS_SQL}"
_SWEEP = ", g AS (SELECT i AS k, i::DOUBLE / 100 AS threshold FROM range(0, 101) t(i))"


def sweep_sql(by: str = "", src: str = "vp", score: str = "score") -> str:
    b = f"{by}, " if by else ""
    return f"(SELECT {b}k, threshold, predicted, tp, positives, {div('tp', 'predicted')} AS precision, {div('tp', 'positives')} AS recall, {div('2 * tp', 'predicted + positives')} AS f1 FROM (SELECT {b}k, threshold, count(*) FILTER ({score} >= threshold) AS predicted, count(*) FILTER ({score} >= threshold AND y = 1) AS tp, sum(y)::BIGINT AS positives FROM {src}, g GROUP BY {b}k, threshold))"


def best_sql(by: str = "", src: str = "vp", score: str = "score") -> str:
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"(SELECT {b}threshold, f1 FROM (SELECT *, row_number() OVER ({part}ORDER BY f1 DESC, k) AS r FROM {sweep_sql(by, src, score)}) WHERE r = 1)"


@query(f"{_VP}{_SWEEP} SELECT k::INT AS k, threshold, predicted, tp, positives, {r6('precision', 'recall', 'f1')} FROM {sweep_sql()}")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return six(M.sweep(scored(spark, sf)))


@query(f"{_VP}{_SWEEP} SELECT threshold, round(f1, 6) AS f1 FROM {best_sql()}")
def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return six(M.best_threshold(scored(spark, sf)))


@query(f"{_VP}, c AS (SELECT count(*) AS n, {counts_sql('score >= 0.5')} FROM vp), m AS (SELECT *, {RATES_SQL} FROM c) SELECT n, {CONF}, {r6(*RATES)} FROM m")
def confusion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return six(M.confusion(scored(spark, sf), 0.5))


def auc_sql(by: str = "", src: str = "vp") -> str:
    b, on, part = (f"{by}, ", f"p.{by} = n.{by}", f"PARTITION BY {by} ") if by else ("", "true", "")
    pb = f"p.{by}, " if by else ""
    gb = f"GROUP BY p.{by}" if by else ""
    gb2 = f"GROUP BY {by}" if by else ""
    ap = f"(SELECT {b}sum(p * tp / cn) / max(pos) AS pr_auc FROM (SELECT {b}p, sum(p) OVER w AS tp, sum(n) OVER w AS cn, sum(p) OVER ({part.strip()}) AS pos FROM (SELECT {b}score, sum(y)::DOUBLE AS p, count(*)::DOUBLE AS n FROM {src} GROUP BY {b}score) WINDOW w AS ({part}ORDER BY score DESC)) {gb2})"
    roc = f"(SELECT {pb}avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END) AS roc_auc FROM (SELECT * FROM {src} WHERE y = 1) p JOIN (SELECT * FROM {src} WHERE y = 0) n ON {on} {gb})"
    return f"(SELECT * FROM {roc} a JOIN {ap} b USING ({by}))" if by else f"(SELECT * FROM {roc} a, {ap} b)"


@query(f"{_VP} SELECT {r6('roc_auc', 'pr_auc')} FROM {auc_sql()}")
def ranking_areas(spark: SparkSession, sf: str) -> DataFrame:
    return six(M.auc(scored(spark, sf)))


@query(f"{_VP} SELECT cluster, {r6('roc_auc', 'pr_auc')} FROM {auc_sql('cluster')}")
def ranking_areas_by_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return six(M.auc(scored(spark, sf), ("cluster",)))


@query(f"{_VP} SELECT DISTINCT score, (SELECT count(*) FROM vp b WHERE b.score >= a.score AND y = 1) AS tp, (SELECT count(*) FROM vp b WHERE b.score >= a.score AND y = 0) AS fp FROM vp a")
def curve_points(spark: SparkSession, sf: str) -> DataFrame:
    return M.curve_points(scored(spark, sf))


@query(f"{_VP}, b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS s, avg(y) AS p FROM vp GROUP BY 1) SELECT round(sum(n * abs(s - p)) / sum(n), 6) AS ece, (SELECT round(avg((score - y) * (score - y)), 6) FROM vp) AS brier FROM b")
def calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    return six(M.calibration(scored(spark, sf)))


@query(f"{_VP}, t AS (SELECT cluster, threshold FROM (VALUES (0, 0.55::DOUBLE), (1, 0.45::DOUBLE)) AS t(cluster, threshold)), c AS (SELECT vp.cluster, count(*) AS n, {counts_sql('score >= coalesce(threshold, 0.5)')} FROM vp LEFT JOIN t ON t.cluster = vp.cluster GROUP BY vp.cluster HAVING count(*) >= 50), m AS (SELECT *, {RATES_SQL} FROM c) SELECT cluster, n, {CONF}, {r6(*RATES)} FROM m")
def group_metrics_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    taus = spark.createDataFrame([(0, 0.55), (1, 0.45)], "cluster int, threshold double")
    return six(M.group_metrics(scored(spark, sf), "cluster", 0.5, taus, 50))


_TABLE = f"""{_VP}{_SWEEP}, c AS (SELECT cluster, count(*) AS n, {counts_sql('score >= 0.5')}, avg(y) AS prevalence, avg(score) AS mean_score, avg(score) FILTER (y = 1) AS mean_pos, avg(score) FILTER (y = 0) AS mean_neg FROM vp GROUP BY cluster), m AS (SELECT *, {RATES_SQL} FROM c),
best AS (SELECT cluster, threshold AS optimal, f1 AS optimal_f1 FROM {best_sql('cluster')}), pl AS (SELECT cluster, min(threshold) AS plateau_low, max(threshold) AS plateau_high FROM {sweep_sql('cluster')} JOIN best USING (cluster) WHERE f1 >= optimal_f1 - 0.01 GROUP BY cluster),
ct AS (SELECT *, pr_auc / prevalence AS pr_auc_lift FROM m JOIN {auc_sql('cluster')} USING (cluster) JOIN best USING (cluster) JOIN pl USING (cluster))"""


@query(f"{_TABLE} SELECT cluster, n, {CONF}, {r6(*RATES, 'prevalence', 'mean_score', 'mean_pos', 'mean_neg', 'roc_auc', 'pr_auc', 'optimal', 'optimal_f1', 'plateau_low', 'plateau_high', 'pr_auc_lift')} FROM ct")
def cluster_table(spark: SparkSession, sf: str) -> DataFrame:
    return six(M.cluster_table(written(scored(spark, sf), scratch(spark)), 0.5))


@query(f"{_TABLE} SELECT round(avg(f1), 6) AS macro_f1, round(min(f1), 6) AS worst_f1, round(max(f1), 6) AS best_f1, round(max(f1) - min(f1), 6) AS f1_range, round(stddev_pop(f1), 6) AS f1_std, round(min(optimal), 6) AS tau_min, round(max(optimal), 6) AS tau_max, round(max(optimal) - min(optimal), 6) AS tau_range, round(stddev_pop(optimal), 6) AS tau_std, round(quantile_cont(optimal, 0.5), 6) AS tau_median FROM ct")
def robustness_summary(spark: SparkSession, sf: str) -> DataFrame:
    return six(M.robustness(M.cluster_table(written(scored(spark, sf), scratch(spark)), 0.5)))


@query(f"{_TABLE}, r AS (SELECT cluster, ((SELECT count(*) FROM ct b WHERE round(b.f1, 6) < round(a.f1, 6)) + (SELECT count(*) FROM ct b WHERE round(b.f1, 6) = round(a.f1, 6)) / 2.0 + 0.5 + (SELECT count(*) FROM ct b WHERE round(b.pr_auc, 6) > round(a.pr_auc, 6)) + (SELECT count(*) FROM ct b WHERE round(b.pr_auc, 6) = round(a.pr_auc, 6)) / 2.0 + 0.5) / 2 AS mean_rank FROM ct a) SELECT cluster, round(mean_rank, 6) AS mean_rank FROM r")
def cluster_ranks(spark: SparkSession, sf: str) -> DataFrame:
    t = six(M.cluster_table(written(scored(spark, sf), scratch(spark)), 0.5).select("cluster", "f1", "pr_auc"))
    return six(M.mean_ranks(t, "cluster", {"f1": False, "pr_auc": True}))


@query(f"{_VP}, c AS (SELECT cluster, count(*) AS n, {counts_sql('score >= 0.5')} FROM vp GROUP BY cluster), m AS (SELECT cluster, {RATES_SQL} FROM c), a AS (SELECT i::INT AS cluster, coalesce(f1, 0) AS f1 FROM range(0, 12) t(i) LEFT JOIN m ON m.cluster = i) SELECT round(avg(f1), 6) AS macro_f1, round(min(f1), 6) AS worst_f1, arg_min(cluster, (f1, cluster)) AS worst_group, (SELECT round(2.0 * count(*) FILTER (score >= 0.5 AND y = 1) / (count(*) FILTER (score >= 0.5) + sum(y)), 6) FROM vp) AS f1 FROM a")
def decisions_by_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return six(M.decisions_by_cluster(scored(spark, sf).withColumn("pred", (F.col("score") >= 0.5).cast("int")), 12))


@query(f"""{_VP}{_SWEEP}, k AS (SELECT 'tuned' AS kind, threshold FROM {best_sql()} UNION ALL SELECT '0.5', 0.5), c AS (SELECT kind, threshold, count(*) AS n, {counts_sql('score >= threshold')} FROM vp, k GROUP BY kind, threshold), m AS (SELECT *, {RATES_SQL} FROM c),
b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS s, avg(y) AS p FROM vp GROUP BY 1), e AS (SELECT sum(n * abs(s - p)) / sum(n) AS ece, (SELECT avg((score - y) * (score - y)) FROM vp) AS brier FROM b)
SELECT kind, threshold, n, {CONF}, {r6(*RATES, 'roc_auc', 'pr_auc', 'ece', 'brier')} FROM m, {auc_sql()}, e""")
def validation_report(spark: SparkSession, sf: str) -> DataFrame:
    return six(M.validation_report(written(scored(spark, sf), scratch(spark))))


@query(f"{_VP}, c AS (SELECT quantile_cont(score_b, [0.25, 0.5, 0.75]) AS q FROM vp), t AS (SELECT y, score, (score_b >= q[1])::INT + (score_b >= q[2])::INT + (score_b >= q[3])::INT AS quartile FROM vp, c), m AS (SELECT quartile, count(*) AS n, {counts_sql('score >= 0.5')} FROM t GROUP BY quartile), r AS (SELECT *, {RATES_SQL} FROM m) SELECT quartile, n, {CONF}, {r6(*RATES, 'roc_auc', 'pr_auc')} FROM r JOIN {auc_sql('quartile', 't')} USING (quartile)")
def boundary_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    t = M.quartile(written(scored(spark, sf), scratch(spark)), "score_b")
    return six(M.confusion(t, 0.5, ("quartile",)).join(M.auc(t, ("quartile",)), "quartile"))


@query(f"{_VP} SELECT round(corr(score, score_b), 6) AS pearson, round(avg(abs(score - score_b)), 6) AS mean_abs_diff FROM vp")
def score_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return six(scored(spark, sf).agg(F.corr("score", "score_b").alias("pearson"), F.avg(F.abs(F.col("score") - F.col("score_b"))).alias("mean_abs_diff")))


@query(f"{_VP} SELECT id, round(ln(least(greatest(score, 1e-6), 1 - 1e-6) / (1 - least(greatest(score, 1e-6), 1 - 1e-6))), 5) AS logit FROM vp")
def score_logits(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("id", F.round(V.logit(F.col("score")), 5).alias("logit"))


@query(f"{_VP} SELECT id, len(va) * 2 + 1 AS dims, round(list_sum(list_transform(list_zip(va, vb), lambda x: abs(x[1] - x[2]))), 6) AS abs_sum, round(list_sum(list_transform(list_zip(va, vb), lambda x: x[1] * x[2])), 6) AS product_sum, round(list_inner_product(va, vb), 6) AS cos FROM vp")
def pair_vectors(spark: SparkSession, sf: str) -> DataFrame:
    p = vector_pairs(spark, sf).select("id", V.pair_vector(F.col("va"), F.col("vb")).alias("x"))
    d = ((F.size("x") - 1) / 2).cast("int")
    return six(p.select("id", F.size("x").cast("long").alias("dims"), V.total(F.slice("x", F.lit(1), d)).alias("abs_sum"), V.total(F.slice("x", d + 1, d)).alias("product_sum"), F.element_at("x", -1).alias("cos")))


# Thresholds and resampling -----------------------------------------------------------

_FIT = f"""all_ AS (SELECT threshold AS t FROM {best_sql()}), own AS (SELECT cluster, threshold AS o FROM {best_sql('cluster')}), sz AS (SELECT cluster, count(*) AS n, sum(y) AS p FROM vp GROUP BY cluster),
pol AS (SELECT cluster, CASE WHEN n >= 300 AND p >= 35 THEN o ELSE t END AS threshold, n >= 300 AND p >= 35 AS own FROM sz JOIN own USING (cluster), all_)"""


@query(f"{_VP}{_SWEEP}, {_FIT} SELECT cluster, threshold, own FROM pol")
def policy_fit(spark: SparkSession, sf: str) -> DataFrame:
    return thresholds.fit(written(scored(spark, sf), scratch(spark)), 300, 35)


@query(f"{_VP}{_SWEEP}, {_FIT}, c AS (SELECT count(*) AS n, {counts_sql('score >= threshold')} FROM vp JOIN pol USING (cluster)), m AS (SELECT *, {RATES_SQL} FROM c) SELECT n, {CONF}, {r6(*RATES)} FROM m")
def policy_apply(spark: SparkSession, sf: str) -> DataFrame:
    s = written(scored(spark, sf), scratch(spark))
    return six(M.decision_metrics(thresholds.apply(s, thresholds.fit(s, 300, 35), M.best_threshold(s))))


def fold_of(df: DataFrame, folds: int) -> DataFrame:
    return df.withColumn("fold", F.pmod(resample.uniform(9, F.col("id")), F.lit(folds)).cast("int"))


def hex_sql(text: str, digits: int) -> str:
    return f"('0x' || substr(md5({text}), 1, {digits}))::BIGINT"


_FOLDS = f"""{_VP}{_SWEEP}, f AS (SELECT *, ({hex_sql("'9|' || id", 12)} % 5)::INT AS fold FROM vp), tr AS (SELECT f.* EXCLUDE (fold), i::INT AS fold FROM f JOIN range(0, 5) t(i) ON i <> f.fold), trc AS (SELECT *, fold * 1000 + cluster AS fc FROM tr),
all_ AS (SELECT fold, threshold AS t FROM {best_sql('fold', 'tr')}), own AS (SELECT fc, threshold AS o FROM {best_sql('fc', 'trc')}), sz AS (SELECT fold, cluster, fold * 1000 + cluster AS fc, count(*) AS n, sum(y) AS p FROM tr GROUP BY fold, cluster),
pol AS (SELECT fold, cluster, CASE WHEN n >= 240 AND p >= 28 THEN o ELSE t END AS threshold, n >= 240 AND p >= 28 AS own FROM sz JOIN own USING (fc) JOIN all_ USING (fold))"""


@query(f"{_FOLDS} SELECT id, y, fold, (score >= coalesce(threshold, t))::INT AS pred FROM f LEFT JOIN pol USING (fold, cluster) JOIN all_ USING (fold)")
def cross_fit_decisions(spark: SparkSession, sf: str) -> DataFrame:
    s = written(fold_of(scored(spark, sf), 5), scratch(spark))
    return thresholds.cross_fit(s, 5, 240, 28)[0].select("id", "y", "fold", "pred")


@query(f"{_FOLDS} SELECT cluster, round(avg(threshold) FILTER (own), 6) AS mean, round(stddev_pop(threshold) FILTER (own), 6) AS std, min(threshold) FILTER (own) AS min, max(threshold) FILTER (own) AS max, round(avg(own::INT), 6) AS own_share FROM pol GROUP BY cluster")
def threshold_stability(spark: SparkSession, sf: str) -> DataFrame:
    s = written(fold_of(scored(spark, sf), 5), scratch(spark))
    return six(thresholds.stability(thresholds.cross_fit(s, 5, 240, 28)[1]))


@query(f"""{_VP}{_SWEEP}, all_ AS (SELECT threshold AS t FROM {best_sql()}), own AS (SELECT cluster, threshold AS o FROM {best_sql('cluster')}), sz AS (SELECT cluster, count(*) AS n, sum(y) AS p FROM vp GROUP BY cluster),
r AS (SELECT min_pairs, cluster, y, n >= min_pairs AND p >= 30 AS has, score >= CASE WHEN n >= min_pairs AND p >= 30 THEN o ELSE t END AS pred FROM vp JOIN own USING (cluster) JOIN sz USING (cluster), all_, (SELECT unnest([100, 350, 400, 1000]) AS min_pairs)), c AS (SELECT min_pairs, count(DISTINCT CASE WHEN has THEN cluster END) AS own, {counts_sql('pred')} FROM r GROUP BY min_pairs)
SELECT min_pairs, round({div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1, own FROM c""")
def min_size_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return six(thresholds.size_sensitivity(written(scored(spark, sf), scratch(spark)), [100, 350, 400, 1000], 30))


@query(f"{_VP}{_SWEEP}, h AS (SELECT *, ({hex_sql("'6|' || id", 1)} % 2)::INT AS half FROM vp), t AS (SELECT 1 - half AS half, threshold FROM {best_sql('half', 'h')}), c AS (SELECT half, threshold, {counts_sql('score >= threshold')} FROM h JOIN t USING (half) GROUP BY half, threshold) SELECT half, threshold, round({div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM c")
def half_transfer(spark: SparkSession, sf: str) -> DataFrame:
    return six(thresholds.half_transfer(written(scored(spark, sf), scratch(spark)), "id", 6))


@query(f"""{_VP}{_SWEEP}, pl AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY cluster) AS size FROM vp), asked AS (SELECT boot, cluster, {hex_sql("'1|' || boot || '|' || cluster || '|' || place", 12)} % size AS place FROM pl, range(0, 10) b(boot)),
dr AS (SELECT asked.boot * 1000 + cluster AS bc, asked.boot, cluster, y, score FROM asked JOIN pl USING (cluster, place)), f AS (SELECT bc, f1 FROM {sweep_sql('bc', 'dr')} WHERE k = 50), b AS (SELECT bc, threshold AS tau FROM {best_sql('bc', 'dr')}), j AS (SELECT bc % 1000 AS cluster, f1, tau FROM f JOIN b USING (bc))
SELECT cluster::INT AS cluster, """ + ", ".join(f"round(quantile_cont({c}, 0.025), 6) AS {c}_low, round(quantile_cont({c}, 0.975), 6) AS {c}_high, round(stddev_pop({c}), 6) AS {c}_std" for c in ("f1", "tau")) + " FROM j GROUP BY cluster")
def cluster_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return six(resample.cluster_bootstrap(written(scored(spark, sf), scratch(spark)), 0.5, 10))


@query(f"""{_VP}, pl AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS size FROM vp), asked AS (SELECT boot, {hex_sql("'2|' || boot || '|0|' || place", 12)} % size AS place FROM pl, range(0, 20) b(boot)), dr AS (SELECT asked.boot, y, score, score_b FROM asked JOIN pl USING (place)),
f AS (SELECT boot, {div('2 * count(*) FILTER (score >= 0.5 AND y = 1)', 'count(*) FILTER (score >= 0.5) + sum(y)')} AS fa, {div('2 * count(*) FILTER (score_b >= 0.51 AND y = 1)', 'count(*) FILTER (score_b >= 0.51) + sum(y)')} AS fb FROM dr GROUP BY boot), g AS (SELECT fb - fa AS gain FROM f)
SELECT round(avg(gain), 6) AS gain, round(quantile_cont(gain, 0.025), 6) AS gain_low, round(quantile_cont(gain, 0.975), 6) AS gain_high, round(avg((gain <= 0)::INT), 6) AS p_no_gain FROM g""")
def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return six(resample.paired_bootstrap(written(scored(spark, sf), scratch(spark)), 0.5, 0.51, 20))


@query(f"""{_VP}, sl AS (SELECT cluster, row_number() OVER (ORDER BY id) AS slot FROM vp), de AS (SELECT boot, y, score, row_number() OVER (PARTITION BY boot ORDER BY {hex_sql("'4|' || boot || '|' || id", 12)}, id) AS slot FROM vp, range(0, 10) b(boot)),
f AS (SELECT boot, cluster, {div('2 * count(*) FILTER (score >= 0.5 AND y = 1)', 'count(*) FILTER (score >= 0.5) + sum(y)')} AS f1 FROM de JOIN sl USING (slot) GROUP BY boot, cluster), s AS (SELECT boot, max(f1) - min(f1) AS spread FROM f GROUP BY boot),
o AS (SELECT max(f1) - min(f1) AS observed FROM (SELECT cluster, {div('2 * count(*) FILTER (score >= 0.5 AND y = 1)', 'count(*) FILTER (score >= 0.5) + sum(y)')} AS f1 FROM vp GROUP BY cluster)) SELECT round(any_value(observed), 6) AS observed, round(avg(spread), 6) AS null_mean, round(avg((spread >= observed)::INT), 6) AS p_value FROM s, o""")
def random_partition_null(spark: SparkSession, sf: str) -> DataFrame:
    return six(resample.partition_null(written(scored(spark, sf), scratch(spark)), 0.5, 10))


@query(f"""{_VP}{_SWEEP}, rk AS (SELECT boot, y, score, row_number() OVER (PARTITION BY boot ORDER BY {hex_sql("'5|' || boot || '|' || id", 12)}, id) AS rank FROM vp, range(0, 8) b(boot)), sb AS (SELECT size * 1000 + boot AS sbt, y, score FROM rk, (SELECT unnest([200, 1000]) AS size) WHERE rank <= size),
be AS (SELECT sbt // 1000 AS size, threshold FROM {best_sql('sbt', 'sb')}), fu AS (SELECT threshold, f1 AS "full" FROM {sweep_sql()}), j AS (SELECT size, threshold, (SELECT max("full") FROM fu) - "full" AS regret FROM be JOIN fu USING (threshold))
SELECT size::INT AS size, round(stddev_pop(threshold), 6) AS tau_std, round(quantile_cont(threshold, 0.05), 6) AS tau_p5, round(quantile_cont(threshold, 0.95), 6) AS tau_p95, round(avg(regret), 6) AS regret_mean, round(quantile_cont(regret, 0.95), 6) AS regret_p95 FROM j GROUP BY size""")
def threshold_reliability(spark: SparkSession, sf: str) -> DataFrame:
    return six(resample.threshold_reliability(written(scored(spark, sf), scratch(spark)), [200, 1000], 8))


def decided_thrice(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions of three repetitions."""
    s = written(scored(spark, sf), scratch(spark))
    return s.select("id", "y", F.explode(F.array(*[F.struct(F.lit(i).alias("rep"), (F.col("score") >= t).cast("int").alias("pred")) for i, t in enumerate((0.48, 0.5, 0.52))])).alias("r")).select("id", "y", "r.*")


@query(f"""{_VP}, pl AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS size FROM vp), asked AS (SELECT boot, {hex_sql("'3|' || boot || '|0|' || place", 12)} % size AS place FROM pl, range(0, 20) b(boot)),
dr AS (SELECT asked.boot, y, score, t FROM asked JOIN pl USING (place), (SELECT unnest([0.48::DOUBLE, 0.5::DOUBLE, 0.52::DOUBLE]) AS t)), f AS (SELECT boot, t, {div('2 * count(*) FILTER (score >= t AND y = 1)', 'count(*) FILTER (score >= t) + sum(y)')} AS f1 FROM dr GROUP BY boot, t), m AS (SELECT boot, avg(f1) AS f1 FROM f GROUP BY boot)
SELECT round(quantile_cont(f1, 0.025), 6) AS f1_low, round(quantile_cont(f1, 0.975), 6) AS f1_high, round(stddev_pop(f1), 6) AS f1_std FROM m""")
def averaged_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return six(resample.averaged_bootstrap(decided_thrice(spark, sf), 20))


@query()
def averaged_bootstrap_1000(spark: SparkSession, sf: str) -> DataFrame:
    return six(replicates.averaged_bootstrap(decided_thrice(spark, sf), BOOTSTRAPS))


# The reference's replicates, sizes and sample. They draw counts, not rows. The queries above of the same kind draw rows and are cut down to what their SQL can do.
BOOTSTRAPS, PERMUTATIONS, SUBSAMPLES, SUBSAMPLE_SIZES, SILHOUETTE_ROWS = 1000, 500, 300, [100, 250, 500, 1000, 2000, 4000], 20_000


@query()
def cluster_bootstrap_1000(spark: SparkSession, sf: str) -> DataFrame:
    return six(replicates.cluster_bootstrap(scored(spark, sf), 0.5, BOOTSTRAPS))


@query()
def paired_bootstrap_1000(spark: SparkSession, sf: str) -> DataFrame:
    """The seven decision metrics and both areas."""
    return six(replicates.paired_bootstrap(scored(spark, sf), 0.5, 0.51, BOOTSTRAPS))


@query()
def cluster_intervals_1000(spark: SparkSession, sf: str) -> DataFrame:
    """By cluster: F1 at 0.5, the optimal threshold and both exact areas, with their intervals over replicates of Poisson weights."""
    return six(poisson.cluster_intervals(scored(spark, sf), 0.5, BOOTSTRAPS))


@query()
def paired_intervals_1000(spark: SparkSession, sf: str) -> DataFrame:
    """Gains in the seven decision metrics and both exact areas, with their intervals over replicates of Poisson weights."""
    return six(poisson.paired_intervals(scored(spark, sf), 0.5, 0.51, BOOTSTRAPS))


@query()
def random_partition_null_500(spark: SparkSession, sf: str) -> DataFrame:
    return six(replicates.partition_null(scored(spark, sf), 0.5, PERMUTATIONS))


@query()
def threshold_reliability_300(spark: SparkSession, sf: str) -> DataFrame:
    return six(replicates.threshold_reliability(scored(spark, sf), SUBSAMPLE_SIZES, SUBSAMPLES))


# Graph and splits ----------------------------------------------------------------------


def linked(spark: SparkSession, sf: str) -> DataFrame:
    """Adjacent turns of conversations as pairs, with keys, component and size; labels are hashed."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    p = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("question2")), ["conv_id", "turn"])
    label = (F.conv(F.substring(F.md5(F.concat_ws("|", "conv_id", "turn")), 1, 1), 16, 10).cast("int") % 4 == 0).cast("int")
    p = p.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question1"), "question2", label.alias("is_duplicate"))
    path = scratch(spark)
    p = graph.edges(p).withColumns({f"loose_{s}": F.md5(X.loose_key(F.col(f"question{i}"))) for i, s in ((1, "a"), (2, "b"))})
    e = written(p.drop("question1", "question2"), f"{path}/edges")
    return written(graph.with_components(e), f"{path}/linked")


def loose_sql(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^0-9a-z]+', ' ', 'g'))"


_LK = rf"""WITH RECURSIVE ed AS (SELECT a.conv_id * 1000 + a.turn AS id, md5({key_sql('a.text')}) AS key_a, md5({key_sql('b.text')}) AS key_b, ({hex_sql("a.conv_id || '|' || a.turn", 1)} % 4 = 0)::INT AS is_duplicate, md5({loose_sql('a.text')}) AS loose_a, md5({loose_sql('b.text')}) AS loose_b FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
un AS (SELECT key_a AS a, key_b AS b FROM ed UNION SELECT key_b, key_a FROM ed), reach AS (SELECT a AS src, a AS dst FROM un UNION SELECT r.src, un.b FROM reach r JOIN un ON r.dst = un.a), cc AS (SELECT src AS key, min(dst) AS component FROM reach GROUP BY src),
lk AS (SELECT ed.*, component, count(*) OVER (PARTITION BY component) AS size FROM ed JOIN cc ON cc.key = ed.key_a)"""
SEED = 42


def before_sql(src: str, by: str, key: str, weight: str, seed: int) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"(SELECT *, coalesce(sum({weight}) OVER ({part}ORDER BY md5('{seed}|' || {key}), {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / sum({weight}) OVER ({part}) AS share FROM {src})"


_BY_SHARE = "CASE WHEN share < 0.1::DOUBLE THEN 'test' WHEN share < 0.2::DOUBLE THEN 'val' ELSE 'train' END"


def node_sql(key: str) -> str:
    p = splits.node_probabilities()
    u = f"({hex_sql(f"'{SEED}|' || {key}", 8)}::DOUBLE / 4294967296)"
    return f"(CASE WHEN {u} < {p['train']!r}::DOUBLE THEN 'train' WHEN {u} < {p['train'] + p['val']!r}::DOUBLE THEN 'val' ELSE 'test' END)"


def comp_sql(src: str, seed: int = 42) -> str:
    return f"(SELECT component, {_BY_SHARE} AS split FROM {before_sql(f'(SELECT component, count(*) AS pairs, (count(*) > 1)::INT + (count(*) > 2)::INT + (count(*) > 5)::INT + (count(*) > 10)::INT AS bucket FROM {src} GROUP BY component)', 'bucket', 'component', 'pairs', seed)})"


_NODE = f"(SELECT *, CASE WHEN {node_sql('key_a')} = {node_sql('key_b')} THEN {node_sql('key_a')} ELSE 'dropped_cross_split' END AS split FROM lk)"
_COMP = f"(SELECT lk.*, split FROM lk JOIN {comp_sql('lk')} USING (component))"
_HYBRID = f"(SELECT id, is_duplicate, key_a, key_b, component, size, split FROM (SELECT * FROM lk WHERE size <= 4) JOIN {comp_sql('(SELECT * FROM lk WHERE size <= 4)')} USING (component) UNION ALL SELECT id, is_duplicate, key_a, key_b, component, size, split FROM {_NODE} WHERE size > 4)"
_RANDOM = f"(SELECT *, {_BY_SHARE} AS split FROM {before_sql('(SELECT *, 1 AS one FROM lk)', 'is_duplicate', 'id', 'one', SEED)})"
_CAP = 4


@query(f"{_LK} SELECT id, component, size FROM lk")
def components(spark: SparkSession, sf: str) -> DataFrame:
    return linked(spark, sf).select("id", "component", "size")


@query(f"{_LK} SELECT CASE WHEN size > 0 AND size <= 2 THEN '(0, 2]' WHEN size <= 4 THEN '(2, 4]' WHEN size <= 8 THEN '(4, 8]' WHEN size <= 1000000 THEN '(8, 1000000]' END AS band, count(DISTINCT component) AS components, count(*) AS pairs, round(avg(is_duplicate), 6) AS positive_rate FROM lk GROUP BY 1")
def component_profile(spark: SparkSession, sf: str) -> DataFrame:
    return six(splits.component_profile(linked(spark, sf), [0, 2, 4, 8, 1000000]))


@query(f"{_LK} SELECT id, split FROM {_RANDOM}")
def split_random(spark: SparkSession, sf: str) -> DataFrame:
    return splits.random_split(linked(spark, sf), SEED).select("id", "split")


@query(f"{_LK} SELECT id, split FROM {_COMP}")
def split_component(spark: SparkSession, sf: str) -> DataFrame:
    return splits.component_split(linked(spark, sf), SEED).select("id", "split")


@query(f"{_LK} SELECT id, split FROM {_NODE}")
def split_node(spark: SparkSession, sf: str) -> DataFrame:
    return splits.node_split(linked(spark, sf), SEED).select("id", "split")


@query(f"{_LK} SELECT id, split FROM {_HYBRID}")
def split_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return splits.hybrid_split(linked(spark, sf), SEED, _CAP).select("id", "split")


@query(f"{_LK}, r AS (SELECT 'random' AS strategy, split, is_duplicate FROM {_RANDOM} UNION ALL SELECT 'component', split, is_duplicate FROM {_COMP} UNION ALL SELECT 'node', split, is_duplicate FROM {_NODE}) SELECT strategy, split, count(*) AS pairs, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY strategy), 6) AS share, round(avg(is_duplicate), 6) AS positive_rate FROM r GROUP BY strategy, split")
def split_report(spark: SparkSession, sf: str) -> DataFrame:
    lk, out = linked(spark, sf), None
    for s in ("random", "component", "node"):
        r = splits.split_report(splits.make_split(lk, s, SEED)).select(F.lit(s).alias("strategy"), "split", "pairs", "share", "positive_rate")
        out = r if out is None else out.unionByName(r)
    return six(out)


_SIDES = "sd AS (SELECT split, key_a AS key FROM sp UNION ALL SELECT split, key_b FROM sp), rf AS (SELECT DISTINCT key FROM sd WHERE split = 'train'), ow AS (SELECT DISTINCT key FROM sd WHERE split = 'test')"


@query(f"{_LK}, sp AS (SELECT * FROM {_RANDOM}), {_SIDES}, t AS (SELECT key_a IN (SELECT key FROM rf) AS a, key_b IN (SELECT key FROM rf) AS b FROM sp WHERE split = 'test') SELECT (SELECT count(*) FROM ow WHERE key IN (SELECT key FROM rf)) AS shared, (SELECT count(*) FROM ow) AS texts, count(*) FILTER (a OR b) AS pairs_any, count(*) FILTER (a AND b) AS pairs_both, count(*) AS pairs, round((SELECT count(*) FROM ow WHERE key IN (SELECT key FROM rf))::DOUBLE / (SELECT count(*) FROM ow), 6) AS rate FROM t")
def text_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return six(splits.text_overlap(splits.random_split(linked(spark, sf), SEED), "train", "test"))


@query(f"{_LK}, sp AS (SELECT * FROM {_RANDOM}), pe AS (SELECT key_a AS a, key_b AS b FROM sp WHERE split = 'train' AND is_duplicate = 1 UNION SELECT key_b, key_a FROM sp WHERE split = 'train' AND is_duplicate = 1), pr AS (SELECT a AS src, a AS dst FROM pe UNION SELECT r.src, pe.b FROM pr r JOIN pe ON r.dst = pe.a), pc AS (SELECT src AS key, min(dst) AS c FROM pr GROUP BY src), t AS (SELECT is_duplicate AS y, coalesce(x.c = z.c, false) AS f FROM sp LEFT JOIN pc x ON x.key = key_a LEFT JOIN pc z ON z.key = key_b WHERE split = 'test') SELECT count(*) AS pairs, count(*) FILTER (f) AS fires, round({div('count(*) FILTER (f)', 'count(*)')}, 6) AS firing_rate, round({div('count(*) FILTER (f AND y = 1)', 'count(*) FILTER (f)')}, 6) AS precision, round({div('count(*) FILTER (f AND y = 1)', 'count(*) FILTER (y = 1)')}, 6) AS recovered FROM t")
def transitive_leakage(spark: SparkSession, sf: str) -> DataFrame:
    return six(splits.transitive_leakage(written(splits.random_split(linked(spark, sf), SEED), scratch(spark))))


@query(f"{_LK} SELECT component, pairs FROM {before_sql('(SELECT component, count(*) AS pairs FROM lk GROUP BY component)', '', 'component', 'pairs', 7)} WHERE share < 0.05::DOUBLE")
def dev_slice(spark: SparkSession, sf: str) -> DataFrame:
    return splits.dev_slice(linked(spark, sf))


@query(f"{_LK}, s AS (SELECT 'component' AS strategy, split, key_a, key_b FROM {_COMP} UNION ALL SELECT 'random', split, key_a, key_b FROM {_RANDOM}), sd AS (SELECT strategy, split, unnest([key_a, key_b]) AS key FROM s WHERE split <> 'dropped_cross_split'), g AS (SELECT strategy, key, count(DISTINCT split) AS n FROM sd GROUP BY 1, 2) SELECT strategy, count(*) FILTER (n > 1) AS leaked FROM g GROUP BY strategy")
def leaked_texts(spark: SparkSession, sf: str) -> DataFrame:
    lk = linked(spark, sf)
    one = lambda s: splits.leaked_texts(splits.make_split(lk, s, SEED)).select(F.lit(s).alias("strategy"), "leaked")
    return one("component").unionByName(one("random"))


@query(f"{_LK}, sp AS (SELECT * FROM {_HYBRID}) SELECT split, sha256(string_agg(id::VARCHAR, ',' ORDER BY id)) AS checksum FROM sp GROUP BY split")
def split_checksums(spark: SparkSession, sf: str) -> DataFrame:
    return splits.id_checksum(splits.hybrid_split(linked(spark, sf), SEED, _CAP))


def tree_sql(src: str, by: str, columns: list[str], depth: int) -> str:
    row = " || ',' || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, 'null')" for c in columns)
    words = " || ',' || ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)" for i in range(8))
    out = [f"t{depth} AS (SELECT {by}, substr(h, 1, {depth}) AS prefix, count(*) AS n, sha256(count(*) || ',' || {words}) AS digest FROM (SELECT {by}, sha256({row}) AS h FROM {src}) GROUP BY 1, 2)"]
    for d in range(depth - 1, -1, -1):
        out.append(f"t{d} AS (SELECT {by}, substr(u.prefix, 1, {d}) AS prefix, sum(n)::BIGINT AS n, sha256(string_agg(u.prefix || ':' || digest, ',' ORDER BY u.prefix)) AS digest FROM t{d + 1} u GROUP BY {by}, substr(u.prefix, 1, {d}))")
    return ", ".join(out) + " " + " UNION ALL ".join(f'SELECT {by}, prefix, n AS "rows", digest FROM t{d}' for d in range(depth, -1, -1))


@query(f"{_LK}, sp AS (SELECT * FROM {_HYBRID}), {tree_sql('sp', 'split', ['id', 'is_duplicate'], 2)}")
def split_checksum_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Checksums of the pairs of each split, from 256 ranges of hashes up to the root."""
    return splits.checksum_tree(splits.hybrid_split(linked(spark, sf), SEED, _CAP), ["id", "is_duplicate"], ("split",), 2)


_SEEDS = " UNION ALL ".join(f"SELECT {i} AS seed, split, is_duplicate FROM (SELECT lk.*, split FROM lk JOIN {comp_sql('lk', i)} USING (component))" for i in range(3))


@query(f"{_LK}, u AS ({_SEEDS}), r AS (SELECT seed, split, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY seed) AS share, avg(is_duplicate) AS positive_rate FROM u GROUP BY seed, split) SELECT split, " + ", ".join(f"round({f}({c}), 6) AS {f}_{c}" for c in ("share", "positive_rate") for f in ("min", "max")) + " FROM r GROUP BY split")
def seed_stability(spark: SparkSession, sf: str) -> DataFrame:
    return six(splits.seed_stability(linked(spark, sf), "component", range(3)))


_GREEDY = f"""{_LK}, co AS (SELECT component, count(*) AS pairs FROM lk GROUP BY component), od AS (SELECT *, row_number() OVER (ORDER BY pairs DESC, {hex_sql(f"'{SEED}|' || component", 12)}, component) AS i FROM co),
gr AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, -1 AS fold, NULL::VARCHAR AS component, 0::BIGINT AS pairs
  UNION ALL SELECT od.i, list_transform(range(1, 6), lambda j: loads[j] + CASE WHEN j = list_position(loads, list_min(loads)) THEN od.pairs ELSE 0 END), list_position(loads, list_min(loads)) - 1, od.component, od.pairs FROM gr JOIN od ON od.i = gr.i + 1)"""


@query(f"{_GREEDY} SELECT component, pairs, fold::INT AS fold FROM gr WHERE i > 0")
def group_folds(spark: SparkSession, sf: str) -> DataFrame:
    """The fold of each component, of five."""
    n = linked(spark, sf).groupBy("component").agg(F.count(F.lit(1)).alias("pairs"))
    return splits.group_folds(n, 5, SEED).select("component", "pairs", "fold")


# Regions ------------------------------------------------------------------------------------


def seeds_of(spark: SparkSession, sf: str) -> clusters.Centroids:
    """The first vector of each label."""
    e = table(spark, sf, "embeddings")
    first = e.groupBy("label").agg(F.min(F.struct("vec_id", V.doubles(F.col("embedding")).alias("e"))).alias("r"))
    return clusters.from_rows(first.select("label", "r.e"), "label", "e")


_CENT = f"""{_VP}, ce AS (SELECT label AS c, arg_min(e, vec_id) AS m FROM v GROUP BY label), cn AS (SELECT c, m, list_inner_product(m, m) AS n2 FROM ce)"""
_ASG = "sc AS (SELECT vec_id, label, e, c, m, n2, list_inner_product(e, m) - n2 / 2 AS s FROM v, cn), rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) AS r FROM sc)"


@query(f"{_CENT}, {_ASG} SELECT a.vec_id, a.c AS cluster, b.c AS second, round(a.s - b.s, 6) AS margin, round(list_inner_product(a.e, a.m) / sqrt(list_inner_product(a.e, a.e)) / sqrt(a.n2), 6) AS cos_assigned FROM rk a JOIN rk b ON b.vec_id = a.vec_id AND b.r = 2 WHERE a.r = 1")
def nearest_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return six(clusters.assign(table(spark, sf, "embeddings"), "embedding", seeds_of(spark, sf)).select("vec_id", "cluster", "second", "margin", "cos_assigned"))


def _best_sql(x: str, name: str) -> str:
    return f"(SELECT id, arg_min(c, (-s, c)) AS {name} FROM (SELECT id, c, list_inner_product({x}, m) - n2 / 2 AS s FROM w, cn) GROUP BY id)"


@query(f"{_CENT}, w AS (SELECT id, va, vb, list_transform(list_zip(list_transform(va, lambda x: x / sqrt(list_inner_product(va, va))), list_transform(vb, lambda x: x / sqrt(list_inner_product(vb, vb)))), lambda z: z[1] + z[2]) AS mid0 FROM vp), w2 AS (SELECT * FROM w), q1 AS {_best_sql('va', 'q1')}, q2 AS {_best_sql('vb', 'q2')}, pa AS (SELECT id, arg_min(c, (-s, c)) AS pair_avg FROM (SELECT id, c, list_inner_product(list_transform(mid0, lambda x: x / sqrt(list_inner_product(mid0, mid0))), m) - n2 / 2 AS s FROM w2, cn) GROUP BY id) SELECT id, q1, pair_avg, CASE WHEN q1 = q2 THEN q1 ELSE -1 END AS same_only FROM q1 JOIN q2 USING (id) JOIN pa USING (id)")
def pair_cluster_rules(spark: SparkSession, sf: str) -> DataFrame:
    p, cents = vector_pairs(spark, sf).select("id", "va", "vb"), seeds_of(spark, sf)
    for rule in ("q1", "pair_avg", "same_only"):
        p = clusters.assign_pairs(p, cents, rule).withColumnRenamed("cluster", rule)
    return p.drop("va", "vb")


_LAB = f"{_CENT}, {_ASG}, la AS (SELECT vec_id, label, e, c AS cluster FROM rk WHERE r = 1)"


def labelled(spark: SparkSession, sf: str, sample: int | None = None) -> DataFrame:
    """All rows, or those of a sample of the silhouette, with the cluster of all rows' first vectors that is nearest."""
    e = table(spark, sf, "embeddings")
    e = e if sample is None else clusters.sampled(e, "vec_id", sample, 1)
    return written(clusters.assign(e, "embedding", seeds_of(spark, sf)).select("vec_id", "label", "embedding", "cluster"), scratch(spark))


@query(f"{_LAB}, n AS (SELECT cluster, count(*) AS n FROM la GROUP BY cluster), p AS (SELECT n, n::DOUBLE / sum(n) OVER () AS p FROM n) SELECT count(*) AS clusters, round(min(p), 6) AS min_share, round(max(p), 6) AS max_share, round(max(n)::DOUBLE / min(n), 6) AS max_min_ratio, round(-sum(p * ln(p)) / ln(count(*)), 6) AS entropy FROM p")
def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return six(clusters.size_stats(labelled(spark, sf)))


@query(f"{_LAB}, ce2 AS (SELECT label, cluster, count(*)::DOUBLE AS n FROM la GROUP BY 1, 2), x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM ce2) AS ij, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM ce2 GROUP BY label)) AS i, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM ce2 GROUP BY cluster)) AS j, (SELECT sum(n) * (sum(n) - 1) / 2 FROM ce2) AS t) SELECT round((ij - i * j / t) / ((i + j) / 2 - i * j / t), 6) AS ari FROM x")
def adjusted_rand(spark: SparkSession, sf: str) -> DataFrame:
    return six(clusters.adjusted_rand(labelled(spark, sf), "label", "cluster"))


_D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"


@query(f"""{_LAB}, lx AS (SELECT vec_id, cluster, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM la), mx AS (SELECT cluster, i, avg(x) AS x FROM lx GROUP BY 1, 2), mm AS (SELECT cluster, list(x ORDER BY i) AS m FROM mx GROUP BY cluster), gx AS (SELECT i, avg(x) AS x FROM lx GROUP BY i), gg AS (SELECT list(x ORDER BY i) AS g FROM gx),
own AS (SELECT cluster, any_value(m) AS m, avg(sqrt({_D2.format(a='e', b='m')})) AS s, sum({_D2.format(a='e', b='m')}) AS w, sum(list_inner_product(e, m) / sqrt(list_inner_product(e, e)) / sqrt(list_inner_product(m, m))) AS c, count(*) AS n FROM la JOIN mm USING (cluster) GROUP BY cluster),
wo AS (SELECT i.cluster, max((i.s + j.s) / sqrt({_D2.format(a='i.m', b='j.m')})) AS r FROM own i JOIN own j ON i.cluster <> j.cluster GROUP BY i.cluster)
SELECT (SELECT round(avg(r), 6) FROM wo) AS davies_bouldin, round((sum(n * {_D2.format(a='m', b='g')}) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 6) AS calinski_harabasz, round(sum(c) / sum(n), 6) AS mean_cosine, round(min(c / n), 6) AS worst_cosine FROM own, gg""")
def cluster_separation(spark: SparkSession, sf: str) -> DataFrame:
    return six(clusters.separation(labelled(spark, sf), "embedding"))


def silhouette_sql(n: int) -> str:
    return f"""{_LAB}, sm AS (SELECT vec_id, e, cluster FROM la ORDER BY md5('1|' || vec_id), vec_id LIMIT {n}), pd AS (SELECT a.vec_id, a.cluster AS own, b.cluster AS other, avg(sqrt({_D2.format(a='a.e', b='b.e')})) AS d FROM sm a JOIN sm b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
ea AS (SELECT vec_id, min(d) FILTER (own = other) AS i, min(d) FILTER (own <> other) AS o FROM pd GROUP BY vec_id) SELECT round(avg(coalesce((o - i) / CASE WHEN i IS NULL THEN NULL ELSE greatest(o, i) END, 0)), 6) AS silhouette FROM ea"""


@query(silhouette_sql(200))
def silhouette_sample(spark: SparkSession, sf: str) -> DataFrame:
    return six(clusters.silhouette(labelled(spark, sf, 200), "embedding", "cluster", "vec_id", 200, 1))


@query(silhouette_sql(20_000))
def silhouette_sample_20000(spark: SparkSession, sf: str) -> DataFrame:
    return six(clusters.silhouette(labelled(spark, sf, SILHOUETTE_ROWS), "embedding", "cluster", "vec_id", SILHOUETTE_ROWS, 1))


@query(f"{_LAB}, n AS (SELECT a.cluster, a.vec_id, round(list_inner_product(a.e, m) / sqrt(list_inner_product(a.e, a.e)) / sqrt(n2), 6) AS cos_assigned FROM la a JOIN cn ON cn.c = a.cluster), w AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY cos_assigned DESC, vec_id) AS r FROM n) SELECT cluster, vec_id, cos_assigned FROM w WHERE r <= 3")
def nearest_members(spark: SparkSession, sf: str) -> DataFrame:
    a = six(clusters.assign(table(spark, sf, "embeddings"), "embedding", seeds_of(spark, sf)).select("vec_id", "cluster", "cos_assigned"))
    return clusters.nearest_members(a, "vec_id", 3)


_NOISE = "sqrt(-2 * ln((" + hex_sql("'3|' || vec_id || '|' || (i - 1) || '|0'", 12) + " + 0.5) / 281474976710656)) * cos(2 * pi() * (" + hex_sql("'3|' || vec_id || '|' || (i - 1) || '|1'", 12) + " + 0.5) / 281474976710656)"


@query(f"{_CENT}, w0 AS (SELECT vec_id AS id, e AS va, list_transform(range(1, len(e) + 1), lambda i: e[i] + 0.0104 * {_NOISE}) AS b FROM v), w AS (SELECT id, va, list_transform(b, lambda x: x / sqrt(list_inner_product(b, b))) AS vb FROM w0), q1 AS {_best_sql('va', 'c1')}, q2 AS {_best_sql('vb', 'c2')} SELECT round(avg((c1 = c2)::INT), 6) AS unchanged FROM q1 JOIN q2 USING (id)")
def noise_stability(spark: SparkSession, sf: str) -> DataFrame:
    return six(clusters.noise_stability(table(spark, sf, "embeddings"), "embedding", "vec_id", seeds_of(spark, sf), 0.0104, 3))


@query()
def kmeans_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return six(kmeans.sweep(table(spark, sf, "embeddings"), "embedding", "vec_id", [5, 8, 10, 12, 15, 20], sample=SILHOUETTE_ROWS))


@query()
def principal_components(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.pca(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 10).select("vec_id", F.size("reduced").alias("dims"), V.norm(F.col("reduced")).alias("length"))


# TF-IDF ---------------------------------------------------------------------------------------

_TF = f"""t AS (SELECT conv_id * 1000 + turn AS key, {tokens_sql(norm_sql('text'))} AS t FROM conversations), g AS (SELECT key, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM t),
tf AS (SELECT key, term, count(*) AS tf FROM g GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), w0 AS (SELECT key, term, (1 + ln(tf)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM t)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)), w AS (SELECT key, term, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS w FROM w0)"""


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), X.tokenize(X.normalize(F.col("text"))).alias("t"))


def _weights(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d, terms = written(_turns(spark, sf), scratch(spark)), X.word_ngrams(F.col("t"))
    w = written(tfidf.weights(d, "key", terms, tfidf.idf(d, "key", terms)), scratch(spark))
    p = d.select("key").join(d.select((F.col("key") - 1).alias("key"), F.col("key").alias("key_b")), "key").select(F.col("key").alias("id"), F.col("key").alias("key_a"), "key_b")
    return p, w


@query(f"WITH {_TF} SELECT key, count(*) AS terms, round(sum(w), 5) AS total FROM w GROUP BY key")
def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(spark, sf)[1].groupBy("key").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 5).alias("total"))


@query(f"WITH {_TF}, p AS (SELECT a.key AS id, b.key AS b FROM t a JOIN t b ON b.key = a.key + 1), c AS (SELECT id, sum(x.w * y.w) AS c FROM p JOIN w x ON x.key = p.id JOIN w y ON y.key = p.b AND y.term = x.term GROUP BY id) SELECT id, round(coalesce(c, 0), 6) AS cosine FROM p LEFT JOIN c USING (id)")
def tfidf_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return six(tfidf.pair_cosine(*_weights(spark, sf)))


@query(f"WITH {_TF}, p AS (SELECT a.key AS id, b.key AS b FROM t a JOIN t b ON b.key = a.key + 1), x AS (SELECT id, term, w AS a FROM p JOIN w ON w.key = p.id), y AS (SELECT id, term, w AS b FROM p JOIN w ON w.key = p.b), z AS (SELECT id, abs(coalesce(a, 0) - coalesce(b, 0)) AS d, coalesce(a, 0) * coalesce(b, 0) AS m FROM x FULL JOIN y USING (id, term)) SELECT id, count(*) AS terms, round(sum(d), 5) AS diff, round(sum(m), 5) AS product FROM z GROUP BY id")
def tfidf_pair_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return tfidf.pair_terms(*_weights(spark, sf)).groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("diff"), 5).alias("diff"), F.round(F.sum("product"), 5).alias("product"))


@query(f"""WITH t AS (SELECT lang, {tokens_sql(norm_sql('text'))} AS t FROM documents), f0 AS (SELECT lang, unnest(list_filter(list_distinct(t), lambda x: regexp_matches(x, {q("^[a-z][a-z0-9+#.'-]*$")}) AND NOT list_contains({words_sql([*X.STOP_WORDS, *tfidf.GENERIC])}, x))) AS term FROM t), f AS (SELECT lang, term, count(*) AS f FROM f0 GROUP BY 1, 2), tt AS (SELECT term, sum(f) AS t FROM f GROUP BY term HAVING sum(f) >= 20),
sz AS (SELECT lang, count(*) AS n FROM t GROUP BY lang), w AS (SELECT lang, term, round(f::DOUBLE / n * ln(1 + (SELECT avg(n) FROM sz) / tt.t), 9) AS weight FROM f JOIN tt USING (term) JOIN sz USING (lang)), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS rank FROM w) SELECT lang, term, round(weight, 6) AS weight, rank::INT AS rank FROM r WHERE rank <= 12""")
def class_terms(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("lang", X.tokenize(X.normalize(F.col("text"))).alias("t"))
    return six(tfidf.class_terms(d, "lang", F.col("t")))


_VOC = f"""WITH t AS (SELECT conv_id * 1000 + turn AS key, {tokens_sql(norm_sql('text'))} AS t FROM conversations), c AS (SELECT token, count(*) AS times FROM (SELECT unnest(t) AS token FROM t) GROUP BY token HAVING count(*) >= 2),
vo AS (SELECT token, row_number() OVER (ORDER BY times DESC, token) + 1 AS id, times FROM c)"""


@query(f"{_VOC} SELECT token, id, times FROM vo")
def token_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.build(_turns(spark, sf), "t")


@query(f"{_VOC}, l AS (SELECT key, unnest(t[1:64]) AS token, generate_subscripts(t[1:64], 1) AS i FROM t), e AS (SELECT key, string_agg(coalesce(id, 1)::VARCHAR, ',' ORDER BY i) AS ids FROM l LEFT JOIN vo USING (token) GROUP BY key) SELECT t.key, coalesce(ids, '1') AS ids FROM t LEFT JOIN e USING (key)")
def encoded_texts(spark: SparkSession, sf: str) -> DataFrame:
    d = written(_turns(spark, sf), scratch(spark))
    e = vocabulary.encode(d, "key", "t", vocabulary.build(d, "t"), 64)
    return e.select("key", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


_REPS = f"""{_VP}{_SWEEP}, f AS (SELECT vp.*, rep, ({hex_sql("rep || '|' || id", 12)} % 4)::INT AS fold FROM vp, range(0, 20) r(rep)), tr AS (SELECT f.* EXCLUDE (fold), rep * 10 + i AS rf, (rep * 10 + i) * 1000 + cluster AS fc FROM f JOIN range(0, 4) t(i) ON i <> f.fold),
all_ AS (SELECT rf, threshold AS t FROM {best_sql('rf', 'tr')}), own AS (SELECT fc, threshold AS o FROM {best_sql('fc', 'tr')}), sz AS (SELECT fc, rf, count(*) AS n, sum(y) AS p FROM tr GROUP BY fc, rf),
pol AS (SELECT fc, CASE WHEN n >= 240 AND p >= 28 THEN o ELSE t END AS threshold FROM sz JOIN own USING (fc) JOIN all_ USING (rf)),
de AS (SELECT rep, y, score >= coalesce(threshold, t) AS pred FROM (SELECT *, rep * 10 + fold AS rf, (rep * 10 + fold) * 1000 + cluster AS fc FROM f) LEFT JOIN pol USING (fc) JOIN all_ USING (rf)), fs AS (SELECT rep, {div('2 * count(*) FILTER (pred AND y = 1)', 'count(*) FILTER (pred) + sum(y)')} AS f1 FROM de GROUP BY rep)"""


@query(f"{_REPS} SELECT round(avg(f1), 6) AS mean, round(min(f1), 6) AS min, round(max(f1), 6) AS max FROM fs")
def fold_repetitions(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, least and greatest F1 of cross-fitted policies over 20 shufflings of the rows to folds."""
    each = thresholds.repetitions(written(scored(spark, sf), scratch(spark)), 20, 4, 240, 28)
    return six(each.agg(F.avg("f1").alias("mean"), F.min("f1").alias("min"), F.max("f1").alias("max")))


# Models and explanations -------------------------------------------------------------------------


def _features(spark: SparkSession, sf: str) -> DataFrame:
    """Features of text pairs with a hashed fold; y is whether both texts have one language."""
    path = scratch(spark)
    with tidy(spark):
        p, texts = text_pair_keys(spark, sf)
        return written(fold_of(pair_features(p.drop("is_duplicate").withColumnRenamed("same_lang", "y"), texts), 3), path)


def _lexical(spark: SparkSession, sf: str) -> DataFrame:
    """FEATURES, y and fold as _features has them, without the annotations, which FEATURES do not need."""
    path = scratch(spark)
    with tidy(spark):
        p, texts = text_pair_keys(spark, sf)
        return written(fold_of(pair_lexical(p.drop("is_duplicate").withColumnRenamed("same_lang", "y"), texts), 3), path)


def pair_lexical(p: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds FEATURES to pairs of keys, with the values that pair_features gives them."""
    return lexical_features(p, texts=texts, slices=SLICES, undot=True).drop("_k1", "_k2")


#: Parts of the pairs that features are made for one after the other: so much less of what joins move lies on disk at a time.
SLICES = 4


def pair_features(p: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds FEATURES and the columns of all groups to pairs of keys. Lexical ones are written first, so that no row holds the parts of both kinds."""
    path = scratch(p.sparkSession)
    with tidy(p.sparkSession):
        p = written(lexical_features(p, texts=texts, slices=SLICES), path)
    both = [c for g in C.GROUPS.values() for c in g if c in FEATURES]
    return C.constraint_features(p.drop(*both), texts=texts, slices=SLICES).drop("_k1", "_k2")


_GROUPS = {k: C.GROUPS[k] for k in ("number", "date_heuristic", "entity_heuristic", "negation", "specificity")}
_COLUMNS = list(dict.fromkeys(FEATURES + [c for g in _GROUPS.values() for c in g]))


@query(f"{_LEX}, m AS (SELECT avg(word_jaccard) AS m, stddev_pop(word_jaccard) AS s, avg(char_len_absdiff) AS m2, stddev_pop(char_len_absdiff) AS s2 FROM lex) SELECT id, round((word_jaccard - m) / s, 5) AS word_jaccard, round((char_len_absdiff - m2) / s2, 5) AS char_len_absdiff FROM lex, m")
def standard_scores(spark: SparkSession, sf: str) -> DataFrame:
    p, texts = text_pair_keys(spark, sf)
    f = written(lexical_features(p, texts=texts, names=["word_jaccard", "char_len_absdiff"]).select("id", "word_jaccard", "char_len_absdiff"), scratch(spark))
    return models.standardised(f, ["word_jaccard", "char_len_absdiff"]).select("id", F.round("word_jaccard", 5).alias("word_jaccard"), F.round("char_len_absdiff", 5).alias("char_len_absdiff"))


@query()
def logistic_grid(spark: SparkSession, sf: str) -> DataFrame:
    d = models.design(_lexical(spark, sf), FEATURES)
    _, marks = models.pick_c(d.where("fold > 0"), d.where("fold = 0"), [0.1, 0.3, 1.0, 3.0, 10.0])
    return spark.createDataFrame(marks, "c double, pr_auc double")


@query()
def out_of_fold_scores(spark: SparkSession, sf: str) -> DataFrame:
    d = written(models.design(_lexical(spark, sf), FEATURES).select("id", "y", "fold", "features"), scratch(spark))
    return models.out_of_fold(d, 3).select("id", "y", "fold", "score")


@query()
def boosted_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Areas, tuned threshold, and F1 overall and by cluster of each variant, on a fold that none has seen."""
    f = _features(spark, sf)
    base = models.out_of_fold(models.design(f, FEATURES).select("id", "y", "fold", "features"), 3)
    f = f.join(base.select("id", V.base_logit(F.col("score")).alias("base_logit")), "id").withColumn("cluster", F.pmod("id", F.lit(4)).cast("int"))
    return variant_areas(written(f.withColumns({f"cluster_{i}": (F.col("cluster") == i).cast("double") for i in range(4)}), scratch(spark)))


def variant_areas(f: DataFrame) -> DataFrame:
    """Each variant of boosted_variants fitted on the folds from 1 on of f, several at a time, and measured on fold 0, all in one plan."""
    spark, path = f.sparkSession, scratch(f.sparkSession)
    made = models.variants(["base_logit"], C.GROUPS, FEATURES, [f"cluster_{i}" for i in range(4)])

    def scored(name: str) -> DataFrame:
        kind, columns = made[name]
        d = models.design(f, columns, scale=kind == "lr")
        r = models.score(models.fitted(d.where("fold > 0"), kind), d.where("fold = 0"))
        return written(r.select(F.lit(name).alias("variant"), F.lit(kind).alias("kind"), "y", "score", "cluster"), f"{path}/{name}")

    schema = side_by_side(spark, scored, made)[0].schema
    r = spark.read.schema(schema).parquet(*[f"{path}/{name}" for name in made])
    best = M.best_threshold(r, ("variant",))
    by = M.confusion(r.join(F.broadcast(best.select("variant", "threshold")), "variant"), F.col("threshold"), ("variant", "cluster"))
    by = by.groupBy("variant").agg(F.avg("f1").alias("macro_f1"), F.min("f1").alias("worst_f1"))
    kinds = r.select("variant", "kind").distinct()
    out = M.auc(r, ("variant",)).join(best, "variant").join(by, "variant").join(kinds, "variant")
    return out.select("variant", "kind", "roc_auc", "pr_auc", "threshold", "f1", "macro_f1", "worst_f1")


@query()
def model_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    m = models.logistic(models.design(_lexical(spark, sf), FEATURES), 1.0)
    return spark.createDataFrame(models.coefficients(m, FEATURES), "feature string, weight double")


DIMS, REGIONS = 128, 8


def hashed_vectors(p: DataFrame) -> DataFrame:
    """va and vb: unit vectors of the tokens t1 and t2, hashed to DIMS places. The encoder's stand-in."""
    place = lambda t: F.pmod(F.xxhash64(t), F.lit(DIMS)).cast("int")
    count = lambda ks: F.transform(F.sequence(F.lit(0), F.lit(DIMS - 1)), lambda i: F.size(F.filter(ks, lambda k: k == i)).cast("double"))
    vector = lambda c: X.let(F.transform(c, place), count)
    return p.withColumns({"va": V.unit(vector(F.col("t1"))), "vb": V.unit(vector(F.col("t2")))})


@query()
def explained_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Adjacent turns: base and final score of fitted models, region, extracted items, signals, what-ifs and a rationale."""
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question1"), "role")
    p = c.join(c.select((F.col("id") - 1).alias("id"), F.col("question1").alias("question2"), F.col("role").alias("other")), "id")
    p = p.select("id", "question1", "question2", (F.col("role") == "user").cast("int").alias("y"))
    f = written(hashed_vectors(with_tokens(explain.extracted(explain.signals(C.constraint_features(lexical_features(p)))))).drop("n1", "n2", "t1", "t2", "a1", "a2"), scratch(spark))
    cents = clusters.kmeans(f.select(V.midpoint(F.col("va"), F.col("vb")).alias("m")), "m", REGIONS, range(1, 2))
    f = f.withColumn("_m", V.midpoint(F.col("va"), F.col("vb")))
    f = written(clusters.assign(f, "_m", cents).withColumn("cosine", V.cosine(F.col("va"), F.col("vb"))).drop("_m", "second", "cos_assigned", "va", "vb"), scratch(spark))
    lexical = [*FEATURES, "cosine"]
    base = models.score(models.logistic(models.design(f, lexical, scale=False), 1.0), models.design(f, lexical, scale=False)).select("id", F.col("score").alias("base"))
    f = written(f.join(base, "id").withColumn("base_logit", V.base_logit(F.col("base"))), scratch(spark))
    columns = ["base_logit", *dict.fromkeys(c for g in C.GROUPS.values() for c in g)]
    model = models.logistic(models.design(f, columns, scale=False), 1.0)
    scorer = lambda df: models.score(model, models.design(df, columns, scale=False))
    effects = explain.what_if(f.select("id", *columns), scorer)
    tau, base_tau = (M.best_threshold(s).head().threshold for s in (scorer(f.select("id", "y", *columns)), f.select("y", F.col("base").alias("score"))))
    out = f.join(scorer(f.select("id", *columns)).select("id", "score"), "id").join(explain.strong_effects(effects), "id", "left")
    out = explain.rationale(explain.decide(out, tau, base_tau), tau, base_tau)
    return out.select("id", "score", "decision", "borderline", "base", "base_decision", "cosine", "cluster", "margin", "near_boundary", "items_a", "items_b", "signals", "strong", "rationale")


@query()
def what_if_scores(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf)
    model = models.logistic(models.design(f, _COLUMNS, scale=False), 1.0)
    return explain.what_if(f.select("id", "y", "fold", *_COLUMNS), lambda df: models.score(model, models.design(df, _COLUMNS, scale=False)), ["number", "date_heuristic", "entity_heuristic", "negation"])
