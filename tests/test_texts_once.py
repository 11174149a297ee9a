import time

from pyspark.sql import functions as F

from pairforge import session
from pairforge.functions import constraints as C
from pairforge.functions import text as X
from pairforge.functions.lexical import FEATURES, lexical_features, with_tokens
from pairforge.plans import catalog, views

TEXTS = ["He saw Paris in 1999, not Rome", "he saw paris in 2001", "nonlinear Ⅷ models and linear ones ﬁt", "linear models", "", None, "NASA’s plan never works in May", "a b", "Ünïcode 𝔘 text", "She met Anna Anna on Monday"]


def reference_tags(pairs):
    """The tags by the words of both whole texts, pair by pair."""
    p = with_tokens(pairs)
    diff = F.array_union(F.array_except("t1", "t2"), F.array_except("t2", "t1"))
    caps = F.array_except(F.transform(F.concat(*[C.all_of(F.trim(F.coalesce(f"question{i}", F.lit(""))), C.ENTITY_TAG) for i in (1, 2)]), F.lower), X.words_of(C.PRONOUN))
    p = p.withColumn("_d", diff).withColumn("_a", F.array_union("t1", "t2"))
    return p.select(
        "id", F.exists("_d", lambda t: t.rlike(r"\p{Nd}")).alias("number_diff"), F.arrays_overlap(caps, F.col("_d")).alias("entity_diff"),
        (F.exists("_d", lambda t: t.isin(X.TAG_NEGATIONS)) | F.exists("_d", lambda t: t.startswith("non") & F.array_contains(F.col("_a"), F.substr(t, F.lit(4))))).alias("negation_diff"),
        F.round(X.jaccard(F.col("t1"), F.col("t2")), 9).alias("jaccard"), F.exists("_d", lambda t: t.rlike(r"^(?:19|20)\d\d$") | t.isin(C.DATE_WORDS[:19])).alias("date_diff"),
    )


def both_forms(spark):
    rows = [(i * 100 + j, a, b) for i, a in enumerate(TEXTS) for j, b in enumerate(TEXTS)]
    pairs = spark.createDataFrame(rows, "id long, question1 string, question2 string")
    keys = pairs.select("id", *[X.text_key(F.col(f"question{i}")).alias(f"_k{i}") for i in (1, 2)])
    texts = spark.createDataFrame([(t,) for t in TEXTS], "_text string").select(X.text_key(F.col("_text")).alias("_key"), "_text")
    return pairs, keys, texts


def collected(df, columns):
    return sorted(map(tuple, df.select("id", *columns).collect()))


def test_tags_of_texts_cut_once_equal_those_of_whole_pairs(spark):
    pairs, keys, texts = both_forms(spark)
    names = ["number_diff", "entity_diff", "negation_diff", "jaccard", "date_diff"]
    rounded = lambda d: d.withColumn("jaccard", F.round("jaccard", 9))
    want = collected(reference_tags(pairs), names)
    assert collected(rounded(C.error_tags(pairs)), names) == want
    assert collected(rounded(C.error_tags(keys, texts=texts)), names) == want


def test_features_by_keys_equal_features_of_pairs(spark):
    pairs, keys, texts = both_forms(spark)
    assert collected(lexical_features(keys, texts=texts), FEATURES) == collected(lexical_features(pairs), FEATURES)
    every = [c for g in C.GROUPS.values() for c in g]
    want = collected(C.constraint_features(pairs), every)
    assert collected(C.constraint_features(keys, texts=texts), every) == want
    assert collected(catalog.pair_features(keys, texts).withColumnRenamed("_none", "_"), every) == want
    some = ("number", "specificity")
    asked = [c for g in some for c in C.GROUPS[g]]
    assert collected(C.constraint_features(keys, texts=texts, groups=some), asked) == collected(C.constraint_features(pairs), asked)


def test_trigram_codes_count_as_strings_do(spark):
    d = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "t string")
    assert all(r.a == r.b for r in d.select(F.size(X.trigram_codes("t")).alias("a"), F.size(X.char_ngrams(F.col("t"))).alias("b")).collect())


def test_pairs_of_keys_are_text_pairs(spark, tmp_path):
    spark.createDataFrame([(i, "en", f"text {i % 3}") for i in range(9)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(["a", None, "A ", "b"])], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    p, texts = views.text_pair_keys(spark, str(tmp_path))
    whole = views.text_pairs(spark, str(tmp_path)).select("id", *[X.text_key(F.col(f"question{i}")).alias(f"_k{i}") for i in (1, 2)], "is_duplicate", "same_lang")
    assert sorted(map(str, p.collect())) == sorted(map(str, whole.select(p.columns).collect()))
    assert {r["_text"] for r in texts.collect()} == {"text 0", "text 1", "text 2", "a", "A ", "b", None}


def test_what_is_known_of_texts_does_not_move(spark):
    pairs, keys, texts = both_forms(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = X.with_both(keys, texts.withColumnRenamed("_text", "known"), "known", ("a", "b"))
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(") == 2, plan
        assert collected(made, ["a", "b"]) == collected(pairs.select("id", "question1", "question2"), ["question1", "question2"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_features_leave_no_scratch_tables(spark, tmp_path):
    from pathlib import Path

    from pairforge.session import scratch

    spark.createDataFrame([(i, "en", f"text {i % 3}") for i in range(9)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(["a", None, "A ", "b"])], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    top = Path(scratch(spark).removeprefix("file:")).parent
    there = set(top.glob("pairforge-*"))
    assert catalog._features(spark, str(tmp_path)).count() == 8 + 6 + 3
    assert len(set(top.glob("pairforge-*")) - there) == 1


def shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def left_after(spark, before):
    """Names of shuffle files that are new and still there after some seconds."""
    for _ in range(50):
        if not shuffled(spark) - before:
            break
        time.sleep(0.1)
    return shuffled(spark) - before


def test_writes_leave_no_shuffle_files(spark):
    before, rows = shuffled(spark), spark.range(1000).withColumn("k", F.col("id") % 7)
    kept = [rows.groupBy("k").count()]
    session.written(kept[0], session.scratch(spark))
    session.bucketed(kept[0], "k", session.scratch(spark))
    assert left_after(spark, before) == set()
    assert spark.conf.get(session.CLEANUP) == "false" and len(kept[0].collect()) == len(kept[0].collect()) == 7


def test_features_in_slices_are_the_same_and_move_less_at_a_time(spark):
    pairs, keys, texts = both_forms(spark)
    every = [c for g in C.GROUPS.values() for c in g]
    assert collected(lexical_features(keys, texts=texts, slices=3), FEATURES) == collected(lexical_features(pairs), FEATURES)
    assert collected(C.constraint_features(keys, texts=texts, slices=3), every) == collected(C.constraint_features(pairs), every)
    before, sizes = shuffled(spark), []
    with_parts = lambda rows: sizes.append(len(left_after(spark, before))) or rows
    X.with_both(keys, texts.withColumnRenamed("_text", "known"), "known", ("a", "b"), with_parts, 3)
    assert sizes == [0, 0, 0]


def test_lexical_features_alone_equal_those_beside_annotations(spark, monkeypatch):
    """logistic_grid needs FEATURES only: texts are not annotated for it, and words are counted without the dots of acronyms as before."""
    texts = {"a": "The U.S.A. and the U.K. agree in 2019", "b": "Can't they agree? I cannot say", "c": "", "d": "ﬁne e.g. N.A.S.A. said"}
    t = spark.createDataFrame(list(texts.items()), "_key string, _text string")
    p = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate((x, y) for x in texts for y in texts)], "id long, _k1 string, _k2 string")
    want = {r.id: r for r in catalog.pair_features(p, t).select("id", *FEATURES).collect()}
    assert len({r.word_count_absdiff for r in want.values()}) > 2
    monkeypatch.setattr(catalog.C, "annotate", None)
    assert {r.id: r for r in catalog.pair_lexical(p, t).select("id", *FEATURES).collect()} == want
