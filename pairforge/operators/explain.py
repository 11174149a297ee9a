"""Explained decisions on pairs: signals, what-if scores and a rationale, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.constraints import GROUPS, PREFIXES, unmatched
from pairforge.functions.text import WH_WORDS, cleaned, words_of

BORDERLINE, NEAR_BOUNDARY, STRONG = 0.05, 0.016, 0.05
# The types of signals.
TYPES = {
    "num": ("numbers mismatch", "numbers only in one question"),
    "dateh": ("dates mismatch", "dates only in one question"),
    "enth": ("named entities mismatch", "named entities only in one question"),
    "neg": ("negation mismatch",),
    "wh": ("question word differs",),
    "content": ("broader / narrower", "different content words"),
}
WHAT_IF = ["number", "date_heuristic", "entity_heuristic", "negation", "intent_word"]


def complete(pairs: DataFrame) -> None:
    """Raises if a side of a pair is empty: there is nothing to explain."""
    if not pairs.where((cleaned(F.col("question1")) == "") | (cleaned(F.col("question2")) == "")).isEmpty():
        raise ValueError("both texts of a pair must hold something")


def listed(items: Column) -> Column:
    return F.when(F.size(items) == 0, "-").otherwise(F.array_join(F.array_sort(items), ", "))


def signal(kind: str, detail: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), detail.alias("detail"))


def signals(pairs: DataFrame) -> DataFrame:
    """Adds signals: the mismatches of annotated pairs with constraint features, in the order of TYPES.

    type is a fixed value; detail names what each text (first, second) has that the other lacks.
    """

    def lacks(a: Column, b: Column) -> Column:
        return F.format_string("first: %s; second: %s", listed(a), listed(b))

    out = []
    for prefix, field in PREFIXES.items():
        a = unmatched(F.col(f"a1.{field}"), F.col(f"a2.{field}"), F.col("a2.norm"))
        b = unmatched(F.col(f"a2.{field}"), F.col(f"a1.{field}"), F.col("a1.norm"))
        both, one = TYPES[prefix]
        out.append(F.when(F.col(f"{prefix}_mismatch") == 1, signal(both, lacks(a, b))).when(F.col(f"{prefix}_one_sided") == 1, signal(one, lacks(a, b))))
    out.append(F.when(F.col("neg_xor") == 1, signal(TYPES["neg"][0], F.format_string("negated: the %s text", F.when(F.col("a1.negation") > 0, "first").otherwise("second")))))
    out.append(F.when(F.col("wh_mismatch") == 1, signal(TYPES["wh"][0], F.format_string("first: %s; second: %s", F.col("a1.wh"), F.col("a2.wh")))))
    wh = words_of(WH_WORDS)
    a, b = F.array_except(F.array_except("a1.content", "a2.content"), wh), F.array_except(F.array_except("a2.content", "a1.content"), wh)
    a, b = (F.slice(F.array_sort(x), 1, 6) for x in (a, b))
    out.append(F.when(F.col("content_subset") == 1, signal(TYPES["content"][0], lacks(a, b))).when((F.size(a) > 0) | (F.size(b) > 0), signal(TYPES["content"][1], lacks(a, b))))
    return pairs.withColumn("signals", F.filter(F.array(*out), lambda s: s.isNotNull()))


def neutral(group: str) -> dict[str, Column]:
    """Columns of a group as if both texts agreed on it: no difference, and what one has the other has too."""
    return {c: F.col(c.removesuffix("_both") + "_any") if c.endswith("_both") else F.lit(0.0) for c in GROUPS[group] if not c.endswith("_any")}


def what_if(features: DataFrame, score: Callable[[DataFrame], DataFrame], groups: list[str] | None = None) -> DataFrame:
    """id, group, probability_if_no_difference, effect for each group in which a pair differs.

    score adds score to a table of features. Scope is never varied: two different texts can't have the same words.
    """
    base = score(features).select("id", F.col("score").alias("_p"))
    out = None
    for g in groups or WHAT_IF:
        if g not in WHAT_IF:
            raise ValueError(f"no what-if for group: {g}")
        differs = [F.col(c) != 0 for c in GROUPS[g] if not c.endswith(("_any", "_both"))]
        rows = features.where(sum((d.cast("int") for d in differs), F.lit(0)) > 0).withColumns(neutral(g))
        got = score(rows).select("id", F.lit(g).alias("group"), F.col("score").alias("probability_if_no_difference"))
        out = got if out is None else out.unionByName(got)
    return out.join(base, "id").select("id", "group", "probability_if_no_difference", (F.col("_p") - F.col("probability_if_no_difference")).alias("effect"))


def decide(scored: DataFrame, tau: float, base_tau: float) -> DataFrame:
    """Adds decision, base_decision, borderline and near_boundary to rows with score, base and margin."""
    return scored.withColumns({"decision": F.col("score") >= tau, "base_decision": F.col("base") >= base_tau, "borderline": F.abs(F.col("score") - tau) < BORDERLINE, "near_boundary": F.col("margin") < NEAR_BOUNDARY})


def extracted(pairs: DataFrame) -> DataFrame:
    """Adds items_a and items_b to annotated pairs: sorted numbers, dates, entities and content words, whether it is negated, and its question word."""
    def items(a: str) -> Column:
        lists = [F.array_sort(F.array_distinct(f"{a}.{f}")).alias(f) for f in ("numbers", "dates", "entities", "content")]
        return F.struct(*lists, (F.col(f"{a}.negation") > 0).alias("negated"), F.when(F.col(f"{a}.wh") != "", F.col(f"{a}.wh")).alias("question_word"))

    return pairs.withColumns({"items_a": items("a1"), "items_b": items("a2")})


def strong_effects(effects: DataFrame, least: float = STRONG, most: int = 3) -> DataFrame:
    """id, strong: the what-if rows of each pair that change its score by `least` or more, from the most lowering one on."""
    rows = F.array_sort(F.collect_list(F.when(F.abs("effect") >= least, F.struct("effect", "group", "probability_if_no_difference"))))
    return effects.groupBy("id").agg(F.slice(rows, 1, most).alias("strong"))


def rationale(decided: DataFrame, tau: float, base_tau: float) -> DataFrame:
    """Adds rationale: sentences on similarity, signals, strong what-ifs, the decision and the region's border, of rows with
    cosine, score, base, signals, strong, decision, base_decision, borderline and near_boundary."""
    verdict = lambda c: F.when(c, "a duplicate").otherwise("no duplicate")
    word = F.when(F.col("cosine") >= 0.85, "very similar").when(F.col("cosine") >= 0.6, "similar").otherwise("not very similar")
    first = F.format_string("Their vectors are %s (cosine %.2f). By these alone the pair scores %.2f and is %s from %.2f on.", word, F.col("cosine"), F.col("base"), verdict(F.col("base_decision")), F.lit(base_tau))
    found = F.when(F.size("signals") > 0, F.concat(F.lit("Signals: "), F.array_join(F.transform("signals", lambda s: F.concat(s["type"], F.lit(" ("), s["detail"], F.lit(")"))), ", "), F.lit("."))).otherwise("There is no signal.")
    change = F.transform(F.coalesce("strong", F.array().cast("array<struct<effect:double,group:string,probability_if_no_difference:double>>")), lambda s: F.format_string("Had both the same %s, the score would be %.2f, not %.2f.", s["group"], s["probability_if_no_difference"], F.col("score")))
    last = F.format_string("The score is %.2f against a threshold of %.2f: %s%s.", F.col("score"), F.lit(tau), verdict(F.col("decision")), F.when(F.col("borderline"), ", but close").otherwise(""))
    border = F.when(F.col("near_boundary"), F.array(F.lit("The pair lies between two regions, so its region says little."))).otherwise(F.array().cast("array<string>"))
    return decided.withColumn("rationale", F.concat(F.array(first, found), change, F.array(last), border))
