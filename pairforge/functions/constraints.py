"""Numbers, dates, entities, negation and scope of a text, and how two texts agree on them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.text import NEGATIONS, STOP_WORDS, TAG_NEGATIONS, WH_WORDS, jaccard, keyed_texts, let, normalize, tokenize, undotted, with_both, words_of

# Number words; "one" and "zero" are left out.
NUMBER_WORDS = {
    "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "fifteen": 15,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "hundred": 100, "thousand": 1000, "million": 1000000, "billion": 1000000000,
}
# Words that are dates.
DATE_WORDS = """january february march april may june july august september october november december
monday tuesday wednesday thursday friday saturday sunday today tomorrow yesterday tonight""".split()
# Patterns of dates, numbers, capitalised words and acronyms. What may stand before a match is looked up behind its first sign, so most places fail at once.
DATE = r"\b(?=[" + "".join(sorted({w[0] for w in DATE_WORDS})) + r"12])((?:1[89]\d\d|20\d\d)(?=s?\b)|(?:" + "|".join(DATE_WORDS) + r")\b)"
NUMBER = r"(?i)(\d(?<![\p{L}\p{N}_.]\d)\d*(?:,\d{3})*(?:\.\d+)?)(?=$|[^\p{L}\p{N}_.]|\.(?!\d)|[a-z%$])"
ENTITY_ITEM = r"([A-Z](?<!^[A-Z])(?<=\b[A-Z])(?<![.?!]\s[A-Z])[\p{L}\p{N}_'&.-]*[\p{L}\p{N}_])"
ENTITY_TAG = r"([A-Z](?<!^[A-Z])(?<=\b[A-Z])(?<![.?!]\s[A-Z])[\p{L}\p{N}_'-]*)"
ACRONYM = r"\b([A-Z]{2,}[0-9]*|[A-Za-z]+[0-9]+[A-Za-z0-9]*)\b"
# Forms of the pronoun.
PRONOUN = ["i", "i'm", "i've", "i'll", "i'd"]

PREFIXES = {"num": "numbers", "dateh": "dates", "enth": "entities"}
PARTS = ["any", "both", "unmatched_total", "unmatched_max_side", "mismatch", "one_sided"]
GROUPS = {
    "number": [f"num_{p}" for p in PARTS],
    "date_heuristic": [f"dateh_{p}" for p in PARTS],
    "entity_heuristic": [f"enth_{p}" for p in PARTS],
    "negation": ["neg_xor", "neg_count_diff"],
    "intent_word": ["wh_mismatch"],
    "specificity": ["extra_content_max", "extra_content_min", "content_subset", "log_len_ratio", "word_count_absdiff"],
}


def all_of(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def numbers(norm: Column, tokens: Column) -> Column:
    """The set of values of numbers in digits and words, as text."""
    value = F.transform(all_of(norm, NUMBER), lambda x: F.regexp_replace(x, ",", ""))
    plain = F.transform(value, lambda v: F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"^0+(?=\d)", ""), r"(\.\d*?)0+$", "$1"), r"\.$", ""))
    table = F.create_map(*[F.lit(x) for k, v in NUMBER_WORDS.items() for x in (k, str(v))])
    spelled = F.transform(F.filter(tokens, lambda t: t.isin(list(NUMBER_WORDS))), lambda t: table[t])
    return F.array_union(F.array_distinct(plain), spelled)


def dates(norm: Column) -> Column:
    """The set of years, months, weekdays and relative days, all found in one pass: each is a word of its own."""
    return F.array_distinct(all_of(norm, DATE))


def entities(undotted: Column) -> Column:
    """The set of capitalised words within sentences and of acronyms; none for a text in capitals. Its dotted acronyms have lost their dots."""
    canon = lambda xs: F.transform(F.array_distinct(xs), lambda x: F.array_join(tokenize(normalize(x, compose=False)), " "))

    def found(t: Column) -> Column:
        shouting = (F.upper(t) == t) & (F.lower(t) != t)
        caps = F.array_except(canon(all_of(t, ENTITY_ITEM)), words_of(STOP_WORDS))
        named = F.array_except(F.array_union(caps, canon(all_of(t, ACRONYM))), words_of([*WH_WORDS, *PRONOUN, ""]))
        return F.when(shouting, F.array().cast("array<string>")).otherwise(named)

    return let(F.trim(undotted), found)


def annotate(texts: DataFrame, column: str, into: str = "ann", compose: bool = True, groups: Iterable[str] = GROUPS) -> DataFrame:
    """Adds a struct of norm (padded tokens), n_words, content, numbers, dates, negation, wh, entities; of the sets, those that groups need."""
    # A column of its own, as normalize names its text several times and Spark would make it as often.
    out = texts.withColumn("_undotted", undotted(F.col(column))).withColumn("_norm", normalize(F.col("_undotted"), compose)).withColumn("_tokens", tokenize(F.col("_norm")))
    norm, tokens = F.col("_norm"), F.col("_tokens")
    first = F.get(tokens, F.lit(0))
    ann = F.struct(
        F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).alias("norm"),
        F.size(tokens).alias("n_words"),
        F.array_except(tokens, words_of([*STOP_WORDS, *NEGATIONS])).alias("content"),
        *[made().alias(name) for group, name, made in (("number", "numbers", lambda: numbers(norm, tokens)), ("date_heuristic", "dates", lambda: dates(norm))) if group in groups],
        (F.size(F.filter(tokens, lambda t: t.isin(NEGATIONS))) + F.regexp_count(norm, F.lit(r"\bnon-?[\p{L}\p{N}_]"))).alias("negation"),
        F.when(first.isin(WH_WORDS), first).otherwise("").alias("wh"),
        *([entities(F.col("_undotted")).alias("entities")] if "entity_heuristic" in groups else []),
    )
    return out.withColumn(into, ann).drop("_undotted", "_norm", "_tokens")


def unmatched(a: Column, b: Column, b_norm: Column) -> Column:
    """Items of a that are neither in b nor whole words of b's text."""
    return F.filter(F.array_except(a, b), lambda x: ~F.contains(b_norm, F.concat(F.lit(" "), x, F.lit(" "))))


def consistency(a: str, b: str, field: str, prefix: str) -> dict[str, Column]:
    items = [F.col(f"{s}.{field}") for s in (a, b)]
    ua = F.size(unmatched(items[0], items[1], F.col(f"{b}.norm")))
    ub = F.size(unmatched(items[1], items[0], F.col(f"{a}.norm")))
    has = [F.size(x) > 0 for x in items]
    made = [has[0] | has[1], has[0] & has[1], ua + ub, F.greatest(ua, ub), has[0] & has[1] & (ua + ub > 0), (has[0] != has[1]) & (ua + ub > 0)]
    return {f"{prefix}_{p}": c.cast("double") for p, c in zip(PARTS, made, strict=True)}


def slim(known: DataFrame) -> DataFrame:
    """Annotations for pairs that keep none: content words as hashes of 64 bits."""
    return known.withColumn("ann", F.col("ann").withField("content", F.transform("ann.content", lambda x: F.xxhash64(x))))


def constraint_features(pairs: DataFrame, compose: bool = True, texts: DataFrame | None = None, groups: Iterable[str] = GROUPS, slices: int = 1) -> DataFrame:
    """Adds the columns of groups to pairs (question1, question2), the same when the sides change places, and the annotations a1 and a2.

    Each distinct text is annotated once and joined to both sides by its hash, so annotations move and no text but once. With texts
    (_key, _text), pairs have the keys _k1 and _k2 in place of the texts and keep them, but no annotations.
    """
    out, known = keyed_texts(pairs, texts)
    known = annotate(known, "_text", compose=compose, groups=groups).drop("_text")
    if texts is None:
        return agreement(with_both(out, known, "ann", ("a1", "a2")).drop("_k1", "_k2"), groups)
    return with_both(out, slim(known), "ann", ("a1", "a2"), lambda rows: agreement(rows, groups).drop("a1", "a2"), slices)


def agreement(out: DataFrame, groups: Iterable[str] = GROUPS) -> DataFrame:
    """Adds the columns of groups to rows with annotations a1 and a2."""
    made: dict[str, Column] = {}
    for group, (prefix, field) in zip(GROUPS, PREFIXES.items(), strict=False):
        made |= consistency("a1", "a2", field, prefix) if group in groups else {}
    neg = [F.col(f"a{i}.negation") for i in (1, 2)]
    wh = [F.col(f"a{i}.wh") for i in (1, 2)]
    only = [F.size(F.array_except(f"a{i}.content", f"a{3 - i}.content")) for i in (1, 2)]
    words = [F.col(f"a{i}.n_words") for i in (1, 2)]
    made |= {
        "neg_xor": (neg[0] > 0) != (neg[1] > 0),
        "neg_count_diff": F.abs(neg[0] - neg[1]),
        "wh_mismatch": (wh[0] != "") & (wh[1] != "") & (wh[0] != wh[1]),
        "extra_content_max": F.greatest(*only),
        "extra_content_min": F.least(*only),
        "content_subset": (F.least(*only) == 0) & (F.greatest(*only) > 0),
        "log_len_ratio": F.abs(F.log(words[0].cast("double") + 1) - F.log(words[1].cast("double") + 1)),
        "word_count_absdiff": F.abs(words[0] - words[1]),
    }
    asked = {c for g in groups for c in GROUPS[g]}
    return out.withColumns({k: v.cast("double") for k, v in made.items() if k in asked})


def error_parts(raw: Column, tokens: Column) -> Column:
    """All that error_tags need of one text: sets of words as hashes of 64 bits, and which of them have digits, negate, are dates, or begin with non."""
    hashes = lambda xs: F.transform(xs, lambda x: F.xxhash64(x))
    caps = F.array_except(F.transform(F.array_distinct(all_of(F.trim(F.coalesce(raw, F.lit(""))), ENTITY_TAG)), F.lower), words_of(PRONOUN))

    def parts(words: Column, digits: Column) -> Column:
        non = F.transform(F.filter(words, lambda t: t.startswith("non")), lambda t: F.struct(F.xxhash64(t).alias("word"), F.xxhash64(F.substr(t, F.lit(4))).alias("rest")))
        dated = F.concat(F.filter(digits, lambda t: t.rlike(r"^(?:19|20)\d\d$")), F.array_intersect(words, words_of(DATE_WORDS[:19])))
        marked = {"digits": digits, "negations": F.array_intersect(words, words_of(TAG_NEGATIONS)), "dated": dated}
        return F.struct(hashes(words).alias("words"), hashes(caps).alias("caps"), non.alias("non"), *[hashes(found).alias(name) for name, found in marked.items()])

    return let(F.array_distinct(tokens), lambda words: let(F.filter(words, lambda t: t.rlike(r"\p{Nd}")), lambda digits: parts(words, digits)))


def error_tags(pairs: DataFrame, compose: bool = True, texts: DataFrame | None = None) -> DataFrame:
    """Adds number_diff, entity_diff, negation_diff, high_overlap, low_overlap, date_diff (whether they differ in a year, month or weekday) and jaccard to pairs.

    As in constraint_features: pairs have question1 and question2 or, with texts (_key, _text), the keys _k1 and _k2.
    """
    out, known = keyed_texts(pairs, texts)
    known = known.withColumn("_tokens", tokenize(normalize(F.col("_text"), compose))).select("_key", error_parts(F.col("_text"), F.col("_tokens")).alias("_parts"))
    p, a, b = with_both(out, known, "_parts", ("_p1", "_p2")), F.col("_p1"), F.col("_p2")
    p = p.withColumn("_diff", F.array_union(F.array_except(a["words"], b["words"]), F.array_except(b["words"], a["words"]))).withColumn("jaccard", jaccard(a["words"], b["words"], True))
    differ = lambda c: (F.size(F.array_except(a[c], b[c])) > 0) | (F.size(F.array_except(b[c], a[c])) > 0)
    has = lambda w: F.array_contains(a["words"], w) | F.array_contains(b["words"], w)
    tags = {
        "number_diff": differ("digits"),
        "entity_diff": F.arrays_overlap(F.concat(a["caps"], b["caps"]), F.col("_diff")),
        "negation_diff": differ("negations") | F.exists(F.concat(a["non"], b["non"]), lambda t: F.array_contains("_diff", t["word"]) & has(t["rest"])),
        "high_overlap": F.col("jaccard") >= 0.6,
        "low_overlap": F.col("jaccard") < 0.2,
        "date_diff": differ("dated"),
    }
    return p.withColumns(tags).drop("_diff", "_p1", "_p2", *([] if texts is not None else ["_k1", "_k2"]))
