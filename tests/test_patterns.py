"""Patterns that begin with what they look for find what their plain forms find."""

import random

from pyspark.sql import functions as F

from pairforge.functions import constraints as C
from pairforge.functions import text as X

PARTS = ["can't", "cannot", "won't", "shan't", "don't", "n't", "scannot", "[math]", "[/math]", "math]", "May", "may", "1999", "1990s", "1999a", "2050", "2150", "today's", "sunday", "sundays", "U.S.A.", "U.S", "a.b.c", "Paris", "O'Neil", "NASA", "B2B",
         "x2", "1,000.50", "3.5.7", "12%", "007", "5kg", "é9", "9é", "“it’s”", "′", "ﬁt", "Ⅷ", "𝔘", "Ünï", "_A", "A_", "nonlinear", "not", ".", "?", "!", ",", "-", "'"]
PLAIN = {
    "number": (C.NUMBER, r"(?i)(?<![\p{L}\p{N}_.])(\d+(?:,\d{3})*(?:\.\d+)?)(?=$|[^\p{L}\p{N}_.]|\.(?!\d)|[a-z%$])"),
    "item": (C.ENTITY_ITEM, r"(?<![.?!]\s)(?<!^)\b([A-Z][\p{L}\p{N}_'&.-]*[\p{L}\p{N}_])"),
    "tag": (C.ENTITY_TAG, r"(?<![.?!]\s)(?<!^)\b([A-Z][\p{L}\p{N}_'-]*)"),
}


def plain_normalize(c):
    t = F.lower(F.translate(X.nfkc(c), "‘’“”′", "''\"\"'"))
    for pattern, to in ((r"\[/?math\]", " "), (r"\bcan't\b|\bcannot\b", "can not"), (r"\bwon't\b", "will not"), (r"\bshan't\b", "shall not"), (r"(\w+)n't\b", "$1 not")):
        t = F.regexp_replace(t, f"(?U){pattern}", to)
    return X.squeezed(t)


def test_patterns_find_what_plain_ones_find(spark):
    draw = random.Random(7)
    rows = [("".join(draw.choice(PARTS) + draw.choice(["", " ", " ", "\n", "  "]) for _ in range(draw.randrange(9))),) for _ in range(3000)]
    t = F.col("t")
    dates = F.array_union(C.all_of(t, r"\b(1[89]\d\d|20\d\d)s?\b"), C.all_of(t, r"\b(" + "|".join(C.DATE_WORDS) + r")\b"))
    undotted = F.regexp_replace(t, r"(?<=\b[A-Za-z])\.(?=[A-Za-z]\.)|(?<=\.[A-Za-z])\.", "")
    checks = {"dates": (F.array_sort(C.dates(t)), F.array_sort(dates)), "undotted": (X.undotted(t), undotted), "normal": (X.normalize(t), plain_normalize(t))}
    checks |= {k: (C.all_of(t, new), C.all_of(t, old)) for k, (new, old) in PLAIN.items()}
    made = spark.createDataFrame(rows, "t string").select("t", *[x.alias(f"{k}_{i}") for k, pair in checks.items() for i, x in enumerate(pair)])
    for r in made.collect():
        for k in checks:
            assert r[f"{k}_0"] == r[f"{k}_1"], (k, r.t)


def test_what_annotations_name_often_is_made_once(spark):
    texts = spark.createDataFrame([("A U.S. text",)], "_text string")
    plan = C.annotate(texts, "_text")._jdf.queryExecution().optimizedPlan().toString()
    dots = r"(?<=\.[A-Za-z]\.)"
    assert plan.count(dots) == 1, plan
