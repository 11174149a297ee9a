"""Secret scan with multipart credential linking, in DataFrame operations only.

A credential has an identifying part (an access key, a user name, an endpoint) and a secret one (an assigned value, a
hexadecimal or an opaque string). Access keys, assignments and hexadecimal strings are strong and stand alone; the
others are weak candidates, reported only with a complementary part: one of the other side, disjoint from it, with a
gap of at most SCOPE code points between the two. A weak candidate that overlaps a strong finding or a weak one of
a more telling kind (endpoint, ident, opaque) is no part. The interval join is a pass over the parts of one document in
either direction that carries the last part of each side, so no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairforge.llm.shared import as_text

SCOPE = 300

_KEYWORDS = ["password", "passwd", "secret", "token", "api_key", "apikey"]


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_QUOTED = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = "(?:" + "|".join(map(_either, _KEYWORDS[:4])) + "|" + _either("api") + "_?" + _either("key") + ")" + _QUOTED + r"[A-Za-z0-9+/_.=-]+"
#: An assignment's value is its longest end of these characters after the operator.
HEAD = "^(?:" + "|".join(map(_either, _KEYWORDS[:4])) + "|" + _either("api") + "_?" + _either("key") + ")" + _QUOTED
ACCESS = "AKIA[A-Z0-9]{14,}"  # equal to AKIA[A-Z0-9]+ of 18 characters or more: a run that fails has no later start that holds
HEX = "[0-9a-f]{16,}"
IDENT = "(?:" + "|".join(map(_either, ["username", "user", "login", "client_id", "account"])) + ")" + _QUOTED + r"[A-Za-z0-9_.@-]{3,}"
ENDPOINT = r"""[hH][tT][tT][pP][sS]?://[!#-&(-;=?-~]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"""
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "ident", "endpoint", "opaque"]
#: The kinds of an identifying part; those of a secret one are the others. Weak kinds, from the most telling.
NAMES, WEAK = ["access", "ident", "endpoint"], ["endpoint", "ident", "opaque"]


def parts(text: Column, guard: Column, kind: str, pattern: str, valid) -> Column:
    """Matches of pattern as an array of (kind, i, gap, len, ok): gap is the text between the match before and this one."""
    made = F.zip_with(
        F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)),
        F.split(text, pattern, -1),
        lambda m, g: F.struct(F.lit(kind).alias("kind"), F.length(g).alias("gap"), F.length(m).alias("len"), valid(m).alias("ok")),
    )
    made = F.filter(made, lambda x: x["len"].isNotNull())  # the piece after the last match
    made = F.transform(made, lambda x, i: F.struct(x["kind"].alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["len"].alias("len"), x["ok"].alias("ok")))
    return F.when(guard & text.rlike(pattern), made).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:int,len:int,ok:boolean>>"))


def scan(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of documents: doc_id, n_assign, n_access, n_hex, base_sha256, spans, links.

    spans has all findings as kind:start:end, links those of them that have a complementary part, with the nearest of
    these: kind:start:end+kind:start:end (the one before on a tie). Null texts are empty; texts without findings have
    counts 0 and empty strings; texts are read whole, however long. Rows are told apart by their place, so rows that
    repeat, or have no doc_id, are reported each. Empty tables give empty results; other columns are ignored, whatever their names.
    """
    docs = as_text(documents.select("doc_id", "text")).withColumn("row", F.monotonically_increasing_id())
    t = F.col("text")
    low = F.lower(t)
    keyed = F.lit(False)
    for w in _KEYWORDS:
        keyed = keyed | low.contains(w)
    named = low.contains("user") | low.contains("login") | low.contains("client_id") | low.contains("account")
    true = lambda m: F.lit(True)
    found = F.concat(
        parts(t, keyed, "assign", ASSIGN, lambda m: F.length(F.regexp_replace(m, HEAD, "")) >= 12),
        parts(t, t.contains("AKIA"), "access", ACCESS, true),
        parts(t, F.lit(True), "hex", HEX, true),
        parts(t, named, "ident", IDENT, true),
        parts(t, t.contains("://") | t.rlike(r"[0-9]\.[0-9]"), "endpoint", ENDPOINT, true),
        parts(t, F.lit(True), "opaque", OPAQUE, lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")),
    )
    rows = docs.select("row", "doc_id", F.explode_outer(found).alias("p")).select("row", "doc_id", "p.*")
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(so_far)
    rows = rows.repartition("row").withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
    rows = rows.withColumn("kind", F.when(F.col("ok"), F.col("kind")))  # a document keeps a row, whatever fails
    base = F.coalesce(F.col("kind").isin(KINDS[:3]), F.lit(False))
    order = sum((F.when(F.col("kind") == k, i).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0))
    rows = rows.withColumn("base", base).withColumn("order", order).withColumn("clear", F.col("base"))
    # Both windows run from one end of the document to the part before or after: what lies beyond is carried along.
    passed = Window.partitionBy("row").orderBy("start", "order").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("order")).rowsBetween(Window.unboundedPreceding, -1)
    for kind in WEAK:
        before, after = (F.max(F.when(F.col("clear"), F.col("end"))).over(passed), F.min(F.when(F.col("clear"), F.col("start"))).over(ahead))
        rows = rows.withColumns({"before": before, "after": after})
        free = F.coalesce(F.col("before") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("after") >= F.col("end"), F.lit(True))
        rows = rows.withColumn("clear", F.col("clear") | (F.coalesce(F.col("kind") == kind, F.lit(False)) & free))
    span = F.struct("start", "order", "end", "kind")
    sides = {"name": F.col("kind").isin(NAMES), "secret": ~F.col("kind").isin(NAMES)}
    near = {f"{side}_{way}": F.last(F.when(F.col("clear") & is_, span), ignorenulls=True).over(w) for side, is_ in sides.items() for way, w in (("before", passed), ("after", ahead))}
    rows = rows.withColumns(near)
    other = lambda way: F.when(sides["name"], F.col(f"secret_{way}")).otherwise(F.col(f"name_{way}"))
    rows = rows.withColumns({"before": other("before"), "after": other("after")})
    gaps = {"gap_before": F.col("start") - F.col("before.end"), "gap_after": F.col("after.start") - F.col("end")}
    rows = rows.withColumns({k: F.when(F.col("clear") & g.between(0, scope), g) for k, g in gaps.items()})
    link = F.when(F.coalesce(F.col("gap_before") <= F.col("gap_after"), F.col("gap_before").isNotNull()), F.col("before")).when(F.col("gap_after").isNotNull(), F.col("after"))
    rows = rows.withColumn("link", link).withColumn("shown", F.col("base") | F.col("link").isNotNull())
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    text = lambda a: F.array_join(F.transform(F.array_sort(a), said), ",")
    count = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    out = rows.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.collect_list(F.when(F.col("base"), span)).alias("b"), F.collect_list(F.when(F.col("shown"), span)).alias("s"),
        F.collect_list(F.when(F.col("link").isNotNull(), F.struct("start", "order", span.alias("x"), F.col("link").alias("y")))).alias("l"),
    )
    links = F.array_join(F.transform(F.array_sort("l"), lambda z: F.concat_ws("+", said(z["x"]), said(z["y"]))), ",")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(text(F.col("b")), 256).alias("base_sha256"), text(F.col("s")).alias("spans"), links.alias("links"))


def _sql_parts(kind: str, order: int, pattern: str, valid: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {order} AS ord, {str(order < 3).lower()} AS base, len(m[i]) AS n,
      list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS start, m[i] AS v
    FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM d WHERE regexp_matches(text, '{p}')), unnest(range(1, len(m) + 1)) AS u(i)
    WHERE {valid}"""


_UNION = "\nUNION ALL ".join(
    _sql_parts(k, i, p, {"assign": f"len(regexp_replace(m[i], '{HEAD.replace(chr(39), chr(39) * 2)}', '')) >= 12", "opaque": "regexp_matches(m[i], '[0-9]') AND regexp_matches(m[i], '[A-Za-z]')"}.get(k, "true"))
    for i, (k, p) in enumerate(zip(KINDS, [ASSIGN, ACCESS, HEX, IDENT, ENDPOINT, OPAQUE], strict=True))
)


def _sql_clear(step: int, kind: str) -> str:
    """Table c{step}: weak parts of kind are clear if they overlap nothing that is clear in the table before."""
    return f"""c{step} AS (SELECT * EXCLUDE (clear), clear OR (kind = '{kind}' AND coalesce(max(CASE WHEN clear THEN stop END) OVER b <= start, true) AND coalesce(min(CASE WHEN clear THEN start END) OVER a >= stop, true)) AS clear
  FROM c{step - 1} WINDOW b AS (PARTITION BY doc_id ORDER BY start, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY doc_id ORDER BY start, ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""


_NAME = "kind IN (" + ", ".join(f"'{k}'" for k in NAMES) + ")"
_SPAN = "{'s': start, 'o': ord, 'e': stop, 'k': kind}"
_near = lambda side, f, w: f"{f}(CASE WHEN clear AND {side} THEN {_SPAN} END IGNORE NULLS) OVER {w}"
#: doc_id tells the rows of documents apart here.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS ({_UNION}),
c0 AS (SELECT *, start + n AS stop, base AS clear FROM p),
{", ".join(_sql_clear(i + 1, k) for i, k in enumerate(WEAK))},
n AS (SELECT *, CASE WHEN {_NAME} THEN {_near(f"NOT {_NAME}", "last_value", "b")} ELSE {_near(_NAME, "last_value", "b")} END AS y, CASE WHEN {_NAME} THEN {_near(f"NOT {_NAME}", "first_value", "a")} ELSE {_near(_NAME, "first_value", "a")} END AS z
  FROM c3 WINDOW b AS (PARTITION BY doc_id ORDER BY start, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY doc_id ORDER BY start, ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
g AS (SELECT *, CASE WHEN clear AND start - y.e BETWEEN 0 AND {SCOPE} THEN start - y.e END AS gy, CASE WHEN clear AND z.s - stop BETWEEN 0 AND {SCOPE} THEN z.s - stop END AS gz FROM n),
l AS (SELECT *, CASE WHEN gy IS NOT NULL AND (gz IS NULL OR gy <= gz) THEN y WHEN gz IS NOT NULL THEN z END AS x FROM g),
f AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (base) AS b, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (base OR x IS NOT NULL) AS spans,
  string_agg(kind || ':' || start || ':' || stop || '+' || x.k || ':' || x.s || ':' || x.e, ',' ORDER BY start, ord) FILTER (x IS NOT NULL) AS links FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(links, '') AS links
FROM d LEFT JOIN f USING (doc_id)
"""
