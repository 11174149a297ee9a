"""Format-preserving Feistel pseudonyms for personal numbers, dates and addresses, in DataFrame operations only.

Findings are validated (Luhn, calendar, octets, mod 97, numbering plans) and replaced by a keyed permutation within
their format, so a value has the same pseudonym in every document and, format by format, two values never share one.
A value is split in two halves; each round adds a keyed hash of one half to the other, modulo its size:

- card: all digits but the check digit, which is computed anew;
- date: years 1700 to 2099 and days of the year, where days up to 12, later days and 29 February stay among themselves,
  so a date is read in the same order of day and month again;
- ip: the 2^32 addresses;
- phone: the national number. The country code is kept and is found by its value, so all ways to write a number have
  one pseudonym; numbers of code 1, also without it, stay within or outside of its numbering plan;
- ssn: area, group and serial numbers in use; iban: letters among letters and digits among digits, with a new check;
- email: letters and digits of the local part, whatever their case.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.shared import as_text

ROUNDS = 10
KINDS = ["email", "date", "ip", "phone", "ssn", "iban", "card"]
_B, _E = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4}"
#: Repeated groups have bounds and long runs are possessive, so no text makes the regex engine recurse or go back far.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?=[A-Za-z0-9][A-Za-z0-9-]{0,62}+(?:\.[A-Za-z0-9][A-Za-z0-9-]{0,62}+){0,124}?\.[A-Za-z]{2})",
    "date": rf"{_B}(?:{_DATE}){_E}",
    "ip": r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])",
    "phone": r"(?<![A-Za-z0-9+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9+.-])(?:(?:1[ .-])?\([2-9][0-9]{2}\)[ .-]?[0-9]{3}[ .-]|1[ .-][2-9][0-9]{2}[ .-][0-9]{3}[ .-]|[2-9][0-9]{2}[.-][0-9]{3}[.-])[0-9]{4}(?![A-Za-z0-9]|[.-][0-9])",
    "ssn": r"(?<![A-Za-z0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|[.-][0-9])",
    "iban": rf"{_B}[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?){_E}",
    "card": rf"{_B}(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}){_E}",
}
ANY = "|".join(f"(?:{PATTERNS[k]})" for k in KINDS)
# Fixed values (ITU-T E.164): country codes of two digits. Those that begin with 1 or 7 have one, all others three.
CODES_2 = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
FIRST_YEAR, YEARS = 1700, 400
_LEAP = [y for y in range(FIRST_YEAR, FIRST_YEAR + YEARS) if y % 4 == 0 and (y % 100 or y % 400 == 0)]
_LATE = [d.strftime("%m-%d") for i in range(365) if (d := datetime.date(2001, 1, 1) + datetime.timedelta(i)).day > 12]
_NONE = "named_struct('kind', cast(null as string), 'value', m)"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _hash(key: str, kind: str, i: str, value: str, bits: int = 256) -> str:
    """Keyed hexadecimal digits for a half; kind is an SQL expression."""
    return f"sha2(concat_ws('|', '{key}', {kind}, {i}, {value}), {bits})"


def _feistel(key: str, kind: str, a: str, b: str, size_a: str, size_b: str) -> str:
    """A struct of two halves a < size_a, b < size_b, permuted."""
    drawn = lambda half: f"cast(conv(substr({_hash(key, kind, 'i', half)}, 1, 15), 16, 10) as bigint)"
    fa = f"(s.a + {drawn('s.b')} % {size_a}) % {size_a}"
    fb = f"(s.b + {drawn('s.a')} % {size_b}) % {size_b}"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, i) -> named_struct('a', if(i % 2 = 0, {fa}, s.a), 'b', if(i % 2 = 0, s.b, {fb})))"


_TENS = "array(" + ",".join(f"{10**i}L" for i in range(11)) + ")"


def _digits(key: str, kind: str, d: str) -> str:
    """A string of 2 to 20 digits, permuted among those of its length."""
    n1 = f"cast(length({d}) div 2 as int)"
    n2 = f"(length({d}) - {n1})"
    f = _feistel(key, kind, f"substr({d}, 1, {n1})", f"substr({d}, {n1} + 1)", f"element_at({_TENS}, {n1} + 1)", f"element_at({_TENS}, {n2} + 1)")
    return _let(f, "h", f"concat(lpad(cast(h.a as string), {n1}, '0'), lpad(cast(h.b as string), {n2}, '0'))")


def _letters(key: str, kind: str, l: str) -> str:
    """A string of up to 64 characters, where small letters are permuted among small letters, large ones and digits likewise."""

    def shifted(half: str, by: str) -> str:
        c, n = f"substr({half}, j, 1)", "cast(conv(substr(x, 4 * j - 3, 4), 16, 10) as int)"
        one = " ".join(f"when {c} between '{lo}' and '{hi}' then chr({ord(lo)} + (ascii({c}) - {ord(lo)} + {n}) % {ord(hi) - ord(lo) + 1})" for lo, hi in ("09", "az", "AZ"))
        return f"if({half} = '', '', " + _let(by, "x", f"array_join(transform(sequence(1, length({half})), j -> case {one} else {c} end), '')") + ")"

    n1 = f"cast(length({l}) div 2 as int)"
    a, b = shifted("s.a", _hash(key, kind, "i", "s.b", 512)), shifted("s.b", _hash(key, kind, "i", "s.a", 512))
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', substr({l}, 1, {n1}), 'b', substr({l}, {n1} + 1)), (s, i) -> named_struct('a', if(i % 2 = 0, {a}, s.a), 'b', if(i % 2 = 0, s.b, {b})), s -> concat(s.a, s.b))"


def _refill(shape: str, drawn: str, sign: str = "c between '0' and '9'") -> str:
    """shape with its digits, or the signs c given, replaced in order."""
    return f"aggregate(transform(sequence(1, length({shape})), j -> substr({shape}, j, 1)), named_struct('o', '', 'k', 1), (s, c) -> if({sign}, named_struct('o', concat(s.o, substr({drawn}, s.k, 1)), 'k', s.k + 1), named_struct('o', concat(s.o, c), 'k', s.k)), s -> s.o)"


def _luhn(d: str) -> str:
    """The Luhn sum of digits that a check digit follows."""
    each = f"cast(substr({d}, length({d}) + 1 - i, 1) as int)"
    return f"aggregate(sequence(1, length({d})), 0, (s, i) -> s + if(i % 2 = 1, if({each} > 4, 2 * {each} - 9, 2 * {each}), {each}))"


def _mod97(s: str) -> str:
    """The remainder of a string whose letters count as 10 to 35."""
    c = f"substr({s}, i, 1)"
    return f"aggregate(sequence(1, length({s})), 0, (r, i) -> if({c} between '0' and '9', r * 10 + cast({c} as int), r * 100 + ascii({c}) - 55) % 97)"


def _found(kind: str, value: str) -> str:
    return f"named_struct('kind', '{kind}', 'value', {value})"


def _card(key: str) -> str:
    body = _let(_digits(key, "'card'", "substr(d, 1, length(d) - 1)"), "e", _refill("m", f"concat(e, cast((10 - {_luhn('e')} % 10) % 10 as string))"))
    return f"if((10 - {_luhn('substr(d, 1, length(d) - 1)')} % 10) % 10 = cast(right(d, 1) as int) and d rlike '[1-9]', {_found('card', body)}, {_NONE})"


def _phone(key: str) -> str:
    """d: all digits; code: how many of them are the country code, 0 if it is left out and is 1; n: the national number."""
    two = ", ".join(f"'{c}'" for c in CODES_2)
    code = f"case when m not like '+%' then length(d) - 10 when left(d, 1) in ('1', '7') then 1 when left(d, 2) in ({two}) then 2 else 3 end"
    area, line = "cast(left(n, 3) as int)", "cast(substr(n, 4) as bigint)"
    high = f"if({area} < 200 or {line} < 2000000, 0, 2000000)"
    size = f"if({area} < 200, 10000000, if({line} < 2000000, 2000000, 8000000))"
    plan = _feistel(key, "'phone|1'", f"{area} - if({area} < 200, 0, 200)", f"{line} - {high}", f"if({area} < 200, 200, 800)", size)
    plan = _let(plan, "h", f"concat(lpad(cast(h.a + if({area} < 200, 0, 200) as string), 3, '0'), lpad(cast(h.b + {high} as string), 7, '0'))")
    own = f"if(length(n) = 10 and left(if(m like '+%', d, '1'), 1) = '1', {plan}, {_digits(key, chr(39) + 'phone|' + chr(39) + ' || substr(d, 1, k)', 'n')})"
    value = _let(code, "k", _let("substr(d, k + 1)", "n", _refill("m", f"concat(substr(d, 1, k), {own})")))
    return f"if(length(d) between 8 and 15, {_found('phone', value)}, {_NONE})"


def _ssn(key: str) -> str:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area = "cast(left(d, 3) as int)"
    f = _feistel(key, "'ssn'", f"{area} - if({area} > 666, 2, 1)", "(cast(substr(d, 4, 2) as int) - 1) * 9999 + cast(right(d, 4) as int) - 1", "898", "989901")
    value = _let(f, "h", "concat(lpad(cast(h.a + if(h.a > 664, 2, 1) as string), 3, '0'), '-', lpad(cast(h.b div 9999 + 1 as string), 2, '0'), '-', lpad(cast(h.b % 9999 + 1 as string), 4, '0'))")
    return f"if({area} between 1 and 899 and {area} != 666 and substr(d, 4, 2) != '00' and right(d, 4) != '0000', {_found('ssn', value)}, {_NONE})"


def _iban(key: str) -> str:
    new = _let(_letters(key, "'iban'", "substr(w, 5)"), "e", _refill("m", f"concat(left(w, 2), lpad(cast(98 - {_mod97("concat(e, left(w, 2), '00')")} as string), 2, '0'), e)", "c != ' '"))
    return _let("replace(m, ' ', '')", "w", f"if(length(w) between 15 and 34 and {_mod97('concat(substr(w, 5), left(w, 4))')} = 1, {_found('iban', new)}, {_NONE})")


def _ip(key: str) -> str:
    octet = lambda i: f"cast(element_at(split(m, '[.]'), {i}) as bigint)"
    bits = _feistel(key, "'ip'", f"{octet(1)} * 256 + {octet(2)}", f"{octet(3)} * 256 + {octet(4)}", "65536", "65536")
    value = _let(bits, "h", "concat_ws('.', cast(h.a div 256 as string), cast(h.a % 256 as string), cast(h.b div 256 as string), cast(h.b % 256 as string))")
    return f"if(forall(split(m, '[.]'), x -> cast(x as int) < 256), {_found('ip', value)}, {_NONE})"


def _date(key: str) -> str:
    """q: 'iso', 'day' or 'month', by what comes first; v: the date; t: its pseudonym as yyyy-MM-dd."""
    order = "case when m rlike '^[0-9]{4}-' then 'iso' when substr(m, 3, 1) = '/' and substr(m, 4, 2) > '12' and substr(m, 1, 2) <= '12' then 'month' else 'day' end"
    text = "case q when 'iso' then m when 'day' then concat(right(m, 4), '-', substr(m, 4, 2), '-', substr(m, 1, 2)) else concat(right(m, 4), '-', substr(m, 1, 2), '-', substr(m, 4, 2)) end"
    year = f"(year(v) - {FIRST_YEAR})"
    late, leap = "array(" + ", ".join(f"'{x}'" for x in _LATE) + ")", "array(" + ", ".join(map(str, _LEAP)) + ")"
    name = f"lpad(cast(h.a + {FIRST_YEAR} as string), 4, '0')"
    early_day = _let(_feistel(key, "'date|early'", year, "(month(v) - 1) * 12 + day(v) - 1", str(YEARS), "144"), "h", f"concat({name}, '-', lpad(cast(h.b div 12 + 1 as string), 2, '0'), '-', lpad(cast(h.b % 12 + 1 as string), 2, '0'))")
    leap_day = _let(_feistel(key, "'date|leap'", f"array_position({leap}, year(v)) - 1", "0", str(len(_LEAP)), "1"), "h", f"concat(cast(element_at({leap}, cast(h.a as int) + 1) as string), '-02-29')")
    late_day = _let(_feistel(key, "'date|late'", year, f"array_position({late}, date_format(v, 'MM-dd')) - 1", str(YEARS), str(len(_LATE))), "h", f"concat({name}, '-', element_at({late}, cast(h.b as int) + 1))")
    new = f"case when day(v) <= 12 then {early_day} when date_format(v, 'MM-dd') = '02-29' then {leap_day} else {late_day} end"
    y, mo, d = "left(t, 4)", "substr(t, 6, 2)", "right(t, 2)"
    put = f"case q when 'iso' then t when 'day' then concat({d}, substr(m, 3, 1), {mo}, substr(m, 6, 1), {y}) else concat({mo}, substr(m, 3, 1), {d}, substr(m, 6, 1), {y}) end"
    read = _let(f"try_to_date({text}, 'yyyy-MM-dd')", "v", f"if(v is not null and year(v) between {FIRST_YEAR} and {FIRST_YEAR + YEARS - 1}, {_found('date', _let(new, 't', put))}, {_NONE})")
    return _let(order, "q", read)


def _email(key: str) -> str:
    """The local part is permuted in small letters; large ones stay large in their places."""
    cased = "array_join(transform(sequence(1, length(l)), j -> if(substr(l, j, 1) between 'A' and 'Z', upper(substr(e, j, 1)), substr(e, j, 1))), '')"
    return _let("substr(m, 1, length(m) - 1)", "l", _let(_letters(key, "'email'", "lower(l)"), "e", _found("email", f"concat({cased}, '@')")))


def expression(key: str) -> str:
    """SQL for the pseudonym of the finding m, as a struct of kind (null if it is not valid) and value."""
    key = key.replace("\\", "\\\\").replace("'", "\\'")
    numbers = f"case when m like '+%' or m rlike '^(?:1[ .-])?(?:[(][0-9]{{3}}[)][ .-]?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}$' then {_phone(key)} when m rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then {_ssn(key)} else {_card(key)} end"
    return f"case when m like '%@' then {_email(key)} when m rlike '^[A-Z]' then {_iban(key)} when m rlike '^(?:{_DATE})$' then {_date(key)} when m rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then {_ip(key)} else {_let("regexp_replace(m, '[^0-9]', '')", 'd', numbers)} end"


def pseudonymise(documents: DataFrame, key: str) -> DataFrame:
    """Per row of documents: doc_id, text with pseudonyms, and counts n_email, n_date, n_ip, n_phone, n_ssn, n_iban, n_card.

    Findings that are not valid stay as they are and are not counted. Null texts become empty; empty tables give empty
    results; texts are read whole, however long. Rows are treated one by one, repeated ones alike; a null doc_id is kept;
    other columns are ignored, whatever their names. Keep key secret and fixed.
    """
    docs = as_text(documents.select("doc_id", "text"))
    t = F.col("text")
    hit = (t.contains("@") | t.rlike("[0-9]")) & t.rlike(ANY)
    docs = docs.withColumn("m", F.when(hit, F.regexp_extract_all(t, F.lit(f"({ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>")))
    docs = docs.withColumn("g", F.when(F.size("m") > 0, F.split(t, ANY, -1)))
    docs = docs.withColumn("p", F.expr(f"transform(m, m -> {expression(key)})"))
    joined = F.array_join(F.zip_with("g", "p", lambda g, p: F.concat(g, F.coalesce(p["value"], F.lit("")))), "")
    counts = [F.size(F.expr(f"filter(p, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return docs.select("doc_id", F.when(F.size("m") > 0, joined).otherwise(t).alias("text"), *counts)
