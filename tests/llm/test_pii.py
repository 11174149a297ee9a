"""Pseudonyms against an independent version in Python, permutations over whole domains, and hostile texts."""

import datetime
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pairforge.llm import pii

KEY = "it's a \\ key"


def drawn(kind, i, half, bits=256):
    return getattr(hashlib, f"sha{bits}")(f"{KEY}|{kind}|{i}|{half}".encode()).hexdigest()


def feistel(kind, a, b, size_a, size_b):
    for i in range(10):
        if i % 2 == 0:
            a = (a + int(drawn(kind, i, b)[:15], 16)) % size_a
        else:
            b = (b + int(drawn(kind, i, a)[:15], 16)) % size_b
    return a, b


def digits(kind, d):
    n = len(d) // 2
    a, b = feistel(kind, int(d[:n]), int(d[n:]), 10**n, 10 ** (len(d) - n))
    return f"{a:0{n}}{b:0{len(d) - n}}"


def letters(kind, s):
    def moved(half, h):
        out = ""
        for j, c in enumerate(half):
            x = int(h[4 * j : 4 * j + 4], 16)
            for lo, n in (("0", 10), ("a", 26), ("A", 26)):
                if ord(lo) <= ord(c) < ord(lo) + n:
                    c = chr(ord(lo) + (ord(c) - ord(lo) + x) % n)
                    break
            out += c
        return out

    a, b = s[: len(s) // 2], s[len(s) // 2 :]
    for i in range(10):
        a, b = (moved(a, drawn(kind, i, b, 512)), b) if i % 2 == 0 else (a, moved(b, drawn(kind, i, a, 512)))
    return a + b


def refill(shape, new, sign=str.isdigit):
    it = iter(new)
    return "".join(next(it) if sign(c) else c for c in shape)


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(d)))


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def date(m):
    iso, month = m[4] == "-", m[2] == "/" and m[3:5] > "12" and m[:2] <= "12"
    y, mo, d = (m[:4], m[5:7], m[8:]) if iso else (m[6:], m[:2], m[3:5]) if month else (m[6:], m[3:5], m[:2])
    try:
        v = datetime.date(int(y), int(mo), int(d))
    except ValueError:
        return None
    if not 1700 <= v.year < 2100:
        return None
    late = [(x.month, x.day) for k in range(365) if (x := datetime.date(2001, 1, 1) + datetime.timedelta(k)).day > 12]
    leap = [x for x in range(1700, 2100) if x % 4 == 0 and x % 100 or x % 400 == 0]
    if v.day <= 12:
        a, b = feistel("date|early", v.year - 1700, (v.month - 1) * 12 + v.day - 1, 400, 144)
        v = datetime.date(a + 1700, b // 12 + 1, b % 12 + 1)
    elif (v.month, v.day) == (2, 29):
        v = datetime.date(leap[feistel("date|leap", leap.index(v.year), 0, 97, 1)[0]], 2, 29)
    else:
        a, b = feistel("date|late", v.year - 1700, late.index((v.month, v.day)), 400, 221)
        v = datetime.date(a + 1700, *late[b])
    return v.isoformat() if iso else v.strftime(f"%m{m[2]}%d{m[5]}%Y" if month else f"%d{m[2]}%m{m[5]}%Y")


def phone(m):
    d = re.sub("[^0-9]", "", m)
    if not 8 <= len(d) <= 15:
        return None
    k = len(d) - 10 if m[0] != "+" else 1 if d[0] in "17" else 2 if d[:2] in pii.CODES_2 else 3
    n = d[k:]
    if len(n) == 10 and (m[0] != "+" or d[0] == "1"):
        area, line = int(n[:3]), int(n[3:])
        lo, size = (0, 10**7) if area < 200 else (0, 2 * 10**6) if line < 2 * 10**6 else (2 * 10**6, 8 * 10**6)
        lo_a = 0 if area < 200 else 200
        a, b = feistel("phone|1", area - lo_a, line - lo, 200 if area < 200 else 800, size)
        new = f"{a + lo_a:03}{b + lo:07}"
    else:
        new = digits(f"phone|{d[:k]}", n)
    return refill(m, d[:k] + new)


def pseudonym(m):
    """(kind, value); no kind for a finding that is not valid."""
    d = re.sub("[^0-9]", "", m)
    if m.endswith("@"):
        e = letters("email", m[:-1].lower())
        return "email", "".join(x.upper() if c.isupper() else x for c, x in zip(m[:-1], e, strict=True)) + "@"
    if m[0].isalpha():
        w = m.replace(" ", "")
        if not 15 <= len(w) <= 34 or mod97(w[4:] + w[:4]) != 1:
            return None, m
        e = letters("iban", w[4:])
        return "iban", refill(m, f"{w[:2]}{98 - mod97(e + w[:2] + '00'):02}{e}", lambda c: c != " ")
    if re.fullmatch(r"\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4}", m):
        v = date(m)
        return ("date", v) if v else (None, m)
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return None, m
        a, b = feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return "ip", f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if m[0] == "+" or re.fullmatch(r"(1[ .-])?(\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}", m):
        v = phone(m)
        return ("phone", v) if v else (None, m)
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        area, group, serial = int(m[:3]), int(m[4:6]), int(m[7:])
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return None, m
        a, b = feistel("ssn", area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 989901)
        return "ssn", f"{a + (2 if a > 664 else 1):03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"
    if (10 - luhn(d[:-1]) % 10) % 10 != int(d[-1]) or not d.strip("0"):
        return None, m
    e = digits("card", d[:-1])
    return "card", refill(m, e + str((10 - luhn(e) % 10) % 10))


def brute(text):
    # Java's possessive quantifiers and look-behinds are those of Python's re.
    pattern, counts = re.compile(pii.ANY, re.A), dict.fromkeys(pii.KINDS, 0)

    def put(found):
        kind, value = pseudonym(found[0])
        if kind:
            counts[kind] += 1
        return value

    return (pattern.sub(put, text or ""), *counts.values())


def iban(country, body):
    return f"{country}{98 - mod97(body + country + '00'):02}{body}"


def texts():
    rng = random.Random(3)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    out = [None, "", "no finding", "@", "a@b", "1.2.3", "12/31/1990 31/12/1990 31.12.1990 1990-12-31 05/06/2001 29/02/2000 02/29/2000 29.02.1900 13/13/2000 1699-12-31"]
    out += ["+15551234567, +1 555 123 4567; (555) 123-4567 555-123-4567 1-555-123-4567 555.123.4567 +1 (555) 123-4567 155-123-4567", "+49 30 1234567 +4930 1234567 +447911123456 +380 44 123 4567 +7 495 123 45 67 +1 123 456 7890 +1 200 111 2222"]
    out += ["Joe.B7+x@Mail.example.com, joe.b7+x@other.org. x@y.z a@-b.com _@a.co é@b.com joe@example.com. " + "l" * 64 + "@a.com " + "l" * 65 + "@a.com", "123-45-6789 666-12-3456 900-12-3456 123-00-6789 123-45-0000 665-01-0001 667-99-9999 899-99-9999"]
    out += [f"IBAN {iban('DE', n(18))} {iban('GB', 'WEST' + n(14))[:4]} DE89 3704 0044 0532 0130 00, GB29NWBK60161331926819 GB29 NWBK 6016 1331 9268 19 DE00370400440532013000"]
    for _ in range(60):
        c = n(rng.choice([12, 14, 15, 18]))
        card = c + str((10 - luhn(c) % 10) % 10)
        parts = [card, " ".join(card[k : k + 4] for k in range(0, 16, 4)), f"{n(3)}-{n(2)}-{n(4)}", f"+{n(2)} {n(3)} {n(4)} {n(3)}", f"({n(3)}) {n(3)}-{n(4)}", f"{n(2)}/{n(2)}/19{n(2)}", f"20{n(2)}-{n(2)}-{n(2)}", ".".join(str(rng.randrange(270)) for _ in range(4)), f"Ab{n(3)}.c@ex-ample.co.uk", iban("FR", n(11) + "Z" + n(11)), n(rng.randrange(1, 22))]
        rng.shuffle(parts)
        out.append(rng.choice([" ", ", ", "\n", " x "]).join(parts))
    return out


def test_equal_to_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: tuple(r)[1:] for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    for i, t in rows:
        assert got[i] == brute(t), t
    assert all(sum(g[1 + k] for g in got.values()) > 5 for k in range(len(pii.KINDS)))


def out_of(spark, texts_):
    return pii.pseudonymise(spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()


def test_ways_to_write_a_value_have_one_pseudonym(spark):
    phones = out_of(spark, ["+15551234567", "+1 555 123 4567", "(555) 123-4567", "555-123-4567", "1 555 123 4567", "+1 (555) 123-4567"])
    assert len({re.sub("[^0-9]", "", r.text)[-10:] for r in phones}) == 1 and all(r.n_phone == 1 for r in phones) and phones[0].text.startswith("+1") and phones[0].text != "+15551234567"
    dates = out_of(spark, ["12/31/1990", "31/12/1990", "31.12.1990", "1990-12-31"])
    y, m, d = dates[3].text.split("-")
    assert [r.text for r in dates] == [f"{m}/{d}/{y}", f"{d}/{m}/{y}", f"{d}.{m}.{y}", f"{y}-{m}-{d}"]
    assert out_of(spark, ["Joe@a.com"])[0].text.lower() == out_of(spark, ["joe@a.com"])[0].text
    assert out_of(spark, ["GB29NWBK60161331926819"])[0].text == out_of(spark, ["GB29 NWBK 6016 1331 9268 19"])[0].text.replace(" ", "")


@pytest.mark.parametrize(("value", "n", "kind", "valid"), [
    ("date_format(date_add(date'1700-01-01', cast(id as int)), 'yyyy-MM-dd')", 146097, "date", r"\d{4}-\d\d-\d\d"),
    ("concat('+1', 2000000000 + id * 7919)", 40000, "phone", r"\+1[2-9]\d{9}"),
    ("concat('(', 200 + id % 800, ') ', 200 + id div 800, '-0000')", 40000, "phone", r"\([2-9]\d\d\) [2-9]\d\d-\d{4}"),
    ("concat(lpad(id % 665 + 1, 3, '0'), '-', lpad(id div 665 % 99 + 1, 2, '0'), '-', lpad(id % 9999 + 1, 4, '0'))", 30000, "ssn", r"\d{3}-\d\d-\d{4}"),
    ("concat(chr(97 + id % 26), chr(97 + id div 26 % 26), id div 676, '@a.com')", 6760, "email", r"[a-z]{2}\d@a\.com"),
    ("concat_ws('.', 10, id div 256 div 256, id div 256 % 256, id % 256)", 40000, "ip", r"[\d.]+"),
])
def test_pseudonyms_are_permutations(spark, value, n, kind, valid):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.expr(f"cast({value} as string)").alias("text")).distinct()
    out = pii.pseudonymise(docs, KEY)
    head = out.agg(F.count_distinct("text"), F.sum(f"n_{kind}"), F.count_if(F.col("text").rlike(f"^(?:{valid})$")), F.count(F.lit(1))).head()
    assert len(set(head)) == 1 and head[3] <= n
    if kind == "date":  # the whole domain maps to itself
        assert out.select("text").exceptAll(docs.select("text")).count() == 0 and head[3] == n


@pytest.mark.parametrize("unit", ["a.", "1.", "@", "x@", "+1", "+1 ", "12-", "(555) ", "AB12", " 1234", "a@a.", "-", "1", "a@" + "a." * 300])
def test_long_texts(spark, unit):
    row = pii.pseudonymise(spark.createDataFrame([(1, "x@" + unit * (1_000_000 // len(unit)) + "com"), (2, "joe@a.com")], "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    assert len(row[0].text) > 900_000 and not row[1].text.startswith("joe@")
