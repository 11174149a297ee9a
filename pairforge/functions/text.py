"""Column functions on text: identity keys, normalisation, tokens and n-grams.

All of them are symmetric building blocks of pair features and run in the JVM, but for NFKC, which Spark lacks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from pairforge.session import bucketed, scratch, written

#: Word characters as the tokeniser counts them: letters, numbers and the low line.
WORD = r"[\p{L}\p{N}_]"
WORD_TOKEN = rf"\p{{Nd}}+(?:[.,]\p{{Nd}}+)*|{WORD}+(?:'{WORD}+)?"
TOKEN = rf"{WORD_TOKEN}|[^\p{{L}}\p{{N}}_\s]"

# Negations and question words are content although they are stop words.
KEEP = "not no nor never without what how why when where which who whom whose can should will would could is are do does".split()
# The words that start a question.
WH_WORDS = """what how why when where which who whom whose is are can should do does will would could""".split()
# Words that negate a question.
NEGATIONS = "not no never without nor none nobody nothing neither cannot".split()
# Words that mark a negation difference between two texts.
TAG_NEGATIONS = "not no never without nor non".split()
#: Stop words: a list of our own, in place of one that comes with another library.
STOP_WORDS = sorted(
    set(
        """a about above across after again against all almost alone along already also although always am among an and another any anyone anything
        are around as at back be became because been before being below between both but by can cannot could did do does done down during each either
        else enough etc even ever every everyone everything few for from further get give go had has have he hence her here hers herself him himself
        his how however i if in indeed into is it its itself keep last least less made many may me might mine more most much must my myself neither
        never next no nobody none nor not nothing now nowhere of off often on once one only onto or other others our ours ourselves out over own per
        perhaps please put rather re same see seem several she should since so some someone something still such than that the their theirs them
        themselves then there therefore these they this those though through thus to together too toward under until up upon us very via was we well
        were what when where whether which while who whom whose why will with within without would yet you your yours yourself yourselves""".split()
    )
    - set(KEEP)
)


def _stable() -> str:
    """A class of characters that NFKC leaves alone in any order: below the combining marks and in the general punctuation."""
    kept = [c for lo, hi in ((0, 0x300), (0x2010, 0x2028)) for c in range(lo, hi) if unicodedata.normalize("NFKC", chr(c)) == chr(c)]
    ends = [c for c in kept if c + 1 not in set(kept)]
    starts = [c for c in kept if c - 1 not in set(kept)]
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True))


#: The look-ahead passes over ASCII, which is stable, at the cost of one range: the class has hundreds.
MAY_CHANGE = rf"(?=[^\x00-\x7F])[^{_stable()}]"


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t))


def nfkc(t: Column) -> Column:
    """Unicode compatibility composition. Only texts with a character that it may change are sent to Python."""
    return F.coalesce(_composed(F.when((F.octet_length(t) != F.length(t)) & t.rlike(MAY_CHANGE), t)), t)


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def text_key(c: Column) -> Column:
    """128 bits that stand for a text; null is a text of its own."""
    return F.coalesce(F.md5(c), F.lit("null"))


def distinct_texts(pairs: DataFrame) -> DataFrame:
    """_key, _text: each text of pairs with _k1 and _k2 once."""
    sides = pairs.select(F.explode(F.array(*[F.struct(F.col(f"_k{i}").alias("_key"), F.col(f"question{i}").alias("_text")) for i in (1, 2)])).alias("s")).select("s.*")
    return sides.groupBy("_key").agg(F.first("_text").alias("_text"))


def with_both(pairs: DataFrame, known: DataFrame, value: str, names: tuple[str, str], then: Callable[[DataFrame], DataFrame] = lambda rows: rows, slices: int = 1) -> DataFrame:
    """Adds value of known (_key, value) for the texts _k1 and _k2 of pairs, and what then makes of such rows.

    known is written, as a plan of two joins would make it twice, in buckets of its key: so neither join moves it, and of a
    pair only what is known of its first text moves, not the text. With slices, as many parts of the pairs, cut by the
    second key, go through one after the other and are written, so what moves lies on disk for one part at a time.
    """
    spark = known.sparkSession
    known = bucketed(known.select("_key", value), "_key", scratch(spark))

    def joined(rows: DataFrame) -> DataFrame:
        for i, name in enumerate(names, 1):
            rows = rows.join(known.select(F.col("_key").alias(f"_k{i}"), F.col(value).alias(name)), f"_k{i}")
        return then(rows)

    if slices == 1:
        return joined(pairs)
    part = F.pmod(F.xxhash64("_k2"), F.lit(slices))
    return reduce(DataFrame.unionByName, [written(joined(pairs.where(part == i)), scratch(spark)) for i in range(slices)])


def keyed_texts(pairs: DataFrame, texts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """pairs with _k1 and _k2, and each text once: as given with texts (_key, _text), else of pairs (question1, question2)."""
    if texts is not None:
        return pairs, texts
    out = pairs.withColumns({f"_k{i}": text_key(F.col(f"question{i}")) for i in (1, 2)})
    return out, distinct_texts(out)


def squeezed(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s&&[^ ]]\s*| \s+", " "))


def identity_key(c: Column) -> Column:
    """Texts with one key are the same question: case and white space do not count, punctuation does."""
    return squeezed(F.lower(text_of(c)))


def loose_key(c: Column) -> Column:
    """Small ASCII letters and digits only, for measuring leakage."""
    return F.trim(F.regexp_replace(F.lower(text_of(c)), "[^0-9a-z]+", " "))


def cleaned(c: Column) -> Column:
    """White space squeezed, case kept."""
    return squeezed(text_of(c))


def undotted(c: Column) -> Column:
    """Dotted acronyms lose their dots. The pattern begins with the dot, so most places fail at once."""
    return F.regexp_replace(text_of(c), r"\.(?:(?<=\b[A-Za-z]\.)(?=[A-Za-z]\.)|(?<=\.[A-Za-z]\.))", "")


def normalize(c: Column, compose: bool = True) -> Column:
    """NFKC, straight quotes, small letters, explicit negation, single blanks. Null: empty. compose: whether to apply NFKC."""
    t = nfkc(text_of(c)) if compose else text_of(c)
    t = F.lower(F.when((F.octet_length(t) != F.length(t)) & t.rlike("[‘-”′]"), F.translate(t, "‘’“”′", "''\"\"'")).otherwise(t))
    # Each pattern begins with its letters and looks back for the start of the word: so most places fail at once. Texts without what they need pass them over.
    patterns = ((r"\[/?math\]", " "), (r"can(?:'t|not)\b(?<=\bcan't|\bcannot)", "can not"), (r"won't\b(?<=\bwon't)", "will not"), (r"shan't\b(?<=\bshan't)", "shall not"), (r"n't\b(?<=\wn't)", " not"))
    replaced = lambda t: reduce(lambda made, p: F.regexp_replace(made, f"(?U){p[0]}", p[1]), patterns, t)
    needed = lambda t: F.contains(t, F.lit("n't")) | F.contains(t, F.lit("cannot")) | F.contains(t, F.lit("math]"))
    return squeezed(let(t, lambda t: F.when(needed(t), replaced(t)).otherwise(t)))


def tokenize(norm: Column, punctuation: bool = False) -> Column:
    """Tokens of normalised text: numbers with inner points and commas, words with one inner apostrophe, single signs."""
    return F.regexp_extract_all(norm, F.lit(f"({TOKEN if punctuation else WORD_TOKEN})"), F.lit(1))


def words_of(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it, also within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def char_ngrams(norm: Column, n: int = 3) -> Column:
    """The set of character n-grams of a text with a blank at both ends.

    A look-ahead finds them all in one pass. It counts UTF-16 units, so texts with characters beyond these are cut by code points.
    """

    def made(chars: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(chars) - n)
        return F.when(F.size(chars) < n, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)])))

    ended = F.concat(F.lit(" "), norm, F.lit(" "))
    by_units = F.regexp_extract_all(ended, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return F.array_distinct(F.when(norm.rlike(r"[\x{10000}-\x{10FFFF}]"), let(F.split(ended, ""), made)).otherwise(by_units))


@F.pandas_udf(ArrayType(LongType()))
def trigram_codes(norms: pd.Series) -> pd.Series:
    """The set of char_ngrams of normalised texts, each as its three code points of 21 bits, sorted: smaller than strings or hashes once compressed."""

    def codes(norm: str) -> np.ndarray:
        c = np.frombuffer(f" {norm} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])

    return norms.map(codes)


def word_ngrams(tokens: Column) -> Column:
    """Words and pairs of adjacent words."""
    return let(tokens, lambda ts: F.concat(ts, F.transform(F.slice(ts, 2, F.greatest(F.size(ts) - 1, F.lit(0))), lambda t, i: F.concat(F.get(ts, i), F.lit(" "), t))))


def jaccard(a: Column, b: Column, sets: bool = False) -> Column:
    """Shared share of two sets; 0 if both are empty. sets: neither array repeats a value."""
    both = F.size(F.array_intersect(a, b))
    n = F.size(a) + F.size(b) if sets else F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.coalesce(F.try_divide(both.cast("double"), (n - both).cast("double")), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 if b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
