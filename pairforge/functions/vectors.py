"""Vector functions on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairforge.functions.text import let


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, e: s + e)


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a over its length; the zero vector stays."""
    return let(norm(a), lambda n: F.transform(doubles(a), lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def midpoint(a: Column, b: Column) -> Column:
    """The unit vector between two directions."""
    return unit(F.zip_with(unit(a), unit(b), lambda x, y: x + y))


def pair_vector(a: Column, b: Column) -> Column:
    """Absolute differences, products and the dot product: 2d + 1 numbers, the same for (b, a)."""
    return F.concat(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)), F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.array(dot(a, b)))


def logit(p: Column) -> Column:
    """Log odds of a chance clipped to [1e-6, 1 - 1e-6]."""
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def base_logit(p: Column) -> Column:
    """logit of a chance in single precision, as scores are stored."""
    return logit(p.cast("float").cast("double"))


def canonical(x: Column) -> Column:
    """Six decimals, half to even."""
    return F.bround(x, 6)


def half(x: Column) -> Column:
    """A number at half precision (11 bits, half to even), as vectors are stored; beyond 65,504 it is infinite."""
    a = F.abs(x.cast("double"))
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(a)), F.lit(-14)) - 10)
    r = F.bround(a / step, 0) * step
    r = F.when(a == 0, 0.0).when(r > 65504.0, float("inf")).otherwise(r)
    return F.when(x.isNotNull(), r * F.signum(x))


def halves(x: Column) -> Column:
    return F.transform(doubles(x), half)
