"""Vector arithmetic on array columns, as columns of built-in functions. Sums run in double precision, in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_EPSILON = 1e-12
NAN = float("nan")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def compensated_sum(values: Column) -> Column:
    """A sum with Neumaier's correction term."""

    def step(acc: Column, x: Column) -> Column:
        t = acc["s"] + x
        lost = F.when(F.abs(acc["s"]) >= F.abs(x), (acc["s"] - t) + x).otherwise((x - t) + acc["s"])
        return F.struct(t.alias("s"), (acc["c"] + lost).alias("c"))

    return F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), step, lambda acc: acc["s"] + acc["c"])


def compensated_dot(a: Column, b: Column) -> Column:
    return compensated_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def axpy(y: Column, alpha: float, x: Column) -> Column:
    """y + alpha * x."""
    return F.zip_with(y, x, lambda p, q: p + F.lit(alpha) * q)


def axpy_float(y: Column, alpha: float, x: Column) -> Column:
    """y + alpha * x in single precision, element by element."""
    return F.zip_with(y, x, lambda p, q: p.cast("float") + F.lit(alpha).cast("float") * q.cast("float"))


def sum_squares(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(sum_squares(a))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def normalized(a: Column, n: Column, least: float = NORM_EPSILON) -> Column:
    """a / n, or null if the norm n is not finite or below `least`. n is a column of its own, so that it is computed once."""
    return F.when(F.isnan(n) | (n == float("inf")) | (n < least), None).otherwise(F.transform(a, lambda x: x / n))


def checked_unit(a: Column, n: Column, least: float = NORM_EPSILON) -> Column:
    """a / n, or an error for an entry that isn't finite (NonFinite) and a norm n below `least` (DegenerateInput)."""
    fault = F.when(F.isnan(n) | (n == float("inf")), "NonFinite").when(n < least, "DegenerateInput")
    return F.when(fault.isNotNull(), F.raise_error(fault).cast("array<double>")).otherwise(F.transform(a, lambda x: x / n))


def clamped_unit(a: Column, n: Column, least: float = NORM_EPSILON) -> Column:
    """a times the reciprocal of its norm, taken as `least` or more."""
    return F.transform(a, lambda x: x * (1 / F.greatest(n, F.lit(least))))


def cosine_distance(a: Column, b: Column, near_unit: float = 1e-3) -> Column:
    """1 - cosine, clamped; infinite if a vector is zero. Vectors that are near unit length are not divided by their norms."""
    aa, bb, ab = sum_squares(a), sum_squares(b), dot(a, b)
    unit = (F.abs(aa - 1) <= near_unit) & (F.abs(bb - 1) <= near_unit)
    cosine = F.when(unit, ab).otherwise(F.try_divide(ab, F.sqrt(aa) * F.sqrt(bb)))
    return F.when((aa == 0) | (bb == 0), float("inf")).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def cosine_distance_with_norms(ab: Column, na: Column, nb: Column) -> Column:
    """From a dot product and two sums of squares; NaN if one is zero."""
    bottom = F.sqrt(na) * F.sqrt(nb)
    return F.when(bottom == 0, F.lit(NAN)).otherwise(1 - F.try_divide(ab, bottom))


def logsumexp(a: Column) -> Column:
    """ln of the sum of exponentials, shifted by the largest; -inf if all are."""
    top = F.array_max(a)
    low = F.lit(float("-inf"))
    return F.when(top == low, low).otherwise(top + F.ln(_sum(F.transform(a, lambda x: F.exp(x - top)))))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / _sum(F.transform(a, lambda y: F.exp(y - top))))
