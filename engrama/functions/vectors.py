"""Vector expressions on arrays, in double arithmetic and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest positive normal 32-bit float: the floor of a quantisation step.
LEAST_STEP = 1.1754943508222875e-38


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return _total(F.zip_with(F.slice(as_doubles(a), F.lit(1), n), F.slice(as_doubles(b), F.lit(1), n), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(as_doubles(v), lambda x: x * x)))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(as_doubles(v), lambda x: x / n)).otherwise(as_doubles(v))


def distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b)


def sq8_encode(v: Column) -> Column:
    """struct(min, delta, codes): 8-bit scalar quantisation over the vector's own range."""
    low, high = F.array_min(as_doubles(v)), F.array_max(as_doubles(v))
    delta = F.greatest((high - low) / 255.0, F.lit(LEAST_STEP))
    codes = F.transform(as_doubles(v), lambda x: F.least(F.greatest(F.round((x - low) / delta), F.lit(0.0)), F.lit(255.0)).cast("int"))
    return F.struct(low.alias("min"), delta.alias("delta"), codes.alias("codes"))


def sq8_decode(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: q["min"] + q["delta"] * c)


def sq8_dot(query: Column, q: Column) -> Column:
    """Inner product of a plain and a quantised vector."""
    return q["min"] * _total(as_doubles(query)) + q["delta"] * _total(F.zip_with(as_doubles(query), q["codes"], lambda x, c: x * c))


def sq8_dot_between(a: Column, b: Column) -> Column:
    """Inner product of two quantised vectors; sums over codes are exact integers."""
    count = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x)
    cross = count(F.zip_with(a["codes"], b["codes"], lambda x, y: (x * y).cast("long")))
    n = F.least(F.size(a["codes"]), F.size(b["codes"]))
    return a["min"] * b["min"] * n + a["min"] * b["delta"] * count(b["codes"]) + a["delta"] * b["min"] * count(a["codes"]) + a["delta"] * b["delta"] * cross
