"""IEEE arithmetic on columns: no NULL and no error where floating point has NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def lit(x: float) -> Column:
    return F.lit(float(x))


def nan() -> Column:
    return F.lit(NAN)


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != lit(INF))


def or_nan(c: Column) -> Column:
    """NULL, which outer joins and empty aggregates make, is NaN in a grid."""
    return F.coalesce(c, nan())


def divide(a: Column, b: Column) -> Column:
    by_zero = F.when((a == 0) | F.isnan(a), nan()).otherwise(F.signum(a) * F.pow(b, lit(-1)))
    return F.when(b == 0, by_zero).otherwise(or_nan(F.try_divide(a, b)))


def log(a: Column, function=F.ln) -> Column:
    return F.when(F.isnan(a), nan()).when(a == 0, lit(-INF)).when(a < 0, nan()).otherwise(function(a))


def power(a: Column, b: Column) -> Column:
    return F.when(a == 1, lit(1)).otherwise(F.pow(a, b))


def compare(op: str, a: Column, b: Column) -> Column:
    """NaN is unequal to everything and on neither side of anything."""
    if op == "!=":
        return F.isnan(a) | F.isnan(b) | (a != b)
    known = ~F.isnan(a) & ~F.isnan(b)
    return known & {"=": a == b, "==": a == b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def total(c: Column, where: Column | None = None) -> Column:
    """Sum over the rows that count, 0 if none does."""
    return F.coalesce(F.sum(c if where is None else F.when(where, c)), lit(0))


def root_sum_squares(c: Column, where: Column | None = None) -> Column:
    return F.sqrt(total(c * c, where))


def worst_tag(tag: Column, where: Column | None = None) -> Column:
    """Aggregate of origin tags: extrapolated before interpolated before original."""
    counted = tag if where is None else F.when(where, tag)
    return F.when(F.min(counted) < 0, F.lit(-1)).when(F.max(counted) > 0, F.lit(1)).otherwise(F.lit(0)).cast("byte")


def worst_of(*tags: Column) -> Column:
    low, high = (F.least(*tags), F.greatest(*tags)) if len(tags) > 1 else (tags[0], tags[0])
    return F.when(low < 0, F.lit(-1)).when(high > 0, F.lit(1)).otherwise(F.lit(0)).cast("byte")
