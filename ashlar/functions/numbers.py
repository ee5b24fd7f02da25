"""Numeric functions: NULL outside a function's domain and for any NULL argument."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _real(x: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def acos(x: Column) -> Column:
    return _real(F.acos(x))


def asin(x: Column) -> Column:
    return _real(F.asin(x))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log(base: float, x: Column) -> Column:
    return F.when((x > 0) & (F.lit(base) > 0) & (F.lit(base) != 1), F.ln(x) / F.ln(F.lit(float(base))))


def log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def cot(x: Column) -> Column:
    return F.when(F.tan(x) != 0, 1 / F.tan(x))


def power(x: Column, y: Column) -> Column:
    return _real(F.pow(x, y))


def truncate(x: Column, digits: int) -> Column:
    """Toward zero at that many digits (negative: before the point)."""
    exact = x.cast("decimal(30,8)")
    if digits >= 0:
        return (F.signum(exact) * F.floor(F.abs(exact) * F.lit(10**digits).cast("decimal(20,0)")).cast("decimal(30,0)") / 10**digits).cast(f"decimal(30,{min(digits, 8)})")
    return (F.signum(exact) * F.floor(F.abs(exact) / F.lit(10**-digits).cast("decimal(20,0)")).cast("decimal(30,0)") * 10**-digits).cast("decimal(30,0)")


def round_(x: Column, digits: int = 0) -> Column:
    """Half away from zero."""
    return F.round(x, digits)


def _with_null(fn, *xs: Column) -> Column:
    return F.when(reduce(lambda a, b: a | b, [x.isNull() for x in xs]), None).otherwise(fn(*xs))


def greatest(*xs: Column) -> Column:
    return _with_null(F.greatest, *xs)


def least(*xs: Column) -> Column:
    return _with_null(F.least, *xs)


def interval(n: Column, *bounds: Column) -> Column:
    """How many of the ascending bounds n reaches; -1 for NULL."""
    return F.when(n.isNull(), F.lit(-1)).otherwise(sum((F.when(b <= n, 1).otherwise(0) for b in bounds), F.lit(0)))


def conv(x: Column, a: int, b: int) -> Column:
    return F.conv(x.cast("string"), a, b)
