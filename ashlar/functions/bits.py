"""Bit operators on unsigned 64-bit numbers; results are decimal(20,0) where they may pass 2^63."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WRAP = str(1 << 64)


def unsigned(value: Column) -> Column:
    """The 64 bits of a long read as an unsigned number."""
    wide = value.cast("decimal(20,0)")
    return F.when(wide < 0, wide + F.lit(_WRAP).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def bit_or(a: Column, b: Column) -> Column:
    return unsigned(a.cast("long").bitwiseOR(b.cast("long")))


def bit_and(a: Column, b: Column) -> Column:
    return unsigned(a.cast("long").bitwiseAND(b.cast("long")))


def bit_xor(a: Column, b: Column) -> Column:
    return unsigned(a.cast("long").bitwiseXOR(b.cast("long")))


def bit_not(a: Column) -> Column:
    return unsigned(F.bitwise_not(a.cast("long")))


def shift_left(a: Column, n: int) -> Column:
    return F.lit(0).cast("decimal(20,0)") if n >= 64 else unsigned(F.shiftleft(a.cast("long"), n))


def shift_right(a: Column, n: int) -> Column:
    return F.lit(0).cast("decimal(20,0)") if n >= 64 else unsigned(F.shiftrightunsigned(a.cast("long"), n))


def bit_count(a: Column) -> Column:
    return F.bit_count(a.cast("long"))


def agg_bit_and(a: Column) -> Column:
    """BIT_AND: all ones over no rows."""
    return unsigned(F.coalesce(F.bit_and(a.cast("long")), F.lit(-1).cast("long")))


def agg_bit_or(a: Column) -> Column:
    return unsigned(F.coalesce(F.bit_or(a.cast("long")), F.lit(0).cast("long")))


def agg_bit_xor(a: Column) -> Column:
    return unsigned(F.coalesce(F.bit_xor(a.cast("long")), F.lit(0).cast("long")))
