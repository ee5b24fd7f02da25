"""Implicit conversions: numeric prefixes of strings, clamping writes, exact division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least and greatest values of the integer types, signed and unsigned.
RANGES = {
    "tinyint": (-(1 << 7), (1 << 7) - 1), "smallint": (-(1 << 15), (1 << 15) - 1), "mediumint": (-(1 << 23), (1 << 23) - 1),
    "int": (-(1 << 31), (1 << 31) - 1), "bigint": (-(1 << 63), (1 << 63) - 1), "tinyint unsigned": (0, (1 << 8) - 1),
    "smallint unsigned": (0, (1 << 16) - 1), "mediumint unsigned": (0, (1 << 24) - 1), "int unsigned": (0, (1 << 32) - 1), "bigint unsigned": (0, (1 << 64) - 1),
}
STORED_AS = {
    "tinyint": "byte", "smallint": "short", "mediumint": "int", "int": "int", "bigint": "long", "tinyint unsigned": "short",
    "smallint unsigned": "int", "mediumint unsigned": "int", "int unsigned": "long", "bigint unsigned": "decimal(20,0)",
}
_NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def to_number(text: Column) -> Column:
    """The number at the start of a string; 0 if there is none, NULL for NULL."""
    found = F.regexp_extract(text.cast("string"), _NUMBER, 1)
    return F.when(text.isNotNull(), F.coalesce(found.try_cast("double"), F.lit(0.0)))


def to_integer(text: Column) -> Column:
    """The integer at the start of a string, as CAST(x AS SIGNED) has it."""
    found = F.regexp_extract(text.cast("string"), r"^\s*([+-]?[0-9]+)", 1)
    return F.when(text.isNotNull(), F.coalesce(found.try_cast("long"), F.lit(0).cast("long")))


def clamp(value: Column, kind: str) -> Column:
    """Rounds half away from zero and holds the value within the type's range, as a write outside strict mode does."""
    low, high = RANGES[kind]
    wide = F.round(value.cast("decimal(38,4)"), 0).cast("decimal(38,0)")
    return F.least(F.greatest(wide, F.lit(low).cast("decimal(38,0)")), F.lit(high).cast("decimal(38,0)")).cast(STORED_AS[kind])


def divide(a: Column, b: Column, scale: int = 0, increment: int = 4) -> Column:
    """``/`` on exact numbers: ``scale`` of the dividend plus four digits; NULL for a divisor of zero."""
    top, bottom = a.cast(f"decimal(30,{scale})"), F.nullif(b.cast("decimal(30,10)"), F.lit(0).cast("decimal(30,10)"))
    return F.round(F.try_divide(top.cast("decimal(38,10)"), bottom.cast("decimal(38,10)")), scale + increment).cast(f"decimal(38,{scale + increment})")


def int_divide(a: Column, b: Column) -> Column:
    """DIV: toward zero, NULL for a divisor of zero."""
    a, b = a.cast("long"), F.nullif(b.cast("long"), F.lit(0).cast("long"))
    return F.call_function("div", a, b)


def modulo(a: Column, b: Column) -> Column:
    """% with the dividend's sign, NULL for a divisor of zero."""
    return F.try_mod(a, b)


def truth(value: Column) -> Column:
    """A value as a condition: anything but zero is true."""
    return value != 0


def xor(a: Column, b: Column) -> Column:
    """Three-valued exclusive or of two conditions."""
    return a != b


def is_true(a: Column) -> Column:
    return F.coalesce(a, F.lit(False))


def is_unknown(a: Column) -> Column:
    return a.isNull()


def collated(text: Column) -> Column:
    """A string under the default collation: neither case nor trailing blanks count."""
    return F.collate(text, "UTF8_LCASE_RTRIM")


def binary(text: Column) -> Column:
    return F.collate(text, "UTF8_BINARY")


def year(text: Column) -> Column:
    """YEAR: four digits, or two that mean 1970 to 2069; 1901 to 2155 and 0, NULL for others."""
    n = F.regexp_extract(text.cast("string"), r"^\s*([0-9]{1,4})\s*$", 1).try_cast("int")
    full = F.when(F.length(F.trim(text.cast("string"))) <= 2, F.when(n < 70, n + 2000).otherwise(n + 1900)).otherwise(n)
    return F.when(full.between(1901, 2155) | (full == 0), full)


def decimal(text: Column, digits: int, scale: int) -> Column:
    """A decimal out of the number at the start of a string, rounded half away from zero and held within its digits."""
    found = F.regexp_extract(text.cast("string"), _NUMBER, 1).try_cast("decimal(38,10)")
    most = F.lit("9" * (digits - scale) + "." + "9" * scale).cast(f"decimal(38,{scale})")
    value = F.round(F.coalesce(found, F.lit(0).cast("decimal(38,10)")), scale).cast(f"decimal(38,{scale})")
    return F.when(text.isNotNull(), F.least(F.greatest(value, -most), most).cast(f"decimal({digits},{scale})"))
