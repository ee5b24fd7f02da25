"""Geometry as text (WKT) and predicates on bounding rectangles, as expressions on four numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def point_text(p: Column) -> Column:
    short = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.concat(F.lit("POINT("), short(p["x"]), F.lit(" "), short(p["y"]), F.lit(")"))


def rectangle(wkt: Column) -> Column:
    """The bounding rectangle (x1, y1, x2, y2) of a geometry's text; NULL if it has no pair of numbers."""
    numbers = F.transform(F.regexp_extract_all(wkt, F.lit(_NUMBER), F.lit(0)), lambda v: v.cast("double"))
    xs, ys = F.filter(numbers, lambda v, i: i % 2 == 0), F.filter(numbers, lambda v, i: i % 2 == 1)
    box = F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))
    return F.when(F.size(numbers) >= 2, box)


def contains(a: Column, b: Column) -> Column:
    return (a["x1"] <= b["x1"]) & (a["y1"] <= b["y1"]) & (a["x2"] >= b["x2"]) & (a["y2"] >= b["y2"])


def within(a: Column, b: Column) -> Column:
    return contains(b, a)


def intersects(a: Column, b: Column) -> Column:
    return (a["x1"] <= b["x2"]) & (b["x1"] <= a["x2"]) & (a["y1"] <= b["y2"]) & (b["y1"] <= a["y2"])


def disjoint(a: Column, b: Column) -> Column:
    return ~intersects(a, b)


def equal(a: Column, b: Column) -> Column:
    return contains(a, b) & contains(b, a)
