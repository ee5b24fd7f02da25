"""UNION with the dialect's widening: a number beside a string makes a string."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(left: DataFrame, right: DataFrame, distinct: bool = True) -> DataFrame:
    if len(left.columns) != len(right.columns):
        raise ValueError("UNION needs as many columns on both sides")
    a, b = [], []
    for (ln, lt), (rn, rt) in zip(left.dtypes, right.dtypes, strict=True):
        mixed = (lt == "string") != (rt == "string")
        a.append(F.col(f"`{ln}`").cast("string").alias(ln) if mixed else F.col(f"`{ln}`"))
        b.append(F.col(f"`{rn}`").cast("string").alias(ln) if mixed else F.col(f"`{rn}`").alias(ln))
    both = left.select(*a).union(right.select(*b))
    return both.distinct() if distinct else both
