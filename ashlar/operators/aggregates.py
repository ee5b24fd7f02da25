"""Aggregates with the dialect's names and rules for empty groups, and the column profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.functions.coerce import to_number


def std(x: Column) -> Column:
    """STD, STDDEV and STDDEV_POP: of the population."""
    return F.stddev_pop(x)


def variance(x: Column) -> Column:
    return F.var_pop(x)


def text_variance(x: Column) -> Column:
    """VARIANCE over strings read as numbers."""
    return F.var_pop(to_number(x))


def average(total: Column, n: Column, scale: int, increment: int = 4) -> Column:
    """AVG of exact numbers out of their sum and count: ``scale`` of the argument and four more digits; NULL for none."""
    return F.round(F.try_divide(total.cast("decimal(38,10)"), n.cast("decimal(20,0)")), scale + increment).cast(f"decimal(38,{scale + increment})")


def group_concat(x: Column, sep: str = ",", order: Column | None = None, distinct: bool = False, most: int = 1024) -> Column:
    """GROUP_CONCAT: NULLs left out, NULL for none, cut at ``most`` characters (the dialect's own limit on this function's result)."""
    x = x.cast("string")
    if order is None:
        items = F.array_sort(F.collect_set(x) if distinct else F.collect_list(x))
    else:
        pairs = F.array_sort((F.collect_set if distinct else F.collect_list)(F.when(x.isNotNull(), F.struct(order.alias("o"), x.alias("x")))))
        items = F.transform(pairs, lambda p: p["x"])
    joined = F.left(F.array_join(items, sep), F.lit(most))
    return F.when(F.size(items) > 0, joined)


def profile(df: DataFrame) -> DataFrame:
    """One row for each column: least and greatest value, their lengths, empties or zeros, nulls, mean, deviation; one pass."""
    aggs = []
    for i, (name, kind) in enumerate(df.dtypes):
        c = F.col(f"`{name}`")
        text = c.cast("string")
        numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
        number = c.cast("double") if numeric else F.lit(None).cast("double")
        blank = (number == 0) if numeric else (F.octet_length(text) == 0)
        aggs.append(
            F.struct(
                F.lit(name).alias("field_name"), F.min(c).cast("string").alias("min_value"), F.max(c).cast("string").alias("max_value"),
                F.min(F.octet_length(text)).alias("min_length"), F.max(F.octet_length(text)).alias("max_length"),
                F.count_if(F.coalesce(blank, F.lit(False))).alias("empties_or_zeros"), F.count_if(c.isNull()).alias("nulls"),
                F.avg(number).alias("avg_value"), F.stddev_pop(number).alias("std"),
            ).alias(f"c{i}")
        )
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(aggs))])).alias("p")).select("p.*")
