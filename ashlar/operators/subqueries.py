"""Quantified comparisons with a subquery, rewritten to aggregates of the subquery's one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _bounds(sub: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return sub.agg(F.min(c).alias("__lo"), F.max(c).alias("__hi"), F.count("*").alias("__n"), F.count(c).alias("__known"))


def _three_valued(certain: Column, nulls: Column, when_nulls: Column) -> Column:
    return F.when(nulls, when_nulls).otherwise(certain)


def _is_in(df: DataFrame, column: str, sub: DataFrame, sub_column: str, name: str) -> DataFrame:
    """``= ANY``, by a join with the subquery's distinct values, and what its NULLs leave open."""
    values = sub.select(F.col(sub_column).alias("__v")).where("__v IS NOT NULL").distinct().withColumn("__hit", F.lit(True))
    joined = df.join(values, F.col(column) == F.col("__v"), "left").crossJoin(F.broadcast(_bounds(sub, sub_column)))  # one row
    unknown = (F.col("__n") > 0) & (F.col(column).isNull() | (F.col("__known") < F.col("__n")))
    value = F.when(F.col("__hit"), F.lit(True)).when(unknown, F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return joined.withColumn(name, value).drop("__v", "__hit", "__lo", "__hi", "__n", "__known")


def compare_any(df: DataFrame, column: str, op: str, sub: DataFrame, sub_column: str, name: str = "matches") -> DataFrame:
    """``column op ANY (subquery)``: false over no rows, unknown where only a NULL could decide.

    For an order comparison only the least or greatest value matters; ``= ANY`` joins the distinct values and
    ``<> ANY`` needs both ends.
    """
    b = F.broadcast(_bounds(sub, sub_column))  # one row
    x = F.col(column)
    joined = df.crossJoin(b)
    if op in _OPS:
        best = F.col("__hi") if op in ("<", "<=") else F.col("__lo")
        hit = F.coalesce(_OPS[op](x, best), F.lit(False))
    elif op == "<>":
        hit = F.coalesce((x != F.col("__lo")) | (x != F.col("__hi")), F.lit(False))
    elif op == "=":
        return _is_in(df, column, sub, sub_column, name)
    else:
        raise ValueError(op)
    unknown = (F.col("__n") > 0) & (x.isNull() | (F.col("__known") < F.col("__n")))
    value = F.when(F.col("__n") == 0, F.lit(False)).when(hit, F.lit(True)).when(unknown, F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return joined.withColumn(name, value).drop("__lo", "__hi", "__n", "__known")


def compare_all(df: DataFrame, column: str, op: str, sub: DataFrame, sub_column: str, name: str = "matches") -> DataFrame:
    """``column op ALL (subquery)``: true over no rows."""
    b = F.broadcast(_bounds(sub, sub_column))  # one row
    x = F.col(column)
    joined = df.crossJoin(b)
    if op in _OPS:
        worst = F.col("__lo") if op in ("<", "<=") else F.col("__hi")
        miss = F.coalesce(~_OPS[op](x, worst), F.lit(False))
    elif op == "=":
        miss = F.coalesce((x != F.col("__lo")) | (x != F.col("__hi")), F.lit(False))
    elif op == "<>":
        return _is_in(df, column, sub, sub_column, name).withColumn(name, ~F.col(name))
    else:
        raise ValueError(op)
    unknown = (F.col("__n") > 0) & (x.isNull() | (F.col("__known") < F.col("__n")))
    value = F.when(F.col("__n") == 0, F.lit(True)).when(miss, F.lit(False)).when(unknown, F.lit(None).cast("boolean")).otherwise(F.lit(True))
    return joined.withColumn(name, value).drop("__lo", "__hi", "__n", "__known")
