"""LIMIT offset, count; FOUND_ROWS; top rows of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def limit(df: DataFrame, count: int, offset: int = 0) -> DataFrame:
    return df.offset(offset).limit(count) if offset else df.limit(count)


def found_rows(df: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """SQL_CALC_FOUND_ROWS: the limited rows, and one row with the number there would have been."""
    return df.limit(count), df.agg(F.count("*").alias("found_rows"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; ``row_number() <= k`` lets Spark keep only k rows a group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")
