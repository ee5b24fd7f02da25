"""Joins that Spark has no operator for: inequality joins without a nested loop, and laxer names for the rest."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


MOST_BUCKETS = 64


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """Rows of ``left`` with rows of ``right`` where ``low <= point <= high``, by buckets of ``width``.

    Each range goes to every bucket that it touches, each point to its own, so that the join has an
    equality to shuffle on; Spark's own plan would be a nested loop over both sides.  Ranges that
    touch more than ``MOST_BUCKETS`` go to wider buckets, ``MOST_BUCKETS`` times as wide a level, so that no range
    is copied more often than that.  ``how`` is inner or left.  NULLs in any of the three never match.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    bucket = lambda c, level: F.floor(c / (F.lit(float(width)) * F.pow(F.lit(float(MOST_BUCKETS)), level))).cast("long")
    reach = (F.col(high) - F.col(low)).cast("double") / F.lit(float(width))
    level = F.when(reach <= MOST_BUCKETS, F.lit(0)).otherwise(F.ceil(F.log(reach) / math.log(MOST_BUCKETS)) - 1).cast("int")
    ranges = right.where(F.col(low) <= F.col(high)).withColumn("__level", level)
    deepest = ranges.agg(F.max("__level").alias("n")).first()["n"] or 0
    ranges = ranges.withColumn("__bucket", F.explode(F.sequence(bucket(F.col(low), F.col("__level")), bucket(F.col(high), F.col("__level")))))

    def met(points: DataFrame, levels: list[int], how: str) -> DataFrame:
        many = len(levels) > 1
        at = F.explode(F.array(*map(F.lit, levels))) if many else F.lit(levels[0])
        l = points.withColumn("__level", at).withColumn("__bucket", bucket(F.col(point), F.col("__level"))).alias("l")
        r = ranges.alias("r")
        on = (F.col("l.__level") == F.col("r.__level")) & (F.col("l.__bucket") == F.col("r.__bucket"))
        on = on & (F.col(f"l.{point}") >= F.col(f"r.{low}")) & (F.col(f"l.{point}") <= F.col(f"r.{high}"))
        return l.join(r, on, how).drop("__bucket", "__level")

    if how == "inner" or not deepest:
        return met(left, list(range(deepest + 1)), how)
    # rows without any range: those that no level's anti join takes away
    alone = left
    for i in range(deepest + 1):
        alone = met(alone, [i], "left_anti")
    empty = [F.lit(None).cast(t).alias(c) for c, t in right.dtypes]
    return met(left, list(range(deepest + 1)), "inner").union(alone.select("*", *empty))


def less_than_counts(left: DataFrame, right: DataFrame, a: str, b: str, name: str = "n") -> DataFrame:
    """Each distinct value of ``a`` in ``left`` with how many values ``b`` of ``right`` are less: a sort join that counts.

    Both columns are merged into one ordering and summed by ranges of it, so that neither side is
    copied to the other and no single task orders all values.
    """
    both = left.select(F.col(a).cast("double").alias("x")).where("x IS NOT NULL").distinct().select("x", F.lit(1).alias("side"), F.lit(0).cast("long").alias("w"))
    both = both.unionByName(right.select(F.col(b).cast("double").alias("x")).where("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("w")).select("x", F.lit(0).alias("side"), "w"))
    # bounds are fixed numbers, so that a value's range follows from the value alone, in every branch and attempt
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = left.select(F.col(a).cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    cuts = sorted(set(cuts))
    ranged = both.withColumn("part", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("x"))) if cuts else F.lit(0))
    sums = ranged.groupBy("part").agg(F.sum("w").alias("s"))  # a row for each range
    before = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = F.coalesce(F.sum("w").over(Window.partitionBy("part").orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    out = ranged.join(F.broadcast(before.select("part", "before")), "part").withColumn("upto", run + F.col("before"))
    same = F.sum("w").over(Window.partitionBy("part", "x"))
    return out.withColumn(name, F.col("upto") - same).where("side = 1").select(F.col("x").alias(a), name)


def anti_join_null(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    """LEFT JOIN .. WHERE right key IS NULL."""
    return left.join(right, on, "left_anti")


def null_safe_join(left: DataFrame, right: DataFrame, a: str, b: str, how: str = "inner") -> DataFrame:
    """Joins on ``<=>``."""
    l, r = left.alias("l"), right.alias("r")
    return l.join(r, F.col(f"l.{a}").eqNullSafe(F.col(f"r.{b}")), how)
