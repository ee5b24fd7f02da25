"""Answers from metadata alone: bounds out of Parquet footers, read by the executors, no data page touched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Footer values of these physical kinds compare as numbers.
_NUMBERS = ("byte", "tinyint", "short", "smallint", "int", "bigint", "long", "float", "double")


def metadata_aggregate(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """COUNT(*), and MIN, MAX and COUNT of each column, answered by the footers of Parquet files.

    Uses the v2 Parquet source with aggregate push-down, so that a scan reads footers only; the
    plan shows ``PushedAggregation``.  The source is chosen in a session of its own: the caller's stays as it is.
    """
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark = spark.newSession()
    spark.conf.set("spark.sql.session.timeZone", zone)
    spark.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    aggs = [F.count("*").alias("rows")]
    for c in columns:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.count(c).alias(f"n_{c}")]
    return spark.read.parquet(path).agg(*aggs)


def rough_filter(bounds: DataFrame, column: str, low, high) -> DataFrame:
    """NONE, SOME or ALL: what a range condition can mean for rows within the bounds of ``metadata_aggregate``."""
    lo, hi = F.col(f"min_{column}"), F.col(f"max_{column}")
    nulls = F.col("rows") > F.col(f"n_{column}")
    value = F.when(lo.isNull() | (hi < F.lit(low)) | (lo > F.lit(high)), "NONE").when((lo >= F.lit(low)) & (hi <= F.lit(high)) & ~nulls, "ALL").otherwise("SOME")
    return bounds.select("rows", lo.alias("low"), hi.alias("high"), value.alias("rough"))


def distinct_bound(bounds: DataFrame, column: str) -> DataFrame:
    """An upper bound of the distinct values of an integer column: its range, or its rows if fewer."""
    return bounds.select(F.least(F.col(f"n_{column}"), F.col(f"max_{column}") - F.col(f"min_{column}") + 1).cast("long").alias("at_most"))


def column_statistics(df: DataFrame) -> DataFrame:
    """(column, rows, nulls, min, max, sum, max_length) of every column in one pass, as a load keeps them beside the data."""
    parts = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        number = c.cast("double") if kind in _NUMBERS or kind.startswith("decimal") else F.lit(None).cast("double")
        length = F.octet_length(c) if kind == "string" else F.lit(None).cast("int")
        parts.append(
            F.struct(
                F.lit(name).alias("column"), F.count("*").alias("rows"), F.count_if(c.isNull()).alias("nulls"), F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"),
                F.sum(number).alias("sum"), F.max(length).alias("max_length"),
            )
        )
    one = df.agg(*[p.alias(f"c{i}") for i, p in enumerate(parts)])
    return one.select(F.explode(F.array(*[f"c{i}" for i in range(len(parts))])).alias("s")).select("s.*")


def write_with_statistics(df: DataFrame, path: str) -> None:
    """Writes ``df`` and, beside it, its statistics, so that sums and lengths are answered without the data."""
    df.write.parquet(f"{path}/data")
    column_statistics(df.sparkSession.read.schema(df.schema).parquet(f"{path}/data")).coalesce(1).write.parquet(f"{path}/statistics")
