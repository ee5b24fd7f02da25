"""Reading from and writing to other databases over JDBC, in parallel by ranges of a column; drivers come with the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, url: str, query: str, properties: dict[str, str], split: tuple[str, int, int, int] | None = None, fetch: int = 10_000) -> DataFrame:
    """``split``: a numeric column, its least and greatest value, and the number of ranges read side by side."""
    reader = spark.read.format("jdbc").options(url=url, fetchsize=str(fetch), **properties)
    if split is None:
        return reader.option("query", query).load()
    column, low, high, n = split
    return reader.options(dbtable=f"({query}) t", partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(n)).load()


def append(df: DataFrame, url: str, target: str, properties: dict[str, str], batch: int = 10_000) -> None:
    df.write.format("jdbc").options(url=url, dbtable=target, batchsize=str(batch), **properties).mode("append").save()
