"""Named memory tables: fetch, sort, column sums, append, as cached DataFrames in the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CALC = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}


class MemoryTables:
    """A collection of tables by name; each is a cached temporary view."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def fetch(self, name: str, sql: str, args: dict | None = None) -> DataFrame:
        df = self.spark.sql(sql, args or {}).cache()
        df.createOrReplaceTempView(name)
        return df

    def add(self, name: str, df: DataFrame) -> None:
        df.cache().createOrReplaceTempView(name)

    def find(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def delete(self, name: str) -> bool:
        if self.exists(name):
            self.spark.table(name).unpersist()
        return self.spark.catalog.dropTempView(name)

    def sort(self, name: str, *columns: str) -> DataFrame:
        return self.find(name).orderBy(*columns)

    def calc(self, name: str, by: list[str], calcs: dict[str, str]) -> DataFrame:
        return self.find(name).groupBy(*by).agg(*[_CALC[how](c).alias(f"{how}_{c}") for c, how in calcs.items()])

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        df = self.find(name).unionByName(rows)
        self.add(name, df)
        return df

    def blocks(self, name: str):
        """Rows one by one, a partition in memory at a time."""
        return self.find(name).toLocalIterator(prefetchPartitions=True)
