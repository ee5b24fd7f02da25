"""Row changes over immutable tables: each gives the table as it is afterwards, to be written in its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def insert_select(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows.select(*table.columns))


def replace(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """REPLACE: new rows take the places of those with their keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows.select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], update: dict[str, Column]) -> DataFrame:
    """INSERT .. ON DUPLICATE KEY UPDATE; ``update`` may use ``old.x`` and, for VALUES(x), ``new.x``."""
    old, new = table.alias("old"), rows.alias("new")
    on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
    both = F.col(f"old.{keys[0]}").isNotNull() & F.col(f"new.{keys[0]}").isNotNull()
    out = []
    for c in table.columns:
        changed = update.get(c, F.col(f"old.{c}"))
        out.append(F.when(both, changed).when(F.col(f"new.{keys[0]}").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c))
    return old.join(new, on, "full").select(*out)


def update_join(table: DataFrame, other: DataFrame, on: str, values: dict[str, Column]) -> DataFrame:
    """UPDATE t, o SET .. WHERE t.on = o.on; ``values`` may use ``t.x`` and ``o.x``.  ``other`` has a key once."""
    t, o = table.alias("t"), other.withColumn("__hit", F.lit(True)).alias("o")
    joined = t.join(o, F.col(f"t.{on}") == F.col(f"o.{on}"), "left")
    return joined.select(*[F.when(F.col("o.__hit"), values[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in values else F.col(f"t.{c}") for c in table.columns])


def delete_join(table: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """DELETE t FROM t, o WHERE t.on = o.on."""
    return table.join(other.select(*on).distinct(), on, "left_anti")


def create_table_as(df: DataFrame, path: str) -> DataFrame:
    """CREATE TABLE .. SELECT: the rows are written once and read back with their types."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_all(table: DataFrame) -> DataFrame:
    """DELETE without a condition: the columns stay."""
    return table.limit(0)


def truncate_partition(spark: SparkSession, path: str, **values) -> bool:
    """Drops one folder of a partitioned table, without reading it; false if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/" + "/".join(f"{k}={v}" for k, v in values.items()))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def with_check_option(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows to be written through a view: one that the view would not show raises as it is written."""
    first = rows.columns[0]
    checked = F.when(F.coalesce(condition, F.lit(False)), F.col(f"`{first}`")).otherwise(F.raise_error(F.lit("CHECK OPTION failed")).cast(rows.schema[first].dataType))
    return rows.withColumn(first, checked)
