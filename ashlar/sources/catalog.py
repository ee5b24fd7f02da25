"""Metadata tables: what information_schema shows, out of Spark's catalog (metadata only, one row a table or column)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tables(spark: SparkSession) -> DataFrame:
    rows = [(t.namespace[0] if t.namespace else None, t.name, "VIEW" if t.isTemporary or t.tableType == "VIEW" else "BASE TABLE") for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_schema string, table_name string, table_type string")


def columns(spark: SparkSession, table: str) -> DataFrame:
    rows = [(table, c.name, i + 1, c.dataType, "YES" if c.nullable else "NO") for i, c in enumerate(spark.catalog.listColumns(table))]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string")
