"""Stored procedures, user functions by name, and the result cache of a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ashlar import dialect


class Procedures:
    """Named scripts: ``BEGIN .. END`` in Spark's SQL scripting, with variables, IF, loops, handlers and FOR over a query's rows (a cursor)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def create(self, name: str, script: str) -> None:
        self.held[name.lower()] = script

    def drop(self, name: str) -> None:
        del self.held[name.lower()]

    def call(self, name: str, **args) -> DataFrame:
        """``CALL name(..)``; the script's ``:parameters`` are ``args``, its result that of its last query."""
        return self.spark.sql(self.held[name.lower()], args)


def create_function(spark: SparkSession, name: str, function: Callable) -> None:
    """CREATE FUNCTION .. SONAME: ``function`` is a pandas UDF (scalar or aggregate), known to query text by ``name``."""
    spark.udf.register(name, function)


def drop_function(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")


class Triggers:
    """AFTER INSERT triggers: what a write does besides, in the order they were made."""

    def __init__(self):
        self.held: dict[str, list[Callable[[DataFrame], None]]] = {}

    def create(self, table: str, action: Callable[[DataFrame], None]) -> None:
        self.held.setdefault(table, []).append(action)

    def insert(self, table: str, rows: DataFrame, path: str) -> None:
        rows.write.mode("append").parquet(path)
        for action in self.held.get(table, []):
            action(rows)


class ResultCache:
    """Results by the text that asked for them, kept in the executors' storage memory or on their disks, until one of their tables changes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held, self.hits = spark, {}, 0

    def query(self, text: str, tables: dict[str, DataFrame], args: dict | list | None = None) -> DataFrame:
        key = (text, str(args))
        if key in self.held:
            self.hits += 1
        else:
            self.held[key] = (dialect.query(self.spark, text, args, **tables).persist(), frozenset(tables))
        return self.held[key][0]

    def invalidate(self, table: str) -> None:
        for key in [k for k, (_, names) in self.held.items() if table in names]:
            self.held.pop(key)[0].unpersist()
