"""Sorting, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ashlar.operators import ordering, sets
from ashlar.plans.registry import register, table


@register("topk_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@register("limit_offset", "SELECT c_custkey, c_name FROM customer ORDER BY c_name LIMIT 7 OFFSET 20")
def limit_offset(spark, d):
    return ordering.limit(table(spark, d, "customer").select("c_custkey", "c_name").orderBy("c_name"), 7, 20)


@register("order_by_multi", "SELECT s_nationkey, s_acctbal, s_suppkey FROM supplier ORDER BY s_nationkey DESC, s_acctbal, 3")
def order_by_multi(spark, d):
    return table(spark, d, "supplier").select("s_nationkey", "s_acctbal", "s_suppkey").orderBy(F.desc("s_nationkey"), "s_acctbal", "s_suppkey")


@register("order_by_case", "SELECT o_orderkey FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, o_orderkey LIMIT 25")
def order_by_case(spark, d):
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    return table(spark, d, "orders").orderBy(rank, "o_orderkey").select("o_orderkey").limit(25)


@register("nulls_first", "SELECT k FROM (SELECT nullif(n_regionkey, 1) AS k, n_nationkey FROM nation) ORDER BY k NULLS FIRST, n_nationkey LIMIT 8")
def nulls_first(spark, d):
    return table(spark, d, "nation").select(F.nullif(F.col("n_regionkey"), F.lit(1)).alias("k"), "n_nationkey").orderBy("k", "n_nationkey").limit(8).select("k")


@register("found_rows", "SELECT count(*) AS found_rows FROM orders WHERE o_totalprice > 300000")
def found_rows(spark, d):
    _, n = ordering.found_rows(table(spark, d, "orders").where("o_totalprice > 300000"), 1)
    return n


@register("top_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 2")
def top_per_group(spark, d):
    return ordering.top_per_group(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@register("running_total", "SELECT o_orderkey, sum(o_shippriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM (SELECT o_orderkey, o_custkey, 1 AS o_shippriority FROM orders)")
def running_total(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.sum(F.lit(1)).over(w).alias("n"))


@register("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return sets.union(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select("s_nationkey"))


@register("union_all", "SELECT 'c' AS kind, count(*) AS n FROM customer UNION ALL SELECT 's', count(*) FROM supplier UNION ALL SELECT 's', count(*) FROM supplier")
def union_all(spark, d):
    one = lambda t, k: table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return sets.union(sets.union(one("customer", "c"), one("supplier", "s"), False), one("supplier", "s"), False)


@register("union_widening", "SELECT r_name AS v FROM region UNION SELECT n_nationkey::VARCHAR FROM nation")
def union_widening(spark, d):
    return sets.union(table(spark, d, "region").select(F.col("r_name").alias("v")), table(spark, d, "nation").select("n_nationkey"))


@register("union_limited", "(SELECT n_name AS x FROM nation ORDER BY n_name LIMIT 3) UNION ALL (SELECT r_name FROM region ORDER BY r_name DESC LIMIT 2) ORDER BY x LIMIT 4")
def union_limited(spark, d):
    a = table(spark, d, "nation").select(F.col("n_name").alias("x")).orderBy("x").limit(3)
    b = table(spark, d, "region").select("r_name").orderBy(F.desc("r_name")).limit(2)
    return sets.union(a, b, False).orderBy("x").limit(4)


@register("intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def intersect(spark, d):
    return table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").where("s_acctbal < 0").select("s_nationkey"))


@register("except_", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def except_(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))
