"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ashlar.operators import joins
from ashlar.plans.registry import register, table


@register(
    "inner_join_revenue",
    """SELECT c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY c_mktsegment""",
)
def inner_join_revenue(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))
    j = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("c_mktsegment").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@register("left_join_counts", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'O' GROUP BY c_custkey")
def left_join_counts(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'O'")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@register("right_join", "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 8000")
def right_join(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 8000")
    return s.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("n_name", "s_suppkey")


@register("full_join", "SELECT a.k AS a, b.k AS b FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 10) b ON a.k = b.k")
def full_join(spark, d):
    n = table(spark, d, "nation")
    a, b = n.where("n_nationkey < 15").select(F.col("n_nationkey").alias("a")), n.where("n_nationkey > 10").select(F.col("n_nationkey").alias("b"))
    return a.join(b, F.col("a") == F.col("b"), "full")


@register("cross_join", "SELECT r_name, n_name FROM region, nation WHERE n_regionkey <> r_regionkey")
def cross_join(spark, d):
    return table(spark, d, "region").crossJoin(table(spark, d, "nation")).where("n_regionkey <> r_regionkey").select("r_name", "n_name")


@register("anti_join_null", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
def anti_join_null(spark, d):
    return joins.anti_join_null(table(spark, d, "customer"), table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@register("semi_join_exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48)")
def semi_join_exists(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_quantity > 48"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@register("self_join", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def self_join(spark, d):
    s = table(spark, d, "supplier")
    a, b = s.alias("a"), s.alias("b")
    on = (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey"))
    return a.join(b, on).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


@register("using_join", "SELECT k, a.n_name AS a, b.r_name AS b FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)")
def using_join(spark, d):
    a = table(spark, d, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("a"))
    return a.join(table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("b")), ["k"])


@register("natural_join", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region)")
def natural_join(spark, d):
    return spark.sql("SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM {n}) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM {r})", n=table(spark, d, "nation"), r=table(spark, d, "region"))


@register("multi_key_join", "SELECT count(*) AS n, sum(a.l_linenumber)::BIGINT AS s FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey")
def multi_key_join(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    return li.join(li.select("l_orderkey", "l_suppkey"), ["l_orderkey", "l_suppkey"]).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"))


@register("straight_join", "SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name")
def straight_join(spark, d):
    j = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count("*").alias("n"))


@register("theta_join_range", "SELECT a.l_orderkey, a.l_linenumber, b.p_partkey FROM lineitem a JOIN part b ON a.l_extendedprice BETWEEN b.p_retailprice - 0.5 AND b.p_retailprice + 0.5 WHERE a.l_quantity <= 2")
def theta_join_range(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity <= 2").select("l_orderkey", "l_linenumber", "l_extendedprice")
    p = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") - 0.5).alias("lo"), (F.col("p_retailprice") + 0.5).alias("hi"))
    return joins.range_join(li, p, "l_extendedprice", "lo", "hi", 8.0).select("l_orderkey", "l_linenumber", "p_partkey")


@register("theta_join_counts", "SELECT c_acctbal, (SELECT count(*) FROM supplier WHERE s_acctbal < c_acctbal) AS n FROM (SELECT DISTINCT c_acctbal FROM customer)")
def theta_join_counts(spark, d):
    return joins.less_than_counts(table(spark, d, "customer"), table(spark, d, "supplier"), "c_acctbal", "s_acctbal")


@register(
    "null_safe_join",
    "WITH a AS (SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS g FROM nation), b AS (SELECT nullif(r_regionkey, 2) AS g, r_name FROM region) SELECT k, r_name FROM a JOIN b ON a.g IS NOT DISTINCT FROM b.g",
)
def null_safe_join(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.nullif(F.col("n_regionkey"), F.lit(2)).alias("g"))
    b = table(spark, d, "region").select(F.nullif(F.col("r_regionkey"), F.lit(2)).alias("g"), "r_name")
    return joins.null_safe_join(a, b, "g", "g").select("l.k", "r.r_name")
