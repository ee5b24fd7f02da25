"""Subqueries and derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ashlar.operators import subqueries
from ashlar.plans.registry import register, table

CORRELATED = "SELECT p_partkey, p_retailprice FROM {part} p WHERE p_retailprice > (SELECT avg(q.p_retailprice) * 1.1 FROM {part} q WHERE q.p_brand = p.p_brand)"


@register("scalar_subquery_corr", CORRELATED.format(part="part"))
def scalar_subquery_corr(spark, d):
    return spark.sql(CORRELATED, part=table(spark, d, "part"))


@register("scalar_subquery", "SELECT s_suppkey, s_acctbal - (SELECT max(c_acctbal) FROM customer) AS gap FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)")
def scalar_subquery(spark, d):
    return spark.sql("SELECT s_suppkey, s_acctbal - (SELECT max(c_acctbal) FROM {c}) AS gap FROM {s} WHERE s_acctbal > (SELECT avg(s_acctbal) FROM {s})", c=table(spark, d, "customer"), s=table(spark, d, "supplier"))


@register("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)")
def in_subquery(spark, d):
    return spark.sql("SELECT c_custkey FROM {c} WHERE c_custkey IN (SELECT o_custkey FROM {o} WHERE o_totalprice > 350000)", c=table(spark, d, "customer"), o=table(spark, d, "orders"))


NOT_IN = "SELECT 'with null' AS kind, count(*) AS n FROM {c} WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM {o} UNION ALL SELECT NULL) UNION ALL SELECT 'without', count(*) FROM {c} WHERE c_custkey NOT IN (SELECT o_custkey FROM {o})"


@register("not_in_null", NOT_IN.format(c="customer", o="orders"))
def not_in_null(spark, d):
    return spark.sql(NOT_IN, c=table(spark, d, "customer"), o=table(spark, d, "orders"))


NOT_EXISTS = "SELECT n_name FROM {n} WHERE NOT EXISTS (SELECT 1 FROM {s} WHERE s_nationkey = n_nationkey AND s_acctbal > 3000) OR n_regionkey = 0"


@register("not_exists_or", NOT_EXISTS.format(n="nation", s="supplier"))
def not_exists_or(spark, d):
    return spark.sql(NOT_EXISTS, n=table(spark, d, "nation"), s=table(spark, d, "supplier"))


@register(
    "any_all",
    """SELECT c_custkey, (c_acctbal > ANY (SELECT s_acctbal FROM supplier WHERE s_nationkey = 3))::INT AS any_, (c_acctbal >= ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey = 3))::INT AS all_,
    (c_acctbal < ALL (SELECT s_acctbal FROM supplier WHERE FALSE))::INT AS all_empty, (c_acctbal < ANY (SELECT s_acctbal FROM supplier WHERE FALSE))::INT AS any_empty FROM customer""",
)
def any_all(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    few, none = s.where("s_nationkey = 3"), s.where("false")
    out = subqueries.compare_any(c, "c_acctbal", ">", few, "s_acctbal", "any_")
    out = subqueries.compare_all(out, "c_acctbal", ">=", few, "s_acctbal", "all_")
    out = subqueries.compare_all(out, "c_acctbal", "<", none, "s_acctbal", "all_empty")
    out = subqueries.compare_any(out, "c_acctbal", "<", none, "s_acctbal", "any_empty")
    return out.select("c_custkey", *[F.col(x).cast("int").alias(x) for x in ("any_", "all_", "all_empty", "any_empty")])


@register(
    "any_all_nulls",
    """WITH t AS (SELECT s_suppkey, nullif(s_nationkey, 4) AS k FROM supplier), u AS (SELECT nullif(n_nationkey, 7) AS k FROM nation WHERE n_nationkey BETWEEN 5 AND 9)
    SELECT s_suppkey, (k > ANY (SELECT k FROM u))::INT AS a, (k > ALL (SELECT k FROM u))::INT AS b FROM t""",
)
def any_all_nulls(spark, d):
    t = table(spark, d, "supplier").select("s_suppkey", F.nullif(F.col("s_nationkey"), F.lit(4)).alias("k"))
    u = table(spark, d, "nation").where("n_nationkey BETWEEN 5 AND 9").select(F.nullif(F.col("n_nationkey"), F.lit(7)).alias("k"))
    out = subqueries.compare_all(subqueries.compare_any(t, "k", ">", u, "k", "a"), "k", ">", u, "k", "b")
    return out.select("s_suppkey", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))


DERIVED = "SELECT y, max(total) AS best FROM (SELECT year(o_orderdate) AS y, o_custkey, round(sum(o_totalprice), 2) AS total FROM {o} GROUP BY year(o_orderdate), o_custkey) t GROUP BY y"


@register("derived_table", DERIVED.format(o="orders"))
def derived_table(spark, d):
    return spark.sql(DERIVED, o=table(spark, d, "orders"))


@register("row_subquery", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey = (SELECT max(l_orderkey) FROM lineitem) AND l_linenumber = (SELECT min(l_linenumber) FROM lineitem)")
def row_subquery(spark, d):
    return spark.sql(
        "SELECT l_orderkey, l_linenumber FROM {l} WHERE struct(l_orderkey, l_linenumber) = (SELECT struct(max(l_orderkey), min(l_linenumber)) FROM {l})", l=table(spark, d, "lineitem")
    )


HAVING = "SELECT c_mktsegment, count(*) AS n FROM {c} GROUP BY c_mktsegment HAVING count(*) > (SELECT count(*) / 5 - 3 FROM {c})"


@register("having_subquery", HAVING.format(c="customer"))
def having_subquery(spark, d):
    return spark.sql(HAVING, c=table(spark, d, "customer"))


CTE = "WITH big AS (SELECT * FROM {o} WHERE o_totalprice > 200000) SELECT o_orderpriority, count(*) AS n FROM big GROUP BY o_orderpriority"


@register("common_table", CTE.format(o="orders"))
def common_table(spark, d):
    return spark.sql(CTE, o=table(spark, d, "orders"))


@register("view", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice < 50000 GROUP BY o_orderstatus")
def view(spark, d):
    table(spark, d, "orders").where("o_totalprice < 50000").createOrReplaceTempView("ashlar_cheap_orders")
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM ashlar_cheap_orders GROUP BY o_orderstatus")
