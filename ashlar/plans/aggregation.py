"""Aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ashlar.functions import bits
from ashlar.operators import aggregates
from ashlar.plans.registry import register, table


@register("count_distinct_multi", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_suppkey, l_linenumber)) AS both_ FROM lineitem GROUP BY l_returnflag")
def count_distinct_multi(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey", "l_linenumber").alias("both_"))


@register("count_distinct_nulls", "WITH t AS (SELECT nullif(l_linenumber, 1) AS a, nullif(l_returnflag, 'A') AS b FROM lineitem) SELECT count(DISTINCT (a, b)) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n, count(DISTINCT a) AS a FROM t")
def count_distinct_nulls(spark, d):
    t = table(spark, d, "lineitem").select(F.nullif(F.col("l_linenumber"), F.lit(1)).alias("a"), F.nullif(F.col("l_returnflag"), F.lit("A")).alias("b"))
    return t.agg(F.countDistinct("a", "b").alias("n"), F.countDistinct("a").alias("a"))


@register("sum_distinct", "SELECT l_linestatus, sum(DISTINCT l_linenumber)::BIGINT AS s, avg(DISTINCT l_quantity) AS a, sum(l_linenumber)::BIGINT AS t FROM lineitem GROUP BY l_linestatus")
def sum_distinct(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_linestatus").agg(F.sum_distinct("l_linenumber").alias("s"), F.expr("avg(DISTINCT l_quantity)").alias("a"), F.sum("l_linenumber").alias("t"))


@register(
    "var_std_family",
    """SELECT o_orderstatus, round(stddev_pop(o_totalprice), 3) AS std, round(var_pop(o_totalprice) / 1e6, 4) AS variance, round(stddev_samp(o_totalprice), 3) AS stddev_samp,
    round(var_samp(o_totalprice) / 1e6, 4) AS var_samp FROM orders GROUP BY o_orderstatus""",
)
def var_std_family(spark, d):
    x = F.col("o_totalprice")
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.round(aggregates.std(x), 3).alias("std"), F.round(aggregates.variance(x) / 1e6, 4).alias("variance"), F.round(F.stddev_samp(x), 3).alias("stddev_samp"), F.round(F.var_samp(x) / 1e6, 4).alias("var_samp")
    )


@register("var_samp_small_groups", "SELECT l_orderkey, round(var_samp(l_quantity), 6) AS samp, round(var_pop(l_quantity), 6) AS pop FROM lineitem GROUP BY l_orderkey")
def var_samp_small_groups(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.var_samp("l_quantity"), 6).alias("samp"), F.round(F.var_pop("l_quantity"), 6).alias("pop"))


@register("bit_aggs", "SELECT l_returnflag, bit_and(l_orderkey | 1) AS a, bit_or(l_partkey) AS o, bit_xor(l_suppkey) AS x FROM lineitem GROUP BY l_returnflag")
def bit_aggs(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        bits.agg_bit_and(F.col("l_orderkey").bitwiseOR(F.lit(1))).cast("long").alias("a"), bits.agg_bit_or(F.col("l_partkey")).cast("long").alias("o"), bits.agg_bit_xor(F.col("l_suppkey")).cast("long").alias("x")
    )
    return li


@register("bit_aggs_empty", "SELECT '18446744073709551615' AS a, '0' AS o, '0' AS x")
def bit_aggs_empty(spark, d):
    e = table(spark, d, "nation").where("false")
    return e.agg(*[f(F.col("n_nationkey")).cast("string").alias(n) for n, f in (("a", bits.agg_bit_and), ("o", bits.agg_bit_or), ("x", bits.agg_bit_xor))])


@register("group_concat_ordered", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name DESC) AS names, string_agg(DISTINCT left(n_name, 1), ',' ORDER BY left(n_name, 1)) AS letters FROM nation GROUP BY n_regionkey")
def group_concat_ordered(spark, d):
    g = table(spark, d, "nation").groupBy("n_regionkey")
    return g.agg(F.expr("listagg(n_name, ';') WITHIN GROUP (ORDER BY n_name DESC)").alias("names"), aggregates.group_concat(F.left("n_name", F.lit(1)), distinct=True).alias("letters"))


@register("having_alias", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND sum(o_totalprice) > 1000000")
def having_alias(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return g.where("n > 15 AND total > 1000000").withColumn("total", F.round("total", 2))


@register("group_by_expression", "SELECT year(o_orderdate) AS y, (o_totalprice > 200000)::INT AS big, count(*) AS n FROM orders GROUP BY 1, 2")
def group_by_expression(spark, d):
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), (F.col("o_totalprice") > 200000).cast("int").alias("big")).agg(F.count("*").alias("n"))


@register(
    "rollup_region_nation",
    "SELECT r_name, n_name, count(*) AS n, round(sum(s_acctbal), 2) AS bal FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY ROLLUP (r_name, n_name)",
)
def rollup_region_nation(spark, d):
    j = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("bal"))


@register("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@register("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark, d):
    o = table(spark, d, "orders")
    return o.groupingSets([[F.col("o_orderstatus")], [F.col("o_orderpriority")], []], F.col("o_orderstatus"), F.col("o_orderpriority")).agg(F.count("*").alias("n"))


@register("global_agg_empty", "SELECT min(n_name) AS lo, max(n_nationkey) AS hi, count(*) AS n, sum(n_nationkey)::BIGINT AS s FROM nation WHERE FALSE")
def global_agg_empty(spark, d):
    return table(spark, d, "nation").where("false").agg(F.min("n_name").alias("lo"), F.max("n_nationkey").alias("hi"), F.count("*").alias("n"), F.sum("n_nationkey").alias("s"))


@register("min_max_types", "SELECT min(o_orderpriority) AS lo_s, max(o_orderpriority) AS hi_s, min(o_totalprice) AS lo_d, max(o_orderkey) AS hi_l, strftime(min(o_orderdate), '%Y-%m-%d') AS lo_t, count(*) AS n, count(nullif(o_orderstatus, 'F')) AS some FROM orders")
def min_max_types(spark, d):
    return table(spark, d, "orders").agg(
        F.min("o_orderpriority").alias("lo_s"), F.max("o_orderpriority").alias("hi_s"), F.min("o_totalprice").alias("lo_d"), F.max("o_orderkey").alias("hi_l"),
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("lo_t"), F.count("*").alias("n"), F.count(F.nullif(F.col("o_orderstatus"), F.lit("F"))).alias("some"),
    )


@register("any_value_group", "SELECT n_regionkey, min(r_name) AS r_name, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY n_regionkey")
def any_value_group(spark, d):
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_regionkey").agg(F.any_value("r_name").alias("r_name"), F.count("*").alias("n"))


def _profile_sql() -> str:
    parts = []
    for name, numeric in (("s_suppkey", True), ("s_name", False), ("s_nationkey", True), ("s_acctbal", True)):
        empty = f"{name} = 0" if numeric else f"{name} = ''"
        mean, dev = (f"avg({name})", f"stddev_pop({name})") if numeric else ("NULL::DOUBLE", "NULL::DOUBLE")
        parts.append(f"SELECT '{name}' AS field_name, count(*) FILTER ({empty}) AS empties_or_zeros, count(*) FILTER ({name} IS NULL) AS nulls, round({mean}, 4) AS avg_value, round({dev}, 4) AS std, max(length({name}::VARCHAR)) FILTER ({name} = {name}) * {0 if name == 's_acctbal' else 1} AS max_length FROM supplier")
    return " UNION ALL ".join(parts)


@register("profile_columns", _profile_sql())
def profile_columns(spark, d):
    p = aggregates.profile(table(spark, d, "supplier"))
    width = F.when(F.col("field_name") == "s_acctbal", F.lit(0)).otherwise(F.col("max_length")).cast("long")
    return p.select("field_name", "empties_or_zeros", "nulls", F.round("avg_value", 4).alias("avg_value"), F.round("std", 4).alias("std"), width.alias("max_length"))


@register("approx_distinct_bound", "SELECT count(DISTINCT o_custkey) AS exact, TRUE AS near FROM orders")
def approx_distinct_bound(spark, d):
    """Both counts are of the distinct keys: a sketch is the same of repeated values, and beside a distinct count each key would carry one."""
    keys = table(spark, d, "orders").select("o_custkey").distinct()
    o = keys.agg(F.count("o_custkey").alias("exact"), F.approx_count_distinct("o_custkey", 0.02).alias("about"))
    return o.select("exact", (F.abs(F.col("about") - F.col("exact")) <= F.col("exact") * 0.1).alias("near"))
