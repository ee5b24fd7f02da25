"""Scans, projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ashlar.functions import coerce, strings
from ashlar.plans.registry import register, table


@register("scan_pruned", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-03-01' AND l_quantity > 40")
def scan_pruned(spark, d):
    day = lambda s: F.lit(s).cast("timestamp")
    li = table(spark, d, "lineitem").where((F.col("l_shipdate") >= day("1995-01-01")) & (F.col("l_shipdate") < day("1995-03-01")) & (F.col("l_quantity") > 40))
    return li.select("l_orderkey", "l_linenumber", "l_quantity")


@register("between_in", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_size NOT BETWEEN 15 AND 16 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND p_size NOT IN (11, 19)")
def between_in(spark, d):
    size = F.col("p_size")
    brands = F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#23")
    return table(spark, d, "part").where(size.between(10, 20) & ~size.between(15, 16) & brands & ~size.isin(11, 19)).select("p_partkey", "p_brand", "p_size")


@register("like_escape", r"SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a_e%' AND p_type NOT ILIKE 'x\%%' ESCAPE '\' AND replace(p_name, ' ', '%') ILIKE '%!%%' ESCAPE '!'")
def like_escape(spark, d):
    name = F.col("p_name")
    return (
        table(spark, d, "part")
        .where(strings.like(name, "%a_e%") & ~strings.like(F.col("p_type"), r"x\%%") & strings.like(F.replace(name, F.lit(" "), F.lit("%")), "%!%%", "!"))
        .select("p_partkey", "p_name")
    )


@register("regexp_posix", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '(?i)^customer#0*[0-9]{1,2}5$') AND NOT regexp_matches(c_mktsegment, '(?i)[0-9]')")
def regexp_posix(spark, d):
    c = table(spark, d, "customer")
    return c.where(strings.regexp(F.col("c_name"), "^customer#0*[[:digit:]]{1,2}5$") & ~strings.regexp(F.col("c_mktsegment"), "[[:digit:]]")).select("c_custkey", "c_name")


@register(
    "null_safe_eq",
    "WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders) SELECT o_orderkey, (s IS NOT DISTINCT FROM 'F')::INT AS eq_f, (s IS NOT DISTINCT FROM NULL)::INT AS eq_null, (s = 'F')::INT AS plain FROM t",
)
def null_safe_eq(spark, d):
    s = F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("o_orderstatus"))
    o = table(spark, d, "orders").select("o_orderkey", s.alias("s"))
    return o.select(
        "o_orderkey", F.col("s").eqNullSafe("F").cast("int").alias("eq_f"), F.col("s").eqNullSafe(F.lit(None)).cast("int").alias("eq_null"), (F.col("s") == "F").cast("int").alias("plain")
    )


@register(
    "three_valued_logic",
    """WITH v(x) AS (VALUES (TRUE), (FALSE), (NULL)) SELECT a.x::INT AS a, b.x::INT AS b, (a.x AND b.x)::INT AS and_, (a.x OR b.x)::INT AS or_, (NOT a.x)::INT AS not_,
    (a.x <> b.x)::INT AS xor_, coalesce(a.x, FALSE)::INT AS is_true, (a.x IS NULL)::INT AS is_unknown FROM v a, v b""",
)
def three_valued_logic(spark, d):
    v = spark.createDataFrame([(True,), (False,), (None,)], "x boolean")
    a, b = F.col("a"), F.col("b")
    cross = v.select(F.col("x").alias("a")).crossJoin(v.select(F.col("x").alias("b")))
    out = {"and_": a & b, "or_": a | b, "not_": ~a, "xor_": coerce.xor(a, b), "is_true": coerce.is_true(a), "is_unknown": coerce.is_unknown(a)}
    return cross.select(a.cast("int").alias("a"), b.cast("int").alias("b"), *[c.cast("int").alias(k) for k, c in out.items()])


@register("row_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('R', 'F')) AND (l_linenumber, l_returnflag) <> (1, 'A')")
def row_in(spark, d):
    pair = F.struct("l_returnflag", "l_linestatus")
    wanted = F.array(*[F.struct(F.lit(a).alias("l_returnflag"), F.lit(b).alias("l_linestatus")) for a, b in (("A", "F"), ("R", "F"))])
    other = ~((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "A"))
    return table(spark, d, "lineitem").where(F.array_contains(wanted, pair) & other).select("l_orderkey", "l_linenumber")


@register(
    "case_when",
    """SELECT p_partkey, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS simple, CASE WHEN p_retailprice < 1000 THEN 'low' WHEN p_retailprice < 1500 THEN 'mid' END AS searched,
    CASE WHEN p_size > 25 THEN p_size ELSE -p_size END AS signed, coalesce(nullif(p_brand, 'Brand#11'), 'none') AS brand FROM part""",
)
def case_when(spark, d):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, d, "part").select(
        "p_partkey", F.when(size == 1, "one").when(size == 2, "two").otherwise("many").alias("simple"), F.when(price < 1000, "low").when(price < 1500, "mid").alias("searched"),
        F.when(size > 25, size).otherwise(-size).alias("signed"), F.ifnull(F.nullif(F.col("p_brand"), F.lit("Brand#11")), F.lit("none")).alias("brand"),
    )


@register("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def select_distinct(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@register("collation_compare", "SELECT lower(rtrim(c_mktsegment)) AS segment, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) || '  ' ELSE c_mktsegment END AS c_mktsegment FROM customer) GROUP BY 1")
def collation_compare(spark, d):
    mixed = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lower("c_mktsegment"), F.lit("  "))).otherwise(F.col("c_mktsegment"))
    grouped = table(spark, d, "customer").select(coerce.collated(mixed).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    return grouped.select(F.lower(F.rtrim(coerce.binary(F.col("s")))).alias("segment"), "n")


@register("constant_conditions", "SELECT count(*) AS n FROM region WHERE FALSE UNION ALL SELECT count(*) FROM region WHERE 1 = 1")
def constant_conditions(spark, d):
    r = table(spark, d, "region")
    return r.where(F.lit(False)).agg(F.count("*").alias("n")).union(r.where(F.lit(1) == 1).agg(F.count("*").alias("n")))


@register("prepared_parameters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'F'")
def prepared_parameters(spark, d):
    return spark.sql("SELECT o_orderkey, o_totalprice FROM {o} WHERE o_totalprice > :least AND o_orderstatus = :status", {"least": 400000, "status": "F"}, o=table(spark, d, "orders"))


@register("dual", "SELECT 1 + 1 AS a, -(1 + 1) * -2 AS b")
def dual(spark, d):
    return spark.sql("SELECT 1 + 1 AS a, -(1 + 1) * -2 AS b")
