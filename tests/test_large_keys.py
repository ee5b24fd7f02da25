"""Queries whose columns come from the keys, on keys as large tables have them: the same values as their SQL."""

import duckdb
import pytest

from pyspark.sql import functions as F

from ashlar import dialect
from ashlar.functions import dates
from ashlar.plans import registry


@pytest.fixture
def same(spark, tmp_path):
    """Compares a query with its SQL over ``rows`` of one table, cell by cell and without rounding."""

    def check(name, table, rows):
        con = duckdb.connect()
        con.execute("SET timezone='UTC'")
        con.execute(f"COPY ({rows}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        want = con.execute(registry.ORACLES[name])
        columns = [x[0] for x in want.description]
        got = registry.QUERIES[name](spark, str(tmp_path)).select(*columns)
        order = lambda found: sorted((tuple(r) for r in found), key=str)
        assert order(got.collect()) == order(want.fetchall())

    return check


def test_addresses_beyond_32_bits(same):
    same("inet_and_hash", "customer", "SELECT unnest([0, 1, 65534, 65535, 65536, 65537, 90000, 5400000, 1000000000000, NULL])::BIGINT AS c_custkey, 'Customer#' || coalesce(c_custkey, 0) AS c_name")


def test_times_beyond_839_hours(same):
    same("load_types", "supplier", "SELECT unnest([0, 1, 837, 838, 839, 6000, 360000, 1000000000000])::BIGINT AS s_suppkey, 4703.96::DOUBLE AS s_acctbal")


def test_a_time_is_still_held(spark):
    from ashlar.sources import delimited

    got = delimited.parse_fields(spark.createDataFrame([("838:59:58",), ("839:02:05",), ("839:60:00",)], "t string"), {"t": "time"}).select(dates.time_to_sec(F.col("t")))
    assert [r[0] for r in got.collect()] == [dates.LONGEST_TIME - 1, dates.LONGEST_TIME, None]


def test_years_past_9999(same):
    same("text_dates", "orders", "SELECT unnest([0, 24855, 2932896, 2932897, 9000000, 54000000, NULL])::BIGINT AS o_orderkey, TIMESTAMP '1996-02-29 00:00:00' AS o_orderdate")


@pytest.mark.parametrize(
    "text, want",
    [
        ("from_unixtime(253402300799)", "9999-12-31 23:59:59"), ("from_unixtime(253402300800)", "10000-01-01 00:00:00"), ("from_unixtime('253402300800', 'in %Y')", "in 10000"), ("from_unixtime(NULL, '%Y')", None),
        ("date_format(from_days(4000000), '%d.%m.%Y')", "18.08.10951"), ("date_format(from_days(300000), '%Y')", "0821"), ("date_format('1997-12-31 23:59:59', '%Y %H')", "1997 23"), ("date_format(NULL, '%Y')", None),
    ],
)
def test_formats_of_late_years(spark, text, want):
    assert dialect.query(spark, f"SELECT {text}").first()[0] == want


def test_format_of_a_late_column(spark):
    day = F.date_add(F.lit("9999-12-31").cast("date"), F.col("id").cast("int"))
    assert [r[0] for r in spark.range(2).select(dates.date_format(day, "%Y/%c")).collect()] == ["9999/12", "10000/1"]


def test_the_sketch_is_not_carried_by_keys(spark, sf_dir):
    found = registry.QUERIES["approx_distinct_bound"](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    keyed = [x for x in plan.splitlines() if "keys=[o_custkey" in x]
    assert keyed and not any("approx_count_distinct" in x for x in keyed)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    about = lambda df: df.agg(F.approx_count_distinct("o_custkey", 0.02)).first()[0]
    assert about(orders) == about(orders.select("o_custkey").distinct())


def test_counts_of_few_keys(same):
    same("approx_distinct_bound", "orders", "SELECT unnest([NULL, NULL, 7, 7, -1, 5400000])::BIGINT AS o_custkey")


def test_counts_of_no_keys(same):
    same("approx_distinct_bound", "orders", "SELECT 1::BIGINT AS o_custkey WHERE false")
