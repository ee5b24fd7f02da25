"""Loads, exports, plug-ins, memory tables, partitions, changes and streams over small files."""

import pytest
from pyspark.sql import functions as F

from ashlar.operators import aggregates, changes, joins, partitions, subqueries
from ashlar.sources import delimited, memory, records
from ashlar.streaming import append_batches, file_stream, windowed_counts


def test_load_options(spark, tmp_path):
    (tmp_path / "a.txt").write_text("head;er\n>>1;'x;y';\\N\n>>2;'it\\'s';3.5\nno prefix\n")
    fmt = delimited.TextFormat(terminated=";", enclosed="'", starting=">>", ignore=1)
    got = delimited.load(spark, str(tmp_path / "a.txt"), "a int, b string, c double", fmt).collect()
    assert [tuple(r) for r in got] == [(1, "x;y", None), (2, "it's", 3.5)]


def test_bad_rows_are_kept_aside(spark, tmp_path):
    (tmp_path / "b.csv").write_text("1,a\nx,b\n3,c\n")
    got = delimited.load(spark, str(tmp_path / "b.csv"), "n int, s string", delimited.TextFormat(terminated=","), bad_rows="bad").collect()
    assert [(r["n"], r["bad"]) for r in got] == [(1, None), (None, "x,b"), (3, None)]
    with pytest.raises(Exception, match=r"(?s)MALFORMED|FAILFAST|parse"):
        delimited.load(spark, str(tmp_path / "b.csv"), "n int, s string", delimited.TextFormat(terminated=",")).collect()


def test_export_with_crlf(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb", None, bytearray(b"\x01\xff"))], "i int, s string, n string, b binary")
    delimited.export(df.coalesce(1), str(tmp_path / "o"), delimited.TextFormat(lines="\r\n"))
    text = next((tmp_path / "o").glob("part-*")).read_bytes()
    assert text == b"1\ta\\\tb\t\\N\t01FF\r\n"
    assert delimited.dump(spark.range(1).select(F.lit("x"))) == b"x"


def test_parser_plug_in(spark, tmp_path):
    (tmp_path / "f1.kv").write_bytes(b"a=1\nbroken\nb=2\n")

    def parse(content):
        for line in content.decode().splitlines():
            k, eq, v = line.partition("=")
            yield (k, int(v)) if eq else None

    got = records.parse_files(spark, str(tmp_path), parse, "k string, v long", glob="*.kv").orderBy("row").collect()
    assert [(r["k"], r["v"], r["bad"]) for r in got] == [("a", 1, False), (None, None, True), ("b", 2, False)]


def test_binary_file(spark, tmp_path):
    import struct

    (tmp_path / "r.bin").write_bytes(b"".join(struct.pack("<i4sd", i, b"ab", i / 2) for i in range(5)))
    got = records.load_binary(spark, str(tmp_path / "r.bin"), {"i": "<i4", "s": "S4", "x": "<f8"}).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(i, "ab", i / 2) for i in range(5)]


def test_memory_tables(spark):
    mt = memory.MemoryTables(spark)
    mt.fetch("mt_a", "SELECT id, id % 2 AS k FROM range(:n)", {"n": 6})
    assert mt.exists("mt_a") and mt.find("mt_a").count() == 6
    assert [r["sum_id"] for r in mt.calc("mt_a", ["k"], {"id": "sum"}).orderBy("k").collect()] == [6, 9]
    assert [r["id"] for r in mt.blocks("mt_a")] == list(range(6))
    assert mt.delete("mt_a") and not mt.exists("mt_a")


def test_partition_rules(spark):
    df = spark.createDataFrame([(-7,), (3,), (None,), (25,)], "x int")
    got = df.select(partitions.by_hash(F.col("x"), 4).alias("h"), partitions.by_range(F.col("x"), [0, 10]).alias("r"), partitions.by_list(F.col("x"), [[-7, None], [3, 25]]).alias("l")).collect()
    assert [tuple(r) for r in got] == [(3, 0, 0), (3, 1, 1), (0, 0, 0), (1, 2, 1)]
    with pytest.raises(Exception, match="no partition"):
        df.select(partitions.by_list(F.col("x"), [[3]])).collect()


def test_upsert_and_replace_on_empty(spark):
    empty = spark.createDataFrame([], "k int, v int")
    one = spark.createDataFrame([(1, 2)], "k int, v int")
    assert [tuple(r) for r in changes.upsert(empty, one, ["k"], {}).collect()] == [(1, 2)]
    assert [tuple(r) for r in changes.replace(one, empty, ["k"]).collect()] == [(1, 2)]


def test_group_concat_limits(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "x string")
    row = df.agg(aggregates.group_concat(F.col("x")).alias("all"), aggregates.group_concat(F.col("x"), distinct=True, sep="-").alias("d"), aggregates.group_concat(F.col("x"), most=3).alias("cut")).first()
    assert tuple(row) == ("a,b,b", "a-b", "a,b")
    assert df.where("false").agg(aggregates.group_concat(F.col("x"))).first()[0] is None


def test_inequality_counts_with_ties_and_nulls(spark):
    a = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,), (9.0,)], "x double")
    b = spark.createDataFrame([(2.0,), (2.0,), (None,), (0.5,), (3.0,)], "y double")
    assert {r["x"]: r["n"] for r in joins.less_than_counts(a, b, "x", "y").collect()} == {1.0: 1, 2.0: 1, 9.0: 4}


def test_left_range_join(spark):
    p = spark.createDataFrame([(1.5,), (7.0,), (None,)], "p double")
    r = spark.createDataFrame([(1.0, 2.0), (1.4, 30.0), (5.0, 4.0)], "lo double, hi double")
    got = joins.range_join(p, r, "p", "lo", "hi", 2.0, "left").select("p", "lo").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1.5, 1.0), (1.5, 1.4), (7.0, 1.4), (None, None)], key=str)


def test_any_with_nulls(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    sub = spark.createDataFrame([(5,), (None,)], "y int")
    assert [r["m"] for r in subqueries.compare_any(df, "x", "<", sub, "y", "m").collect()] == [True, None]
    assert [r["m"] for r in subqueries.compare_all(df, "x", "<", sub, "y", "m").collect()] == [None, None]


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = file_stream(spark, f"{tmp_path}/in", events.schema)
    q = append_batches(stream, f"{tmp_path}/out", f"{tmp_path}/c1")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == events.count()
    counts = windowed_counts(file_stream(spark, f"{tmp_path}/in", events.schema), "ts", ["event_type"], "1 day", late="3650 days")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("ashlar_counts").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    q.awaitTermination(120)
    batch = windowed_counts(events, "ts", ["event_type"], "1 day")
    assert sorted((str(r[0]), r[1], r[2]) for r in spark.table("ashlar_counts").collect()) == sorted((str(r[0]), r[1], r[2]) for r in batch.collect())


def test_view_refuses_rows_that_it_would_not_show(spark):
    rows = spark.createDataFrame([(1, "a"), (9, "b")], "k int, s string")
    with pytest.raises(Exception, match="CHECK OPTION"):
        changes.with_check_option(rows, F.col("k") < 5).collect()
    assert changes.with_check_option(rows.where("k = 1"), F.col("k") < 5).count() == 1


def test_wide_ranges_are_not_copied_often(spark):
    p = spark.createDataFrame([(x,) for x in (1.0, 700.0, 90_000.0, -3.0, 2_000_000.0)], "p double")
    r = spark.createDataFrame([(0.0, 10.0), (0.0, 1e6), (600.0, 800.0)], "lo double, hi double")
    for how in ("inner", "left"):
        got = joins.range_join(p, r, "p", "lo", "hi", 1.0, how).collect()
        want = [(x["p"], y["lo"], y["hi"]) for x in p.collect() for y in r.collect() if y["lo"] <= x["p"] <= y["hi"]]
        want += [(-3.0, None, None), (2_000_000.0, None, None)] if how == "left" else []
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_triggers_and_schedules(spark, tmp_path):
    from ashlar import procedures
    from ashlar.streaming import scheduled

    seen = []
    triggers = procedures.Triggers()
    triggers.create("t", lambda rows: seen.append(rows.count()))
    triggers.insert("t", spark.range(3), f"{tmp_path}/t")
    assert seen == [3] and spark.read.parquet(f"{tmp_path}/t").count() == 3
    ran = []
    q = scheduled(spark, lambda s, number: ran.append(number), 0.5, f"{tmp_path}/c")
    for _ in range(60):
        if len(ran) >= 2:
            break
        q.awaitTermination(1)
    q.stop()
    assert ran[:2] == [0, 1]


def test_result_cache_forgets_changed_tables(spark):
    from ashlar import procedures

    cache = procedures.ResultCache(spark)
    for _ in range(2):
        assert cache.query("SELECT count(*) AS n FROM r", {"r": spark.range(3)}).first()["n"] == 3
    cache.invalidate("r")
    assert cache.hits == 1 and cache.query("SELECT count(*) AS n FROM r", {"r": spark.range(5)}).first()["n"] == 5


def test_limit_reaches_the_scan_and_the_join(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = o.where("o_totalprice > 0").limit(3)._jdf.queryExecution().executedPlan().toString()
    assert "CollectLimit 3" in plan or "LocalLimit" in plan
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    plan = c.join(o, c.c_custkey == o.o_custkey, "left").limit(3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LocalLimit 3") == 2  # also on the side that is kept whole

