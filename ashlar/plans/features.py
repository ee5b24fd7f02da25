"""Other features: full text, partitions, metadata answers, changes, files, memory tables, UDFs, windows over time."""

from __future__ import annotations

import tempfile

import pandas as pd
from pyspark.sql import functions as F

from ashlar.operators import changes, fulltext, partitions, rough
from ashlar.plans.registry import register, table
from ashlar.sources import delimited, memory, records
from ashlar.streaming import windowed_counts

_WORDS = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_'']+'), lambda w: length(w) BETWEEN 4 AND 84)"


def scratch(spark) -> str:
    """A folder that all executors share, or of our own where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        import uuid

        return f"{base.rstrip('/')}/ashlar-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="ashlar-")


@register(
    "fulltext_natural",
    f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS word FROM d), f AS (SELECT doc_id, word, count(*) AS tf FROM t GROUP BY ALL),
    n AS (SELECT doc_id, count(*) AS u, sum(ln(tf) + 1) AS logs FROM f GROUP BY doc_id), q AS (SELECT f.doc_id, word, (ln(tf) + 1) / logs * u / (1 + 0.0115 * u) AS weight FROM f JOIN n USING (doc_id) WHERE word IN ('reading', 'thing', 'token', 'password')),
    i AS (SELECT word, count(*) AS df FROM q GROUP BY word), g AS (SELECT word, ln(((SELECT count(*) FROM documents) - df) / df) AS idf FROM i WHERE df * 2 <= (SELECT count(*) FROM documents))
    SELECT doc_id, round(sum(weight * idf), 6) AS score FROM q JOIN g USING (word) GROUP BY doc_id HAVING sum(weight * idf) > 0""",
)
def fulltext_natural(spark, d):
    found = fulltext.match_natural(table(spark, d, "documents"), "doc_id", "text", "reading thing token password")
    return found.select("doc_id", F.round("score", 6).alias("score"))


@register(
    "fulltext_boolean",
    r"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_'']+') AS w FROM documents)
    SELECT doc_id FROM d WHERE list_contains(w, 'the') AND NOT list_contains(w, 'password') AND len(list_filter(w, lambda x: starts_with(x, 'than') AND length(x) <= 84)) > 0 AND regexp_matches(t, '(^|[^\p{L}\p{N}_''])of[^\p{L}\p{N}_'']+the($|[^\p{L}\p{N}_''])')""",
)
def fulltext_boolean(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(fulltext.boolean_condition(F.col("text"), '+the -password +than* +"of the"')).select("doc_id")


@register("partition_pruning", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_custkey % 4 = 3 AND year(o_orderdate) >= 1995")
def partition_pruning(spark, d):
    path = scratch(spark)
    years = partitions.by_range(F.year("o_orderdate"), [1993, 1995, 1997])
    partitions.write(table(spark, d, "orders"), path, {"part_h": partitions.by_hash(F.col("o_custkey"), 4), "part_y": years})
    kept = spark.read.parquet(path).where("part_h = 3 AND part_y >= 2").where(F.year("o_orderdate") >= 1995)
    return kept.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))


@register("rough_answer", "SELECT count(*) AS rows, min(l_orderkey) AS low, max(l_orderkey) AS high, 'SOME' AS rough FROM lineitem")
def rough_answer(spark, d):
    return rough.rough_filter(rough.metadata_aggregate(spark, f"{d}/lineitem.parquet", ["l_orderkey"]), "l_orderkey", 100, 200)


@register("replace_rows", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'new' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'new', 9")
def replace_rows(spark, d):
    n = table(spark, d, "nation")
    new = n.where("n_nationkey < 5").withColumn("n_name", F.lit("new")).unionByName(spark.createDataFrame([(100, "new", 9)], "n_nationkey int, n_name string, n_regionkey int"))
    return changes.replace(n, new, ["n_nationkey"])


@register("upsert_rows", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey < 5 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL SELECT 200, 'added', 10")
def upsert_rows(spark, d):
    n = table(spark, d, "nation")
    new = n.where("n_nationkey < 5").withColumn("n_regionkey", F.lit(10)).unionByName(spark.createDataFrame([(200, "added", 10)], "n_nationkey int, n_name string, n_regionkey int"))
    return changes.upsert(n, new, ["n_nationkey"], {"n_regionkey": F.col("old.n_regionkey") + F.col("new.n_regionkey")})


@register("update_delete_join", "SELECT s_suppkey, CASE WHEN n_regionkey = 1 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2")
def update_delete_join(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    s = changes.update_join(s, n.where("n_regionkey = 1").select("s_nationkey"), "s_nationkey", {"s_acctbal": F.lit(0.0)})
    return changes.delete_join(s, n.where("n_regionkey = 2"), ["s_nationkey"]).select("s_suppkey", "s_acctbal")


@register("insert_select", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region WHERE r_regionkey > 1")
def insert_select(spark, d):
    return changes.insert_select(table(spark, d, "nation").select(F.col("n_name").alias("name")), table(spark, d, "region").where("r_regionkey > 1").select(F.col("r_name").alias("name")))


@register("export_and_load", "SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment || ';\"' END AS seg FROM customer")
def export_and_load(spark, d):
    path = scratch(spark) + "/out"
    fmt = delimited.TextFormat(terminated=";", enclosed='"')
    seg = F.when(F.col("c_custkey") % 5 != 0, F.concat("c_mktsegment", F.lit(';"')))
    delimited.export(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", seg.alias("seg")), path, fmt)
    return delimited.load(spark, path, "c_custkey long, c_name string, c_acctbal double, seg string", fmt)


@register("binary_records", "SELECT n_nationkey AS k, n_name AS name, n_regionkey / 2 AS half FROM nation")
def binary_records(spark, d):
    """Records are written by Spark, as whole files of little-endian fields, and read back."""
    path = scratch(spark) + "/records"
    rows = table(spark, d, "nation")

    def pack(batches):
        import struct

        for b in batches:
            yield pd.DataFrame({"r": [struct.pack("<i16sd", k, n.encode(), g / 2) for k, n, g in zip(b["n_nationkey"], b["n_name"], b["n_regionkey"], strict=True)]})

    packed = rows.mapInPandas(pack, "r binary").rdd.map(lambda r: (None, bytes(r["r"])))
    packed.map(lambda x: (bytearray(b"k"), bytearray(x[1]))).saveAsNewAPIHadoopFile(path, "org.apache.hadoop.mapreduce.lib.output.SequenceFileOutputFormat", "org.apache.hadoop.io.BytesWritable", "org.apache.hadoop.io.BytesWritable")
    held = spark.sparkContext.sequenceFile(path).map(lambda kv: (bytearray(kv[1]),)).toDF("record binary")
    return records.unpack(held, {"k": "<i4", "name": "S16", "half": "<f8"})


@register("memory_tables", "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS s, max(o_orderkey) AS m FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F') GROUP BY o_orderstatus")
def memory_tables(spark, d):
    mt = memory.MemoryTables(spark)
    o = table(spark, d, "orders")
    mt.add("ashlar_orders", o)
    mt.append("ashlar_orders", o.where("o_orderstatus = 'F'"))
    return mt.calc("ashlar_orders", ["o_orderstatus"], {"o_totalprice": "sum", "o_orderkey": "max"}).select("o_orderstatus", F.round("sum_o_totalprice", 2).alias("s"), F.col("max_o_orderkey").alias("m"))


@register("scalar_udf", "SELECT p_partkey, (p_size * 2 + length(p_name))::BIGINT AS v FROM part")
def scalar_udf(spark, d):
    @F.pandas_udf("long")
    def weigh(size: pd.Series, name: pd.Series) -> pd.Series:
        return size.astype("int64") * 2 + name.str.len()

    return table(spark, d, "part").select("p_partkey", weigh("p_size", "p_name").alias("v"))


@register("aggregate_udf", "SELECT s_nationkey, round(median(s_acctbal), 4) AS m FROM supplier GROUP BY s_nationkey")
def aggregate_udf(spark, d):
    @F.pandas_udf("double")
    def middle(x: pd.Series) -> float:
        return float(x.median())

    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.round(middle("s_acctbal"), 4).alias("m"))


@register("table_procedure", "SELECT n_regionkey, count(*) AS n, min(n_name) AS first FROM nation GROUP BY n_regionkey")
def table_procedure(spark, d):
    def finish(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n_regionkey": [b["n_regionkey"].iloc[0]], "n": [len(b)], "first": [b["n_name"].min()]})

    return table(spark, d, "nation").groupBy("n_regionkey").applyInPandas(finish, "n_regionkey int, n long, first string")


@register("windowed_events", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS h, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def windowed_events(spark, d):
    out = windowed_counts(table(spark, d, "events"), "ts", ["event_type"], "1 hour")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("h"), "event_type", "n", F.round("total", 2).alias("total"))


@register("pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, max(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS p FROM orders GROUP BY o_orderpriority")
def pivot(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(s == "F").alias("f"), F.count_if(s == "O").alias("o"), F.max(F.when(s == "P", F.col("o_orderkey"))).alias("p"))


@register("merge_union_tables", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation) GROUP BY k")
def merge_union_tables(spark, d):
    parts = [table(spark, d, t).select(F.col(c).alias("k")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("k").agg(F.count("*").alias("n"))


@register("xml_values", "SELECT n_nationkey, n_name AS name, n_regionkey::VARCHAR || ' x' AS parts FROM nation")
def xml_values(spark, d):
    from ashlar.functions import xml

    doc = F.concat(F.lit("<a><n>"), F.col("n_name"), F.lit("</n><p>"), F.col("n_regionkey").cast("string"), F.lit("</p><p>x</p></a>"))
    return table(spark, d, "nation").select("n_nationkey", xml.extract_value(doc, "/a/n").alias("name"), xml.extract_value(doc, "/a/p").alias("parts"))


@register("spatial_rectangles", "SELECT a.s_suppkey AS a, b.n_nationkey AS b FROM supplier a JOIN nation b ON abs(a.s_suppkey % 25 - b.n_nationkey) <= 2")
def spatial_rectangles(spark, d):
    """Rectangles two wide meet within a range join on their left ends, then by the exact predicate."""
    from ashlar.functions import spatial
    from ashlar.operators import joins

    wkt = lambda x: F.concat(F.lit("LINESTRING("), x.cast("string"), F.lit(" 0,"), (x + 2).cast("string"), F.lit(" 1)"))
    a = table(spark, d, "supplier").select("s_suppkey", spatial.rectangle(wkt(F.col("s_suppkey") % 25)).alias("ra")).withColumn("x", F.col("ra.x1"))
    b = table(spark, d, "nation").select("n_nationkey", spatial.rectangle(wkt(F.col("n_nationkey"))).alias("rb"))
    b = b.withColumn("lo", F.col("rb.x1") - 2).withColumn("hi", F.col("rb.x2"))
    met = joins.range_join(a, b, "x", "lo", "hi", 4.0).where(spatial.intersects(F.col("ra"), F.col("rb")))
    return met.select(F.col("s_suppkey").alias("a"), F.col("n_nationkey").alias("b"))


@register("aes_round_trip", "SELECT c_custkey, c_name AS back, 1 AS wrong_is_null FROM customer")
def aes_round_trip(spark, d):
    from ashlar.functions import crypto

    secret = crypto.aes_encrypt(F.col("c_name"), "a key longer than sixteen bytes")
    c = table(spark, d, "customer").select("c_custkey", "c_name", secret.alias("e"))
    return c.select(
        "c_custkey", crypto.aes_decrypt(F.col("e"), "a key longer than sixteen bytes").cast("string").alias("back"),
        F.coalesce((crypto.aes_decrypt(F.col("e"), "another").cast("string") != F.col("c_name")).cast("int"), F.lit(1)).alias("wrong_is_null"),
    )


@register("metadata_tables", "SELECT 'n_nationkey' AS column_name, 1 AS ordinal_position, 'int' AS data_type UNION ALL SELECT 'n_name', 2, 'string' UNION ALL SELECT 'n_regionkey', 3, 'int'")
def metadata_tables(spark, d):
    from ashlar.sources import catalog

    table(spark, d, "nation").createOrReplaceTempView("ashlar_nation")
    return catalog.columns(spark, "ashlar_nation").select("column_name", "ordinal_position", "data_type")


@register("sorted_write", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01' AND o_orderdate < TIMESTAMP '1996-07-01' GROUP BY o_orderstatus")
def sorted_write(spark, d):
    """Rows are laid out by date first, so that the filter skips row groups."""
    path = scratch(spark) + "/sorted"
    delimited.write_sorted(table(spark, d, "orders"), path, ["o_orderdate"])
    t = F.col("o_orderdate")
    kept = spark.read.parquet(path).where((t >= F.lit("1996-06-01").cast("timestamp")) & (t < F.lit("1996-07-01").cast("timestamp")))
    return kept.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@register("dialect_text", "SELECT n_regionkey, count(*) AS n, round(stddev_pop(n_nationkey), 6) AS s, max(strlen(n_name))::INT AS l FROM nation GROUP BY n_regionkey ORDER BY n_regionkey LIMIT 3 OFFSET 1")
def dialect_text(spark, d):
    from ashlar import dialect

    text = "SELECT SQL_CALC_FOUND_ROWS n_regionkey, count(*) AS n, round(std(n_nationkey), 6) AS s, max(length(n_name)) AS l FROM nation GROUP BY n_regionkey ORDER BY n_regionkey LIMIT 1, 3"
    return dialect.query(spark, text, nation=table(spark, d, "nation"))
