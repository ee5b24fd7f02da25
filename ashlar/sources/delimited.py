"""LOAD DATA and SELECT .. INTO OUTFILE over delimited text."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashlar.functions import coerce, dates


@dataclass(frozen=True)
class TextFormat:
    terminated: str = "\t"
    enclosed: str = ""
    optionally: bool = True
    escaped: str = "\\"
    lines: str = "\n"
    starting: str = ""
    ignore: int = 0
    null: str = "\\N"
    charset: str = "UTF-8"
    date_format: str = "yyyy-MM-dd"
    timestamp_format: str = "yyyy-MM-dd HH:mm:ss"


def load(spark: SparkSession, path: str, schema: T.StructType | str, fmt: TextFormat = TextFormat(), bad_rows: str | None = None) -> DataFrame:
    """Typed rows of a delimited text.

    Without ``bad_rows`` a row that doesn't fit its types raises; with it such rows keep their text
    in the column so named.  Header lines are left out file by file, a prefix that lines start
    with is taken off, a byte order mark is read over by the reader.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else spark.createDataFrame([], schema).schema
    options = {
        "sep": fmt.terminated, "quote": fmt.enclosed, "escape": fmt.escaped, "nullValue": fmt.null, "encoding": fmt.charset,
        "dateFormat": fmt.date_format, "timestampNTZFormat": fmt.timestamp_format, "timestampFormat": fmt.timestamp_format, "mode": "FAILFAST",
    }
    if bad_rows:
        schema = T.StructType([*schema.fields, T.StructField(bad_rows, T.StringType())])
        options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad_rows}
    if not fmt.starting and fmt.ignore <= 1 and fmt.lines in ("\n", "\r\n", "\r"):
        return spark.read.schema(schema).options(**options, header=str(fmt.ignore == 1).lower(), enforceSchema="true").csv(path)
    text = spark.read.option("lineSep", fmt.lines).option("encoding", fmt.charset).text(path)
    if fmt.ignore:
        # lines are counted within their file: a file's rows come in order from blocks that know their offset
        from pyspark.sql import Window

        where = F.struct(F.input_file_name().alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
        text = text.withColumn("w", where)
        heads = text.where("w.b = 0").withColumn("n", F.row_number().over(Window.partitionBy("w.f").orderBy("w.i"))).where(F.col("n") > fmt.ignore).drop("n")
        text = heads.unionByName(text.where("w.b > 0")).select("value")
    if fmt.starting:
        at = F.locate(fmt.starting, F.col("value"))
        text = text.where(at > 0).select(F.substring(F.col("value"), at + len(fmt.starting), F.lit(1 << 30)).alias("value"))
    parsed = text.select(F.from_csv("value", F.lit(spark.createDataFrame([], schema).schema.simpleString()[7:-1].replace(":", " ")), options).alias("r"))
    return parsed.select("r.*")


def export(df: DataFrame, path: str, fmt: TextFormat = TextFormat(), mode: str = "error") -> None:
    """INTO OUTFILE; binary columns as hexadecimal digits, lines ended as the format says (CRLF too)."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        c = F.hex(c) if kind == "binary" else F.date_format(c, fmt.timestamp_format) if kind in ("timestamp", "timestamp_ntz") else F.date_format(c, fmt.date_format) if kind == "date" else c
        text = c.cast("string")
        if fmt.escaped:
            for ch in dict.fromkeys((fmt.escaped, fmt.enclosed or fmt.terminated, "\n")):
                text = F.replace(text, F.lit(ch), F.lit(fmt.escaped + ("n" if ch == "\n" else ch)))
        quoted = bool(fmt.enclosed) and (not fmt.optionally or kind in ("string", "date", "timestamp", "timestamp_ntz", "binary"))
        if quoted:
            text = F.concat(F.lit(fmt.enclosed), text, F.lit(fmt.enclosed))
        cols.append(F.coalesce(text, F.lit(fmt.null)))
    line = F.concat(F.lit(fmt.starting), F.concat_ws(fmt.terminated, *cols))
    df.select(line.alias("value")).write.mode(mode).option("lineSep", fmt.lines).option("encoding", fmt.charset).text(path)


def dump(df: DataFrame) -> bytes:
    """INTO DUMPFILE: the one value of the one row, raw."""
    rows = df.limit(2).collect()
    if len(rows) != 1 or len(rows[0]) != 1:
        raise ValueError("a dump needs one row of one column")
    v = rows[0][0]
    return bytes(v) if isinstance(v, (bytes, bytearray)) else str(v).encode()


def write_sorted(df: DataFrame, path: str, by: list[str], mode: str = "error") -> None:
    """Rows in ranges of ``by``, each file sorted, so that row groups have narrow bounds."""
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode(mode).parquet(path)


def parse_fields(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns of a load as the dialect's types: int, bigint, decimal(p,s), double, date, datetime, time, year.

    ``int`` and its like are held within their range; a date or time that isn't one is NULL.
    """
    out = {}
    for name, kind in kinds.items():
        c = F.col(f"`{name}`")
        if kind in coerce.RANGES:
            out[name] = coerce.clamp(coerce.to_number(c), kind)
        elif kind.startswith("decimal"):
            digits, scale = (int(x) for x in kind[8:-1].split(","))
            out[name] = coerce.decimal(c, digits, scale)
        elif kind == "double":
            out[name] = coerce.to_number(c)
        elif kind == "date":
            out[name] = F.regexp_replace(F.trim(c), r"[./]", "-").try_cast("date")
        elif kind == "datetime":
            out[name] = F.trim(c).try_cast("timestamp_ntz")
        elif kind == "time":
            out[name] = dates.parse_time(c)
        elif kind == "year":
            out[name] = coerce.year(c)
        else:
            raise ValueError(kind)
    return rows.withColumns(out)


def load_local(spark: SparkSession, source: Iterable[bytes], path: str, schema: str, fmt: TextFormat = TextFormat(), chunk: int = 50_000) -> DataFrame:
    """LOAD DATA LOCAL: the client's lines, from an open file or a pipe, are handed to the cluster ``chunk`` at a time and then loaded."""
    lines: list[tuple[str]] = []

    def hand_over() -> None:
        # one file a chunk: the order of lines is kept
        spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").option("lineSep", fmt.lines).text(path)
        lines.clear()

    for i, line in enumerate(source):
        text = line.decode(fmt.charset).removeprefix("\ufeff") if not i else line.decode(fmt.charset)
        lines.append((text.rstrip("\r\n"),))
        if len(lines) >= chunk:
            hand_over()
    if lines:
        hand_over()
    return load(spark, path, schema, fmt)
