"""Fixed-size binary records, and the file parser plug-in."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\n"
_KINDS = {"<i2": "short", "<i4": "int", "<i8": "long", "<f4": "float", "<f8": "double"}


def load_binary(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Files of little-endian records; ``fields`` gives each field's numpy kind (``<i4``, ``<f8``, ``S10``).

    Spark cuts the files at record ends itself (fixed-length records), so that a file of any size
    is read by many tasks.
    """
    size = np.dtype([(k, v) for k, v in fields.items()]).itemsize
    return unpack(spark.sparkContext.binaryRecords(path, size).map(lambda r: (bytearray(r),)).toDF("record binary"), fields)


def pack(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Typed columns as one column ``record`` of little-endian records, all of one size."""
    kind = np.dtype([(k, v) for k, v in fields.items()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros(len(b), dtype=kind)
            for k, v in fields.items():
                out[k] = [x.encode() for x in b[k]] if v.startswith("S") else b[k]
            yield pd.DataFrame({"record": [r.tobytes() for r in out]})

    return rows.select(*fields).mapInPandas(run, "record binary")


def write_binary(packed: DataFrame, path: str) -> None:
    """Files of the records, one a partition; the text writer puts their bytes down as they are, and after each the byte ``END``, a last field of kind S1."""
    packed.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).text(path)


def unpack(raw: DataFrame, fields: dict[str, str]) -> DataFrame:
    """A column ``record`` of binary records as typed columns."""
    kind = np.dtype([(k, v) for k, v in fields.items()])
    schema = ", ".join(f"{k} {_KINDS.get(v, 'string')}" for k, v in fields.items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = np.frombuffer(b"".join(map(bytes, b["record"])), dtype=kind)
            yield pd.DataFrame({k: [x.rstrip(b"\0 ").decode() for x in rows[k]] if v.startswith("S") else rows[k] for k, v in fields.items()})

    return raw.mapInPandas(run, schema)


def parse_files(spark: SparkSession, path: str, parser: Callable[[bytes], Iterable[tuple | None]], schema: str, glob: str | None = None) -> DataFrame:
    """The parser plug-in: ``parser`` makes rows of one file's bytes; a row that is None is bad.

    Columns of the schema, then ``path``, ``row`` (from 0 in its file) and ``bad``.  Files are read
    by Spark, from any store it reads, one file in a worker's memory at a time.
    """
    names = spark.createDataFrame([], schema).columns
    files = spark.read.format("binaryFile")
    files = (files.option("pathGlobFilter", glob) if glob else files).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                rows = [(*(r if r is not None else (None,) * len(names)), file, i, r is None) for i, r in enumerate(parser(bytes(content)))]
                yield pd.DataFrame(rows, columns=[*names, "path", "row", "bad"])

    return files.mapInPandas(run, f"{schema}, path string, row long, bad boolean")
