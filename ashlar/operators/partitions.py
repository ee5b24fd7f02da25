"""Table partitioning by RANGE, LIST, HASH and KEY as derived columns, written as folders that Spark prunes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_range(x: Column, bounds: list) -> Column:
    """The number of the first bound above x; NULL goes to the first partition, past the last bound to a last one."""
    out = F.when(x.isNull(), 0)
    for i, b in enumerate(bounds):
        out = out.when(x < F.lit(b), i)
    return out.otherwise(len(bounds))


def by_list(x: Column, lists: list[list]) -> Column:
    """The number of the list that holds x; a value in none raises, as a write does."""
    out = None
    for i, values in enumerate(lists):
        hit = x.isin([v for v in values if v is not None])
        hit = (hit | x.isNull()) if None in values else F.coalesce(hit, F.lit(False))
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out.otherwise(F.raise_error(F.lit("no partition for value")).cast("int"))


def by_hash(x: Column, n: int) -> Column:
    """HASH: |x mod n|; NULL as 0."""
    return F.abs(F.coalesce(x.cast("long"), F.lit(0)) % n).cast("int")


def by_key(n: int, *xs: Column) -> Column:
    return F.pmod(F.xxhash64(*xs), F.lit(n)).cast("int")


def write(df: DataFrame, path: str, parts: dict[str, Column], mode: str = "overwrite") -> None:
    """Rows are brought together by partition first, so that each folder gets few files."""
    out = df.withColumns(parts)
    out.repartition(*parts).write.mode(mode).partitionBy(*parts).parquet(path)


def write_subpartitioned(df: DataFrame, path: str, part: Column, subparts: int, *keys: Column, mode: str = "overwrite") -> None:
    """PARTITION BY .. SUBPARTITION BY HASH or KEY: folders within folders, both pruned."""
    sub = by_hash(keys[0], subparts) if len(keys) == 1 else by_key(subparts, *keys)
    write(df, path, {"part": part, "subpart": sub}, mode)
