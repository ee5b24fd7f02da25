"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import forget, join_hot, stored


def _stars(edges: DataFrame, most: int) -> DataFrame:
    """A large-star and a small-star step over (a, b) with a > b, at most ``most`` of them.

    Minima are taken by partial aggregation, and nodes of high degree meet theirs by broadcast.  Such nodes are the
    least of their neighbours, or soon are, so that they have few lesser ones in the second step.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    down = join_hot(both, least, "u", "n", 2 * most).where("v > u AND v <> m").select("v", "m").distinct()
    least = down.groupBy("v").agg(F.min("m").alias("l"))
    moved = down.join(least, "v").select(F.col("m").alias("a"), F.col("l").alias("b"))
    return moved.unionByName(least.select(F.col("v").alias("a"), F.col("l").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) long, in any order -> (node, root): each node of an edge with the least node of its component.

    Self edges are left out; no edges give no rows.  Each round is written to the shared folder,
    so that a lost executor costs one round at most, and the round before is deleted; it ends when a round changes nothing.
    """
    # the same edges again: by number and an order-free sum of hashes
    marks = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")]
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(now, "components")
    mark = now.agg(*marks).first()
    for _ in range(most_rounds):
        if not mark["n"]:
            break
        done, old, now = mark, now, stored(_stars(now, mark["n"]), "components")
        mark = now.agg(*marks).first()
        forget(old)
        if mark == done:
            break
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
