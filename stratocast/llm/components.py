"""Connected components of links, by alternating large-star and small-star steps.

Each step is a partial aggregation (the smallest neighbour) and a join, so a
node of any degree is spread; both sides of a join are written tables, whose
skewed partitions Spark can split. Nodes shrink to stars on their smallest
member in a number of rounds that grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocast.storage import stored


def _toward(links: DataFrame, large: bool) -> DataFrame:
    """Large star: larger neighbours of each node go to its smallest one. Small star: smaller ones do, and the node."""
    if large:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stored(both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m")))
    met = both.join(least, "u")
    out = met.where("v > u") if large else met
    moved = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return stored(moved.where("u <> v").distinct())


def components(links: DataFrame, a: str, b: str, rounds: int = 100) -> DataFrame:
    """`node`, `root` for every linked node; the root is the smallest node of its component."""
    now = stored(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    before = None
    for _ in range(rounds):
        now = _toward(_toward(now, True), False)
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise ValueError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
