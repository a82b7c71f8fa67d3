"""Connected components of links between documents, by alternating large-star and small-star rounds in DataFrame operations.

Each round is a map-side combined minimum by node and a join, whose hot nodes adaptive execution splits; nothing is collected by node.
Every round's links are cut off from their lineage in the shared checkpoint folder. The number of rounds grows with the logarithm of the
number of links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.join(least, both["u"] == least["k"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    moved = down.join(least, down["u"] == least["k"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that each node of the links reaches, itself included. Null ends and loops link nothing."""
    now = cut(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    sign = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
    old = None
    while (new := sign(now)) != old and new[0]:
        old = new
        now = cut(_small(_large(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
