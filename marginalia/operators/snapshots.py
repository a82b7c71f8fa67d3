"""Imports as snapshots with digests, so that a new one is compared with the last by reading only what differs.

Rows lie in leaves by a hash of their keys, some hundreds to a leaf, and leaves in folders by their first bits. A leaf's digest is a sum over the
digests of its rows, so it doesn't depend on their order, is combined before it is shuffled, and adds up to the digests of the nodes above: one
number of bits further up is a level, and two snapshots with leaves of different depth still have all levels of the shallower one in common.
`differing` goes down from the top, and follows only nodes whose digests differ.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Rounds, written
from .imports import PRESENTATION, compare

#: Rows meant for a leaf, bits from level to level, and bits of a folder's name.
LEAF_ROWS, STEP, FOLDER = 512, 4, 8
#: Parts of a row's SHA-256 that are added up, of 60 bits each: sums of 2^60 rows fit their decimals.
PARTS = 4
DIGEST = ["n", *(f"s{i}" for i in range(PARTS))]


def hashed(keys: list[str]) -> Column:
    """32 bits of the keys' hash, nulls included."""
    return F.pmod(F.xxhash64(*keys, *(F.col(k).isNull() for k in keys)), F.lit(1 << 32))


class Snapshot:
    """One import below a path: rows by (folder, leaf), and the digests of its leaves."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        shape = spark.read.parquet(f"{self.path}/shape").first()
        self.bits, self.total, columns = shape["bits"], shape["total"], shape["columns"]
        self.rows = spark.read.schema(f"{columns}, leaf bigint, folder int").parquet(f"{self.path}/rows")
        self.leaves = spark.read.schema("leaf bigint, n bigint, " + ", ".join(f"{d} decimal(38,0)" for d in DIGEST[1:])).parquet(f"{self.path}/leaves")

    @classmethod
    def write(cls, rows: DataFrame, path: str, keys: list[str], leaf_rows: int = LEAF_ROWS) -> Snapshot:
        """All columns of rows are kept and count; a key that several rows have is in one leaf, whose digest covers each of them."""
        spark = rows.sparkSession
        total = rows.count()
        bits = min(32, STEP * max(1, math.ceil(math.log2(max(2, total / leaf_rows)) / STEP)))
        leaf = F.shiftrightunsigned(hashed(keys), 32 - bits)
        at = rows.withColumn("leaf", leaf).withColumn("folder", F.shiftrightunsigned("leaf", max(0, bits - FOLDER)).cast("int"))
        at.repartitionByRange("folder", "leaf").sortWithinPartitions("folder", "leaf").write.partitionBy("folder").parquet(f"{path}/rows")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        kept = spark.read.schema(f"{columns}, leaf bigint, folder int").parquet(f"{path}/rows")
        sha = F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256)
        part = lambda i: F.sum(F.conv(F.substr("sha", F.lit(1 + 15 * i), F.lit(15)), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"s{i}")
        leaves = kept.withColumn("sha", sha).groupBy("leaf").agg(F.count("*").alias("n"), *(part(i) for i in range(PARTS)))
        leaves.write.parquet(f"{path}/leaves")
        spark.createDataFrame([(bits, total, columns)], "bits int, total bigint, columns string").write.parquet(f"{path}/shape")
        return cls(spark, path)

    def level(self, bits: int) -> DataFrame:
        """node and its digest, for all nodes of some bits."""
        node = F.shiftrightunsigned("leaf", self.bits - bits)
        return self.leaves.groupBy(node.alias("node")).agg(*(F.sum(d).alias(d) for d in DIGEST))

    def of(self, nodes: DataFrame, bits: int) -> DataFrame:
        """The rows of some nodes: of the folders that have any, those of their leaves."""
        names = nodes.select((F.shiftrightunsigned("node", bits - FOLDER) if bits > FOLDER else F.col("node")).alias("f")).distinct().collect()  # 2^FOLDER at most
        mine = [r["f"] for r in names]
        if self.bits < FOLDER or bits < FOLDER:  # folders of other widths: all that begin with the node's bits
            width = min(self.bits, FOLDER)
            mine = [f for f in range(1 << width) if (f >> max(0, width - bits)) in set(mine)]
        own = self.rows.filter(F.col("folder").isin(mine))
        return own.join(nodes, F.shiftrightunsigned(own["leaf"], self.bits - bits) == nodes["node"], "left_semi").drop("leaf", "folder")


def differing(old: Snapshot, new: Snapshot) -> tuple[DataFrame, int]:
    """node of the deepest common level, where the snapshots differ, and the bits of that level."""
    bits = min(old.bits, new.bits)
    with Rounds(old.spark) as rounds:
        nodes = None
        for b in range(STEP, bits + 1, STEP):
            a, c = old.level(b), new.level(b)
            if nodes is not None:
                below = nodes.select(F.col("node").alias("above"))
                a, c = (x.join(below, F.shiftrightunsigned(x["node"], STEP) == below["above"], "left_semi") for x in (a, c))
            same = F.lit(True)
            for d in DIGEST:
                same = same & F.col(f"a.{d}").eqNullSafe(F.col(f"c.{d}"))
            both = a.alias("a").join(c.alias("c"), F.col("a.node") == F.col("c.node"), "full_outer").filter(~same)
            nodes = rounds.cut(both.select(F.coalesce("a.node", "c.node").alias("node")))
            if nodes.isEmpty():
                break
        return written(nodes), bits


def changes(old: Snapshot, new: Snapshot, keys: list[str], presentation: tuple[str, ...] = PRESENTATION) -> DataFrame:
    """What `compare` says of all rows that aren't unchanged in every respect; rows of equal leaves aren't read."""
    nodes, bits = differing(old, new)
    found = compare(old.of(nodes, bits), new.of(nodes, bits), keys, presentation)
    return found.filter("class <> 'unchanged' OR presentation_changed")


def tally(old: Snapshot, new: Snapshot, keys: list[str], presentation: tuple[str, ...] = PRESENTATION) -> DataFrame:
    """class, n: as counted over the whole comparison; what isn't read is unchanged, and its number known."""
    found = changes(old, new, keys, presentation).groupBy("class").agg(F.count("*").alias("n"))
    gone = F.coalesce(F.sum(F.when(F.col("class").isin("new", "changed"), F.col("n"))), F.lit(0))
    rest = found.filter("class <> 'unchanged'").agg((F.lit(new.total) - gone).alias("n")).select(F.lit("unchanged").alias("class"), "n").filter("n > 0")
    return found.filter("class <> 'unchanged'").unionByName(rest)
