"""Snapshots against a full comparison, and what a comparison reads."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import imports, snapshots
from marginalia.operators.snapshots import Snapshot

SHOWN = ("title",)


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "paper string, source_key string, content_hash string, title string")


@pytest.mark.parametrize(("n", "more"), [(0, 5), (5, 0), (40, 3), (900, 6000)])
def test_against_compare(spark, tmp_path, n, more):
    rng = random.Random(n)
    old = [(rng.choice(["p", None]), f"k{i}", f"h{i}", None if i % 3 else "t") for i in range(n)]
    new = [(p, k, h + "x" if i % 50 == 7 else h, "u" if i % 90 == 8 else t) for i, (p, k, h, t) in enumerate(old) if i % 70 != 3] + [("p", f"m{i}", "h", None) for i in range(more)]
    a, b = rows(spark, old), rows(spark, new)
    keys = ["paper", "source_key"]
    a, b = (x.withColumn("paper", F.coalesce("paper", F.lit("none"))) for x in (a, b))
    one, two = Snapshot.write(a, f"file://{tmp_path}/a", keys, 16), Snapshot.write(b.repartition(7), f"file://{tmp_path}/b", keys, 16)
    whole = {tuple(r) for r in imports.compare(a, b, keys, SHOWN).collect()}
    assert {tuple(r) for r in snapshots.changes(one, two, keys, SHOWN).collect()} == {r for r in whole if r[2] != "unchanged" or r[3]}
    counts = {}
    for r in whole:
        counts[r[2]] = counts.get(r[2], 0) + 1
    assert {r["class"]: r.n for r in snapshots.tally(one, two, keys, SHOWN).collect()} == counts
    again = Snapshot(spark, f"file://{tmp_path}/a")
    assert snapshots.changes(one, again, keys, SHOWN).collect() == [] and snapshots.differing(one, again)[0].count() == 0


def test_equal_leaves_are_not_read(spark, tmp_path):
    """One changed row of 20,000: a leaf of some hundred rows, in one of 256 folders."""
    base = spark.range(20_000).select(F.lit("p").alias("paper"), F.col("id").cast("string").alias("source_key"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.lit("t").alias("title"))
    keys = ["paper", "source_key"]
    one = Snapshot.write(base, f"file://{tmp_path}/a", keys, 64)
    two = Snapshot.write(base.withColumn("content_hash", F.when(F.col("source_key") == "777", "new").otherwise(F.col("content_hash"))), f"file://{tmp_path}/b", keys, 64)
    nodes, bits = snapshots.differing(one, two)
    assert nodes.count() == 1 and bits == 12
    read = two.of(nodes, bits)
    assert 0 < read.count() < 60
    leaf = nodes.first()[0]
    scan = two.rows.filter(F.col("folder") == leaf >> 4).select("leaf")
    scan.collect()
    files = lambda df: sum(leaves.apply(i).metrics().apply("numFiles").value() for leaves in [df._jdf.queryExecution().executedPlan().collectLeaves()] for i in range(leaves.size()))
    every = two.rows.select("leaf")
    every.collect()
    assert files(scan) * 100 < files(every)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "folder" in plan.split("PartitionFilters")[1][:200]
    assert [tuple(r) for r in snapshots.changes(one, two, keys, SHOWN).collect()] == [("p", "777", "changed", False)]
