"""Places and pages against plain sorting; a large group isn't one task's."""

import random

from pyspark.sql import functions as F

from marginalia.operators import ranks


def test_ranked(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hub", "hub", "hub", "b", None]), rng.choice([None, *range(40)]), i) for i in range(600)] + [("one", 1, 600)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    got = ranks.ranked(df, ["g"], ["v", "i"]).collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    for g in {r[0] for r in rows}:
        want = sorted((r for r in rows if r[0] == g), key=key)
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        assert [tuple(r)[:3] for r in mine] == want and [r.place for r in mine] == list(range(len(want))) and {r.size for r in mine} == {len(want)}
    overall = ranks.ranked(df, [], ["v", "i"], "p", "n").collect()
    assert [tuple(r)[:3] for r in sorted(overall, key=lambda r: r.p)] == sorted(rows, key=key) and {r.n for r in overall} == {601}
    assert ranks.ranked(df.limit(0), ["g"], ["v"]).collect() == [] == ranks.ranked(df.limit(0), [], ["v"]).collect()


def test_a_large_group(spark):
    """A million members of one group, numbered in all partitions."""
    df = spark.range(1_000_000).select((F.col("id") * 7 % 1_000_003).alias("v"), F.lit("hub").alias("g"))
    at = ranks.ranked(df, ["g"], ["v"])
    assert at.agg(F.count_distinct("place"), F.min("place"), F.max("place"), F.max("size")).first() == (1_000_000, 0, 999_999, 1_000_000)
    assert at.join(at.select(F.col("place") - 1, F.col("v").alias("next")).toDF("place", "next"), "place").filter("next < v").count() == 0
    parts = [r.n for r in at.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(parts) >= 4 and max(parts) < 600_000


def test_paged(spark):
    rows = [("hub", f"{i:03}", i) for i in range(95)] + [("a", "x", 1), ("exact", "p", 1), ("exact", "q", 2), (None, "n", 3)]
    df = spark.createDataFrame(rows, "id string, other string, w int")
    got = {(r.id, r.page): r for r in ranks.paged(df, ["id"], ["other"], ["other", "w"], 2).collect()}
    assert len(got) == 48 + 1 + 1 + 1
    seen, page = [], got["hub", 0]
    while True:  # a reader follows the continuation keys
        seen += [(e.other, e.w) for e in page.entries]
        assert len(page.entries) <= 2 and page.size == 95 and page.pages == 48
        if page.next is None:
            break
        page = got["hub", page.page + 1]
        assert page.entries[0].other == got["hub", page.page - 1].next.other
    assert seen == [(f"{i:03}", i) for i in range(95)]
    assert got["exact", 0].next is None and [e.w for e in got["exact", 0].entries] == [1, 2] and got[None, 0].entries[0].other == "n"


def test_short_and_long_lists(spark):
    """Lists that one task orders and lists that many rank give the same pages; repeats count once where that is asked for."""
    rng = random.Random(2)
    rows = [(rng.choice(["hub", "hub", "b", "c", None]), rng.choice([None, *"pqrstuvw"]), rng.choice([None, 1, 2, 3])) for _ in range(150)]
    df = spark.createDataFrame(rows, "id string, other string, w int").repartition(5)
    shape = lambda p: sorted(((r.id, r.page, r.pages, r.size, [tuple(e) for e in r.entries], tuple(r.next) if r.next else None) for r in p.collect()), key=str)
    for once in (False, True):
        want = []
        for g in {r[0] for r in rows}:
            mine = sorted((set(rows) if once else rows), key=lambda r: [(v is not None, v if v is not None else 0) for v in r[1:]])
            mine = [r[1:] for r in mine if r[0] == g]
            want += [(g, i // 3, -(-len(mine) // 3), len(mine), mine[i : i + 3], mine[i + 3] if i + 3 < len(mine) else None) for i in range(0, len(mine), 3)]
        for long in (1, 60, 10**9):
            assert shape(ranks.paged(df, ["id"], ["other", "w"], ["other", "w"], 3, once=once, long=long)) == sorted(want, key=str), (once, long)
    assert ranks.paged(df.limit(0), ["id"], ["other"], ["other", "w"], 3).collect() == []


def test_short_lists_are_shuffled_once(spark):
    df = spark.range(1000).select((F.col("id") % 50).cast("string").alias("id"), F.col("id").cast("string").alias("other"))
    pages = ranks.paged(df, ["id"], ["other"], ["other"], 4, once=True)
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort ") == 1


def test_what_rows_give_is_not_shuffled(spark, sf, monkeypatch):
    """Columns that the rows' own give are made after the shuffle, short lists and long ones alike; and the more rows, the more tasks order them."""
    df = spark.range(900).select((F.col("id") % 7 * (F.col("id") % 3)).alias("key"), (F.col("id") * 7 % 60).alias("other_key")).repartition(5)
    shown = {"id": F.concat(F.lit("N-"), "key"), "other": F.concat(F.lit("O-"), "other_key")}
    shape = lambda p: sorted((r.id, r.page, r.size, [e.other for e in r.entries], r.next) for r in p.collect())
    want = shape(ranks.paged(df.withColumns(shown), ["id"], ["other"], ["other"], 4, once=True))
    for long in (1, 40, 10**9):
        assert shape(ranks.paged(df, ["id"], ["other"], ["other"], 4, once=True, long=long, shown=shown, near=["key"])) == want
    monkeypatch.setattr(ranks, "TASK_ROWS", 20)
    pages = ranks.paged(df, ["id"], ["other"], ["other"], 4, once=True, long=2000, shown=shown, near=["key"])
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort ") == 1 and "hashpartitioning(key" in plan and pages.rdd.getNumPartitions() >= 30 and shape(pages) == want


def test_hub_pages_shuffle_numbers(spark, sf):
    from marginalia.plans import registry

    plan = registry.QUERIES["q_hub_pages"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert len(moved) == 1 and "hashpartitioning(key" in moved[0]


def test_ends_are_the_buckets(spark, sf):
    from marginalia.operators import graph
    from marginalia.plans import bindings as B

    rows = lambda df: sorted(map(tuple, df.select("id", "bucket", "other", "label").collect()))
    assert rows(B.ends(spark, sf).withColumns(B.listed())) == rows(graph.buckets(graph.every_relation(B.relations(spark, sf), B.depends(spark, sf))))
