"""Facet bitmaps against plain filters."""

import random

import pytest

from marginalia.operators.facets import FacetIndex


def test_facets(spark):
    rng = random.Random(5)
    rows = [(f"N-{i:03}", rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "y"]), rng.choice([None, [], ["P"], ["P", "Q", "P"], ["R", None]])) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, kind string, state string, projects array<string>").repartition(6)
    index = FacetIndex.build(df, ["kind", "state", "projects"])
    has = lambda r, f, vs: bool({"kind": {r[1]}, "state": {r[2]}, "projects": set(r[3] or [])}[f] & set(vs))
    for chosen in ({}, {"kind": ["a"]}, {"kind": ["b"], "state": ["x"]}, {"kind": ["a", "b"], "state": [], "projects": ["Q", "R"]}, {"kind": ["none"], "state": ["x"]}):
        for inner in (None, {r[0] for r in rows[:90]}, set()):
            within = None if inner is None else spark.createDataFrame([(i,) for i in inner], "id string")
            base = [r for r in rows if inner is None or r[0] in inner]
            got = {(r.facet, r.value): (r.total, r.n, r.chosen) for r in index.counts(chosen, within).collect()}
            want = {}
            for f, values in (("kind", "ab"), ("state", "xy"), ("projects", "PQR")):
                for v in values:
                    others = [r for r in base if all(has(r, g, vs) for g, vs in chosen.items() if vs and g != f)]
                    want[f, v] = (sum(has(r, f, [v]) for r in rows), sum(has(r, f, [v]) for r in others), v in chosen.get(f, []))
            assert got == want
            assert {r.id for r in index.ids(chosen, within).collect()} == {r[0] for r in base if all(has(r, g, vs) for g, vs in chosen.items() if vs)}
    with pytest.raises(ValueError, match="No such facet"):
        index.counts({"color": ["red"]})


def test_many_buckets(spark):
    """More records than a bitmap has bits; a choice that has none in some of them."""
    df = spark.range(100_000).selectExpr("id", "case when id < 40000 then 'low' else 'high' end AS half", "cast(id % 3 AS string) AS rest")
    index = FacetIndex.build(df, ["half", "rest"])
    got = {(r.facet, r.value): r.n for r in index.counts({"half": ["low"], "rest": ["1"]}).collect()}
    assert got == {("half", "low"): 13333, ("half", "high"): 20000, ("rest", "0"): 13334, ("rest", "1"): 13333, ("rest", "2"): 13333}
    assert index.ids({"half": ["low"], "rest": ["1"]}).selectExpr("count(*)", "min(id)", "max(id)", "count_if(id % 3 <> 1 OR id >= 40000)").first() == (13333, 1, 39997, 0)
    assert index.counts().filter("n <> total").count() == 0
