"""The trigram index against a scan, and how much of it a search reads."""

import random

from pyspark.sql import functions as F

from marginalia.operators import search
from marginalia.operators.trigrams import TrigramIndex


def read(df, name):
    """A number that the scan of a plan without shuffles counts while it runs."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply(name).value() for i in range(leaves.size()))


def test_same_as_a_scan(spark, tmp_path):
    rng = random.Random(3)
    bits = ["ab", "abc", "B", " ", "é", "\U0001f642", "日本", "aaa", ".", "\n", "%", "_", "\\", "x"]
    texts = [None, "", "a", "ab", "ABC"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(300)]
    rows = [(i, t, "P" if i % 2 else "Q") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, haystack string, type string").repartition(5)
    index = TrigramIndex.build(df, f"file://{tmp_path}/x", buckets=8, block=16, part=50)
    for q in ("abc", "ab", "\U0001f642a", "aaaa", "é\U0001f642日", "日本", "%_", "b\\", "a b", "", " ABC ", "nothing", "x.", "\n", "日本日"):
        want = {i for i, t, _ in rows if q.strip().lower() in (t or "").lower()}
        got = [r.id for r in index.search(q).collect()]
        assert len(got) == len(set(got)) and set(got) == want, q
    shown = search.indexed_filter(df, TrigramIndex(spark, f"file://{tmp_path}/x"), "abc", type="P")
    assert {r.id for r in shown.collect()} == {i for i, t, p in rows if p == "P" and "abc" in (t or "").lower()}
    assert {r.id for r in search.indexed_filter(df, index, " ", type="P").collect()} == {i for i, _, p in rows if p == "P"}
    empty = TrigramIndex.build(df.limit(0), f"file://{tmp_path}/y")
    assert empty.search("abc").collect() == [] and empty.search("a").collect() == []


def test_reads_in_proportion(spark, tmp_path):
    """A rare trigram's postings are one bucket's file and its block's part of the texts; the rest of the index isn't opened."""
    rng = random.Random(4)
    df = spark.createDataFrame([(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(6)) + (" quux" if i == 777 else "")) for i in range(2000)], "id long, haystack string")
    index = TrigramIndex.build(df, f"file://{tmp_path}/x", buckets=32, block=64, part=100)
    assert index.chosen("a quux")[0] in (" qu", "quu", "uux", "a q") and index.chosen("zzz") is None
    rare, hot = index._looked_up(index.postings, ["quu"]), index._looked_up(index.postings, ["lph", "amm"])
    every = read(index.postings.select("gram"), "numFiles")
    assert read(rare.select("ns"), "numFiles") <= 2 < every // 4 and rare.count() == 1 and hot.count() > 40
    assert read(index.texts.filter("part = 7").select("text"), "numFiles") < read(index.texts.select("text"), "numFiles") // 4
    assert [r.id for r in index.search("A QUUX").collect()] == [777]
    assert index.search("alpha b").count() == df.filter(F.col("haystack").contains("alpha b")).count()


def test_postings_of_a_task():
    """Trigrams of a task are put together before they leave it, block by block, as a plain loop finds them."""
    from marginalia.operators import trigrams

    texts = ["abcabc", "", "ab", "xabc\U0001f642日本", "b\x00\x00\x00c", "\U0010ffff" * 4, "abc"]
    batch = lambda lo, hi: trigrams.pa.RecordBatch.from_arrays([trigrams.pa.array(range(lo, hi), trigrams.pa.int64()), trigrams.pa.array([t.encode() for t in texts[lo:hi]], trigrams.pa.binary())], ["n", "text"])
    out = [r for b in trigrams.posted(iter([batch(0, 3), batch(3, 7)]), 4) for r in b.to_pylist()]
    want = {(t[i : i + 3], n // 4): [] for n, t in enumerate(texts) for i in range(len(t) - 2)}
    for g, k in want:
        want[g, k] = [n for n, t in enumerate(texts) if g in t and n // 4 == k]
    assert {(r["gram"], r["block"]): r["ns"] for r in out} == want and len(out) == len(want)
