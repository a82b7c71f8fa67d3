from pyspark.sql import functions as F

from marginalia.operators import imports
from marginalia.sources.files import children
from marginalia.streaming import ledger


def test_stream_agrees_with_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    src = str(tmp_path / "in")
    for k in range(3):
        events.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(src)
    stream = ledger.read_decisions(spark, src, "user_id long, ts timestamp, event_id long, event_type string")
    query = ledger.run(stream, ["user_id"], ["ts", "event_id"], f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    query.awaitTermination()
    got = {tuple(r) for r in ledger.kept(spark, f"file://{tmp_path}/out").select("user_id", "event_type", "event_id").collect()}
    want = {tuple(r) for r in imports.ledger_latest(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id").collect()}
    assert got == want


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k long, state string")


def state(spark, path):
    return {r.k: r.state for r in ledger.kept(spark, path).collect()}


def test_batches_rewrite_only_their_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/kept"
    assert ledger.kept(spark, path) is None
    write = ledger.upsert_to(path, ["k"])
    write(rows(spark, [(i, "old") for i in range(20)] + [(None, "none")]), 0)
    before = ledger.manifest(spark, path).buckets
    for epoch in (1, 2, 3, 3):  # the last batch comes twice
        write(rows(spark, [(5, f"new{epoch}"), (None, "one")]), epoch)
    assert state(spark, path) == {i: "new3" if i == 5 else "old" for i in range(20)} | {None: "one"}
    after = ledger.manifest(spark, path)
    assert after.epoch == 3 and sum(before[b] == after.buckets[b] for b in before) >= 2  # others keep the version of the first batch
    assert len(ledger.manifests(spark, path)) == 2


def test_growth(spark, tmp_path):
    """Buckets are split one at a time, over more than two doublings, and every key stays where its hash says."""
    path = f"file://{tmp_path}/kept"
    write, counts = ledger.upsert_to(path, ["k"], bucket_rows=10), []
    for epoch in range(6):
        write(rows(spark, [(i, f"e{epoch}") for i in range(30 * epoch, 30 * epoch + 40)]), epoch)
        now = ledger.manifest(spark, path)
        counts.append(now.count)
        placed = now.read(spark, path).select("k", now.bucket(["k"]).alias("b"), F.regexp_extract(F.col("_metadata.file_path"), "_b=([0-9]+)", 1).cast("int").alias("at"))
        assert placed.filter("b <> at").count() == 0 and now.rows == placed.count() == 30 * epoch + 40
    assert counts == sorted(counts) and counts[0] == 4 and counts[-1] >= 17
    assert state(spark, path) == {i: f"e{min(5, i // 30)}" for i in range(190)}


def test_reader_and_failed_attempt(spark, tmp_path, monkeypatch):
    """Who read the manifest before still finds its rows while and after a batch; a batch that dies before its manifest changes nothing."""
    path = f"file://{tmp_path}/kept"
    write = ledger.upsert_to(path, ["k"], bucket_rows=3)
    write(rows(spark, [(i, "old") for i in range(12)]), 0)
    reader = ledger.kept(spark, path)
    seen = []
    commit = ledger.atomic_write

    def dies(*_):
        seen.append(state(spark, path))  # in the middle of the batch
        raise OSError("lost")

    monkeypatch.setattr(ledger, "atomic_write", dies)
    for _ in range(2):
        try:
            write(rows(spark, [(3, "new"), (50, "new")]), 1)
        except OSError:
            pass
    monkeypatch.setattr(ledger, "atomic_write", commit)
    assert seen == [{i: "old" for i in range(12)}] * 2 and state(spark, path) == seen[0]
    write(rows(spark, [(3, "new"), (50, "new")]), 1)
    assert state(spark, path) == {i: "new" if i == 3 else "old" for i in range(12)} | {50: "new"}
    assert {r.k: r.state for r in reader.collect()} == seen[0]
    assert len(children(spark, f"{path}/data")) == 2  # what the failed attempts wrote is gone
