"""The review ledger as a stream: decisions arrive, the last for each key stays."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import atomic_write, children, read_text, remove


def read_decisions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def latest(decisions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A running maximum by key. State is one row for each key; nothing is late, as a later decision wins whenever it arrives."""
    rest = [c for c in decisions.columns if c not in (*keys, *order)]
    return decisions.groupBy(*keys).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("last")).select(*keys, "last.*")


def windowed(decisions: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Decisions by window and key, closed once the watermark has passed."""
    return decisions.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


#: Buckets of an empty ledger, and rows for each beyond which another is split.
FIRST, BUCKET_ROWS = 4, 100_000


class Manifest:
    """What a ledger consists of after an epoch: how far its buckets are split, and for each the folder of its newest version and its rows.

    Buckets grow by linear hashing: `split` of the `width` buckets of this round have been split in two, in order, and the hashes of those tell
    by one bit more; when all are, the next round has twice the width. So growth moves the rows of one bucket at a time.
    """

    def __init__(self, epoch: int = -1, width: int = FIRST, split: int = 0, buckets: dict[int, tuple[str, int]] | None = None, shape: str | None = None):
        self.epoch, self.width, self.split, self.buckets, self.shape = epoch, width, split, buckets or {}, shape

    @property
    def count(self) -> int:
        return self.width + self.split

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.buckets.values())

    def bucket(self, keys: list[str]) -> Column:
        hash = F.xxhash64(*keys)
        wide = F.pmod(hash, F.lit(2 * self.width))
        return F.when(wide % self.width < self.split, wide).otherwise(wide % self.width).cast("int")

    def grown(self, rows: int, bucket_rows: int) -> tuple[Manifest, set[int]]:
        """As many splits as `rows` rows need, and the buckets that they take apart."""
        width, split, apart = self.width, self.split, set()
        while rows > bucket_rows * (width + split):
            apart.add(split)
            split += 1
            if split == width:
                width, split = 2 * width, 0
        return Manifest(self.epoch, width, split, dict(self.buckets), self.shape), {b for b in apart if b in self.buckets}

    def dump(self) -> str:
        return json.dumps({"epoch": self.epoch, "width": self.width, "split": self.split, "shape": self.shape, "buckets": sorted((b, *v) for b, v in self.buckets.items())})

    @classmethod
    def load(cls, text: str) -> Manifest:
        m = json.loads(text)
        return cls(m["epoch"], m["width"], m["split"], {b: (folder, n) for b, folder, n in m["buckets"]}, m["shape"])

    def read(self, spark: SparkSession, path: str, only: set[int] | None = None) -> DataFrame | None:
        paths = [f"{path}/data/{folder}/_b={b}" for b, (folder, _) in sorted(self.buckets.items()) if only is None or b in only]
        return spark.read.schema(self.shape).parquet(*paths) if paths else None


def manifests(spark: SparkSession, path: str) -> list[str]:
    """The folders of committed manifests, oldest first: one for each epoch."""
    return [v for v in children(spark, f"{path}/manifests") if read_text(spark, f"{path}/manifests/{v}/manifest.json") is not None]


def manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The newest manifest; None if there is no ledger."""
    found = manifests(spark, path)
    return Manifest.load(read_text(spark, f"{path}/manifests/{found[-1]}/manifest.json")) if found else None


def upsert_to(path: str, keys: list[str], bucket_rows: int = BUCKET_ROWS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: puts each batch's rows in the place of older ones, in versions that appear whole.

    A batch rewrites the buckets that its keys are in, and those that its growth splits, in one job to a folder of its own; then a manifest names
    the new versions beside the others, in one step. An epoch that is committed isn't written again, and what a failed attempt left is in no
    manifest. The manifest before stays readable, with all that it names, for whoever is reading it; older folders go. A batch has
    each key once; rows of a key without a value are like any other.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = manifest(spark, path) or Manifest()
        if epoch <= old.epoch:
            return
        dealt = batch.withColumn("_b", old.bucket(keys)).persist()
        rows = dealt.drop("_b")
        new, apart = old.grown(old.rows + dealt.count(), bucket_rows)
        new.epoch, new.shape = epoch, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
        # one number for each bucket, of which there is one for every bucket_rows rows
        touched = {r[0] for r in dealt.select("_b").distinct().collect()} | apart
        held, folder = old.read(spark, path, touched), f"e{epoch:010d}-{uuid.uuid4().hex}"
        if held is not None:
            same = [rows[k].eqNullSafe(held[k]) for k in keys]
            rows_now = held.join(rows.select(*keys), same, "left_anti").unionByName(rows)
        else:
            rows_now = rows
        target = f"{path}/data/{folder}"
        out = rows_now.withColumn("_b", new.bucket(keys))
        out.repartition("_b").write.partitionBy("_b").parquet(target)
        found = spark.read.schema(f"{new.shape}, _b int").parquet(target).groupBy("_b").count().collect()
        new.buckets = {b: v for b, v in new.buckets.items() if b not in touched} | {r["_b"]: (folder, r["count"]) for r in found}
        atomic_write(spark, f"{path}/manifests/{epoch:010d}/manifest.json", new.dump())
        dealt.unpersist()
        _clean(spark, path)

    return write


def _clean(spark: SparkSession, path: str) -> None:
    """Removes manifests but for the last two, and folders that neither names."""
    found = manifests(spark, path)
    live = {folder for v in found[-2:] for folder, _ in Manifest.load(read_text(spark, f"{path}/manifests/{v}/manifest.json")).buckets.values()}
    for folder in children(spark, f"{path}/data"):
        if folder not in live:
            remove(spark, f"{path}/data/{folder}")
    for v in found[:-2]:
        remove(spark, f"{path}/manifests/{v}")


def kept(spark: SparkSession, path: str) -> DataFrame | None:
    """The decisions that stay, as of the newest manifest. None if there is no ledger."""
    now = manifest(spark, path)
    return now.read(spark, path) if now else None


def run(decisions: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str, bucket_rows: int = BUCKET_ROWS) -> StreamingQuery:
    """Starts the upsert of a stream into a ledger below path."""
    query = latest(decisions, keys, order).writeStream.outputMode("update").foreachBatch(upsert_to(path, keys, bucket_rows)).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start()
