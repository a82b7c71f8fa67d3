"""Sharding by size-tiered compaction, in DataFrame operations only.

`append` writes an arrival as small immutable shards and commits a manifest version that lists them. `compact` looks at the tiers of the
current version (a shard's tier is the logarithm of its size to the base `fan_in`): where a tier below the target has `fan_in` runs or
more, its shards are packed into bins of the target size, and each bin becomes one file. A merge is one job whose shuffle deals rows to
their bins; a bin never exceeds the target, so neither does a task. The new version lists the new shards and those that stay.

A version is a small file that names manifest lists, one or a few for each tier, each of which lists shards; lists are immutable as shards
are. An append adds a list and a merge replaces the lists of the tiers it touches, so neither reads nor writes what is known of shards that
have reached the target, which are most of a large table. A version's file is written in full under another name and then linked (local
file systems) or renamed without overwriting (all others) into place: of two writers of a version one succeeds, the other gets an error and
can try again. Object stores without an atomic rename need a committer of their own. Readers hold to a version; `vacuum` removes lists and
shards that no kept version names.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, table, unused

TARGET_BYTES, ARRIVAL_ROWS, FAN_IN = 128 << 20, 2_000, 4
LEAST_BYTES = 64 << 10
BROADCAST_SHARDS = 100_000
#: Arrivals into which op7 deals the documents, each followed by a compaction.
ARRIVALS = 3


@dataclass(frozen=True, order=True)
class Shard:
    path: str
    bytes: int
    version: int


@dataclass(frozen=True)
class ShardList:
    """A manifest list: where it is, the tier of its shards (FULL: those that aren't merged any more), how many they are."""

    path: str
    tier: int
    shards: int


FULL = -1


def tier(size: int, target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> int:
    """The tier of a shard of a size; FULL from half of the target on."""
    if 2 * size >= target:
        return FULL
    return max(0, int(math.log(size / LEAST_BYTES, fan_in))) if size > LEAST_BYTES else 0


def packed(shards: list[Shard], target: int) -> list[list[Shard]]:
    """Bins of at most the target: each shard, the largest first, goes to the first bin that has room for it (best room found by a tree of maxima)."""
    order = sorted(shards, key=lambda s: (-s.bytes, s.path))
    width = 1 << max(0, len(order) - 1).bit_length()
    room = [target] * (2 * width)  # node k holds the most room of any bin below it
    bins: list[list[Shard]] = [[] for _ in order]
    for s in order:
        need, k = min(s.bytes, target), 1
        while k < width:
            k = 2 * k if room[2 * k] >= need else 2 * k + 1
        bins[k - width].append(s)
        room[k] -= need
        while k > 1:
            k //= 2
            room[k] = max(room[2 * k], room[2 * k + 1])
    return [b for b in bins if b]


def plan(shards: list[Shard], target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> list[list[Shard]]:
    """Bins of shards to merge. A tier of fan_in shards or more is packed into bins of the target at most; a bin of one shard stays as it is.

    Packing a tier can give runs of a higher tier, which later calls merge again, so a byte is rewritten once for each tier at most.
    """
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        tiers.setdefault(tier(s.bytes, target, fan_in), []).append(s)
    tiers.pop(FULL, None)
    return [b for _, own in sorted(tiers.items()) if len(own) >= fan_in for b in packed(own, target) if len(b) > 1]


def bounded(shards: DataFrame, n: int) -> DataFrame:
    """Broadcasts short rows about shards up to a number of them; beyond, they are joined by a shuffle."""
    return F.broadcast(shards) if n <= BROADCAST_SHARDS else shards


class Store:
    """A versioned set of Parquet shards under one root that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target, fan_in
        self.jvm = spark._jvm
        self.jpath = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.jpath(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.jpath(f"{self.root}/manifest"))

    # files

    def _put(self, path: str, value) -> None:
        out = self.fs.create(self.jpath(path), False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def _get(self, path: str):
        stream = self.fs.open(self.jpath(path))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, tmp: str, to: str) -> bool:
        """Puts a whole file in place unless something is there; only one of several callers succeeds."""
        try:
            if self.fs.getUri().getScheme() == "file":
                at = lambda p: self.jvm.java.nio.file.Paths.get(self.jpath(p).toUri().getPath(), self.spark._sc._gateway.new_array(self.jvm.java.lang.String, 0))
                self.jvm.java.nio.file.Files.createLink(at(to), at(tmp))
                self.fs.delete(self.jpath(tmp), False)
            else:
                options = self.spark._sc._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(self.jpath(tmp), self.jpath(to), options)
        except Py4JJavaError as error:
            if self.fs.exists(self.jpath(to)):
                self.fs.delete(self.jpath(tmp), False)
                return False
            raise error
        return True

    # versions

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self.jpath(f"{self.root}/manifest"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def newest(self) -> int:
        return (self.versions() or [0])[-1]

    def lists(self, version: int | None = None) -> list[ShardList]:
        """The manifest lists of a version; of the newest if none is given; none if there is no version."""
        at = self.newest() if version is None else version
        return [ShardList(**x) for x in self._get(f"{self.root}/manifest/{at:010d}.json")] if at else []

    def shards(self, version: int | None = None, lists: list[ShardList] | None = None) -> list[Shard]:
        """The shards of a version, or of some of its lists."""
        return [Shard(**x) for one in (self.lists(version) if lists is None else lists) for x in self._get(one.path)]

    def _listed(self, shards: list[Shard]) -> list[ShardList]:
        """Writes new lists for shards, one for each tier."""
        tiers: dict[int, list[Shard]] = {}
        for s in sorted(shards):
            tiers.setdefault(tier(s.bytes, self.target, self.fan_in), []).append(s)
        out = []
        for k, own in sorted(tiers.items()):
            out.append(ShardList(f"{self.root}/manifest/list-{uuid.uuid4().hex}", k, len(own)))
            self._put(out[-1].path, [asdict(s) for s in own])
        return out

    def commit(self, lists: list[ShardList], base: int) -> int:
        """Makes version base + 1 of the lists; fails if another writer has made it meanwhile."""
        tmp = f"{self.root}/manifest/_{uuid.uuid4().hex}"
        self._put(tmp, [asdict(x) for x in lists])
        if not self._publish(tmp, f"{self.root}/manifest/{base + 1:010d}.json"):
            raise RuntimeError(f"version {base + 1} was committed by another writer")
        return base + 1

    def files(self, folder: str, version: int) -> list[Shard]:
        """The data files below a folder that a job has committed."""
        found, todo = [], [self.jpath(folder)]
        while todo:
            for s in self.fs.listStatus(todo.pop()):
                name = s.getPath().getName()
                if s.isDirectory():
                    if name[0] not in "_.":
                        todo.append(s.getPath())
                elif name.endswith(".parquet"):
                    found.append(Shard(s.getPath().toString(), s.getLen(), version))
        return found

    def append(self, rows: DataFrame, arrival_rows: int = ARRIVAL_ROWS, tries: int = 10) -> int:
        """Adds rows as shards of arrival_rows at most, without a shuffle; the new version. Where another writer was first, it commits anew."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", arrival_rows).option("compression", "zstd").parquet(folder)
        own = self._listed(self.files(folder, self.newest() + 1))
        for left in reversed(range(tries)):
            base = self.newest()
            try:
                return self.commit(self.lists(base) + own, base)
            except RuntimeError:
                if not left:
                    raise
        raise AssertionError

    def compact(self) -> int:
        """Merges until no tier is due; the newest version. Only lists of tiers that are due are read."""
        while True:
            base = self.newest()
            lists = self.lists(base)
            count: dict[int, int] = {}
            for x in lists:
                count[x.tier] = count.get(x.tier, 0) + x.shards
            due = [x for x in lists if x.tier != FULL and count[x.tier] >= self.fan_in]
            shards = self.shards(lists=due)
            bins = plan(shards, self.target, self.fan_in)
            if not bins:
                return base
            of = [(s.path.rsplit("/", 1)[-1], k) for k, own in enumerate(bins) for s in own]
            rows = self.spark.read.parquet(*(s.path for own in bins for s in own))
            columns = rows.columns
            name, at = unused(rows, "shard_name", "shard_bin")
            # one short row for each merged file; file names are unique, as every job's names bear its id
            names = bounded(self.spark.createDataFrame(of, f"{name} string, {at} int"), len(of))
            rows = rows.withColumn(name, F.col("_metadata.file_name")).join(names, name)
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            rows.repartitionById(len(bins), F.col(at)).select(*columns).write.option("compression", "zstd").parquet(folder)
            gone = {s for own in bins for s in own}
            new = self._listed([s for s in shards if s not in gone] + self.files(folder, base + 1))
            self.commit([x for x in lists if x not in due] + new, base)

    # rows

    def read(self, version: int | None = None, path: str | None = None) -> DataFrame | None:
        """The rows of a version, and under the name `path` the file that holds each; None if it has no shards."""
        paths = [s.path for s in self.shards(version)]
        if not paths:
            return None
        rows = self.spark.read.parquet(*paths)
        return rows.withColumn(path, F.col("_metadata.file_name")) if path else rows

    def vacuum(self, keep: int = 2) -> int:
        """Removes lists and shards that the newest `keep` versions don't name, and older versions; how many shards."""
        versions = self.versions()
        lists = lambda some: {x for v in some for x in self.lists(v)}
        kept, old = lists(versions[-keep:]), lists(versions[:-keep])
        gone = {replace(s, version=0) for s in self.shards(lists=[*(old - kept)])} - {replace(s, version=0) for s in self.shards(lists=[x for x in kept if old])}
        for v in versions[:-keep]:
            self.fs.delete(self.jpath(f"{self.root}/manifest/{v:010d}.json"), False)
        for path in [x.path for x in old - kept] + [s.path for s in gone]:
            self.fs.delete(self.jpath(path), False)
        return len(gone)


def shard_documents(docs: DataFrame, root: str, arrivals: int = 1, by: str | None = None, target: int = TARGET_BYTES, arrival_rows: int = ARRIVAL_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Writes docs as arrivals, compacts after each, and reads them back: the columns of docs, and shard, shard_bytes, shard_version.

    by: a column by whose hash rows are dealt to the arrivals; by default, all are. Every row of the input is in exactly one shard, nulls,
    repeated rows and empty texts as they are. An empty table gives no rows. Where a column of docs has one of the three names, the
    added one has underscores behind its name. The two newest versions stay readable.
    """
    spark = docs.sparkSession
    store = Store(spark, root, target, fan_in)
    for k in range(arrivals):
        hashed = F.xxhash64(*([by] if by else docs.columns))
        store.append(docs.filter(F.pmod(hashed, F.lit(arrivals)) == k) if arrivals > 1 else docs, arrival_rows)
        store.compact()
    store.vacuum()
    shard, size, made = unused(docs, "shard", "shard_bytes", "shard_version")
    rows = store.read(path=shard)
    if rows is None:
        return docs.limit(0).withColumns({shard: F.lit(""), size: F.lit(0).cast("long"), made: F.lit(0).cast("long")})
    about = [(s.path.rsplit("/", 1)[-1], s.bytes, s.version) for s in store.shards()]
    return rows.join(bounded(spark.createDataFrame(about, f"{shard} string, {size} long, {made} long"), len(about)), shard).select(*docs.columns, shard, size, made)


def op7_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the newest version holds it: digest and length of its text, and whether its shard keeps to the target size."""
    rows = shard_documents(table(spark, sf_dir, "documents"), fresh_dir(spark, "shards"), ARRIVALS, "doc_id")
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", F.sha2(text, 256).alias("text_sha256"), F.octet_length(text).cast("long").alias("n_bytes"), "lang", "source", (F.col("shard_bytes") <= TARGET_BYTES).alias("within_target"))


ORACLE_SQL = """
SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, lang, source, true AS within_target FROM documents
"""
