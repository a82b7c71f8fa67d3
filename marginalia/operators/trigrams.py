"""Substring search by a persisted index of trigrams.

Texts are numbered and written in parts by number. For every trigram the index holds, block by block of numbers, those whose text has it; so the
postings of a frequent trigram are many rows of bounded size. They are written in buckets by a hash of the trigram and sorted in these, with a table of
how many texts have each. A search looks up the counts of its query's trigrams, reads the postings of the rarest ones (their buckets, and in these
the row groups that can hold them), intersects them block by block, and looks into the texts left, in whose parts alone it reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import ranked

#: Trigrams of a query whose postings are intersected.
RAREST = 4


#: Trigrams that a task holds before it gives out postings.
HELD = 1 << 21


def grams(text: bytes) -> np.ndarray:
    """The distinct trigrams of a text in UTF-8, as numbers of three times 21 bits, ascending."""
    c = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(c) < 3:
        return c[:0]
    keys = c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    keys.sort()
    return keys[np.r_[True, keys[1:] != keys[:-1]]]


def _postings(held: list[np.ndarray], ns: list[int], block: int) -> pa.RecordBatch:
    """gram, block, ns: a row for each trigram and block of what is held."""
    keys, n = np.concatenate(held), np.repeat(np.array(ns, np.int64), [len(h) for h in held])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (n[1:] // block != n[:-1] // block)])
    shown = np.stack([keys[new] >> 42, keys[new] >> 21 & 0x1FFFFF, keys[new] & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
    lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(keys)], pa.int32()), pa.array(n))
    return pa.RecordBatch.from_arrays([pa.array([shown[i : i + 3] for i in range(0, len(shown), 3)], pa.string()), pa.array(n[new] // block), lists], ["gram", "block", "ns"])


def posted(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Postings of rows (n, text as bytes), of which a task gives out several for a trigram and block if it can't hold them."""
    held, ns, size = [], [], 0
    for batch in batches:
        for n, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = grams(text.as_py())
            if len(found):
                held.append(found)
                ns.append(n)
                size += len(found)
            if size >= HELD:
                yield _postings(held, ns, block)
                held, ns, size = [], [], 0
    if held:
        yield _postings(held, ns, block)


def bucket_of(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


class TrigramIndex:
    """An index below a path. Searches find the ids whose text contains the query, white space around it aside, in lower case: as a scan does."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        shape = spark.read.parquet(f"{self.path}/shape")
        self.buckets, self.part = shape.select("buckets", "part").first()
        self.id_type = shape.schema["id"].dataType.simpleString()

    def _table(self, name: str, columns: str) -> DataFrame:
        return self.spark.read.schema(columns).parquet(f"{self.path}/{name}")

    @property
    def texts(self) -> DataFrame:
        return self._table("texts", f"id {self.id_type}, text string, n bigint, part int")

    @property
    def postings(self) -> DataFrame:
        return self._table("postings", "gram string, block bigint, ns array<bigint>, bucket int")

    @property
    def counts(self) -> DataFrame:
        return self._table("counts", "gram string, texts bigint, bucket int")

    @classmethod
    def build(cls, rows: DataFrame, path: str, id: str = "id", text: str = "haystack", *, buckets: int = 64, block: int = 4096, part: int = 1 << 20) -> TrigramIndex:
        """rows: id, text. A null text counts as empty. block: numbers in one row of a trigram's postings; part: texts in one folder."""
        spark = rows.sparkSession
        at = ranked(rows.select(F.col(id).alias("id"), F.lower(F.coalesce(text, F.lit(""))).alias("text")), [], ["id"], "n", "size").drop("size")
        texts = at.withColumn("part", F.floor(F.col("n") / part).cast("int"))
        shape = spark.range(1).select(F.lit(None).cast(at.schema["id"].dataType).alias("id"), F.lit(buckets).alias("buckets"), F.lit(part).alias("part"))
        shape.write.parquet(f"{path}/shape")
        texts.repartitionByRange("n").sortWithinPartitions("n").write.partitionBy("part").parquet(f"{path}/texts")
        found = cls(spark, path).texts.select("n", F.col("text").cast("binary").alias("text")).mapInArrow(lambda batches: posted(batches, block), "gram string, block bigint, ns array<bigint>")
        held = found.groupBy("gram", "block").agg(F.sort_array(F.flatten(F.collect_list("ns"))).alias("ns"))
        order = ["bucket", "gram", "block"]
        held = held.withColumn("bucket", bucket_of(F.col("gram"), buckets)).repartitionByRange(*order).sortWithinPartitions(*order)
        held.write.partitionBy("bucket").parquet(f"{path}/postings")
        counts = cls(spark, path).postings.groupBy("bucket", "gram").agg(F.sum(F.size("ns")).alias("texts"))
        counts.repartitionByRange("bucket", "gram").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/counts")
        return cls(spark, path)

    def _looked_up(self, table: DataFrame, wanted: list[str]) -> DataFrame:
        """The rows of some trigrams: folders by bucket, row groups by trigram."""
        places = self.spark.createDataFrame([(g,) for g in wanted], "gram string").select(bucket_of(F.col("gram"), self.buckets)).distinct().collect()
        return table.filter(F.col("bucket").isin([p[0] for p in places]) & F.col("gram").isin(wanted))

    def chosen(self, query: str) -> list[str] | None:
        """The rarest trigrams of a query, as many as are intersected; None if no text has one of them. A row for each trigram of the query is looked up."""
        wanted = sorted({query[i : i + 3] for i in range(len(query) - 2)})
        found = {r["gram"]: r["texts"] for r in self._looked_up(self.counts, wanted).select("gram", "texts").collect()}
        return sorted(found, key=lambda g: (found[g], g))[:RAREST] if len(found) == len(wanted) else None

    def candidates(self, wanted: list[str]) -> DataFrame:
        """n of the texts that have all of the trigrams."""
        blocks = self._looked_up(self.postings, wanted).groupBy("block").agg(F.collect_list("ns").alias("lists")).filter(F.size("lists") == len(wanted))
        both = F.aggregate(F.slice("lists", 2, len(wanted)), F.get("lists", 0), lambda acc, ns: F.array_intersect(acc, ns))
        return blocks.select(F.explode(both).alias("n"))

    def search(self, query: str) -> DataFrame:
        """id of every text that contains the query. One of fewer than three characters has no trigram, and all texts are looked into."""
        query = query.strip().lower()
        has = F.col("text").contains(query)
        if len(query) < 3:
            return self.texts.filter(has).select("id")
        wanted = self.chosen(query)
        if wanted is None:
            return self.texts.select("id").limit(0)
        found = self.candidates(wanted)
        near = found.withColumn("part", F.floor(F.col("n") / self.part).cast("int"))
        return self.texts.join(near, ["part", "n"], "left_semi").filter(has).select("id")
