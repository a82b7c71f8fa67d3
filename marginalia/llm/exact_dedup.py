"""Exact deduplication: a tree merge of sorted digest runs, in DataFrame operations only.

Each text is hashed once: a row's identifier, SHA-256, byte length and XXH64 are written to the shared folder with the number of the
partition they came from, its run. A round merges `fan_in` neighbouring runs: every run is sorted by digest and equal neighbours become one
record, which holds the identifier that stays and the count; the records are exchanged by (run of the next level, digest), and the receiving
side sorts what it got from its runs and merges again. The identifiers are structs, for which Spark has no hash aggregation, so both halves
of a round are a sort and one pass over sorted records. After ceil(log(runs) / log(fan_in)) rounds one run is left, spread over all
partitions by digest.

Records are equal only if digest, length and XXH64 all agree, at every level; so an identifier that is kept is verified against what it
stands for by two independent hashes. A digest that a third of all rows share is one record a run from the first sort on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table, unused

FAN_IN = 16
#: What makes texts equal, in the order in which runs are sorted.
KEYS = ("digest", "length", "check")
#: Dropped rows up to which `deduplicate` moves no text: about 100 bytes each on every executor.
BROADCAST_ROWS = 200_000


def digest_of(text: Column) -> tuple[Column, Column, Column]:
    """SHA-256, byte length and XXH64 of the normalised text."""
    norm = ascii_lower(text)
    return F.unhex(F.sha2(norm, 256)), F.octet_length(norm), F.xxhash64(norm)


def runs_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest, length, check, run of every row, written to the shared folder."""
    digests = [c.alias(k) for c, k in zip(digest_of(F.col(text_col)), KEYS, strict=True)]
    return cut(docs.select(F.col(id_col).alias("id"), *digests, F.spark_partition_id().alias("run")))


def merge_runs(runs: DataFrame, keep: str = "max", fan_in: int = FAN_IN) -> DataFrame:
    """digest, length, check, best (a struct of the id that stays; null if no row of the group has one), size, spread over all partitions by digest.

    keep: which identifier of a group stays, "max" or "min".
    """
    best = F.max if keep == "max" else F.min
    left = 1 + (runs.agg(F.max("run")).first()[0] or 0)
    merged = runs.select(*KEYS, F.when(F.col("id").isNotNull(), F.struct("id")).alias("best"), F.lit(1).cast("long").alias("size"), "run")
    while True:
        left = -(-left // fan_in)
        keys = [*KEYS, "run"] if left > 1 else [*KEYS]
        merged = merged.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).groupBy(*keys).agg(best("best").alias("best"), F.sum("size").alias("size"))
        if left == 1:
            return merged


def _joined(docs: DataFrame, id_col: str, text_col: str, keep: str, fan_in: int) -> DataFrame:
    """id, keep_id, size, kept, digest of every row."""
    runs = runs_of(docs, id_col, text_col)
    merged = merge_runs(runs, keep, fan_in)
    joined = runs.join(merged, [*KEYS])
    return joined.select("id", F.col("best.id").alias("keep_id"), "size", F.col("best.id").eqNullSafe(F.col("id")).alias("kept"), "digest")


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for every row of docs.

    Texts are equal when identical after lower-casing A-Z. A null text counts as empty. Of rows with the same text *and* the same id
    (repeated rows), all bear kept = true, as no id tells them apart; rows without an id stay only if their group has no id at all.
    An empty table gives no rows. Other columns are not read, whatever their names.
    """
    rows = _joined(docs, id_col, text_col, keep, fan_in)
    return rows.select(F.col("id").alias("doc_id"), "keep_id", F.col("size").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = FAN_IN) -> DataFrame:
    """The rows that stay as `mark_duplicates` says, all their columns untouched; repeated rows of one id and text stay together.

    Only what is dropped is joined with docs, by id and text; up to BROADCAST_ROWS of it, no text is shuffled.
    """
    gone_id, gone_digest = unused(docs, "gone_id", "gone_digest")
    gone = cut(_joined(docs, id_col, text_col, keep, fan_in).filter("not kept").select(F.col("id").alias(gone_id), F.col("digest").alias(gone_digest)).distinct())
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    digest = digest_of(docs[text_col])[0]
    return docs.join(gone, docs[id_col].eqNullSafe(gone[gone_id]) & (digest == gone[gone_digest]), "left_anti")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
