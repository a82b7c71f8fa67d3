"""Vector code compression: product quantisation in whole numbers.

A component x counts as floor(scale * x); a vector is cut into consecutive parts, each with a codebook of its own. A round broadcasts the
codebooks, whose size doesn't grow with the table, and reads the vectors where they lie: an Arrow batch at a time, all distances of a part come
from |x|^2 - 2 x.c + |c|^2 with an exact int64 matrix product, and the first least one is the code. Each task adds up its vectors by entry and
sends one row for each entry and component; a grouped shuffle merges these sums, and the new codebooks come to the driver. No vector moves, and
no round depends on how rows are dealt, so a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, spread, table, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors whose distances to all entries are held at a time.
BLOCK = 2048
#: Labels up to which their sums are broadcast: about 40 bytes each.
BROADCAST_LABELS = 200_000


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds neither nulls nor what isn't finite."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def bound(width: int) -> int:
    """Components beyond count as this, for past it distances don't fit 64 bits: 2^27 and more for up to 128 components."""
    return math.isqrt((1 << 61) // width)


def integers(lists: pa.Array, width: int, scale: int) -> np.ndarray:
    """A row of whole numbers for each vector."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    most = bound(width)
    return np.clip(np.floor(values * scale), -most, most).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the first of equally near ones, and its squared distance."""
    at, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    turned, norm = np.ascontiguousarray(book.T), (book * book).sum(axis=1)
    for lo in range(0, len(x), BLOCK):
        some = x[lo : lo + BLOCK]
        far = norm - 2 * (some @ turned)
        best = far.argmin(axis=1)
        at[lo : lo + BLOCK] = best
        error[lo : lo + BLOCK] = far[np.arange(len(some)), best] + (some * some).sum(axis=1)
    return at, error


class Codebooks:
    """Learns the codebooks of a table of vectors and encodes it; `books` holds an array (entries, components) for each part."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE):
        self.parts, self.entries, self.scale, self.spark = parts, entries, scale, vectors.sparkSession
        kept = spread(vectors.filter(usable(F.col(vector_col))))
        # what most vectors have; others can't be cut into the same parts
        widths = kept.groupBy(F.size(vector_col).alias("width")).count().filter(f"width > 0 AND width % {parts} = 0")
        found = widths.orderBy(F.desc("count"), "width").first()
        self.width = found["width"] if found else 0
        self.kept = kept.filter(F.size(vector_col) == self.width) if self.width else kept.limit(0)
        self.id_col, self.vector_col = id_col, vector_col
        self.books = self.first() if self.width else []
        for _ in range(rounds if self.width else 0):
            self.books = self.refined()

    def first(self) -> list[np.ndarray]:
        """The vectors with the smallest ids; those without an id come last."""
        rows = self.kept.orderBy(F.asc_nulls_last(self.id_col), self.vector_col).select(self.vector_col).limit(self.entries).collect()
        x = integers(pa.array([r[0] for r in rows], pa.list_(pa.float64())), self.width, self.scale)
        return [np.ascontiguousarray(p) for p in np.split(x, self.parts, axis=1)]

    def refined(self) -> list[np.ndarray]:
        """One round: every part to its nearest entry, every entry to the floor of its parts' mean; what no part chose stays."""
        width, scale, sent = self.width, self.scale, self.spark.sparkContext.broadcast(self.books)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = sent.value
            total, n = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
            for batch in batches:
                x = integers(batch.column(0), width, scale)
                for p, (part, book) in enumerate(zip(np.split(x, len(books), axis=1), books, strict=True)):
                    at, _ = nearest(part, book)
                    np.add.at(total[p], at, part)
                    n[p] += np.bincount(at, minlength=len(book))
            for p, each in enumerate(n):
                used = np.flatnonzero(each)
                size = books[p].shape[1]
                cols = [np.full(len(used) * size, p, np.int32), np.repeat(used, size).astype(np.int32), np.tile(np.arange(size, dtype=np.int32), len(used)), total[p][used].ravel(), np.repeat(each[used], size)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["part", "entry", "at", "total", "n"])

        found = self.kept.select(self.vector_col).mapInArrow(tidy(sums), "part int, entry int, at int, total long, n long")
        merged = found.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        books = [b.copy() for b in self.books]
        for r in merged.collect():  # no more rows than the codebooks have components
            books[r["part"]][r["entry"], r["at"]] = r["total"] // r["n"]
        sent.unpersist()
        return books

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.books for v in book.ravel().tolist()).encode()).hexdigest()

    def encode(self, *carried: str) -> DataFrame:
        """id, code (two hex digits for each part), error of every usable vector, and the carried columns under their names."""
        width, scale, books = self.width, self.scale, self.books
        sent = self.spark.sparkContext.broadcast(books)
        digits = len(f"{max(self.entries - 1, 1):x}")
        digits += digits % 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = integers(batch.column(0), width, scale)
                found = [nearest(part, book) for part, book in zip(np.split(x, len(sent.value), axis=1), sent.value, strict=True)]
                names = np.array([f"{i:0{digits}x}" for i in range(max(map(len, sent.value)))], dtype=object)
                code = sum((names[at] for at, _ in found[1:]), names[found[0][0]])
                error = sum(e for _, e in found)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(code, pa.string()), pa.array(error, pa.int64())], [*batch.schema.names[1:], "code", "error"])

        rows = self.kept.select(self.vector_col, F.col(self.id_col).alias("id"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carried)))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
        if not self.width:
            return rows.drop(self.vector_col).withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).toDF("id", *carried, "code", "error")
        return rows.mapInArrow(tidy(run), f"{kinds}, code string, error long").toDF("id", *carried, "code", "error")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **settings) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: a row for each usable vector.

    Vectors that are null, or hold nulls or what isn't finite, go. So do vectors of another length than most have, and of lengths that can't be
    cut into equal parts, which no codebook fits. Components past `bound` count as it. Repeated rows each have a row and count each; rows without
    an id have a null one, and start a codebook only if too few have one; equal ids are ordered by their vectors. Fewer vectors than entries make
    a smaller codebook. An empty table gives no rows. label_error sums over equal labels, nulls together; it is null where it passes 64 bits.
    Other columns are not read.
    """
    books = Codebooks(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label")), "id", "vector", **settings)
    coded = cut(books.encode("label"))
    sums = cut(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    joined = coded.join(sums, coded["label"].eqNullSafe(sums["of"]))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    near = lambda b: f"SELECT x.vec_id, x.p, min({{'d': x.xx - 2 * list_inner_product(x.x, b.c) + b.cc, 'e': b.e}}) AS m FROM parts x JOIN {b} b USING (p) GROUP BY x.vec_id, x.p"
    steps = []
    for r in range(rounds):
        steps += [
            f"a{r} AS MATERIALIZED ({near(f'b{r}')})",
            f"s{r} AS (SELECT p, e, list(v ORDER BY j) AS c FROM (SELECT p, m.e AS e, j, (sum(x[j])::BIGINT - ((sum(x[j])::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS v FROM a{r} JOIN parts USING (vec_id, p), range(1, w + 1) t(j) GROUP BY ALL) GROUP BY ALL)",
            f"b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(s.c::DOUBLE[], b.c) AS c, list_inner_product(coalesce(s.c::DOUBLE[], b.c), coalesce(s.c::DOUBLE[], b.c)) AS cc FROM b{r} b LEFT JOIN s{r} s USING (p, e))",
        ]
    hex = f"string_agg(printf('%02x', m.e), '' ORDER BY p)"
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, len(v) // {parts} AS w, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x, list_inner_product(x, x) AS xx FROM kept, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c, xx AS cc FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})),
{", ".join(steps)},
z AS MATERIALIZED ({near(f'b{rounds}')}),
coded AS (SELECT vec_id, label, {hex} AS code, sum(m.d)::BIGINT AS error FROM z JOIN kept USING (vec_id) GROUP BY ALL)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(c[j]::BIGINT::VARCHAR, ',' ORDER BY p, e, j)) FROM b{rounds}, range(1, len(c) + 1) t(j)) AS codebooks_sha256
FROM coded
"""


ORACLE_SQL = oracle()
