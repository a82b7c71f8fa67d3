"""Merkle dataset manifest: a tree of SHA-256 digests over the rows of each source, a root over the sources, and a proof for every row.

Spark hashes rows where they lie and numbers the digests in order, by a range shuffle and one count for each partition. So every digest knows its
bucket, an aligned stretch of fan^3 leaves of its source; a source of any size is many buckets. On the executors, DuckDB takes blocks of whole
buckets as Arrow tables and builds their levels, each by one query: an ordered string_agg for each run, and its sha256. What leaves a bucket is its
root, which Spark combines, level by level, to the roots of the sources and of the set. Going down again gives each bucket its outer proof, which
travels beside the bucket's leaves; DuckDB builds the bucket's levels anew, joins the siblings and folds every leaf up to the root. Only digests are
shuffled; texts are read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, spread, table, tidy

FAN = 16
#: Levels inside a bucket, and leaves that make a block for DuckDB (or one bucket, where that has more).
INNER, BLOCK_LEAVES = 3, 16_384
#: Rows of a table of sources or partitions up to which it is broadcast: about 100 bytes each.
BROADCAST_ROWS = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows of values look alike; null is a dash."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(framed, values)), 256)


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows and `rank`, their place in the order from 0: sorted by ranges, numbered within partitions, moved on by the counts of those before.

    The counts, one for each partition, come to the driver. The sorted rows are written first: numbers stay whatever is run again.
    """
    spark = rows.sparkSession
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()}))
    moved, before = [], 0
    for part, n in sorted(tuple(r) for r in placed.groupBy("part_").count().collect()):
        moved.append((part, before - (part << 33)))
        before += n
    shift = spark.createDataFrame(moved, "part_ int, shift_ long")
    return placed.join(F.broadcast(shift), "part_").withColumn("rank", F.col("at_") + F.col("shift_")).drop("part_", "at_", "shift_")


def height(n: Column, fan: int) -> Column:
    """Levels above n leaves."""
    return sum((F.when(n > fan**k, 1).otherwise(0) for k in range(1, 63) if fan**k < 1 << 63), F.when(n > 1, 1).otherwise(0))


def numbered(leaves: DataFrame, fan: int = FAN, inner: int = INNER) -> DataFrame:
    """s (the source's place among the sources), bucket, i (the leaf's place in its source), height, id, leaf, altered.

    leaves: source, id, leaf, altered. In a source, leaves ascend by id, nulls first, equal ids by digest.
    """
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("id"), F.asc("leaf"), F.asc_nulls_first("altered"), F.asc("row")]
    at = ranked(leaves.withColumn("row", F.monotonically_increasing_id()), *order)
    sources = ranked(at.groupBy("source").agg(F.min("rank").alias("first"), F.count("*").alias("n")), F.asc_nulls_first("source"))
    sources = cut(sources.select(F.col("source").alias("of"), "first", height(F.col("n"), fan).alias("height"), F.col("rank").alias("s")))
    if sources.count() <= BROADCAST_ROWS:
        sources = F.broadcast(sources)
    i = F.col("rank") - F.col("first")
    return at.join(sources, at["source"].eqNullSafe(sources["of"])).select("s", F.floor(i / fan**inner).alias("bucket"), i.alias("i"), "height", "id", "leaf", "altered")


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of whole buckets, of about `most` rows each; rows come in order of s and bucket."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            rows = pa.Table.from_batches(held)
            last = rows.slice(n - 1)
            differs = (rows["s"].to_numpy() != last["s"][0].as_py()) | (rows["bucket"].to_numpy() != last["bucket"][0].as_py())
            whole = int(differs.nonzero()[0][-1]) + 1 if differs.any() else 0
            if whole:
                yield rows.slice(0, whole)
            held, n = rows.slice(whole).to_batches(), n - whole
    if n:
        yield pa.Table.from_batches(held)


def engine() -> duckdb.DuckDBPyConnection:
    """DuckDB within a task: one thread and a bound on memory, as other tasks run beside it."""
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "allow_unsigned_extensions": False})


def build(con: duckdb.DuckDBPyConnection, rows: pa.Table, fan: int, inner: int) -> None:
    """Tables l0 ... of a block's levels: s, bucket, i, height, h."""
    con.register("rows", rows)
    con.execute("CREATE OR REPLACE TEMP TABLE l0 AS SELECT s, bucket, i, height, leaf AS h FROM rows WHERE leaf IS NOT NULL")
    for k in range(1, inner + 1):
        con.execute(f"CREATE OR REPLACE TEMP TABLE l{k} AS SELECT s, bucket, i // {fan} AS i, height, sha256(string_agg(h, '' ORDER BY i)) AS h FROM l{k - 1} WHERE height >= {k} GROUP BY ALL")


def bucket_roots(at: DataFrame, fan: int = FAN, inner: int = INNER, block_leaves: int = BLOCK_LEAVES) -> DataFrame:
    """s, i (the bucket), left (levels still to build above it), h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = engine()
        tops = " UNION ALL ".join(f"SELECT s, bucket AS i, greatest(height - {inner}, 0)::INT AS left, h FROM l{k} WHERE height {'>=' if k == inner else '='} {k}" for k in range(inner + 1))
        for rows in blocks(batches, block_leaves):
            build(con, rows, fan, inner)
            yield from con.sql(f'SELECT s, i, "left", h FROM ({tops})').to_arrow_table().to_batches()
        con.close()

    aligned = at.select("s", "bucket", "i", "height", "leaf").repartition("s", "bucket").sortWithinPartitions("s", "bucket", "i")
    return aligned.mapInArrow(tidy(run), "s long, i long, left int, h string")


STEP = "array<struct<pre:string,suf:string>>"


def climb(nodes: DataFrame, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """The roots (s, h) of the trees over nodes (s, i, left, h), and for every node its path (s, i, path), a step for each level: the digests
    of its run before and after it. A run is `fan` nodes at most; each level is a grouped shuffle of what the one below left."""
    now = cut(nodes)
    levels, done = [], [now.filter("left = 0").select("s", "h")]
    while not now.filter("left > 0").isEmpty():
        runs = cut(now.filter("left > 0").groupBy("s", F.floor(F.col("i") / fan).alias("run"), "left").agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("kids")))
        levels.append(runs)
        now = runs.select("s", F.col("run").alias("i"), (F.col("left") - 1).alias("left"), F.sha2(F.array_join("kids.h", ""), 256).alias("h"))
        done.append(now.filter("left = 0").select("s", "h"))
    roots = done[0]
    for more in done[1:]:
        roots = roots.unionAll(more)
    paths = roots.select("s", F.lit(0).cast("long").alias("run"), F.array().cast(STEP).alias("above"))
    for runs in reversed(levels):
        joined = runs.join(paths, ["s", "run"]).select("s", "above", "kids", F.posexplode("kids").alias("at", "kid"))
        side = lambda lo, n: F.array_join(F.slice(F.col("kids.h"), lo, n), "")
        step = F.struct(side(F.lit(1), F.col("at")).alias("pre"), side(F.col("at") + 2, F.size("kids")).alias("suf"))
        down = joined.select("s", F.col("kid.i").alias("run"), F.concat(F.array(step), "above").alias("above"))
        paths = cut(down.unionAll(paths.join(runs.select("s").distinct(), "s", "left_anti")))
    return roots, paths.select("s", F.col("run").alias("i"), F.col("above").alias("path"))


PROVED = "id long, s long, leaf string, proof_sha256 string, folded_root string"


def proofs(at: DataFrame, outer: DataFrame, fan: int = FAN, inner: int = INNER, block_leaves: int = BLOCK_LEAVES) -> DataFrame:
    """id, s, leaf, proof_sha256, folded_root of every leaf. outer: s, bucket, path above the bucket's root; one row goes with each bucket's
    leaves to the task that folds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = engine()
        for rows in blocks(batches, block_leaves):
            build(con, rows, fan, inner)
            con.execute("CREATE OR REPLACE TEMP TABLE outer_ AS SELECT s, bucket, path FROM rows WHERE leaf IS NULL")
            steps = con.sql("SELECT coalesce(max(len(path)), 0) FROM outer_").fetchall()[0][0]
            sides, joins, folded = [], [], "coalesce(rows.altered, rows.leaf)"
            for k in range(inner):
                con.execute(
                    f"CREATE OR REPLACE TEMP TABLE p{k} AS SELECT s, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre,"
                    f" coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS suf FROM l{k} WHERE height > {k} WINDOW w AS (PARTITION BY s, i // {fan} ORDER BY i)"
                )
                joins.append(f"LEFT JOIN p{k} ON p{k}.s = rows.s AND p{k}.i = rows.i // {fan**k}")
                sides.append(f"coalesce(p{k}.pre || p{k}.suf, '')")
                folded = f"CASE WHEN p{k}.i IS NULL THEN {folded} ELSE sha256(p{k}.pre || {folded} || p{k}.suf) END"
            for k in range(1, steps + 1):
                sides.append(f"coalesce(o.path[{k}].pre || o.path[{k}].suf, '')")
                folded = f"CASE WHEN len(o.path) >= {k} THEN sha256(o.path[{k}].pre || {folded} || o.path[{k}].suf) ELSE {folded} END"
            found = con.sql(f"""SELECT rows.id, rows.s, rows.leaf, sha256({" || ".join(sides)}) AS proof_sha256, {folded} AS folded_root
                FROM rows JOIN outer_ o ON o.s = rows.s AND o.bucket = rows.bucket {" ".join(joins)} WHERE rows.leaf IS NOT NULL""")
            yield from found.to_arrow_table(batch_size=10_000).to_batches(max_chunksize=10_000)
        con.close()

    leaves = at.withColumn("path", F.lit(None).cast(STEP))
    heads = outer.select("s", "bucket", F.lit(-1).cast("long").alias("i"), F.lit(0).alias("height"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("leaf"), F.lit(None).cast("string").alias("altered"), "path")
    return leaves.unionByName(heads).repartition("s", "bucket").sortWithinPartitions("s", "bucket", "i").mapInArrow(tidy(run), PROVED)


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = FIELDS, altered: dict[str, Column] | None = None, suspect: Column | None = None, *, fan: int = FAN, inner: int = INNER, block_leaves: int = BLOCK_LEAVES) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a row for every row of docs.

    fields: the columns that a leaf covers, in order; null, empty and very long values are told apart by their lengths. altered: what columns are
    said to hold now, for rows where suspect holds; their leaf is recomputed and folded with the siblings of the original, so that
    `verified` shows whether it still proves. Rows without a source form one of their own, which comes first; rows without an id come
    first in their source; rows that repeat an id are ordered by their digest, and each is a leaf. An empty table gives no rows.
    Other columns are not read.
    """
    leaf = digest(*(F.col(c) for c in fields))
    other = F.lit(None).cast("string")
    if altered:
        other = F.when(F.coalesce(suspect if suspect is not None else F.lit(True), F.lit(False)), digest(*(altered.get(c, F.col(c)) for c in fields)))
    leaves = cut(spread(docs).select(F.col(source_col).alias("source"), F.col(id_col).cast("long").alias("id"), leaf.alias("leaf"), other.alias("altered")))
    at = numbered(leaves, fan, inner)
    subroots, inside = climb(bucket_roots(at, fan, inner, block_leaves), fan)
    subroots = cut(subroots)
    n = subroots.count()
    tops, above = climb(subroots.select(F.lit(0).cast("long").alias("s"), F.col("s").alias("i"), height(F.lit(n), fan).alias("left"), "h"), fan)
    root = tops.first()
    outer = inside.withColumnRenamed("i", "bucket").join(above.select(F.col("i").alias("s"), F.col("path").alias("more")), "s")
    proved = proofs(at, outer.select("s", "bucket", F.concat("path", "more").alias("path")), fan, inner, block_leaves)
    known = subroots.select("s", F.col("h").alias("subroot"))
    if n <= BROADCAST_ROWS:
        known = F.broadcast(known)
    root = F.lit(root["h"] if root else None).cast("string")
    out = proved.join(known, "s").withColumn("root", root)
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(table(spark, sf_dir, "documents"), altered={"text": F.translate("text", UPPER, LOWER)}, suspect=fifth)


def _oracle_tree(name: str, key: str, levels: int, fan: int = FAN) -> str:
    """Tables {name}1 ... of the levels over {name}0 (key, i, n, h), with run-wise windows for the siblings."""
    out = []
    for k in range(levels):
        out.append(f"{name}{k + 1} AS (SELECT {key}, i // {fan} AS i, n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k} WHERE n > {fan**k} GROUP BY ALL)")
        w = f"PARTITION BY {key}, i // {fan} ORDER BY i"
        out.append(f"{name}p{k} AS (SELECT {key}, i, n > {fan**k} AS there, coalesce(string_agg(h, '') OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre, coalesce(string_agg(h, '') OVER ({w} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS suf FROM {name}{k})")
    return ",\n".join(out)


def oracle(levels: int = 5, fan: int = FAN) -> str:
    """Up to fan^levels leaves in a source, and as many sources."""
    framed = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(framed(c) for c in FIELDS[:-1])} || {framed(text)})"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    joins = " ".join(f"LEFT JOIN lp{k} ON lp{k}.s = d.s AND lp{k}.i = d.i // {fan**k}" for k in range(levels)) + " " + " ".join(f"LEFT JOIN gp{k} ON gp{k}.i = d.s // {fan**k}" for k in range(levels))
    top = lambda t, key: " UNION ALL ".join(f"SELECT {key}, h FROM {t}{k} WHERE n <= {fan**k}{f' AND n > {fan ** (k - 1)}' if k else ''}" for k in range(levels + 1))
    return f"""
WITH bits AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))),
own AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) % 5 = 0 AS fifth FROM documents, bits),
d AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
  {leaf('text')} AS leaf, CASE WHEN fifth THEN {leaf(low)} END AS altered FROM own),
l0 AS (SELECT s, i, n, leaf AS h FROM d),
{_oracle_tree('l', 's', levels)},
subroots AS ({top('l', 's')}),
g0 AS (SELECT 0 AS o, s AS i, count(*) OVER () AS n, h FROM subroots),
{_oracle_tree('g', 'o', levels)},
root AS ({top('g', 'o')}),
sides AS (SELECT d.doc_id, d.s, d.leaf, coalesce(d.altered, d.leaf) AS start_, [{", ".join(f"CASE WHEN {t}p{k}.there THEN [{t}p{k}.pre, {t}p{k}.suf] END" for t in "lg" for k in range(levels))}] AS steps FROM d {joins})
SELECT doc_id, leaf, subroots.h AS subroot, root.h AS root, sha256(coalesce(list_aggregate(list_transform(list_filter(steps, lambda x: x IS NOT NULL), lambda x: x[1] || x[2]), 'string_agg', ''), '')) AS proof_sha256,
  list_reduce(list_prepend([start_, ''], list_filter(steps, lambda x: x IS NOT NULL)), lambda a, x: [sha256(x[1] || a[1] || x[2]), ''])[1] AS folded_root, folded_root = root.h AS verified
FROM sides JOIN subroots USING (s), root
"""


ORACLE_SQL = oracle()
