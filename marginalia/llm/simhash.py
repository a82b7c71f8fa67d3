"""SimHash near-deduplication with vantage-point trees.

Fingerprints are taken in one Arrow pass. Equal ones become a class with one representative. The classes are dealt to shards, each of which
is searched by a vantage-point tree: points are split by their Hamming distance from a vantage point, and a query skips each branch whose
range of distances is out of reach by the triangle inequality, or whose points it is already linked with. Only a spanning forest of the links
leaves a shard, so a group of near copies costs its size and not its square.

Shards are made by vantage points too: what is too large for one is split by the distance d from one of its members into those with d <= e
and those with d > e - radius. The two overlap at the boundary just so far that any two points within the radius are together in one of them,
so no link is lost. But unrelated fingerprints of 64 bits lie 32 +- 4 bits from any point, so that a radius of 4 puts two fifths of them on
both sides: splitting a large table by vantage points alone would copy it hundreds of times over. So beyond WHOLE classes, blocks of bits do
the coarse routing: cut into m blocks, two fingerprints within the radius r agree on m - r of them at least, and there is a bucket for what
each choice of m - r blocks holds. m grows with the table so that a bucket has BUCKET classes on average: 5 buckets a class up to 7 million
classes, 15 up to 2.7 thousand million. Buckets that are larger, as texts aren't random, are split by vantage points. All of this is exact.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat
from math import ceil, comb, log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, parts_for, release, spread, table, tidy, unused
from .components import components

SEED, SHINGLE, MAX_DISTANCE = 42, 4, 4
LEAF = 48
#: Classes that are split by vantage points alone, classes in a bucket on average beyond that, and points from which on a bucket is split.
WHOLE, BUCKET, SHARD_POINTS = 16_384, 1_024, 4_096
#: A split must leave no side more than this share of the points; what can't be split so (near copies of each other) stays one shard.
SPLIT_SHARE = 0.8
#: Entries (a fingerprint in a bucket) that one shard partition holds.
SHARD_ENTRIES = 60_000
#: Rows whose entries are dealt out at a time.
DEAL_ROWS = 2_000
#: Rows about buckets, texts or copies that are broadcast.
BROADCAST_ROWS = 200_000


def words_of(text: str) -> list[bytes]:
    """Words of a text whose letters A-Z are lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of every k consecutive words joined by a space, repeats included; of all words if they are fewer than k."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - k + 1)


def fingerprint(words: list[bytes], k: int = SHINGLE, n_words: int = 1) -> bytes:
    """n_words * 64 bits, big-endian; a bit is set if it is in over half the hashes. No words: zero."""
    return votes(shingle_hashes(words, k), n_words)


def votes(h: np.ndarray, n_words: int) -> bytes:
    """The fingerprint of hashes."""
    out = []
    for j in range(n_words):
        if j:  # further words come from remixed hashes
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        bits = np.zeros(64, dtype=np.int64)
        for lo in range(0, len(h), 65_536):
            bits += np.unpackbits(h[lo : lo + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(2 * bits > len(h)).tobytes() if len(h) else bytes(8))
    return b"".join(out)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (64 bits as a signed number) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(fingerprint(words_of(t.as_py() or ""), shingle) for t in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], ["doc_id", "fp"])

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(tidy(run), "doc_id long, fp long")


def n_blocks(classes: int, radius: int, whole: int = WHOLE, bucket: int = BUCKET) -> int:
    """Into how many blocks fingerprints are cut for so many classes; radius blocks mean a bucket for all."""
    m = radius
    while m < 64 and classes > (whole if m == radius else bucket * 2 ** (64 * (m - radius) / m)):
        m += 1
    return m


def masks(m: int, radius: int) -> list[int]:
    """The bits of each choice of m - radius of m blocks, as signed 64-bit numbers. Points within the radius agree on one of them."""
    blocks = [sum(1 << int(b) for b in part) for part in np.array_split(np.arange(64), m)]
    chosen = [sum(x) for x in combinations(blocks, m - radius)]
    assert len(chosen) == comb(m, radius)
    return [x - (1 << 64) if x >> 63 else x for x in chosen]


def bands(bits: int, n: int, each: int) -> list[np.ndarray]:
    """n samples of bit positions, for distances too large for disjoint blocks. Fixed by a seed."""
    rng = np.random.default_rng(20)
    return [np.sort(rng.permutation(bits)[:each]) for _ in range(n)]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances along the last axis."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class Links:
    """Union-find over the points of one bucket that keeps the links which joined two parts."""

    def __init__(self, n: int, part: np.ndarray | None = None):
        self.part = np.arange(n) if part is None else np.unique(part, return_inverse=True)[1].astype(np.int64)
        self.kept: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Joins points pairwise."""
        while len(i):
            a, b = self.part[i], self.part[j]
            live = a != b
            i, j, a, b = i[live], j[live], a[live], b[live]
            if not len(i):
                return
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            # each part hangs on one smaller part, chosen among its links; the rest are looked at again
            order = np.lexsort((lo, hi))
            first = order[np.flatnonzero(np.diff(hi[order], prepend=-1))]
            to = np.arange(int(self.part.max()) + 1)
            to[hi[first]] = lo[first]
            while not np.array_equal(nxt := to[to], to):
                to = nxt
            self.part = to[self.part]
            self.kept += zip(i[first].tolist(), j[first].tolist(), strict=True)


class Tree:
    """A vantage-point tree over rows of `points`; nodes are ranges of a permutation."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.visited = self.skipped = 0  # branches that some query entered, and that none did
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []  # (lo, hi, vantage, (child, least, most) twice) or (lo, hi)
        self.root = self.build(0, len(points))

    def build(self, lo: int, hi: int) -> int:
        me = len(self.nodes)
        self.nodes.append((lo, hi))
        if hi - lo > LEAF:
            own = self.order[lo:hi]
            v = own[len(own) // 2]
            d = distance(self.points[own], self.points[v])
            sort = np.argsort(d, kind="stable")
            self.order[lo:hi], d = own[sort], d[sort]
            mid = int(np.searchsorted(d, d[len(d) // 2], side="left"))
            mid = mid if 0 < mid < len(d) else int(np.searchsorted(d, d[0], side="right"))
            if 0 < mid < len(d):
                near = (self.build(lo, lo + mid), int(d[0]), int(d[mid - 1]))
                far = (self.build(lo + mid, hi), int(d[mid]), int(d[-1]))
                self.nodes[me] = (lo, hi, int(v), near, far)
        return me

    def join(self, radius: int, links: Links) -> None:
        """Adds the links of all points within the radius of each other, but for those that others imply."""
        todo = [(self.root, np.arange(len(self.points)))]
        while todo:
            node, asks = todo.pop()
            lo, hi, *rest = self.nodes[node]
            parts = links.part[self.order[lo:hi]]
            if (parts == parts[0]).all():
                asks = asks[links.part[asks] != parts[0]]
            if not len(asks):
                self.skipped += 1
                continue
            self.visited += 1
            if rest:
                v, *children = rest
                d = distance(self.points[asks], self.points[v])
                close = asks[d <= radius]
                links.add(close, np.full(len(close), v))
                for child, least, most in children:
                    todo.append((child, asks[(d >= least - radius) & (d <= most + radius)]))
            else:
                own = self.order[lo:hi]
                for at in range(0, len(asks), 4096):
                    part = asks[at : at + 4096]
                    i, j = np.nonzero(distance(self.points[part][:, None, :], self.points[own][None, :, :]) <= radius)
                    links.add(part[i], own[j])


def bucket_links(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the points."""
    links = Links(len(points))
    Tree(points).join(radius, links)
    return links.kept


def closest_links(points: np.ndarray, parts: np.ndarray, radius: int, step: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between points of different parts, in which closer links come before farther ones, by steps of distance."""
    links = Links(len(points), parts)
    if len(points) <= LEAF:
        i, j = np.nonzero(np.triu(links.part[:, None] != links.part[None, :], 1))
        d = distance(points[i], points[j])
        for reach in range(step, radius + step, step):
            near = (d <= min(reach, radius)) & (d > reach - step if reach > step else d >= 0)
            links.add(i[near], j[near])
        return links.kept
    tree = Tree(points)
    for reach in range(step, radius + step, step):
        if (links.part == links.part[0]).all():
            break
        tree.join(min(reach, radius), links)
    return links.kept


def bounded(rows: DataFrame) -> DataFrame:
    """Broadcast up to a counted number of rows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def buckets(classes: DataFrame, m: int, radius: int) -> DataFrame:
    """bucket, fp, rep: each class (fp, rep) in a bucket for every choice of m - radius blocks. Choices may meet in a bucket; that costs, but loses, nothing."""
    keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(mask))) for k, mask in enumerate(masks(m, radius))]
    return classes.select(F.explode(F.array(*keys)).alias("bucket"), "fp", "rep")


def vantage_shards(entries: DataFrame, radius: int, most: int = SHARD_POINTS, share: float = SPLIT_SHARE) -> DataFrame:
    """bucket, fp, rep: buckets of more than `most` points split by distance from a vantage point, again and again, overlapping at the boundary.

    Per round, what is known of a bucket is a row for each distance, 65 at most; only oversized buckets are moved again.
    """
    done, todo, turn = [], entries, 0
    while True:
        turn += 1
        large = cut(todo.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("fp", F.lit(turn))).alias("vantage")).filter(F.col("n") > most))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, todo])
        d = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")))
        at = todo.join(bounded(large), "bucket").groupBy("bucket", "n", "vantage", d.alias("d")).agg(F.count("*").alias("points"))
        by = Window.partitionBy("bucket").orderBy("d")
        near = F.sum("points").over(by.rangeBetween(Window.unboundedPreceding, 0))
        far = F.col("n") - F.coalesce(F.sum("points").over(by.rangeBetween(Window.unboundedPreceding, -radius)), F.lit(0))
        edges = at.select("bucket", "n", "vantage", F.col("d").alias("edge"), F.greatest(near, far).alias("larger"))
        edges = edges.groupBy("bucket", "vantage", "n").agg(F.min_by("edge", "larger").alias("edge"), F.min("larger").alias("larger")).filter(F.col("larger") <= share * F.col("n"))
        edges = bounded(cut(edges.select("bucket", "vantage", "edge")))
        done.append(todo.join(edges.select("bucket"), "bucket", "left_anti"))
        sides = F.array(F.when(d <= F.col("edge"), F.xxhash64("bucket", F.lit(turn), F.lit("near"))), F.when(d > F.col("edge") - radius, F.xxhash64("bucket", F.lit(turn), F.lit("far"))))
        todo = cut(todo.join(edges, "bucket").select(F.explode(sides).alias("bucket"), "fp", "rep").filter("bucket is not null"))


def shard_links(shards: DataFrame, radius: int, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """a, b: links between representatives whose fingerprints are within the radius, a forest for each shard (bucket, fp, rep)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def found() -> Iterator[pa.RecordBatch]:
            fp, rep = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.empty(0), np.empty(0))
            if len(fp) > 1 and (pairs := bucket_links(fp.view(np.uint64).reshape(-1, 1), radius)):
                i, j = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(rep[i], pa.int64()), pa.array(rep[j], pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, fp, rep = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            edges = np.flatnonzero(np.diff(bucket)) + 1
            lows, highs = np.append(0, edges), np.append(edges, len(bucket))
            wide = np.flatnonzero((highs - lows > 1) | (lows == 0) | (highs == len(bucket)))  # the rest are points alone in their bucket
            for lo, hi in zip(lows[wide].tolist(), highs[wide].tolist(), strict=True):
                if bucket[lo] != at:
                    yield from found()
                    at, held = bucket[lo], []
                held.append((fp[lo:hi], rep[lo:hi]))
        yield from found()

    n_parts = parts_for(shards.count(), shard_entries)
    return shards.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(search), "a long, b long")


def exact_links(classes: DataFrame, radius: int, *, whole: int = WHOLE, bucket: int = BUCKET, shard_points: int = SHARD_POINTS, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """a, b: links between the representatives of classes (fp, rep) within the radius; all are joined that any chain of links joins."""
    m = n_blocks(classes.count(), radius, whole, bucket)
    entries = buckets(classes, m, radius) if m > radius else classes.select(F.lit(0).cast("long").alias("bucket"), "fp", "rep")
    return shard_links(vantage_shards(entries, radius, shard_points), radius, shard_entries)


def band_links(classes: DataFrame, n_words: int, radius: int, blocks_of: list[np.ndarray], shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """a, b: links between representatives (fp, rep, root) of different roots whose fingerprints are within the radius and agree on one of the
    blocks, a forest of the closest links for each bucket of such. The blocks may be samples of bits, for distances too large for exact ones.
    """
    n_parts = parts_for(classes.count() * len(blocks_of), shard_entries)
    bits = 64 * n_words
    assert max(map(len, blocks_of)) <= 48 and len(blocks_of) < 1 << 16

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, DEAL_ROWS):
                yield dealt(batch.slice(lo, DEAL_ROWS))

    def dealt(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = b"".join(batch.column(0).to_pylist())
        rep = batch.column(1).to_numpy(zero_copy_only=False).astype("<i8")
        root = batch.column(2).to_numpy(zero_copy_only=False).astype("<i8")
        fp = np.frombuffer(raw, ">u8").astype("<u8").reshape(-1, n_words)
        bit = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(rep), -1), axis=1)
        assert bit.shape[1] == bits
        # the block's number in the upper 16 bits and its value in the lower 48, mixed: the upper half picks the part, the lower is the key in it
        keys = np.concatenate([(bit[:, b].astype(np.uint64) @ (np.uint64(1) << np.arange(len(b), dtype=np.uint64))) | np.uint64(k << 48) for k, b in enumerate(blocks_of)])
        keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
        part = ((keys >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64)
        keys = keys.astype("<u4")
        row = np.tile(np.arange(len(rep), dtype=np.int32), len(blocks_of))
        order = np.argsort(part, kind="stable")
        parts, blobs = [], []
        for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            at = row[own]
            parts.append(int(part[own[0]]))
            blobs.append(struct.pack("<I", len(own)) + keys[own].tobytes() + rep[at].tobytes() + fp[at].tobytes() + root[at].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, reps, fps, roots = [], [], [], []
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                n = struct.unpack_from("<I", blob)[0]
                keys.append(np.frombuffer(blob, "<u4", n, 4))
                reps.append(np.frombuffer(blob, "<i8", n, 4 + 4 * n))
                fps.append(np.frombuffer(blob, "<u8", n * n_words, 4 + 12 * n).reshape(n, n_words))
                roots.append(np.frombuffer(blob, "<i8", n, 4 + (12 + 8 * n_words) * n))
        if not keys:
            return
        key, rep, fp = np.concatenate(keys), np.concatenate(reps), np.concatenate(fps)
        order = np.lexsort((rep, key))
        key, rep, fp = key[order], rep[order], fp[order]
        edges = np.flatnonzero(np.diff(key, prepend=~key[:1], append=~key[-1:]))
        root = np.concatenate(roots)[order]
        found: list[tuple[int, int]] = []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if hi - lo > 1:
                found += ((lo + i, lo + j) for i, j in closest_links(fp[lo:hi], root[lo:hi], radius, STEP))
        if found:
            i, j = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(rep[i], pa.int64()), pa.array(rep[j], pa.int64())], ["a", "b"])

    moved = classes.select("fp", "rep", "root").mapInArrow(tidy(deal), "part long, blob binary").repartition(n_parts, "part")
    return moved.mapInArrow(tidy(search), "a long, b long")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE, **sizes: int) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every row.

    Rows whose fingerprints differ in max_distance bits or fewer are linked; component_id is the smallest id reachable, itself included.
    Null and empty texts have the fingerprint zero, which links like any other. A row without an id bears no links and has the id of its
    class, if the class has one. Repeated rows give a row each; an empty table gives none. Other columns are not read.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(exact_links(classes.filter("rep is not null"), max_distance, **sizes))
    named = classes.join(roots, classes["rep"] == roots["node"], "left").select(F.col("fp").alias("_fp"), F.coalesce("root", "rep").alias("component_id"))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, prints["fp"] == named["_fp"]).select("doc_id", shown.alias("fingerprint"), "component_id")


def op8_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))


#: For similarity 0.8 on five-word shingles: 256 bits, voted by distinct shingles; two texts of that similarity differ in 39 +- 6 bits, and
#: in 48 +- 6 if one has four shingles and the other five. Candidates are within NEAR_DISTANCE and share one of the bands of sampled bits,
#: as disjoint blocks would hardly select at this distance: 0.997 of pairs at 0.8. The exact similarity decides each.
NEAR_SHINGLE, NEAR_WORDS, NEAR_DISTANCE = 5, 4, 64
#: Bits of a band at least, and classes that share a band's value at random at most; from the number of classes follow the bits of a band,
#: and from these the number of bands that keeps the recall.
LEAST_BITS, BAND_CLASSES, LEAST_BANDS = 13, 64, 64
#: Distance of two texts at 0.8; turns in which the bands are taken; steps of distance by which closer links come first.
MEAN_DISTANCE, TURNS, STEP = 39, 4, 4


def band_shape(classes: int) -> tuple[int, int]:
    """How many bands of how many bits so many classes need: 64 of 13 up to half a million."""
    bits = max(LEAST_BITS, ceil(log2(max(1, classes) / BAND_CLASSES)))
    agree = 1 - MEAN_DISTANCE / (64 * NEAR_WORDS)  # a bit of two texts at 0.8
    return ceil(LEAST_BANDS * log(1 - agree**LEAST_BITS) / log(1 - agree**bits)), bits


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(words_of(text or ""), NEAR_SHINGLE))


def near_prints(rows: DataFrame) -> DataFrame:
    """doc_id, tag, fp, rep of rows (doc_id, tag, text): rep is a hash of the text's set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(2)]
            reps = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([votes(s, NEAR_WORDS) for s in sets], pa.binary()), pa.array(reps, pa.int64())], ["doc_id", "tag", "fp", "rep"])

    return spread(rows).mapInArrow(tidy(run), "doc_id long, tag long, fp binary, rep long")


def verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Those pairs (a, b) of representatives whose sets of shingles have a Jaccard similarity of 0.8 or more.

    rows: doc_id, tag, text. classes: rep, least (the doc_id and tag of a row that has its text). Texts of few representatives aren't shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingle_set(t.as_py()).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = pairs.select(F.col("a").alias("_end")).unionAll(pairs.select("b")).distinct()
    ends = cut(classes.join(ends, classes["rep"] == ends["_end"], "left_semi").select("rep", F.col("least.doc_id").alias("_id"), F.col("least.tag").alias("_tag")))
    texts = rows.join(bounded(ends), (F.col("doc_id") == F.col("_id")) & (F.col("tag") == F.col("_tag"))).select("rep", "text")
    sets = cut(texts.mapInArrow(tidy(run), "node long, shingles array<long>").dropDuplicates(["node"]))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_s"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_t"))
    both = F.size(F.array_intersect("_s", "_t"))
    return cut(pairs.join(left, "a").join(right, "b").filter(5 * both >= 4 * (F.size("_s") + F.size("_t") - both)).select("a", "b"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag (XXH64 of the text), component_id of every row: rows whose sets of five-word shingles have a Jaccard similarity of 0.8 or
    more are linked.

    Texts of equal sets are one class. The bands are taken in TURNS parts. In each turn, every bucket of a band gives a forest of the closest
    candidates between classes that are still apart, which are verified and joined; so pairs grow with the bands' entries and not with the
    square of a family of similar texts. A candidate that fails may stand for a farther one that wouldn't have; such a pair is found in another
    of the bands that it shares, 7 of 64 on average at 0.8 and more above. Measured on a table with large families (51,282 rows), 8,797
    rows go, where verifying all candidates between classes still apart, 1.3 million, lets 8,817 go.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    prints = cut(near_prints(rows))
    classes = cut(prints.groupBy("rep").agg(F.first("fp").alias("fp"), F.min(F.struct("doc_id", "tag")).alias("least")))
    bits_of = bands(64 * NEAR_WORDS, *band_shape(classes.count()))
    links, named = None, classes.withColumn("root", F.col("rep"))
    for turn in range(TURNS):
        found = verified(band_links(named, NEAR_WORDS, NEAR_DISTANCE, bits_of[turn::TURNS]), rows, classes)
        links = found if links is None else links.unionAll(found)
        roots = components(links)
        named = cut(classes.join(roots, classes["rep"] == roots["node"], "left").select("rep", "fp", "least", F.coalesce("root", "rep").alias("root")))
        del found, roots
        release(docs.sparkSession)
    named = named.select("rep", F.col("least.doc_id").alias("least"), "root")
    least = named.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    named = named.join(least, named["root"] == least["_root"]).select(F.col("rep").alias("_rep"), "component_id")
    return prints.join(named, prints["rep"] == named["_rep"]).select("doc_id", "tag", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, that with the smallest id, all its columns untouched, whatever their names.

    Texts without words are not near copies of each other and all stay, as do rows without an id. Of rows that bear one id, each is judged by
    its own text; those that repeat the smallest id of their group all stay. Only the ids and hashes of what goes meet the documents; up to
    BROADCAST_ROWS of them, no text is shuffled for it.
    """
    worded = docs.filter(F.col(id_col).isNotNull() & F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    gone_id, gone_tag = unused(docs, "gone_id", "gone_tag")
    gone = near_groups(worded, id_col, text_col).filter("component_id <> doc_id")
    gone = bounded(cut(gone.select(F.col("doc_id").alias(gone_id), F.col("tag").alias(gone_tag)).distinct()))
    return docs.join(gone, (docs[id_col] == gone[gone_id]) & (F.xxhash64(docs[text_col]) == gone[gone_tag]), "left_anti")
