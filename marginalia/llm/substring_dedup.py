"""Substring deduplication by prefix-partitioned suffix trees.

A suffix is the sequence of a document's words from some word on; of interest are those with 13 words or more. Suffixes are split into
groups by a prefix of variable length: up to and with the anchor, the four words of least hash within the suffix's first 13. Suffixes whose
first 13 words agree have the same anchor and so meet in one group, and consecutive suffixes of a document mostly share theirs, so that a
run of them travels as one piece of text. Within a group, suffixes are sorted by their words, neighbours are compared word by word, and the
maximal intervals of neighbours that share 13 words or more are the deep internal nodes of the group's suffix tree. A suffix below a node is
a repeat if a smaller document has a suffix there too. Hashes decide only which suffixes meet, never whether they agree.

Memory: a group is held as a whole, so one that outgrows `group_suffixes` isn't held at all. Its prefixes are extended to 13 words instead:
each suffix goes on by itself, and a second shuffle sorts them by these prefixes, so that a task needs to hold one prefix at a time.

A map batch settles what it can alone: of suffixes that agree within the batch, only those of the smallest document travel on, as the
others are repeats whatever other batches hold. A passage in a third of all documents costs a record for each batch, not for each document.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, parts_for, spread, table, tidy

WINDOW, ANCHOR = 13, 4
#: Text in one map batch, in one group of suffixes on average, and in one partition of groups; suffixes that are held and sorted at once.
BATCH_CHARS, GROUP_CHARS, PART_CHARS, GROUP_SUFFIXES = 8_000_000, 3_000_000, 192_000_000, 2_000_000
#: Of zstd, by which what moves takes two fifths of its size.
LEVEL = 3
#: Partitions of groups, if there are as many groups; more for large tables.
PARTS = 512
#: Ids with several texts that are broadcast.
BROADCAST_IDS = 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)
RUN = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("first", "<u4"), ("count", "<u4")])
HEAD = struct.Struct("<III")


def words_of(text: str) -> list[bytes]:
    """Maximal runs of characters other than space and the controls from tab to carriage return."""
    return text.encode("utf-8", "surrogatepass").split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * MIX
    return h ^ (h >> np.uint64(32))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values."""
    out = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
    for j in range(k):
        out = out * MIX + h[j : j + len(out)]
    return mixed(out)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    out, have = v, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def split(text: bytes) -> pa.Array:
    """The words of a text in which single spaces part them."""
    return pc.split_pattern(pa.array([text], pa.large_binary()), pattern=" ").flatten() if text else pa.array([], pa.large_binary())


def numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's rank among the distinct ones, and these in order."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(order)


def packed(flat: np.ndarray, starts: np.ndarray, names: int, depth: int = WINDOW) -> list[np.ndarray]:
    """The first `depth` words of each suffix as few numbers that sort as the words do."""
    bits = max(1, int(names).bit_length())
    each = max(1, 63 // bits)
    keys = []
    for lo in range(0, depth, each):
        key = np.zeros(len(starts), dtype=np.int64)
        for j in range(lo, min(depth, lo + each)):
            key = key << bits | flat[starts + j]
        keys.append(key)
    return keys


def suffix_order(flat: np.ndarray, starts: np.ndarray, docs: np.ndarray, names: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes sorted by their first 13 words, then by document; and where in that order a node of depth 13 begins."""
    keys = packed(flat, starts, names)
    order = np.lexsort((docs, *reversed(keys)))
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = False
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
    return order, np.flatnonzero(new)


def common_words(flat: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """How many words the suffixes at a and b share (the LCP), up to `most`; ends: where the text of each position's document or run ends."""
    room = np.minimum(ends[a] - a, ends[b] - b)
    if most is not None:
        room = np.minimum(room, most)
    out, live = np.zeros(len(a), dtype=np.int64), np.flatnonzero(room > 0)
    while len(live):
        live = live[flat[a[live] + out[live]] == flat[b[live] + out[live]]]
        out[live] += 1
        live = live[out[live] < room[live]]
    return out


def maximal_repeats(texts: list[tuple[int, str]], least: int = WINDOW) -> list[tuple[tuple[bytes, ...], list[tuple[int, int]]]]:
    """The maximal repeats of `least` words or more: each with its occurrences (document, word) in order, two or more.

    They are the internal nodes of depth `least` on of the suffix tree whose suffixes don't all follow the same word: the intervals of the
    suffix order whose LCPs are all as great, ended by smaller ones on both sides.
    """
    docs = [(d, words_of(t)) for d, t in texts]
    flat, names = numbered(pa.array([w for _, ws in docs for w in ws], pa.large_binary()))
    lengths = np.array([len(ws) for _, ws in docs], dtype=np.int64)
    firsts = np.cumsum(lengths) - lengths
    ends = np.repeat(firsts + lengths, lengths)
    at = np.arange(len(flat))
    starts = at[ends - at >= least]
    order = starts[np.array(sorted(range(len(starts)), key=lambda i: flat[starts[i] : ends[starts[i]]].tolist()), dtype=np.int64)] if len(starts) else starts
    owner = np.repeat(np.arange(len(docs)), lengths)
    lcp = [0, *common_words(flat, ends, order[:-1], order[1:]).tolist(), 0]
    before = {int(p): (int(flat[p - 1]) if p != firsts[owner[p]] else -1 - int(owner[p])) for p in order}
    found, open_ = [], []  # open nodes: depth, first suffix
    for i in range(1, len(lcp)):
        first = i - 1
        while open_ and open_[-1][0] > lcp[i]:
            depth, first = open_.pop()
            below = order[first:i].tolist()
            if len({before[p] for p in below}) > 1:
                p = below[0]
                found.append((tuple(names[w].as_py() for w in flat[p : p + depth].tolist()), sorted((docs[owner[q]][0], int(q - firsts[owner[q]])) for q in below)))
        if lcp[i] >= least and (not open_ or open_[-1][0] < lcp[i]):
            open_.append((lcp[i], first))
    return found


def repeats(docs: np.ndarray, order: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Which suffixes lie below a node that a smaller document reaches; order sorts each node's suffixes by document."""
    out = np.zeros(len(docs), dtype=bool)
    least = np.repeat(docs[order[node]], np.diff(np.append(node, len(order))))
    out[order] = docs[order] > least
    return out


def intervals(at: np.ndarray) -> np.ndarray:
    """Sorted positions as (first, count) pairs of consecutive runs."""
    if not len(at):
        return np.empty((0, 2), dtype="<u4")
    new = np.flatnonzero(np.diff(at, prepend=at[0] - 2) != 1)
    return np.stack([at[new], np.diff(np.append(new, len(at)))], axis=1).astype("<u4")


def by_doc(docs: np.ndarray, tags: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(document, tag, packed intervals of its repeated window starts)."""
    order = np.lexsort((at, tags, docs))
    docs, tags, at = docs[order], tags[order], at[order]
    cuts = np.flatnonzero((np.diff(docs) != 0) | (np.diff(tags) != 0)) + 1
    for d, t, a in zip(np.split(docs, cuts), np.split(tags, cuts), np.split(at, cuts), strict=True):
        if len(d):
            yield int(d[0]), int(t[0]), intervals(np.unique(a)).tobytes()


def batch_runs(docs: list[tuple[int, int, int, bytes]], n_groups: int) -> Iterator[tuple[int, int | None, int, bytes]]:
    """(group, None, 0, runs of suffixes) for other batches to be compared with, and (group, document, tag, intervals) of repeats found here.

    docs: (document, tag, number of words, the words with single spaces between them).
    """
    docs = [x for x in docs if x[2] >= WINDOW]
    if not docs:
        return
    text = b" ".join(x[3] for x in docs)
    words = split(text)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    ends = ends[1:] - ends[0] + np.arange(len(words))  # of each word in the text
    coded = words.dictionary_encode()
    names, flat = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, names.to_pylist()), np.uint64, len(names))[flat]
    lengths = np.array([x[2] for x in docs])
    firsts = np.cumsum(lengths) - lengths
    anchor = sliding_min(gram_hashes(hashes, ANCHOR), WINDOW - ANCHOR + 1)
    inside = np.ones(len(flat) - WINDOW + 1, dtype=bool)  # windows that cross from one document to the next don't count
    for k in range(1, WINDOW):
        across = firsts[1:] - k
        inside[across[(across >= 0) & (across < len(inside))]] = False
    at = np.flatnonzero(inside)
    owner = np.repeat(np.arange(len(docs)), lengths)[at]
    ids, tags = (np.array([x[i] for x in docs], dtype=np.int64) for i in (0, 1))
    doc, tag, pos = ids[owner], tags[owner], at - firsts[owner]

    # equal hashes first, as they are one number to sort by; only if words that differ share one are the words sorted
    key = gram_hashes(hashes, WINDOW)[at]
    order = np.lexsort((doc, key))
    new = np.diff(key[order], prepend=~key[order[:1]]) != 0
    same = np.flatnonzero(~new)
    if any((flat[at[order[same]] + j] != flat[at[order[same - 1]] + j]).any() for j in range(WINDOW)):
        order, node = suffix_order(flat, at, doc, len(names))
    else:
        node = np.flatnonzero(new)
    repeat = repeats(doc, order, node)
    for d, t, blob in by_doc(doc[repeat], tag[repeat], pos[repeat]):
        yield d % n_groups, d, t, blob

    own = ~repeat
    at, owner, anchor = at[own], owner[own], anchor[at[own]]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(owner) != 0) | (np.diff(at) != 1) | (anchor[1:] != anchor[:-1])
    begin = np.flatnonzero(new)
    runs = np.empty(len(begin), dtype=RUN)
    runs["doc"], runs["tag"], runs["first"] = ids[owner[begin]], tags[owner[begin]], at[begin] - firsts[owner[begin]]
    runs["count"] = np.diff(np.append(begin, len(at)))
    group = (mixed(anchor[begin]) % np.uint64(n_groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    lo = np.where(at[begin] > 0, ends[at[begin] - 1] + 1, 0)
    hi = ends[at[begin] + runs["count"] + WINDOW - 2]
    for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        if len(part):
            pieces = [text[a:b] for a, b in zip(lo[part].tolist(), hi[part].tolist(), strict=True)]
            yield int(group[part[0]]), None, 0, pack(runs[part], pieces)


def pack(runs: np.ndarray, pieces: list[bytes]) -> bytes:
    """Runs field by field and byte by byte, as high bytes hardly vary, and the words of each; compressed."""
    raw = b"".join(np.ascontiguousarray(runs[f]).view(np.uint8).reshape(len(runs), -1).T.tobytes() for f in RUN.names) + b" ".join(pieces)
    return HEAD.pack(len(runs), int(runs["count"].sum()), len(raw)) + pa.Codec("zstd", compression_level=LEVEL).compress(raw, asbytes=True)


def suffixes_in(blob: bytes) -> int:
    return HEAD.unpack_from(blob)[1]


def unpack(blob: bytes) -> tuple[np.ndarray, bytes]:
    """The runs of a blob, and the words of all of them, count + 12 for each, with single spaces between them."""
    n, _, size = HEAD.unpack_from(blob)
    raw = pa.decompress(pa.py_buffer(blob)[HEAD.size :], size, codec="zstd", asbytes=True)
    runs, at = np.empty(n, dtype=RUN), 0
    for f in RUN.names:
        wide = RUN[f].itemsize
        runs[f] = np.frombuffer(raw, np.uint8, wide * n, at).reshape(wide, n).T.copy().view(RUN[f]).ravel()
        at += wide * n
    return runs, raw[at:]


def laid_out(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each suffix of the runs: its run, its position in its document, and where it starts among the words of all runs."""
    count = runs["count"].astype(np.int64)
    run = np.repeat(np.arange(len(runs)), count)
    step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    width = count + WINDOW - 1
    return run, runs["first"].astype(np.int64)[run] + step, (np.cumsum(width) - width)[run] + step


def subtree(blobs: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(document, tag, intervals) of the repeats of one group, from its suffixes in order."""
    parts = [unpack(b) for b in blobs]
    runs = np.concatenate([r for r, _ in parts])
    flat, names = numbered(split(b" ".join(w for _, w in parts)))
    run, pos, start = laid_out(runs)
    doc, tag = runs["doc"][run], runs["tag"][run]
    hit = repeats(doc, *suffix_order(flat, start, doc, len(names)))
    yield from by_doc(doc[hit], tag[hit], pos[hit])


def extended(blob: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(hash of the prefix, document, tag, position, prefix): each suffix by itself under a prefix of 13 words."""
    runs, text = unpack(blob)
    words = text.split()
    run, pos, start = laid_out(runs)
    for r, p, s in zip(run.tolist(), pos.tolist(), start.tolist(), strict=True):
        prefix = b" ".join(words[s : s + WINDOW])
        yield xxhash.xxh64_intdigest(prefix) - (1 << 63), int(runs["doc"][r]), int(runs["tag"][r]), p, prefix


def covered(n_words: int, blobs: list[bytes]) -> np.ndarray:
    """Which words a repeated window covers."""
    steps = np.zeros(n_words + 1, dtype=np.int64)
    for blob in blobs:
        pairs = np.frombuffer(blob, "<u4").reshape(-1, 2).astype(np.int64)
        np.add.at(steps, pairs[:, 0], 1)
        np.add.at(steps, np.minimum(pairs[:, 0] + pairs[:, 1] - 1 + WINDOW, n_words), -1)
    return np.cumsum(steps[:-1]) > 0


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of long and binary columns."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "binary" else pa.int64()) for c, k in zip(cols, kinds, strict=True)], list(names))


MOVED, SETTLED = "grp long, doc_id long, tag long, blob binary", "doc_id long, tag long, blob binary"
#: What a task of groups puts out: settled repeats (no key), or a suffix under an extended prefix.
MIXED = "key long, doc_id long, tag long, at long, blob binary"


def scan(n_groups: int, batch_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for d, g, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py()
                words = words_of(text)
                held.append((d, g, len(words), b" ".join(words)))
                size += len(text)
                if size >= batch_chars:
                    found = list(batch_runs(held, n_groups))
                    held, size = [], 0
                    if found:
                        yield batch_of(found, MOVED)
        if found := list(batch_runs(held, n_groups)):
            yield batch_of(found, MOVED)

    return run


def trees(group_suffixes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size, out = None, [], 0, []

        def close() -> None:
            nonlocal size
            if held:
                out.extend((None, d, g, None, b) for d, g, b in subtree(held))
            held.clear()
            size = 0

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            if len(out) >= least:
                yield batch_of(out, MIXED)
                out.clear()

        for batch in batches:
            for g, d, t, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if g != at:
                    close()
                    at, over = g, False
                if d is not None:
                    out.append((None, d, t, None, blob))
                elif not over and size + suffixes_in(blob) <= group_suffixes:
                    held.append(blob)
                    size += suffixes_in(blob)
                else:  # the group outgrows memory: its prefixes are extended
                    over = True
                    for one in (*held, blob):
                        out.extend(extended(one))
                        yield from flush(1)
                    held.clear()
                yield from flush(10_000)
        close()
        yield from flush(1)

    return run


def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among suffixes that come sorted by the hash of their prefix and by document: the first of a prefix is of the least document."""
    at, least = None, {}
    for batch in batches:
        out = []
        for key, d, t, p, prefix in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if key != at:
                at, least = key, {}
            if least.setdefault(prefix, d) < d:
                out.append((d, t, struct.pack("<II", p, 1)))
        if out:
            yield batch_of(out, SETTLED)


def tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tag, text of every row. The tag tells the texts of one id apart: XXH64 of the text where an id has several, else 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    several = rows.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    several = cut(several.filter("a <> b").select("_id"))
    n = several.count()
    if not n:
        return rows.select("doc_id", F.lit(0).cast("long").alias("tag"), "text")
    rows = rows.join(F.broadcast(several) if n <= BROADCAST_IDS else several, rows["doc_id"] == several["_id"], "left")
    return rows.select("doc_id", F.when(F.col("_id").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0)).alias("tag"), "text")


def repeated_windows(rows: DataFrame, batch_chars: int = BATCH_CHARS, group_chars: int = GROUP_CHARS, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """doc_id, tag, starts of rows (doc_id, tag, text): for each text with repeats, blobs of (first, count) intervals of the window starts
    whose words a smaller doc_id has too. Rows without an id or text take no part."""
    rows = spread(rows.filter("doc_id is not null and text is not null"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n_groups = parts_for(chars, group_chars)
    n_parts = min(n_groups, parts_for(chars, PART_CHARS, PARTS))
    moved = rows.mapInArrow(tidy(scan(n_groups, batch_chars)), MOVED).repartition(n_parts, "grp").sortWithinPartitions("grp")
    found = cut(moved.mapInArrow(tidy(trees(group_suffixes)), MIXED))
    extended = found.filter("key is not null")
    settled = found.filter("key is null").select("doc_id", "tag", "blob")
    if n := extended.count():
        n_parts = parts_for(n, group_suffixes)
        settled = settled.unionAll(extended.repartition(n_parts, "key").sortWithinPartitions("key", "doc_id").mapInArrow(leaves, SETTLED))
    return settled.groupBy("doc_id", "tag").agg(F.collect_list("blob").alias("starts"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, **sizes: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; with_text adds kept (the words that stay, joined by a space) and removed
    (first word and number of words of each maximal stretch that goes).

    A word goes if a window of 13 consecutive words covers it whose sequence also starts in a document with a smaller id. Rows that repeat
    an id are judged each by its own text; their windows aren't compared with each other, as neither id is smaller. Null texts have no
    words; a text under 13 words loses none; a row without an id keeps all. An empty table gives no rows. Other columns are not read.
    """
    rows = tagged(docs, id_col, text_col)
    starts = repeated_windows(rows, **sizes).withColumnsRenamed({"doc_id": "_id", "tag": "_tag"})

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, blobs in zip(batch.column(1), batch.column(2), strict=True):
                words = words_of(t.as_py() or "")
                blobs = blobs.as_py()
                gone = covered(len(words), blobs) if blobs else None
                left = words if gone is None else list(itertools.compress(words, ~gone))
                kept = b" ".join(left)
                row = [len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest()]
                if with_text:
                    row += [kept.decode("utf-8", "surrogatepass"), [] if gone is None else intervals(np.flatnonzero(gone)).astype("<i8").tolist()]
                out.append(row)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int64()))][: 5 if with_text else 3]
            cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "removed"][: len(kinds) + 1])

    joined = rows.join(starts, (rows["doc_id"] == starts["_id"]) & (rows["tag"] == starts["_tag"]), "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(tidy(cut_out), "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string, removed array<array<long>>" if with_text else ""))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 12)) AS p, ws FROM t WHERE len(ws) >= 13),
w AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS g FROM s),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS least FROM w),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 12)) AS i FROM m WHERE least < doc_id),
k AS (SELECT t.doc_id, count(*) AS n_words, count(c.i) AS n_removed, coalesce(string_agg(u.w, ' ' ORDER BY u.i) FILTER (WHERE c.i IS NULL), '') AS kept
  FROM t, LATERAL (SELECT unnest(t.ws) AS w, unnest(generate_series(1, len(t.ws))) AS i) u LEFT JOIN c ON c.doc_id = t.doc_id AND c.i = u.i GROUP BY t.doc_id)
SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)
"""
