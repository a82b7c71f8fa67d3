"""Lexical retrieval packing: a sharded BM25 inverted index finds unused neighbours for each seed document.

A task cuts its rows into shards of at most `shard_tokens` tokens, so memory is bounded whatever the partition holds. Each shard has an
inverted index of its own. The first unused document seeds a window of `seq_len` tokens; the index ranks the unused documents of the
shard by BM25 against the seed's most telling terms, and they fill the window from the best down. The one that no longer fits is cut; its
rest seeds the next window. So every window is full but the last of a shard, whose tokens go to sequences of lengths that are powers of two,
which need no padding. There is no shuffle: a lost executor costs the tasks it ran. Shards follow the order of a task's rows, so which
documents are neighbours, and with it the sequences, depends on how the table is laid out in files; that every token lies in exactly one
sequence doesn't.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import give_back, spread, table, tidy

SEQ_LEN, END_ID = 2048, 1
SHARD_TOKENS, QUERY_TERMS = 2_000_000, 24
K1, B = 1.2, 0.75
#: Fixed value: the pattern by which byte-level BPE splits a text before it merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts on which the fast way must agree with the tokenizer, or else the tokenizer does all.
PROBES = ["", "It's a  test,\n\n of 12 \t things… and été ü", " \x85\u00a0x\u2003 y ", "日本語 🙂 naïve", "'Re 'LL don't  "]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_ranks(vocab: dict[str, int]) -> dict[bytes, int]:
    """The vocabulary of a byte-level BPE by its bytes: printable Latin-1 stands for itself, the other bytes for U+0100 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(own))}
    return {bytes(back[c] for c in piece): i for piece, i in vocab.items() if all(c in back for c in piece)}


class Encoder:
    """Token ids of whole texts. Merges by rank give the tokenizer's own ids several times faster; a text with one of its special strings goes
    to the tokenizer itself, as do all with `slow`. The tokenizer is some 30 MB, so it is held only from the first text on that needs it."""

    def __init__(self, tokenizer: str, slow: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        full = Tokenizer.from_file(tokenizer)
        self.path, self.full = tokenizer, None
        self.special = [t.content for t in full.get_added_tokens_decoder().values()]
        ranks = {k: i for k, i in byte_ranks(full.get_vocab()).items() if k.decode("utf-8", "replace") not in self.special}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        if slow or any(self.fast(x) != full.encode(x, add_special_tokens=False).ids for x in PROBES):
            self.fast, self.full = None, full

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(x in text for x in self.special):
            if self.full is None:
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_file(self.path)
            return np.asarray(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self.fast(text), dtype="<u4")


def starts(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal neighbours begin."""
    new = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


class Index:
    """BM25 postings of one shard: for each term, the documents that hold it and what it adds to their score. Arrays as long as the shard are few
    at a time, as several tasks build one at once."""

    def __init__(self, terms: list[np.ndarray]):
        n = len(terms)
        length = np.array([len(t) for t in terms], dtype=np.int64)
        width = max(1, n)
        # a sorted number for each occurrence, the term above the document; runs of equal ones are postings
        key = np.concatenate(terms, dtype=np.int64) if n else np.empty(0, np.int64)
        key *= width
        at = 0
        for doc, size in enumerate(length.tolist()):
            key[at : at + size] += doc
            at += size
        key.sort()
        at = starts(key)
        tf = np.diff(at, append=len(key)).astype(np.int32)
        key = key[at]
        del at
        self.doc = (key % width).astype(np.int32)
        key //= width
        term = key.astype(np.int32)
        del key
        first = starts(term)
        df = np.diff(first, append=len(term))
        del term
        self.first, self.df = first, df
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(1.0, length.mean() if n else 1.0))
        weight = np.repeat(idf, df)
        weight *= tf
        weight *= K1 + 1
        below = norm[self.doc]
        below += tf
        weight /= below
        del below, tf
        self.weight = weight.astype(np.float32)
        del weight
        self.n = n
        by_doc = np.argsort(self.doc, kind="stable")
        self.slot = np.repeat(np.arange(len(df), dtype=np.int32), df)[by_doc]
        self.by_doc = np.append(0, np.cumsum(np.bincount(self.doc, minlength=n)))
        self.own = self.weight[by_doc]

    def neighbours(self, seed: int, unused: np.ndarray, terms: int) -> np.ndarray:
        """Unused documents that share one of the seed's most telling terms, best first, ties by position."""
        lo, hi = self.by_doc[seed], self.by_doc[seed + 1]
        slots, own = self.slot[lo:hi], self.own[lo:hi]
        shared = self.df[slots] > 1
        slots, own = slots[shared], own[shared]
        if len(slots) > terms:
            slots = slots[np.argsort(-own, kind="stable")[:terms]]
        if not len(slots):
            return slots
        spans = [slice(self.first[s], self.first[s] + self.df[s]) for s in slots]
        docs = np.concatenate([self.doc[s] for s in spans])
        score = np.bincount(docs, np.concatenate([self.weight[s] for s in spans]), minlength=self.n)
        score[~unused] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(lengths: list[int], index: Index, seq_len: int, query_terms: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; every token of the shard lies in exactly one."""
    out: list[tuple[int, int, int, int, int]] = []
    start = [0] * len(lengths)
    unused = np.ones(len(lengths), dtype=bool)
    seq = at = nxt = 0

    def put(doc: int, n: int) -> None:
        nonlocal seq, at
        out.append((doc, start[doc], n, seq, at))
        start[doc] += n
        at += n
        if at == seq_len:
            seq, at = seq + 1, 0

    cut = -1
    while True:
        if cut < 0:
            while nxt < len(lengths) and not unused[nxt]:
                nxt += 1
            if nxt == len(lengths):
                break
            cut = nxt
        seed, cut = cut, -1
        unused[seed] = False
        while lengths[seed] - start[seed] >= seq_len - at:
            put(seed, seq_len - at)
        if start[seed] == lengths[seed]:
            continue
        put(seed, lengths[seed] - start[seed])
        ranked = iter(index.neighbours(seed, unused, query_terms))
        while at:
            doc = next(ranked, None)
            if doc is None:
                break  # no neighbour is left: the next unused document goes on in this window
            doc = int(doc)
            unused[doc] = False
            n = min(seq_len - at, lengths[doc])
            put(doc, n)
            if n < lengths[doc]:
                cut = doc
    return halve(out, seq, at) if at else out


def halve(pieces: list[tuple[int, int, int, int, int]], seq: int, left: int) -> list[tuple[int, int, int, int, int]]:
    """Deals the last, partial window out to sequences whose lengths are powers of two."""
    sizes = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
    done, ends = [p for p in pieces if p[3] < seq], np.cumsum([0, *sizes])
    for doc, start, n, s, at in pieces:
        if s < seq:
            continue
        while n:
            k = int(np.searchsorted(ends, at, side="right")) - 1
            take = min(n, int(ends[k + 1]) - at)
            done.append((doc, start, take, seq + k, at - int(ends[k])))
            start, n, at = start + take, n - take, at + take
    return done


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, seq_len: int = SEQ_LEN, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, query_terms: int = QUERY_TERMS, with_ids: bool = False, slow: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most seq_len tokens.

    A null text counts as empty and is the end id alone. Rows that repeat an id are packed each for itself; a null id stays null. An empty
    table gives no pieces. Other columns are not read. Of documents that score alike, the earlier one comes first. query_terms: how many of a
    seed's most telling terms are looked up; the length of the seed is the exact way. with_ids adds each piece's token ids as
    array<int>. slow: every text goes to the tokenizer itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = Encoder(tokenizer, slow), np.asarray([end_id], dtype="<u4")
        give_back()
        base = TaskContext.get().partitionId() << 40
        done = 0
        shard: list[tuple[int | None, np.ndarray, np.ndarray]] = []
        words: dict[str, int] = defaultdict(lambda: len(words))
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done, tokens
            pieces = pack_shard([len(x[1]) for x in shard], Index([x[2] for x in shard]), seq_len, query_terms)
            for lo in range(0, len(pieces), 20_000):
                part = pieces[lo : lo + 20_000]
                ids = [shard[d][1][s : s + n] for d, s, n, _, _ in part]
                cols = [
                    pa.array([shard[p[0]][0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64()), pa.array([p[2] for p in part], pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([len(shard[p[0]][1]) for p in part], pa.int64()),
                    pa.array([base + done + p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.int64()),
                ]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
            done += max((p[3] for p in pieces), default=-1) + 1
            shard.clear()
            words.clear()
            tokens = 0
            del pieces
            give_back()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids = np.append(enc.encode(text), end)
                shard.append((doc, ids, np.fromiter(map(words.__getitem__, text.lower().split()), np.int32)))
                tokens += len(ids)
                if tokens >= shard_tokens:
                    yield from flush()
            del batch  # or it would stay until the next one is read
        if shard:
            yield from flush()

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return spread(rows).mapInArrow(tidy(run), SCHEMA + (", ids array<int>" if with_ids else ""))


def op1_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
