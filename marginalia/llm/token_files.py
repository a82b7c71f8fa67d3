"""Token files: ids of whole documents one after another, and Elias-Fano coded boundaries to find each.

A file holds, in this order: MAGIC; the ids, two bytes each where the vocabulary allows it, else four; the boundaries, that is where each document
begins and where the last one ends, as an Elias-Fano sequence; the documents' numbers as another; a footer of fixed size. A sequence of n numbers
up to u takes about 2 + log2(u / n) bits a number, plus a 32-bit position for every STEP-th one, from which `select` scans to its
own; there is no table of 64-bit offsets. So a reader that wants one document reads the footer, the sequences and that document's bytes.

Writing: documents are range-shuffled by number, and each task sorts, encodes and writes its own to files of bounded size under names that no
other attempt uses; its rows of the manifest name the files that it finished, so what failed attempts leave is never read. Where a file begins in
the whole follows from the counts in the manifest. Reading deals out files, not rows, and holds some megabytes of ids at a time.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_dir, table, tidy
from .warc import opened

MAGIC, END_ID = b"TOKIDS1\n", 1
#: Numbers from one sampled position to the next.
STEP = 256
#: Ids in one file, in one piece of a file as it is read, and characters that are encoded at a time.
FILE_TOKENS, READ_TOKENS, TEXT_CHARS = 1 << 26, 1 << 21, 1 << 20
#: Head of a sequence: how many, what was taken off, width of the low bits, bytes of low and high bits, positions.
HEAD = struct.Struct("<qqBqqq")
#: Footer: documents, documents without a number, ids, bytes of an id, and where the two sequences begin.
FOOT = struct.Struct("<qqqBqq")


class EliasFano:
    """A non-decreasing sequence of whole numbers of up to 64 bits, from a base."""

    def __init__(self, n: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.n, self.base, self.low_bits, self.low, self.high, self.marks = n, base, low_bits, low, high, marks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, 0, *(np.empty(0, t) for t in (np.uint8, np.uint8, np.uint32)))
        base = int(values[0])
        up = np.asarray(values, np.int64).view(np.uint64) - np.int64(base).view(np.uint64)  # differences of 64-bit numbers fit 64 unsigned bits
        bits = max(0, (int(up[-1]) // n).bit_length() - 1)
        at = (up >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = int(at[-1]) + 1
        if size >= 1 << 32:
            raise ValueError("a sequence holds 2^31 numbers at most")
        ones = np.zeros(size, np.uint8)
        ones[at] = 1
        low = []
        for lo in range(0, n if bits else 0, 1 << 16):  # a multiple of 8 numbers fills whole bytes
            some = up[lo : lo + (1 << 16), None] >> np.arange(bits, dtype=np.uint64)
            low.append(np.packbits((some & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
        return cls(n, base, bits, np.concatenate(low) if low else np.empty(0, np.uint8), np.packbits(ones, bitorder="little"), at[::STEP].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return HEAD.pack(self.n, self.base, self.low_bits, len(self.low), len(self.high), len(self.marks)) + self.low.tobytes() + self.high.tobytes() + self.marks.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, base, bits, low, high, marks = HEAD.unpack_from(data)
        at = HEAD.size
        return cls(n, base, bits, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low), np.frombuffer(data, "<u4", marks, at + low + high))

    def _lows(self, lo: int, hi: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(hi - lo, np.uint64)
        first, last = lo * self.low_bits, hi * self.low_bits
        bits = np.unpackbits(self.low[first >> 3 : (last + 7) >> 3], bitorder="little")[first & 7 :][: last - first]
        return (bits.reshape(-1, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def _number(self, high: np.ndarray | int, low: np.ndarray) -> np.ndarray:
        up = (np.asarray(high, np.uint64) << np.uint64(self.low_bits)) | low
        return (up + np.int64(self.base).view(np.uint64)).view(np.int64)

    def select(self, i: int) -> int:
        """The i-th number: from the sampled position before it, the set bits are counted up to it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.marks[i // STEP]), i % STEP
        byte = at >> 3
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + 128], bitorder="little")) + 8 * byte
            ones = ones[ones >= at]
            if left < len(ones):
                return int(self._number(int(ones[left]) - i, self._lows(i, i + 1))[0])
            left, byte, at = left - len(ones), byte + 128, 0

    def part(self, lo: int, hi: int) -> np.ndarray:
        """The numbers lo to hi (exclusive), selected together: only the bits between their sampled positions are looked at."""
        if lo >= hi:
            return np.empty(0, np.int64)
        mark, after = lo // STEP, -(-hi // STEP)
        first = int(self.marks[mark])
        last = int(self.marks[after]) if after < len(self.marks) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[first >> 3 : (last + 7) >> 3], bitorder="little")) + (first & ~7)
        ones = ones[ones >= first][lo - mark * STEP :][: hi - lo]
        return self._number(ones - np.arange(lo, hi), self._lows(lo, hi))


#: Code points that the fast way handles: none composes with another, and each has at most one lower-case form.
RANGES = ((0x00, 0x180), (0x370, 0x530), (0x2000, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20C0), (0x2100, 0x2400), (0x2500, 0x27C0), (0x3000, 0x302A), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4), (0xFF01, 0xFF5F), (0x1F300, 0x1F5FF), (0x1F600, 0x1F650))
SPACE, LETTER, DIGIT, OTHER, UNKNOWN = range(5)
#: The letters that make a piece with an apostrophe before them.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def characters() -> tuple[np.ndarray, np.ndarray]:
    """The class and the lower-case form of each code point; those beyond the table are unknown."""
    kind, lower = np.full(1 << 17, UNKNOWN, np.uint8), np.arange(1 << 17, dtype=np.uint32)
    for lo, hi in RANGES:
        for i in range(lo, hi):
            c = chr(i)
            if len(c.lower()) == 1 and unicodedata.is_normalized("NFC", c) and not unicodedata.combining(c) and (i < 0x180 or unicodedata.category(c) != "Cn"):
                kind[i] = SPACE if c.isspace() and not 0x1C <= i <= 0x1F else {"L": LETTER, "N": DIGIT}.get(unicodedata.category(c)[0], OTHER)
                lower[i] = ord(c.lower())
    return kind, lower


def spaced(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points in lower case with a space after every piece and no other white space, and where each of the given ones is (or would be)
    in that. A piece is a run of letters, one digit, a run of what is neither, or an apostrophe with a contraction."""
    kinds, lower = characters()
    kind, low = kinds[points], lower[points]
    begins = np.empty(len(kind), bool)
    begins[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == DIGIT
    after = len(kind)
    for i in np.flatnonzero((low == 39) & begins).tolist():
        text = "".join(map(chr, low[i + 1 : i + 3].tolist()))
        n = next((len(c) for c in CONTRACTIONS if text.startswith(c)), 0)
        if n:
            begins[i + 1 : i + 1 + n] = False
            if i + 1 + n < after:
                begins[i + 1 + n] = True
    keep = kind != SPACE
    ends = keep.copy()
    ends[:-1] &= begins[1:] | ~keep[1:]
    size = keep.astype(np.int8) + ends
    at = np.cumsum(size, dtype=np.int64) - size
    out = np.full(int(at[-1]) + int(size[-1]) if len(at) else 0, 32, np.uint32)
    out[at[keep]] = low[keep]
    return out, at


class Encoder:
    """Ids of texts by a byte-level BPE with word ends. Merges by rank give the tokenizer's own ids several times faster, with a space as
    the mark of a word's end; `fast` says whether the vocabulary allows it (`regular`). Texts with characters that need more care, or with the
    tokenizer's special strings, go to the tokenizer itself, as do all without `fast`."""

    def __init__(self, tokenizer: str, fast: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(tokenizer)
        self.size, self.fast = self.full.get_vocab_size(), None
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        if fast:
            ranks, ids = ranks_of(tokenizer)
            self.ids = np.array(ids, np.uint32)
            self.fast = tiktoken.Encoding("ranks", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        if self.fast is None:
            out = [self.whole(t) for t in texts]
        else:
            points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), "<u4")
            stop = np.cumsum([len(t) + 1 for t in texts]) - 1
            kinds = characters()[0]
            odd = np.concatenate([[0], np.cumsum((points >= len(kinds)) | (kinds[np.minimum(points, len(kinds) - 1)] == UNKNOWN))])
            odd = np.diff(np.concatenate([[0], odd[stop]]))
            # text by text where some are odd, since an odd one's pieces aren't known
            clean = [not o and not any(s in t for s in self.special) for t, o in zip(texts, odd.tolist(), strict=True)]
            mapped, at = spaced(np.where(points < len(kinds), points, 0))
            marked, edges = mapped.tobytes().decode("utf-32-le"), [0, *at[stop].tolist()]
            out = [self.ids[self.fast(marked[a:b])] if ok else self.whole(t) for t, ok, a, b in zip(texts, clean, edges, edges[1:], strict=False)]
        return np.concatenate(out) if out else np.empty(0, np.uint32), np.array([len(x) for x in out], np.int64)

    def pieces(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(how many texts, ids, counts), some TEXT_CHARS characters at a time; a longer text is cut at spaces, over which no piece reaches, and
        each of its parts but the last has -1 in place of 1."""
        lo = 0
        while lo < len(texts):
            hi, held = lo + 1, len(texts[lo])
            while hi < len(texts) and held + len(texts[hi]) <= TEXT_CHARS:
                held += len(texts[hi])
                hi += 1
            at = 0
            while held > TEXT_CHARS and (end := texts[lo].find(" ", at + TEXT_CHARS)) > 0:
                yield -1, *self.encode([texts[lo][at:end]])
                at = end + 1
            yield hi - lo, *self.encode([texts[lo][at:], *texts[lo + 1 : hi]])
            lo = hi


def parts_of(tokenizer: str) -> tuple[dict[str, int], list[tuple[str, str]], dict[str, int]]:
    """The vocabulary, the merges in order, and the bytes that its characters stand for."""
    with open(tokenizer, encoding="utf-8") as f:
        model = json.load(f)["model"]
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(own))}
    return model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]], back


END = "</w>"


def ranks_of(tokenizer: str) -> tuple[dict[bytes, int], list[int]]:
    """Ranks of byte strings, in which a space ends a word, and the id of each rank: bytes, bytes at a word's end, then the merges."""
    vocab, merges, back = parts_of(tokenizer)
    ranks = {}
    for tail in ("", END):
        for c, b in back.items():
            ranks[bytes([b]) + b" " * bool(tail)] = vocab[c + tail]
    for a, b in merges:
        ranks[bytes(back[c] for c in (a + b).removesuffix(END)) + b" " * (a + b).endswith(END)] = vocab[a + b]
    return {w: i for i, w in enumerate(ranks)}, list(ranks.values())


@cache
def regular(tokenizer: str) -> bool:
    """Whether merging by the rank of what two neighbours make is the same as merging the listed pairs. It is if each word of the vocabulary,
    merged by the listed pairs alone, becomes that word: where two other parts of it could meet, they would have met there too."""
    from tokenizers import Tokenizer

    model = json.loads(Tokenizer.from_file(tokenizer).to_str())["model"]
    if model.get("end_of_word_suffix") != END or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
        return False
    vocab, merges, back = parts_of(tokenizer)
    if any(c + tail not in vocab for c in back for tail in ("", END)) or len({a + b for a, b in merges}) < len(merges):
        return False
    order = {m: i for i, m in enumerate(merges)}
    for a, b in merges:
        word = list((a + b).removesuffix(END))
        if (a + b).endswith(END):
            word[-1] += END
        while len(word) > 1:
            _, i = min((order.get(p, len(order)), i) for i, p in enumerate(pairwise(word)))
            if (word[i], word[i + 1]) not in order:
                return False
            word[i : i + 2] = [word[i] + word[i + 1]]
    return True


class Writer:
    """One file: ids as they come, then the two sequences and the footer. Of what is held, 16 bytes are a document's."""

    def __init__(self, fs: pafs.FileSystem, path: str, width: int):
        self.out, self.kind = fs.open_output_stream(path, compression=None), f"<u{width}"
        self.out.write(MAGIC)
        self.width, self.tokens, self.ids, self.ends = width, 0, [], [np.zeros(1, np.int64)]

    def write(self, ids: np.ndarray) -> None:
        self.out.write(ids.astype(self.kind).tobytes())

    def documents(self, numbers: list[int | None], counts: np.ndarray) -> None:
        """Whose ids were written: numbers ascend, documents without one come first."""
        self.ids += numbers
        self.ends.append(self.tokens + np.cumsum(counts))
        self.tokens = int(self.ends[-1][-1])

    def close(self) -> tuple[int, int]:
        nulls = sum(i is None for i in self.ids)
        bounds = EliasFano.of(np.concatenate(self.ends)).to_bytes()
        numbers = EliasFano.of(np.array(self.ids[nulls:], np.int64)).to_bytes()
        at = len(MAGIC) + self.tokens * self.width
        self.out.write(bounds + numbers + FOOT.pack(len(self.ids), nulls, self.tokens, self.width, at, at + len(bounds)))
        self.out.close()
        return len(self.ids), self.tokens


class TokenFile:
    """A file, opened for reading; documents are counted from 0."""

    def __init__(self, path: str):
        fs, name = opened(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        self.n, self.nulls, self.tokens, self.width, bounds, numbers = FOOT.unpack(self._at(size - FOOT.size, FOOT.size))
        self.bounds = EliasFano.from_bytes(self._at(bounds, numbers - bounds))
        self.numbers = EliasFano.from_bytes(self._at(numbers, size - FOOT.size - numbers))

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of the file."""
        return np.frombuffer(self._at(len(MAGIC) + lo * self.width, (hi - lo) * self.width), f"<u{self.width}").astype("<u4")

    def document(self, k: int) -> np.ndarray:
        return self.ids(self.bounds.select(k), self.bounds.select(k + 1))

    def number(self, k: int) -> int | None:
        return None if k < self.nulls else self.numbers.select(k - self.nulls)

    def find(self, number: int) -> int:
        """The first document with the number, by bisection; -1 without one."""
        lo, hi = 0, self.numbers.n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.numbers.select(mid) < number else (lo, mid)
        return lo + self.nulls if lo < self.numbers.n and self.numbers.select(lo) == number else -1

    def close(self) -> None:
        self.file.close()


MANIFEST = "part int, seq int, path string, documents long, tokens long"


def write_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = END_ID, file_tokens: int = FILE_TOKENS, slow: bool = False) -> DataFrame:
    """Writes the ids of every text and an end id as files under `path`, by ascending document number; gives their manifest, written too.

    A null text counts as empty and is the end id alone. Documents without a number come first; those that repeat one are ordered by a
    hash of their texts, and equal ones by where they lie. A text of any length is encoded in pieces. An empty table makes no files.
    Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # hash and place split a number that many rows repeat
    order = [F.asc_nulls_first("id"), F.asc("hash"), F.asc("row")]
    dealt = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)

    fast = not slow and regular(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(tokenizer, fast)
        width = 2 if max(enc.size, end_id + 1) <= 1 << 16 else 4
        fs, root = opened(path)
        fs.create_dir(root, recursive=True)
        out, name, seq, held = None, "", 0, 0

        def done() -> pa.RecordBatch:
            n, tokens = out.close()
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (part, seq, name, n, tokens)], ["part", "seq", "path", "documents", "tokens"]).cast(pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

        for batch in batches:
            part = batch.column(2)[0].as_py()
            numbers, at = batch.column(0).to_pylist(), 0
            for k, ids, counts in enc.pieces(batch.column(1).to_pylist()):
                if out is None:
                    name = f"{path}/part-{part:06d}-{uuid.uuid4().hex}.tokens"
                    out = Writer(fs, opened(name)[1], width)
                if k > 0:
                    ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                out.write(ids)
                held += int(counts.sum())
                if k < 0:
                    continue  # more of this text is to come
                counts[0] += held - int(counts.sum())  # what came before of a text in pieces
                out.documents(numbers[at : at + k], counts)
                at, held = at + k, 0
                if out.tokens >= file_tokens:
                    yield done()
                    out, seq = None, seq + 1
        if out is not None:
            yield done()

    return cut(dealt.select("id", "text", F.spark_partition_id().alias("part")).mapInArrow(tidy(run), MANIFEST))


def read_files(manifest: DataFrame, read_tokens: int = READ_TOKENS) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files. The manifest has a row for each file of tens of millions of ids, so
    that their counts are added up on the driver."""
    spark, listed, start = manifest.sparkSession, [], 0
    for r in sorted(manifest.collect(), key=lambda r: (r["part"], r["seq"])):
        listed.append((r["path"], start))
        start += r["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = TokenFile(path)
                lo = 0
                while lo < file.n:
                    bounds = file.bounds.part(lo, min(lo + 65_536, file.n) + 1)
                    hi = lo + max(1, int(np.searchsorted(bounds[1:] - bounds[0], read_tokens, side="right")))
                    bounds = bounds[: hi - lo + 1]
                    if len(bounds) == 2 and bounds[1] - bounds[0] > read_tokens:  # one long document, in pieces
                        crc = 0
                        for x in range(int(bounds[0]), int(bounds[1]), read_tokens):
                            crc = zlib.crc32(file.ids(x, min(x + read_tokens, int(bounds[1]))), crc)
                        crcs = [crc]
                    else:
                        ids, cuts = file.ids(int(bounds[0]), int(bounds[-1])), (bounds - bounds[0]).tolist()
                        crcs = [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                    known = max(lo, file.nulls)
                    numbers = [None] * (min(hi, file.nulls) - lo) + file.numbers.part(known - file.nulls, hi - file.nulls).tolist()
                    cols = [pa.array(numbers, pa.int64()), pa.array(base + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])
                    lo = hi
                file.close()

    files = spark.createDataFrame(listed, "path string, base long")
    return files.repartition(max(1, len(listed))).mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_files(write_files(table(spark, sf_dir, "documents"), fresh_dir(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json")))
