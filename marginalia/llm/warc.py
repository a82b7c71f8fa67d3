"""WARC archives as a PySpark data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Writing: each task writes gzip-member-per-record files under names of its own; the commit on the driver lists them, with the byte offsets
of some records, in a manifest of its own that is renamed into place. Appending adds a manifest; overwriting adds one that names those it
replaces. What failed or doubled attempts leave is in no manifest and isn't read. Each member says in its header how long it is, compressed
and not (the "sl" field of the WARC standard's annex on gzip).

Reading: partitions are byte ranges of the files that begin at records. Predicates on warc_type, target_uri, record_id and payload_digest
are pushed down and decided on a record's headers alone: these are inflated first, and the rest of a record that they drop, or of every
record under the option `payload=false`, is skipped by its length, neither inflated nor, where it is long, read. Members without a length
are inflated to find their end. The option `verify=true` recomputes the digest of each payload that is read.

Archives that others wrote (files `.warc` and `.warc.gz` below the path, or the path itself) are read too, a file to a partition, as one stream
of records, whatever their gzip members hold; what isn't wanted of them is inflated, but not kept. A record that isn't HTTP (warcinfo, metadata,
DNS) has its whole block as payload. payload_length is what the HTTP headers say, else the payload's length. A path without any archive, and a
file that isn't one, are errors.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .common import fresh_dir, table

SCHEMA = "record_id string, warc_type string, target_uri string, payload_digest string, payload_length long, refers_to string, payload binary"
PUSHED = ("warc_type", "target_uri", "record_id", "payload_digest")
#: Compressed bytes in one file, and in one partition of a reader.
FILE_BYTES, SPLIT_BYTES = 256 << 20, 16 << 20
#: Bytes that are inflated at a time.
PIECE = 4096
LEAST_REVISIT = 100
MANIFEST = "_manifest-"
#: Names of archives, and of those that the writer gives its own, which count only if a manifest lists them.
FOREIGN, OWN = re.compile(r"\.warc(\.gz)?$", re.I), re.compile(r"part-[0-9a-f]{32}\.warc\.gz")
#: Head of a member: ten fixed bytes, length of the extra field, its name and size, and the two lengths.
HEAD = struct.Struct("<10sH2sHII")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed value: the archive holds no crawl times; one date serves all records.
DATE = "2000-01-01T00:00:00Z"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if re.match(r"[a-z][a-z0-9+.-]*:/", uri) else f"file://{uri}")


def clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(row: dict) -> bytes:
    """One record: WARC headers, and an HTTP block with the payload, or for a revisit the HTTP headers alone."""
    payload = row["payload"] or b""
    n = row["payload_length"] if row["payload_length"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http + (payload if row["warc_type"] != "revisit" else b"")
    head = ["WARC/1.1", f"WARC-Type: {row['warc_type']}", f"WARC-Record-ID: <{clean(row['record_id'])}>", f"WARC-Date: {DATE}"]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {clean(row['target_uri'])}")
    head.append(f"WARC-Payload-Digest: sha256:{row['payload_digest'] or hashlib.sha256(payload).hexdigest()}")
    if row["warc_type"] == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{clean(row['refers_to'] or '')}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field holds its own length and that of the data."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    total = HEAD.size + len(body) + 8
    if max(total, len(data)) >= 1 << 32:  # beyond what the field can hold
        return gzip.compress(data, level, mtime=0)
    return HEAD.pack(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff", 12, b"sl", 8, total, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, list[int]]]


def manifests(path: str) -> dict[str, dict]:
    """The manifests of an archive that no other replaces, by name."""
    fs, root = opened(path)
    found = {}
    for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith(MANIFEST) and info.base_name.endswith(".json"):
            with fs.open_input_stream(info.path, compression=None) as f:
                found[info.base_name] = json.loads(f.read())
    replaced = {name for m in found.values() for name in m["replaces"]}
    return {name: m for name, m in sorted(found.items()) if name not in replaced}


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.size = options["path"].rstrip("/"), int(options.get("file_bytes", FILE_BYTES))
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        files, out, name, at, marks = [], None, "", 0, []
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name, at, marks = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                data = member(record(row))
                if at - marks[-1] >= self.split:
                    marks.append(at)
                out.write(data)
                at += len(data)
                if at >= self.size:
                    out.close()
                    files.append((name, at, marks))
                    out = None
        if out is not None:
            out.close()
            files.append((name, at, marks))
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        files = sorted(f for m in messages if m for f in m.files)
        name = uuid.uuid4().hex
        with fs.open_output_stream(f"{root}/_{name}.tmp", compression=None) as out:
            out.write(json.dumps({"files": files, "replaces": sorted(manifests(self.path)) if self.overwrite else []}).encode())
        fs.move(f"{root}/_{name}.tmp", f"{root}/{MANIFEST}{name}.json")

    def abort(self, messages: list) -> None:
        fs, root = opened(self.path)
        for m in messages:
            for name, _, _ in m.files if m else ():
                fs.delete_file(f"{root}/{name}")


@dataclass
class Range(InputPartition):
    file: str
    lo: int
    hi: int
    own: bool = True  # written here, a member for each record


def heads(raw: bytes) -> tuple[dict[str, str], int]:
    """Header fields in lower case, and where the block begins."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def http(head: dict[str, str]) -> bool:
    return head.get("content-type", "").lower().startswith("application/http")


def proves(digest: str, payload: bytes) -> bool:
    """Whether a digest fits a payload: SHA-256 in hexadecimal, or SHA-1 in base 32, as many archives have it. Others aren't looked at."""
    if re.fullmatch("[0-9a-f]{64}", digest):
        return hashlib.sha256(payload).hexdigest() == digest
    if digest.lower().startswith("sha1:") and len(digest) == 37:
        return base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest[5:].upper()
    return True


class Source:
    """A range of a file, read in blocks; what is skipped beyond the block at hand isn't read."""

    def __init__(self, file: pa.NativeFile, lo: int, end: int, block: int = 1 << 20):
        self.file, self.at, self.end, self.block = file, lo, end, block
        self.lo, self.held = lo, b""

    def peek(self, n: int) -> bytes:
        off = self.at - self.lo
        if not 0 <= off <= len(self.held) - n:
            self.file.seek(self.at)
            self.lo, off = self.at, 0
            self.held = self.file.read(max(0, min(max(n, self.block), self.end - self.at)))
        return self.held[off : off + n]

    def take(self, n: int) -> bytes:
        got = self.peek(min(n, self.end - self.at))
        self.at += len(got)
        return got

    def skip(self, n: int) -> None:
        self.at = min(self.end, self.at + n)


class Inflated:
    """What gzip members one after another hold, as one stream; at most a little more than what is asked for is in memory."""

    def __init__(self, source: Source):
        self.source, self.z, self.held = source, None, bytearray()

    def peek(self, n: int) -> bytes:
        while len(self.held) < n:
            if self.z is None or self.z.eof:
                data = (self.z.unused_data if self.z else b"") or self.source.take(1 << 16)
                if not data.strip(b"\0"):  # padding at the end of a file
                    break
                self.z = zlib.decompressobj(31)
            else:
                data = self.z.unconsumed_tail or self.source.take(1 << 16)
                if not data:
                    raise ValueError("a file ends within a gzip member")
            self.held += self.z.decompress(data, 1 << 20)
        return bytes(self.held[:n])

    def take(self, n: int) -> bytes:
        got = self.peek(n)
        del self.held[: len(got)]
        return got

    def skip(self, n: int) -> None:
        while n and (got := len(self.take(min(n, 1 << 20)))):
            n -= got


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """One for each stretch between two marks of the files in the manifests, and one for each archive that others wrote; a listing and the
        manifests are all that is read. A path without any archive is an error."""
        fs, root = opened(self.path)
        here = fs.get_file_info(root)
        if here.type == pafs.FileType.File:
            return [Range("", 0, here.size, own=False)]
        known = manifests(self.path)
        files = [f for m in known.values() for f in m["files"]]
        parts = [Range(name, lo, hi) for name, size, marks in files for lo, hi in zip(marks, [*marks[1:], size], strict=True)]
        listed = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if here.type == pafs.FileType.Directory else []
        theirs = sorted((i.path[len(root) :].lstrip("/"), i.size) for i in listed if i.type == pafs.FileType.File and FOREIGN.search(i.path) and not OWN.fullmatch(i.base_name))
        if not known and not theirs:
            raise FileNotFoundError(f"no archive at {self.path}")
        return parts + [Range(name, 0, size, own=False) for name, size in theirs] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for row in self.records(partition) if partition.hi else ():
            rows.append(row)
            size += len(row[6] or b"")
            if len(rows) >= 2000 or size >= 8 << 20:
                yield self.batch(rows)
                rows, size = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def records(self, part: Range) -> Iterator[tuple]:
        fs, root = opened(self.path)
        with fs.open_input_file(f"{root}/{part.file}" if part.file else root) as f:
            source = Source(f, part.lo, part.hi)
            if not part.own:
                yield from self.stream(Inflated(source) if source.peek(2) == b"\x1f\x8b" else source)
            while part.own and source.at < source.end:
                yield from self.record(source)

    def stream(self, source: Source | Inflated) -> Iterator[tuple]:
        """The records of an archive that others wrote, compressed or not, in members of any number of records: headers first, then the block, or
        past it."""
        while True:
            while source.peek(2) == b"\r\n":
                source.skip(2)
            n = PIECE
            while (raw := source.peek(n)) and b"\r\n\r\n" not in raw:
                if len(raw) < n or n >= 1 << 20:
                    raise ValueError("not a WARC record")
                n *= 2
            if not raw:
                return
            head, body = heads(raw)
            size = int(head["content-length"])
            source.skip(body)
            if not self.fits(head):
                source.skip(size)
            elif self.payload or self.verify:
                yield self.row(head, source.take(size), 0)
            else:
                yield self.row(head, source.peek(min(size, 1 << 16)), 0)
                source.skip(size)

    def record(self, source: Source) -> Iterator[tuple]:
        """The record that begins here, if it fits; moves to the next one."""
        first = source.peek(HEAD.size)
        length = HEAD.unpack(first)[4] if len(first) == HEAD.size and first[3] == 4 and first[10:16] == b"\x0c\0sl\x08\0" else None
        z, raw, head, body, begin = zlib.decompressobj(31), bytearray(), None, 0, source.at
        while not z.eof:
            data = source.take(PIECE)
            if not data:
                raise ValueError("a range ends within a record")
            while data and not z.eof:
                # headers first: a little is inflated until they are whole, the rest only if the payload is wanted
                raw += z.decompress(data, PIECE if head is None else 0)
                data = z.unconsumed_tail
                if head is None and b"\r\n\r\n" in raw:
                    head, body = heads(bytes(raw))
                    if length and not self.fits(head):
                        source.at = begin + length
                        return
                if length and head and not (self.payload or self.verify) and (not http(head) or b"\r\n\r\n" in raw[body:]):
                    source.at = begin + length
                    yield self.row(head, bytes(raw), body)
                    return
        source.at -= len(z.unused_data)
        if self.fits(head):
            yield self.row(head, bytes(raw), body)

    def fits(self, head: dict[str, str]) -> bool:
        own = self.meta(head)
        return all(own[k] in v for k, v in self.wanted.items())

    @staticmethod
    def meta(head: dict[str, str]) -> dict[str, str | None]:
        return {"record_id": head.get("warc-record-id", "").strip("<>"), "warc_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha256:")}

    def row(self, head: dict[str, str], raw: bytes, body: int) -> tuple:
        own, size = self.meta(head), int(head["content-length"])
        # HTTP headers come before the payload; a block of another kind is the payload
        blank = raw.find(b"\r\n\r\n", body)
        begin = body if not http(head) else body + size if blank < 0 else blank + 4
        told = re.search(rb"(?i)\r\ncontent-length: *(\d+)", raw[body:begin]) if http(head) else None
        length, payload = int(told[1]) if told else max(0, body + size - begin), None
        if own["warc_type"] != "revisit" and (self.payload or self.verify):
            payload = bytes(raw[begin : body + size])
            if self.verify and not proves(own["payload_digest"], payload):
                raise ValueError(f"digest of {own['record_id']} doesn't fit its payload")
        refers = head.get("warc-refers-to")
        return (own["record_id"], own["warc_type"], own["target_uri"], own["payload_digest"], length, refers.strip("<>") if refers else None, payload if self.payload else None)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def records_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The records of pages in the columns of SCHEMA; payload: the html in UTF-8, empty for null.

    Of records with equal payloads of 100 bytes or more, that with the smallest id is the response, and the others revisit it. Rows that
    repeat that id are responses too, as are rows of a payload that no id bears. An empty table gives no records.
    """
    digest, payload = F.sha2("payload", 256), F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    firsts = rows.select("_id", digest.alias("_digest"), F.octet_length("payload").alias("_n")).filter(f"_n >= {LEAST_REVISIT}")
    firsts = firsts.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_copies")).filter("_copies > 1").select("_digest", "_first")
    rows = rows.withColumns({"payload_digest": digest, "payload_length": F.octet_length("payload").cast("long")})
    rows = rows.join(firsts, rows["payload_digest"] == firsts["_digest"], "left")
    again = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("_id"))
    name = lambda c: F.concat(F.lit("urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")))
    return rows.select(
        name(F.col("_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("warc_type"), "target_uri", "payload_digest", "payload_length",
        F.when(again, name(F.col("_first"))).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    )


def write(records: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """Adds records to the archive at path; mode "overwrite" puts them in the place of all others."""
    register(records.sparkSession)
    records.write.format("warc").mode(mode).options(**options).save(path)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "warc")
    write(records_of(table(spark, sf_dir, "pages")), path)
    number = lambda c: F.expr(f"try_cast(substring({c}, 12) AS BIGINT)")
    back = read(spark, path, verify="true", payload="false")
    return back.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f
"""
