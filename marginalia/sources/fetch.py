"""Fetching files of papers as a planned data source: a partition has some files of a commit, and the executors ask for them, keep them, and tell
what went wrong as rows."""

from __future__ import annotations

import re
import threading
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.bundle import MAX_CHARS

#: An address to a status, headers and a body.
Transport = Callable[[str], tuple[int, dict[str, str], bytes]]
SECONDS, ATTEMPTS, PAUSE, FILES = 30.0, 3, 0.5, 16
MISSING = "answered 404"


class FetchError(OSError):
    """again: whether another attempt may help."""

    def __init__(self, message: str, again: bool):
        super().__init__(message)
        self.again = again


@dataclass(frozen=True)
class Http:
    """A transport over HTTP: addresses below `raw/` are files, all others are asked of the interface. Reads a byte more than the cap at most."""

    api: str
    raw: str
    headers: tuple[tuple[str, str], ...] = ()
    seconds: float = SECONDS

    def __call__(self, address: str) -> tuple[int, dict[str, str], bytes]:
        base, rest = (self.raw, address.removeprefix("raw/")) if address.startswith("raw/") else (self.api, address)
        request = urllib.request.Request(f"{base.rstrip('/')}/{rest}", headers=dict(self.headers))
        try:
            with urllib.request.urlopen(request, timeout=self.seconds) as answer:
                return answer.status, dict(answer.headers), answer.read(MAX_CHARS + 1)
        except urllib.error.HTTPError as error:
            return error.code, dict(error.headers), b""


def asked(transport: Transport, address: str, most: int = MAX_CHARS, seconds: float = SECONDS) -> bytes:
    """The body of an address, within a time limit. Refused: any status but 2xx, and bodies over the cap, by what the header says or by what comes."""
    got: list = []

    def ask() -> None:
        try:
            got.append(transport(address))
        except Exception as error:  # noqa: BLE001  whatever a transport raises is told as its own
            got.append(error)

    worker = threading.Thread(target=ask, daemon=True)
    worker.start()
    worker.join(seconds)
    if not got:
        raise FetchError(f"no answer within {seconds:g} s", again=True)
    if isinstance(got[0], Exception):
        raise FetchError(f"{type(got[0]).__name__}: {got[0]}", again=True) from got[0]
    status, headers, body = got[0]
    if not 200 <= status < 300:
        raise FetchError(f"answered {status}", again=status >= 500 or status == 429)
    told = {k.lower(): v for k, v in headers.items()}.get("content-length", "0")
    if len(body) > most or told.isdigit() and int(told) > most:
        raise FetchError(f"exceeds {most} bytes", again=False)
    return body


@dataclass(frozen=True)
class Plan:
    """How files of a commit are had: from what is kept below `cache`, else by the transport; without one, only what is kept."""

    commit: str
    cache: str
    transport: Transport | None
    seconds: float = SECONDS
    attempts: int = ATTEMPTS
    pause: float = PAUSE

    def file(self, paper: str, path: str) -> tuple[str | None, str | None, int]:
        """text, problem, attempts: one of the first two is null. Failures that may pass are tried again, after pauses that double."""
        from pyarrow import fs

        kept = f"{self.cache}/files/{self.commit}/{paper}/{path}"
        store, name = fs.FileSystem.from_uri(kept if re.match(r"[a-z][a-z0-9+.-]*:/", kept) else f"file://{kept}")
        if store.get_file_info(name).type == fs.FileType.File:
            with store.open_input_stream(name, compression=None) as f:
                return f.read().decode("utf-8"), None, 0
        if self.transport is None:
            return None, "not kept for offline use", 0
        for n in range(1, self.attempts + 1):
            try:
                text = asked(self.transport, f"raw/{self.commit}/{paper}/{path}", seconds=self.seconds).decode("utf-8")
            except FetchError as error:
                if not error.again or n == self.attempts:
                    return None, str(error), n
                time.sleep(self.pause * 2 ** (n - 1))
            except UnicodeDecodeError:
                return None, "is not UTF-8", n
            else:
                break
        store.create_dir(name.rsplit("/", 1)[0], recursive=True)
        tmp = f"{name}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(tmp, compression=None) as f:
            f.write(text.encode())
        store.move(tmp, name)  # a reader finds it whole or not at all
        return text, None, n


class Part(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


SCHEMA = "paper string, path string, text string, problem string, attempts int"


class Reader(DataSourceReader):
    def __init__(self, plan: Plan, files: list[tuple[str, str]], each: int):
        self.plan, self.files, self.each = plan, files, each

    def partitions(self) -> list[Part]:
        return [Part(self.files[k : k + self.each]) for k in range(0, len(self.files), self.each)] or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        for paper, path in partition.files:
            text, problem, n = self.plan.file(paper, path)
            columns = [pa.array([v], t) for v, t in ((paper, pa.string()), (path, pa.string()), (text, pa.string()), (problem, pa.string()), (n, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["paper", "path", "text", "problem", "attempts"])


def fetched(spark: SparkSession, plan: Plan, files: list[tuple[str, str]], each: int = FILES) -> DataFrame:
    """paper, path, text, problem, attempts of files (paper, path), `each` to a partition: a row for each, whether it could be had or not."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paper_files"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> Reader:
            return Reader(plan, files, each)

    spark.dataSource.register(Source)
    return spark.read.format("paper_files").load()
