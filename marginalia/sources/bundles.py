"""Bundles of source files, pinned to a commit, from a local mirror; catalog; staging of imports."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas as S
from ..functions.bundle import MAX_CHARS, MAX_DEPTH, MAX_FILES, page_of, safe_segment
from . import fetch
from .files import children, exists, read_json, read_text, write_json, written

REPORT = "metric string, value long"


def discover(entries: object) -> list[str]:
    """Names of paper folders in a repository listing, sorted; the listing must be a list and every name safe."""
    if not isinstance(entries, list):
        raise TypeError("Repository listing is not a list")
    return sorted(safe_segment(e["name"]) for e in entries if isinstance(e, dict) and e.get("type") == "dir" and isinstance(e.get("name"), str))


def read_bundles(spark: SparkSession, root: str, papers: list[str] | None = None) -> DataFrame:
    """paper, path, text, sha256, bytes of the TeX and bibliography files below root/<paper>/. Files over the cap have no text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{tex,bib}").load(root)
    rest = F.regexp_replace(F.col("path"), f"^.*?{re.escape(root.rstrip('/').split('/')[-1])}/", "")
    text = F.when(F.col("length") <= MAX_CHARS, F.decode("content", "UTF-8"))
    rows = files.select(F.regexp_extract(rest, r"^([^/]+)/", 1).alias("paper"), F.regexp_replace(rest, r"^[^/]+/", "").alias("path"), text.alias("text"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    return rows.filter(F.col("paper").isin(papers)) if papers else rows


def file_list(bundles: DataFrame) -> DataFrame:
    """paper, files: path, sha256 and bytes of each, by path."""
    return bundles.groupBy("paper").agg(F.sort_array(F.collect_list(F.struct("path", "sha256", "bytes"))).alias("files"))


class MirrorPart(InputPartition):
    def __init__(self, name: str):
        self.name = name


class MirrorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")

    def partitions(self) -> list[MirrorPart]:
        from pyarrow import fs

        f, root = fs.FileSystem.from_uri(self.root if ":" in self.root else f"file://{self.root}")
        return [MirrorPart(i.base_name) for i in sorted(f.get_file_info(fs.FileSelector(root)), key=lambda i: i.base_name) if i.type == fs.FileType.Directory] or [MirrorPart("")]

    def read(self, partition: MirrorPart) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if not partition.name:
            return
        f, root = fs.FileSystem.from_uri(self.root if ":" in self.root else f"file://{self.root}")
        base = f"{root}/{safe_segment(partition.name)}"
        for i in f.get_file_info(fs.FileSelector(base, recursive=True)):
            if i.type == fs.FileType.File and i.extension in ("tex", "bib") and i.size <= MAX_CHARS:
                with f.open_input_stream(i.path) as s:
                    yield pa.RecordBatch.from_pydict({"paper": [partition.name], "path": [i.path[len(base) + 1 :]], "text": [s.read().decode("utf-8", "replace")]})


class Mirror(DataSource):
    """`spark.read.format("paper_mirror")`: one partition for each paper folder of a mirrored repository."""

    @classmethod
    def name(cls) -> str:
        return "paper_mirror"

    def schema(self) -> str:
        return "paper string, path string, text string"

    def reader(self, schema) -> MirrorReader:
        return MirrorReader(self.options)


def stage(proposals: DataFrame, report: DataFrame, root: str, dry_run: bool = False) -> None:
    """Writes an import below root, a folder for each paper; papers that aren't imported keep what they have."""
    if dry_run:
        return
    for df, name in ((proposals, "proposals"), (report, "report")):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("paper").parquet(f"{root}/{name}")


def staged(spark: SparkSession, root: str, name: str = "proposals") -> DataFrame | None:
    """What is staged; None if nothing is. A filter on paper prunes partitions."""
    return spark.read.parquet(f"{root}/{name}") if children(spark, f"{root}/{name}") else None


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """paper, source_key and the decision, from review files (root/<paper>/review.json), in one scan; no file means no decisions."""
    if not any(exists(spark, f"{root}/{paper}/review.json") for paper in children(spark, root)):
        return spark.createDataFrame([], "paper string, source_key string, state string, contentHash string, nodeId string, commit string, reviewedAt string, note string")
    docs = spark.read.schema(S.LEDGER).option("multiLine", True).option("mode", "FAILFAST").json(f"{root}/*/review.json")
    paper = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return docs.select(F.url_decode(paper).alias("paper"), F.explode("decisions").alias("source_key", "d")).select("paper", "source_key", "d.*")


def write_decision(spark: SparkSession, root: str, paper: str, source_key: str, decision: dict) -> None:
    """Puts one decision into a paper's ledger; an older one of the key goes."""
    path = f"{root}/{safe_segment(paper)}/review.json"
    now = [r.asDict(recursive=True) for r in read_json(spark, path, S.LEDGER).collect()]
    decisions = (now[0]["decisions"] or {}) if now else {}
    decisions = {k: {f: v for f, v in d.items() if v is not None} for k, d in decisions.items()}
    write_json(spark, path, {"formatVersion": 1, "decisions": decisions | {source_key: decision}})


class Online:
    """A repository of papers behind two requests, the commit of a branch and the folders of a commit, and one for each file.

    transport: address to (status, headers, body), such as fetch.Http; it goes to the executors, which fetch files. What was read of a commit is
    kept below `cache`, by commit and path, and never asked for again; `offline`, nothing is asked for at all.
    """

    def __init__(self, spark: SparkSession, transport: fetch.Transport | None, cache: str, branch: str = "main", offline: bool = False, seconds: float = fetch.SECONDS, pause: float = fetch.PAUSE):
        self.spark, self.transport, self.cache, self.branch, self.offline, self.seconds, self.pause = spark, transport, cache.rstrip("/"), branch, offline, seconds, pause

    def request(self, address: str, most: int = MAX_CHARS) -> bytes:
        return fetch.asked(self.transport, address, most, self.seconds)

    def catalog(self) -> tuple[str, list[str]]:
        """The commit that the branch stands for, and the paper folders in it; offline, those that were kept last for the branch."""
        kept = f"{self.cache}/branches/{safe_segment(self.branch)}.json"
        if self.offline:
            text = read_text(self.spark, kept)
            if text is None:
                raise FileNotFoundError(f"no catalog of {self.branch} is kept for offline use")
            found = json.loads(text)
        else:
            commit = json.loads(self.request(f"commits/{self.branch}"))["sha"]
            if not re.fullmatch("[0-9a-f]{40}", commit):
                raise ValueError(f"not a commit: {commit}")
            found = {"commit": commit, "directories": discover(json.loads(self.request(f"contents/?ref={commit}")))}
            write_json(self.spark, kept, found)
        return found["commit"], found["directories"]

    def bundles(self, papers: list[str] | None = None, entrypoint: str = "main.tex") -> tuple[DataFrame, DataFrame]:
        """Of all papers of the catalog, or some, the files that each one's entrypoint leads to (paper, commit, path, text, sha256, bytes), and the
        files that couldn't be had (paper, path, problem, attempts).

        Files are fetched a level of inputs at a time, of all papers together; the executors fetch, and say what a file names in turn.
        """
        commit, directories = self.catalog()
        for paper in papers or ():
            if paper not in directories:
                raise ValueError(f"{paper} is not among the papers at {commit}")
        plan = fetch.Plan(commit, self.cache, None if self.offline else self.transport, self.seconds, pause=self.pause)
        wanted, seen, rows = [(safe_segment(p), entrypoint) for p in (directories if papers is None else papers)], set(), None
        for _ in range(MAX_DEPTH + 2):
            if not wanted:
                break
            seen.update(wanted)
            level = written(fetch.fetched(self.spark, plan, wanted))
            rows = level if rows is None else rows.unionByName(level)
            named = level.filter("text IS NOT NULL AND path LIKE '%.tex'").select("paper", "path", "text").mapInArrow(named_files, "paper string, path string").distinct()
            count = Counter(p for p, _ in seen)
            wanted = [(r["paper"], r["path"]) for r in named.sort("paper", "path").collect() if (r["paper"], r["path"]) not in seen]  # names of files, as a listing
            wanted = [x for x in wanted if count[x[0]] < MAX_FILES]
        rows = rows if rows is not None else self.spark.createDataFrame([], fetch.SCHEMA)
        files = rows.filter("text IS NOT NULL").select("paper", F.lit(commit).alias("commit"), "path", "text", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))
        return files, rows.filter("problem IS NOT NULL").select("paper", "path", "problem", "attempts")

    def bundle(self, paper: str, entrypoint: str = "main.tex") -> DataFrame:
        """paper, commit, path, text, sha256, bytes of one paper. A file that the repository doesn't have is left out, for the import to report; any
        other failure is an error, and no list of an incomplete bundle is kept."""
        files, failed = self.bundles([paper], entrypoint)
        bad = failed.filter(F.col("problem") != fetch.MISSING).sort("path").first()
        if bad:
            raise fetch.FetchError(f"{paper}/{bad['path']}: {bad['problem']}", again=True)
        files = files.sort("path")
        listed = [r.asDict() for r in files.select("path", "sha256", "bytes", "commit").collect()]
        commit = listed[0]["commit"] if listed else self.catalog()[0]
        write_json(self.spark, f"{self.cache}/bundles/{commit}/{paper}.json", {"commit": commit, "paper": paper, "files": [{k: r[k] for k in ("path", "sha256", "bytes")} for r in listed]})
        return files


def named_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """paper, path of the files that TeX files name."""
    for batch in batches:
        out = [(paper, name) for paper, path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for c in page_of(path, text).calls for name in (*filter(None, [c.loads]), *c.cites)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], ["paper", "path"])
