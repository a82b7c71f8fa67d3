"""Papers from bundles of files: one Python pass for each paper, then native joins over the rows of all papers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bundle as B
from ..sources.files import shared_dir

_SPANS = "array<struct<file:string,startLine:int,endLine:int>>"
#: Schemas of the rows that the pass gives, by tag.
TAGS = {
    "object": f"ordinal int, environment string, labels array<string>, latex_label string, printed_number string, numbering_note string, title string, statement string, section string, subsection string, source_file string, start_line int, end_line int, spans {_SPANS}, references array<struct<label:string,command:string,context:string>>, citations array<string>, equations array<string>, proof string, proof_spans {_SPANS}, proposed_type string, verification_note string, fingerprint string, text_key string, macros map<string,string>",
    "section": "level string, title string, number string, labels array<string>, source_file string, start_line int",
    "label": "label string, kind string, object int, file string, line int",
    "citation": "key string, entry_type string, authors array<string>, title string, year string, journal string, doi string, eprint string, url string, fields map<string,string>, raw string, source_file string",
    "diagnostic": "severity string, file string, line int, message string",
    "paper": "title string, authors array<string>, author_latex array<string>, abstract string, arxiv string, cited_keys array<string>, macros map<string,string>, n_files int, entrypoint string, end_line int, files array<struct<path:string,sha256:string,bytes:bigint>>, fingerprint string",
}


def scan_papers(files: DataFrame, entrypoint: str = "main.tex", root: str = "papers", tags: Iterable[str] = tuple(TAGS)) -> DataFrame:
    """paper, tag, pos, payload (JSON) of every paper in files (paper, path, text), and of the tags alone that are asked for. The only step in
    Python: papers are sorted together and pass by one after the other, so a task holds a batch of files and one paper.

    A paper's files are bounded by the limits of a bundle; files without a paper or path don't count, a null text is empty.
    """
    wanted = tuple(tags)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        every = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for paper, group in groupby(every, key=itemgetter(0)):
            texts = {path: text or "" for path, text in sorted((r[1], r[2] or "") for r in group)}
            found = B.scan_bundle(texts, entrypoint, paper, root)
            yield from ((paper, tag, i, json.dumps(r, ensure_ascii=False)) for tag in wanted for i, r in enumerate(found[tag]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = rows(batches)
        while some := list(islice(out, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], ["paper", "tag", "pos", "payload"])

    named = files.filter("paper IS NOT NULL AND path IS NOT NULL").select("paper", "path", "text")
    return named.repartition("paper").sortWithinPartitions("paper", "path").mapInArrow(scan, "paper string, tag string, pos int, payload string")


def kept(scanned: DataFrame) -> DataFrame:
    """What the pass gave, written once, in folders by tag, of which each reader reads its own."""
    path = f"{shared_dir(scanned.sparkSession)}/papers-{uuid.uuid4().hex}"
    scanned.write.partitionBy("tag").parquet(path)
    # JSON takes many times its file's size in memory, so the planner must not broadcast by that
    return scanned.sparkSession.read.schema("paper string, pos int, payload string, tag string").parquet(path).hint("merge")


def rows_of(scanned: DataFrame, tag: str) -> DataFrame:
    return scanned.filter(F.col("tag") == tag).select("paper", "pos", F.from_json("payload", TAGS[tag]).alias("r")).select("paper", "pos", "r.*")


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("paper", "label").agg(F.count("*").alias("n"))


def identified(objects: DataFrame, labels: DataFrame) -> DataFrame:
    """Objects with source_key, suggested_id, blocked and warnings.

    The key is the first label, or else the kind and the text's hash. Of objects with one key, the second and later ones bear the place in
    theirs, and all are blocked, as are objects with a label that the paper gives twice.
    """
    base = F.when(F.col("latex_label").isNotNull(), F.concat(F.lit("label:"), "latex_label")).otherwise(F.col("text_key"))
    w = Window.partitionBy("paper", "_key")
    o = objects.withColumn("_key", base).withColumns({"_nth": F.row_number().over(w.orderBy("ordinal")), "_all": F.count("*").over(w)})
    shared = label_counts(labels).filter("n > 1").select("paper", "label")
    hit = o.select("paper", "ordinal", F.explode("labels").alias("label")).join(shared, ["paper", "label"], "left_semi").select("paper", "ordinal").distinct().withColumn("_shared", F.lit(True))
    o = o.join(hit, ["paper", "ordinal"], "left").withColumn("_shared", F.coalesce("_shared", F.lit(False)))
    key = F.when(F.col("_nth") == 1, F.col("_key")).otherwise(F.concat("_key", F.lit(":duplicate:"), "source_file", F.lit(":"), F.col("start_line").cast("string")))
    warn = F.array_compact(F.array(F.when(F.size("labels") == 0, B.NO_LABEL), F.when(F.col("_shared"), B.SHARED_LABEL), F.when((F.col("_all") > 1) & (F.col("_nth") < F.col("_all")), B.SHARED_TEXT)))
    o = o.withColumns({"source_key": key, "blocked": F.col("_shared") | (F.col("_all") > 1), "warnings": warn})
    from ..functions.text import suggested_id

    return o.withColumn("suggested_id", suggested_id(F.col("paper"), F.col("source_key"))).drop("_key", "_nth", "_all", "_shared")


def label_catalog(labels: DataFrame, objects: DataFrame) -> DataFrame:
    """paper, label, kind, source_key, file, line, n: every place of a label, and how many it has."""
    keyed = labels.join(objects.select("paper", F.col("ordinal").alias("object"), "source_key"), ["paper", "object"], "left")
    return keyed.withColumn("n", F.count("*").over(Window.partitionBy("paper", "label"))).select("paper", "label", "kind", "source_key", "file", "line", "n")


def resolved_references(objects: DataFrame, catalog: DataFrame) -> DataFrame:
    """paper, source_key, pos, label, command, context, target_kind, target_key, problem: a reference resolves if its label has one place."""
    refs = objects.select("paper", "source_key", F.posexplode("references").alias("pos", "r")).select("paper", "source_key", "pos", "r.*")
    one = catalog.groupBy("paper", "label").agg(F.max("n").alias("n"), F.first("kind").alias("kind"), F.first("source_key").alias("key"))
    j = refs.join(one, ["paper", "label"], "left")
    sure = F.col("n") == 1
    return j.select("paper", "source_key", "pos", "label", "command", "context", F.when(sure, F.col("kind")).alias("target_kind"), F.when(sure, F.col("key")).alias("target_key"), F.when(F.col("n").isNull(), "Unresolved").when(~sure, "Ambiguous").alias("problem"))


def used_citations(citations: DataFrame, papers: DataFrame) -> DataFrame:
    """Citations with used: the paper cites the key, or everything."""
    keys = papers.select("paper", F.explode("cited_keys").alias("key")).distinct().withColumn("_hit", F.lit(True))
    every = papers.filter(F.array_contains("cited_keys", "*")).select("paper", F.lit(True).alias("_all"))
    return citations.join(keys, ["paper", "key"], "left").join(every, "paper", "left").withColumn("used", F.coalesce("_hit", "_all", F.lit(False))).drop("_hit", "_all")


def missing_citations(citations: DataFrame, papers: DataFrame) -> DataFrame:
    return papers.select("paper", F.explode("cited_keys").alias("key")).filter("key <> '*'").distinct().join(citations.select("paper", "key"), ["paper", "key"], "left_anti")


def section_counters(rows: DataFrame, within: str, order: list[str], opens: Column, at: str) -> DataFrame:
    """rows with section (how many have been opened so far in their text), section_<at> (where the last one was), and number, which counts what
    doesn't open a section and begins anew with each. The rows of one text are counted in order, in one task."""
    so_far = Window.partitionBy(within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"section": F.sum(F.when(opens, 1).otherwise(0)).over(so_far), f"section_{at}": F.last(F.when(opens, F.col(at)), ignorenulls=True).over(so_far)})
    since = Window.partitionBy(within, "section").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("number", F.concat(F.col("section").cast("string"), F.lit("."), F.sum(F.when(opens, 0).otherwise(1)).over(since).cast("string")))


def duplicate_citations(citations: DataFrame) -> DataFrame:
    return citations.groupBy("paper", "key").agg(F.count("*").alias("n")).filter("n > 1")


def content_hashes(objects: DataFrame, citations: DataFrame) -> DataFrame:
    """Objects with content_hash: SHA-256 of the JSON of the fingerprint and of the entries that the object cites (`*`: all), in the bibliography's
    order, each as its key and fields, in the order in which they stand there. Entries are never broadcast: files that look small to the planner hold
    many of them."""
    named = objects.select("paper", "source_key", F.explode("citations").alias("key"))
    key = F.regexp_replace(F.to_json(F.array("key")), r"\]\z", "")
    entry = F.concat(key, F.lit(","), F.coalesce(F.to_json("fields"), F.lit("{}")), F.lit("]"))
    entries = citations.select("paper", "key", "pos", entry.alias("entry")).hint("merge")
    by_key = named.filter("key <> '*'").distinct().join(entries, ["paper", "key"])
    by_all = named.filter("key = '*'").select("paper", "source_key").distinct().join(entries, "paper").select(*by_key.columns)
    cited = by_key.unionByName(by_all).distinct().groupBy("paper", "source_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "entry"))), lambda x: x["entry"]).alias("_cited"))
    whole = F.concat(F.lit('["'), "fingerprint", F.lit('",['), F.array_join(F.coalesce("_cited", F.array().cast("array<string>")), ","), F.lit("]]"))
    return objects.join(cited, ["paper", "source_key"], "left").withColumn("content_hash", F.sha2(whole, 256)).drop("_cited")


def diagnostics(scanned: DataFrame) -> DataFrame:
    """paper, severity, file, line, message: what the pass said, and what only the joins show."""
    said = rows_of(scanned, "diagnostic").drop("pos")
    labels, citations, papers = (rows_of(scanned, t) for t in ("label", "citation", "paper"))
    row = lambda df, severity, message: df.select("paper", F.lit(severity).alias("severity"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), message.alias("message"))
    twice = row(label_counts(labels).filter("n > 1"), "error", F.concat(F.lit("Duplicate label "), "label", F.lit(" ("), F.col("n").cast("string"), F.lit(" occurrences)")))
    keys = row(duplicate_citations(citations), "error", F.concat(F.lit("Duplicate bibliography key across files: "), "key"))
    absent = row(missing_citations(citations, papers), "warning", F.concat(F.lit("Citation key has no bibliography entry: "), "key"))
    return said.unionByName(twice).unionByName(keys).unionByName(absent)


def proposals(scanned: DataFrame) -> DataFrame:
    """The paper's own proposal and one for each statement, with everything that review needs."""
    citations, papers = rows_of(scanned, "citation"), rows_of(scanned, "paper")
    labels = rows_of(scanned, "label")
    objects = identified(rows_of(scanned, "object"), labels)
    refs = resolved_references(objects, label_catalog(labels, objects))
    unresolved = refs.filter("problem IS NOT NULL").groupBy("paper", "source_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.concat("problem", F.lit(" source reference: "), "label").alias("w")))), lambda x: x["w"]).alias("_more"))
    objects = content_hashes(objects, citations).join(unresolved, ["paper", "source_key"], "left")
    objects = objects.withColumn("warnings", F.concat("warnings", F.coalesce("_more", F.array().cast("array<string>"))))
    cols = ["paper", "source_key", "environment", "latex_label", "labels", "printed_number", "title", "statement", "proof", "section", "subsection", "source_file", "start_line", "end_line", "citations", "proposed_type", "suggested_id", "content_hash", "blocked", "warnings"]
    from ..functions.text import paper_id

    none = lambda t: F.lit(None).cast(t)
    strings = F.array().cast("array<string>")
    own = papers.select(
        "paper", F.lit("paper").alias("source_key"), F.lit("paper").alias("environment"), none("string").alias("latex_label"), strings.alias("labels"), none("string").alias("printed_number"), "title", F.coalesce("abstract", F.lit("")).alias("statement"),
        none("string").alias("proof"), none("string").alias("section"), none("string").alias("subsection"), F.col("entrypoint").alias("source_file"), F.lit(1).alias("start_line"), "end_line", F.col("cited_keys").alias("citations"), F.lit("paper").alias("proposed_type"),
        paper_id(F.col("paper")).alias("suggested_id"), F.col("fingerprint").alias("content_hash"), F.lit(False).alias("blocked"), strings.alias("warnings"),
    )
    return own.unionByName(objects.select(*cols))


def commands_of(texts: Iterator) -> Iterator:
    """For mapInPandas: a row for each command of each text."""
    from ..functions.tex import Scan

    for pdf in texts:
        yield pd.DataFrame([(k, i, c.name, c.start, c.end) for k, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True) for i, c in enumerate(Scan(t or "").commands)], columns=["id", "pos", "name", "start", "end"])
