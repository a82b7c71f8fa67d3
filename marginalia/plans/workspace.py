"""The operations of the command line over a workspace: records under content/nodes, imports under imports. Nothing is written unless told to.

A workspace is what a curator edits by hand, so plans for single records are small; the work on all papers and records is done by the
DataFrame functions that they call.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.tex import relevant_macros
from ..operators import validate
from ..sources import bundles, curated
from ..sources.files import atomic_write, children, read_json, read_text, remove, write_json
from . import pages, review

META = "paper string, title string, authors array<string>, abstract string, arxiv string, macros map<string,string>, files array<struct<path:string,sha256:string,bytes:bigint>>, commit string, retrieved string"


class RefusedError(ValueError):
    pass


@dataclass
class Change:
    file: str
    node_id: str
    before: str
    after: str
    written: bool


@dataclass
class Workspace:
    spark: SparkSession
    root: str
    repository: str = "org/papers"
    branch: str = "main"

    @property
    def nodes_dir(self) -> str:
        return f"{self.root}/content/nodes"

    @contextlib.contextmanager
    def lock(self) -> Iterator[None]:
        """One writer at a time, over processes; a workspace is edited by hand and on a local disk. The lock goes with its process, even if that crashes."""
        path = self.root.removeprefix("file://")
        if ":" in path.split("/", 1)[0]:
            raise RefusedError(f"{self.root} isn't a local folder; a workspace is written in one")
        with open(f"{path}/.papers.lock", "w") as handle:
            try:
                fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as error:
                raise RefusedError("Another process is writing to this workspace.") from error
            self.recover()
            yield

    def records(self) -> DataFrame:
        if not children(self.spark, f"{self.root}/content"):
            return self.spark.createDataFrame([], T.StructType([*S.NODE.fields, *T.StructType.fromDDL("file string, raw string, body string").fields]))
        return curated.read_curated(self.spark, self.nodes_dir)

    def projects(self) -> DataFrame:
        return curated.read_projects(self.spark, f"{self.root}/content/projects.json")

    def check(self, nodes: DataFrame) -> None:
        relations, _ = pages.edges_of(nodes)
        found = validate.network(nodes.select("id"), relations).unionByName(validate.membership(nodes.select("id", "projects"), self.projects().select("key", "anchor"))).unionByName(validate.schema(nodes)).unionByName(validate.claim_standing(nodes))
        validate.raise_on(found)

    def import_papers(self, mirror: str, commit: str, papers: list[str] | None = None, dry_run: bool = False) -> dict[str, DataFrame]:
        """Imports the mirrored papers, all or some, and stages them."""
        files = bundles.read_bundles(self.spark, mirror, papers)
        old = bundles.staged(self.spark, f"{self.root}/imports")
        done = pages.import_papers(files, self.records(), bundles.read_ledger(self.spark, f"{self.root}/ledger"), old, commit, self.repository, before=bundles.staged(self.spark, f"{self.root}/imports", "report"))
        staged = done["proposals"].join(done["states"], ["paper", "source_key"]).join(done["candidates"].groupBy("paper", "source_key").agg(F.sort_array(F.collect_list(F.struct("rank", "cid", "confidence", "exact"))).alias("candidates")), ["paper", "source_key"], "left")
        errors = done["diagnostics"].filter("severity = 'error'").select("paper").distinct().withColumn("has_error", F.lit(True))
        staged = staged.join(errors, "paper", "left").withColumn("has_error", F.coalesce("has_error", F.lit(False)))
        meta = done["papers"].select("paper", "title", "authors", "abstract", "arxiv", "macros", "files", "commit", F.lit(self.now()).alias("retrieved"))
        if not dry_run:
            staged = self._settled(staged)
            bundles.stage(staged, meta, f"{self.root}/imports")
        return done | {"staged": staged}

    def _settled(self, df: DataFrame) -> DataFrame:
        from ..sources.files import cut

        return cut(df)  # the staged folder is read while it is planned, and written after

    @staticmethod
    def now() -> str:
        return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"

    def status(self, paper: str | None = None) -> DataFrame:
        staged = bundles.staged(self.spark, f"{self.root}/imports")
        if staged is None:
            return self.spark.createDataFrame([], "paper string, source_key string, line string")
        staged = staged if paper is None else staged.filter(F.col("paper") == paper)
        found = staged.select("paper", "source_key", F.explode("candidates").alias("c")).select("paper", "source_key", "c.rank", "c.cid", "c.confidence")
        return review.status_lines(staged.select("paper", "source_key", "review_state"), found)

    def proposal(self, paper: str, key: str) -> dict:
        """The one proposal that a key or label names."""
        staged = bundles.staged(self.spark, f"{self.root}/imports")
        if staged is None:
            raise RefusedError(f"Import {paper} first.")
        found = review.find_proposal(staged.filter(F.col("paper") == paper), key).limit(2).collect()
        if len(found) != 1:
            raise RefusedError(f"Expected one proposal for {key}; found {len(found)}. Use its full source key.")
        return found[0].asDict(recursive=True)

    def meta(self, paper: str) -> dict:
        return bundles.staged(self.spark, f"{self.root}/imports", "report").filter(F.col("paper") == paper).first().asDict(recursive=True)

    def accept(self, paper: str, key: str, match: str | None = None, new_id: str | None = None, projects: list[str] | None = None, publication: str = "draft", write: bool = False) -> Change:
        """Plans the acceptance of a proposal into a record, new or existing; writes record and decision only if told to."""
        p, m = self.proposal(paper, key), self.meta(paper)
        records = self.records()
        frame = lambda rows, ddl: self.spark.createDataFrame(rows, ddl)
        props = frame([(paper, p["source_key"], p["content_hash"], p["blocked"], p["has_error"])], "paper string, source_key string, content_hash string, blocked boolean, has_error boolean")
        own = records.select(F.col("id").alias("node_id"), F.explode("sources").alias("s")).filter(F.col("s.repository") == self.repository).select("node_id", F.col("s.paperDirectory").alias("paper"), F.col("s.sourceKey").alias("source_key"))
        ledger = bundles.read_ledger(self.spark, f"{self.root}/ledger").select("paper", "source_key", "state", F.col("nodeId").alias("node_id"))
        choice = frame([(paper, p["source_key"], match, new_id, projects)], "paper string, source_key string, match string, new_id string, projects array<string>")
        plan = review.accept_plan(props, own, ledger, records, choice).first()
        if plan.problem:
            raise RefusedError(plan.problem)
        at = self.now()
        source = self.source_of(p, m, at)
        if plan.action == "update":
            record = records.filter(F.col("id") == plan.node_id).first().asDict(recursive=True)
            same = [s["repository"] == self.repository and s["paperDirectory"] == paper and s["sourceKey"] == p["source_key"] for s in record["sources"]]
            sources = [source if hit else s for hit, s in zip(same, record["sources"], strict=True)] + ([] if any(same) else [source])
            node, file, before, body = record | {"sources": sources}, record["file"], record["raw"], record["body"]
        else:
            one = review.new_nodes(frame([(paper, p["source_key"], "create", plan.node_id)], "paper string, source_key string, action string, node_id string"), bundles.staged(self.spark, f"{self.root}/imports"), F.lit(None).cast("array<string>"), publication).first().asDict()
            node = {f.name: [] if isinstance(f.dataType, T.ArrayType) else None for f in S.NODE.fields} | {k: v for k, v in one.items() if k in S.NODE.names}
            node |= {"authors": m["authors"], "projects": projects, "sources": [source], "arxiv": m["arxiv"] if p["environment"] == "paper" else None}
            node["verification"] = {"method": "human-source", "note": f"Extracted from a {p['environment']} environment in the author's source; not independently verified."}
            file, before, body = f"{self.nodes_dir}/{one['file']}", "", review.BODY
        after = self.text_of(node, body)
        clean = {k: node[k] for k in S.NODE.names}
        self.check(review.replaced(records.select(*S.NODE.names), self.spark.createDataFrame([clean], S.NODE)))
        if write:
            decision = {"state": "ACCEPTED", "contentHash": p["content_hash"], "nodeId": plan.node_id, "commit": m["commit"], "reviewedAt": at, "note": review.ACCEPT_NOTE}
            self.put_both(file, before, after, paper, p["source_key"], decision)
        return Change(file, plan.node_id, before, after, write)

    def source_of(self, p: dict, m: dict, at: str) -> dict:
        empty = {f.name: [] if isinstance(f.dataType, T.ArrayType) else None for f in S.SOURCE.fields}
        own = {
            "kind": "github-latex", "repository": self.repository, "branch": self.branch, "commit": m["commit"], "path": p["source_file"], "paperDirectory": p["paper"], "sourceKey": p["source_key"], "label": p["latex_label"], "environment": p["environment"],
            "section": p["section"], "printedNumber": p["printed_number"], "startLine": p["start_line"], "endLine": p["end_line"], "contentHash": p["content_hash"], "retrievedAt": m["retrieved"], "acceptedAt": at, "statementLatex": p["statement"], "proofLatex": p["proof"],
            "macros": relevant_macros(p["statement"] + (p["proof"] or ""), m["macros"] or {}), "files": m["files"],
        }
        if p["environment"] == "paper":
            own["paperMetadata"] = {k: m[k] for k in ("title", "authors", "abstract")}
        return empty | own

    @staticmethod
    def text_of(node: dict, body: str) -> str:
        def slim(v):
            if isinstance(v, dict):
                return {k: slim(x) for k, x in v.items() if x is not None}
            return [slim(x) for x in v] if isinstance(v, list) else v

        meta = slim({k: node[k] for k in S.NODE.names})
        return "---\n" + json.dumps(meta, ensure_ascii=False) + "\n---\n" + (body or "")

    def put(self, file: str, before: str, after: str) -> None:
        """Writes a record unless someone has changed it since it was read."""
        self._unchanged(file, before)
        atomic_write(self.spark, file, after)

    def _unchanged(self, file: str, before: str) -> None:
        now = read_text(self.spark, file)
        if (now or "") != before:
            raise RefusedError("Curated file changed while the change was prepared; retry." if before else f"Refusing to overwrite {file}")

    def put_both(self, file: str, before: str, after: str, paper: str, source_key: str, decision: dict) -> None:
        """Writes a record and the decision about it, both or, to whoever opens the workspace next, as if both.

        What is to be written is written down first, whole; then come the record and the decision, and the note goes. A process that dies between
        leaves the note, and `recover` does what is left of it.
        """
        self._unchanged(file, before)
        note = f"{self.root}/pending/{uuid.uuid4().hex}"
        write_json(self.spark, f"{note}/intent.json", {"file": file, "before": before, "after": after, "paper": paper, "sourceKey": source_key, "decision": decision})
        self._settle(note)

    def _settle(self, note: str) -> bool:
        """Does what a note says and removes it; every step may have been done before. A record that someone has changed since it was read, without
        the accepted source, is left alone, and the decision isn't written."""
        text = read_text(self.spark, f"{note}/intent.json")
        if text is None:  # the process died before it had written down anything
            remove(self.spark, note)
            return False
        i = json.loads(text)
        now = read_text(self.spark, i["file"]) or ""
        if now == i["before"]:
            atomic_write(self.spark, i["file"], i["after"])
            now = i["after"]
        accepted = now == i["after"] or f'"acceptedAt": "{i["decision"]["reviewedAt"]}"' in now
        if accepted:
            bundles.write_decision(self.spark, f"{self.root}/ledger", i["paper"], i["sourceKey"], i["decision"])
        remove(self.spark, note)
        return accepted

    def recover(self) -> dict[str, bool]:
        """Settles what processes that died have left: whether each acceptance was completed (or else dropped), by note."""
        return {name: self._settle(f"{self.root}/pending/{name}") for name in children(self.spark, f"{self.root}/pending")}

    def reject(self, paper: str, key: str, note: str, write: bool = False) -> dict:
        """The decision, also when nothing is written."""
        if not note.strip():
            raise RefusedError("A note is required for a rejection.")
        p, m = self.proposal(paper, key), self.meta(paper)
        decision = {"state": "REJECTED", "contentHash": p["content_hash"], "commit": m["commit"], "reviewedAt": self.now(), "note": note}
        if write:
            bundles.write_decision(self.spark, f"{self.root}/ledger", paper, p["source_key"], decision)
        return decision

    def relate(self, node: str, target: str, type: str, note: str, write: bool = False) -> Change:
        """Adds a relation to a record; membership isn't looked at again."""
        records = self.records()
        relations, _, _ = pages.graph.relations_of(records)
        wanted = self.spark.createDataFrame([(node, target, type, note)], "id string, target string, type string, note string")
        problem = review.relate_plan(wanted, records.select("id"), relations).first().problem
        if problem:
            raise RefusedError(problem)
        record = records.filter(F.col("id") == node).first().asDict(recursive=True)
        record["relations"] = record["relations"] + [{"target": target, "type": type, "note": note}]
        after = self.text_of(record, record["body"])
        changed = self.spark.createDataFrame([{k: record[k] for k in S.NODE.names}], S.NODE)
        network = review.replaced(records.select(*S.NODE.names), changed)
        validate.raise_on(validate.network(network.select("id"), pages.edges_of(network)[0]))
        if write:
            self.put(record["file"], record["raw"], after)
        return Change(record["file"], node, record["raw"], after, write)

    def migrate(self, write: bool = False) -> list[str]:
        """Files whose records still have legacy keys; rewrites them if told to."""
        old = self.records().filter(F.col("raw").rlike(r"(?m)^(status|claimStatus|project):"))
        files = []
        for r in old.toLocalIterator():  # legacy records of one curator's workspace, one at a time
            record = r.asDict(recursive=True)
            files.append(record["file"])
            if write:
                self.put(record["file"], record["raw"], self.text_of(record, record["body"]))
        return sorted(files)

    def fragments(self) -> DataFrame:
        return read_json(self.spark, f"{self.root}/content/fragments.json", S.FRAGMENT)
