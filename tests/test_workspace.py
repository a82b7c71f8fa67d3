"""Import, review and acceptance end to end in a workspace, and the pages over it."""

import json

import pytest

from marginalia import cli
from marginalia.plans import fixtures, pages
from marginalia.plans.workspace import RefusedError, Workspace
from marginalia.sources.files import guarded, read_pages
from marginalia.operators import audit

RECORD = """---
id: {id}
title: {title}
shortTitle: {title}
type: {type}
{more}
editorialState: draft
publicationStatus: draft
summary: A summary
projects: [P]
verification:
  method: human
  note: n
provenance: background
---

Prose of {id} stays.
"""


@pytest.fixture
def workspace(spark, tmp_path):
    nodes = tmp_path / "content/nodes"
    nodes.mkdir(parents=True)
    for id, title, kind, more in (("A-1", "Flat shapes are few", "lemma", "claimStanding: open"), ("B-1", "Ground", "concept", "dependsOn: []\ntimeline: {stage: 2, note: x}"), ("C-1", "Every claim about ground", "claim", "claimStanding: open\nabout: [B-1]\nrelations:\n  - target: B-1\n    type: motivates\n    note: n")):
        (nodes / f"{id.lower()}.md").write_text(RECORD.format(id=id, title=title, type=kind, more=more))
    (tmp_path / "content/projects.json").write_text(json.dumps({"P": {"title": "P", "short": "P", "description": "d", "anchor": "B-1", "direction": "d"}}))
    for path, text in fixtures.PAPERS["2701.00001"].items():
        f = tmp_path / "mirror/2701.00001" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    return Workspace(spark, f"file://{tmp_path}")


def state(w, key):
    from marginalia.sources import bundles

    rows = {r.source_key: r.review_state for r in bundles.staged(w.spark, f"{w.root}/imports").collect()}
    return rows[key]


def test_review_round(workspace, tmp_path):
    w, mirror = workspace, f"file://{tmp_path}/mirror"
    w.import_papers(mirror, "c" * 40, dry_run=True)
    assert w.status().count() == 0
    w.import_papers(mirror, "c" * 40)
    assert state(w, "label:lem:flat") == "POSSIBLE DUPLICATE" and state(w, "paper") == "NEW"
    with pytest.raises(RefusedError, match="Choose an existing ID"):
        w.accept("2701.00001", "lem:flat")
    with pytest.raises(RefusedError, match="Unknown curated ID"):
        w.accept("2701.00001", "lem:flat", match="X-1")
    with pytest.raises(RefusedError, match="Expected one"):
        w.accept("2701.00001", "nothing")
    dry = w.accept("2701.00001", "lem:flat", match="A-1")
    assert not dry.written and (tmp_path / "content/nodes/a-1.md").read_text() == dry.before
    w.accept("2701.00001", "lem:flat", match="A-1", write=True)
    text = (tmp_path / "content/nodes/a-1.md").read_text()
    assert text.endswith("\nProse of A-1 stays.\n") and '"sourceKey": "label:lem:flat"' in text
    new = w.accept("2701.00001", "thm:main", new_id="T-1", projects=["P"], write=True)
    assert new.file.endswith("t-1.md") and new.before == ""
    assert w.reject("2701.00001", "paper", "no", write=True)["state"] == "REJECTED"
    w.import_papers(mirror, "d" * 40)
    assert (state(w, "label:lem:flat"), state(w, "label:thm:main"), state(w, "paper")) == ("ACCEPTED", "ACCEPTED", "REJECTED")
    with pytest.raises(RefusedError, match="another stable node"):
        w.accept("2701.00001", "lem:flat", match="B-1")
    second = tmp_path / "mirror/2701.00001/parts/second.tex"
    second.write_text(second.read_text().replace("shapes are few", "shapes are very few"))
    w.import_papers(mirror, "e" * 40)
    assert state(w, "label:lem:flat") == "CHANGED"
    w.import_papers(mirror, "f" * 40)
    assert state(w, "label:lem:flat") == "CHANGED"  # until someone decides
    w.accept("2701.00001", "lem:flat", write=True)
    w.import_papers(mirror, "f" * 40)
    assert state(w, "label:lem:flat") == "ACCEPTED"
    assert w.records().filter("id = 'A-1'").first().sources[0].contentHash


def test_relate_and_pages(workspace, tmp_path, capsys):
    w = workspace
    with pytest.raises(RefusedError, match="supported type"):
        w.relate("A-1", "B-1", "likes", "n")
    assert cli.main(["--root", w.root, "relate", "A-1", "--target", "B-1", "--type", "uses", "--note", "because", "--write"], w.spark) == 0
    assert "WROTE" in capsys.readouterr().out
    assert cli.main(["--root", w.root, "relate", "A-1", "--target", "B-1", "--type", "uses", "--note", "because"], w.spark) == 1
    nodes = w.records()
    page = {r.id: r for r in pages.node_pages(nodes, "/atlas/").collect()}
    assert [x.other for x in page["A-1"].dependencies] == ["B-1"] and [x.claim for x in page["B-1"].claims] == ["C-1"]
    assert page["B-1"].href == "/atlas/node/B-1/" and page["B-1"].neighbours == 2 and {x.label for x in page["B-1"].related} == {"uses → this object", "motivates → this object"}
    n, e = pages.graph_data(nodes)
    assert n.count() == 3 and {r.kind for r in e.collect()} == {"semantic", "structural"}
    assert all("<" not in r.json for r in pages.graph_json(nodes).collect())
    shown, counts = pages.index_view(nodes, query="GROUND")
    assert {r.id for r in shown.collect()} == {"B-1", "C-1"} and {r.section: r.visible for r in counts.collect()}["Results"] == 0
    assert [(r.stage, r.id) for r in pages.timeline(nodes).collect()] == [(2, "B-1")]
    edges, cards = pages.home(nodes, w.projects(), ["A-1", "B-1"])
    assert edges.count() == 1 and cards.first().anchor_title == "Ground"


def test_migration_of_files(workspace, tmp_path):
    f = tmp_path / "content/nodes/old.md"
    f.write_text("---\nid: O-1\ntitle: t\nshortTitle: t\ntype: claim\nstatus: in-progress\nproject: P\nsummary: s\nverification:\n  method: human\n  note: n\nprovenance: background\n---\nBody.\n")
    assert len(workspace.migrate()) == 1 and "status:" in f.read_text()
    workspace.migrate(write=True)
    assert workspace.migrate() == [] and f.read_text().endswith("\n---\nBody.\n")
    r = workspace.records().filter("id = 'O-1'").first()
    assert (r.claimStanding, r.projects) == ("conjectural", ["P"])


def test_built_pages(spark, tmp_path):
    (tmp_path / "dist/node/a").mkdir(parents=True)
    (tmp_path / "dist/index.html").write_text('<a href="/base/node/a/">x</a> <a href="/off">y</a> <img src="none.png"> <a href="https://x">z</a>')
    (tmp_path / "dist/node/a/index.html").write_text('<a href="../../index.html?q=1">up</a>')
    p = read_pages(spark, f"{tmp_path}/dist")
    from pyspark.sql import functions as F

    folder = F.regexp_replace(F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), "/$", "")
    found = audit.links(p, "path", "html").withColumnRenamed("path", "page").withColumn("dir", F.regexp_replace(F.regexp_extract("page", r"^(.*/)?[^/]*$", 1), "/$", ""))
    known = p.select("path").unionByName(p.filter("path LIKE '%index.html'").select(folder.alias("path")))
    got = {(r.page, r.raw): r.problem for r in audit.link_errors(found, "page", "/base/", known, F.col("dir")).collect()}
    assert got == {("index.html", "/off"): "missing base path", ("index.html", "none.png"): "broken"}
    (tmp_path / "out.txt").write_text("x")
    (tmp_path / "dist/link").symlink_to(tmp_path / "out.txt")
    with pytest.raises(ValueError):
        guarded(str(tmp_path / "dist"), "link")
    assert guarded(str(tmp_path / "dist"), "index.html").endswith("index.html")


def test_acceptance_is_both_or_neither(workspace, tmp_path, monkeypatch):
    """A process that dies before or after the record leaves a note; whoever opens the workspace next does the rest."""
    from marginalia.plans import workspace as module
    from marginalia.sources import bundles

    w = workspace
    w.import_papers(f"file://{tmp_path}/mirror", "c" * 40)
    record, notes = tmp_path / "content/nodes/a-1.md", tmp_path / "pending"
    before = record.read_text()
    decided = lambda: {r.source_key: r.nodeId for r in bundles.read_ledger(w.spark, f"{w.root}/ledger").collect()}

    def dies(*_):
        raise OSError("the process died")

    for name, owner in (("write_decision", bundles), ("atomic_write", module)):
        record.write_text(before)
        ledger = tmp_path / "ledger/2701.00001/review.json"
        if ledger.exists():
            ledger.unlink()
        with monkeypatch.context() as m:
            m.setattr(owner, name, dies)
            with pytest.raises(OSError, match="died"):
                w.accept("2701.00001", "lem:flat", match="A-1", write=True)
        assert (record.read_text() == before) == (name == "atomic_write") and decided() == {} and len(list(notes.iterdir())) == 1
        with Workspace(w.spark, w.root).lock():
            assert decided() == {"label:lem:flat": "A-1"} and '"sourceKey": "label:lem:flat"' in record.read_text() and list(notes.iterdir()) == []
    # the record was edited by hand before the rest could be done: without the source it is left alone, with it the decision follows
    for edit, done in ((before + "By hand.\n", False), (None, True)):
        record.write_text(before)
        (tmp_path / "ledger/2701.00001/review.json").unlink(missing_ok=True)
        with monkeypatch.context() as m:
            m.setattr(bundles, "write_decision", dies)
            with pytest.raises(OSError, match="died"):
                w.accept("2701.00001", "lem:flat", match="A-1", write=True)
        record.write_text(edit or record.read_text() + "By hand.\n")
        text = record.read_text()
        assert list(w.recover().values()) == [done] and record.read_text() == text and bool(decided()) == done and w.recover() == {}


def test_one_writer_at_a_time(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}")
    with w.lock():
        with pytest.raises(RefusedError, match="Another process"), w.lock():
            pass
    with w.lock():  # free again, though the file is there
        assert (tmp_path / ".papers.lock").exists()
    with pytest.raises(RefusedError, match="local"), Workspace(spark, "hdfs://x/y").lock():
        pass
