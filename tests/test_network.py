"""Relations, validation, import states, provenance, review plans and sources on small cases."""

import hashlib
import random

import pytest
from oracle import connect, same
from pyspark.sql import Row
from pyspark.sql import functions as F

from marginalia import schemas as S
from marginalia.operators import extract, graph, imports, provenance, search, validate
from marginalia.plans import fixtures, review
from marginalia.sources import bundles, curated, files


def network(spark, *nodes):
    """nodes: (id, dependsOn, [(target, type)])."""
    rel = [(i, t, k, None, p) for i, _, rs in nodes for p, (t, k) in enumerate(rs)]
    dep = [(i, t, p) for i, ds, _ in nodes for p, t in enumerate(ds)]
    ids = spark.createDataFrame([(i,) for i, _, _ in nodes], "id string")
    return ids, graph.normalized_relations(spark.createDataFrame(rel, "id string, target string, type string, note string, pos int"), spark.createDataFrame(dep, "id string, target string, pos int"))


def test_aliases_collapse(spark):
    _, r = network(spark, ("A-1", ["B-1", "B-1"], [("B-1", "uses"), ("B-1", "depends-on")]), ("B-1", [], []))
    assert sorted((x.target, x.type) for x in r.collect()) == [("B-1", "depends-on"), ("B-1", "uses")]


def rules(spark, *nodes):
    ids, r = network(spark, *nodes)
    return {(x.rule, x.id) for x in validate.network(ids, r).collect()}


def test_network_rules(spark):
    assert rules(spark, ("A-1", ["B-1"], []), ("B-1", [], [("A-1", "motivates")])) == set()
    assert rules(spark, ("A-1", ["X-1"], []), ("A-1", [], [])) == {("unknown-target", "A-1"), ("duplicate-id", "A-1")}
    assert rules(spark, ("A-1", ["B-1"], []), ("B-1", ["A-1"], []), ("C-1", ["A-1"], [])) == {("cycle", "A-1"), ("cycle", "B-1")}
    assert ("self-relation", "A-1") in rules(spark, ("A-1", [], [("A-1", "related-to")]))
    ids, r = network(spark, ("A-1", ["X-1"], []))
    with pytest.raises(validate.ViolationError, match="unknown-target"):
        validate.raise_on(validate.network(ids, r))


def test_closure_on_a_circle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "source string, target string")
    assert {(x.id, x.ancestor): x.depth for x in graph.closure(e).collect()} == {("a", "b"): 1, ("b", "a"): 1, ("b", "c"): 1, ("a", "a"): 2, ("a", "c"): 2, ("b", "b"): 2}


def test_closure_of_a_long_chain(spark):
    """Every depth is found, with a shorter way where there is one."""
    links = [(i, i + 1) for i in range(40)] + [(0, 20), (50, 50), (60, None)]
    got = {(x.id, x.ancestor): x.depth for x in graph.closure(spark.createDataFrame(links, "source long, target long")).collect()}
    want = {(a, b): min(b - a, (b - 20 + 1) if a == 0 and b >= 20 else 99) for a in range(41) for b in range(a + 1, 41)} | {(50, 50): 1}
    assert got == want


def test_views(spark):
    edges = spark.createDataFrame([("a", "b", "uses"), ("c", "a", "implies"), ("b", "c", "uses")], "source string, target string, type string")
    assert {(r.kind, r.id) for r in graph.highlighted(edges, "a").collect()} == {("node", "a"), ("node", "b"), ("node", "c"), ("edge", "a:uses:b"), ("edge", "c:implies:a")}
    assert [tuple(r) for r in graph.highlighted(edges, "z").collect()] == [("node", "z")]
    tones = spark.createDataFrame([("P0",), ("P2",), ("P3",), ("X",), (None,)], "p string").select(graph.group_tone(F.col("p"), ["P0", "P1", "P2", "P3"])).collect()
    assert [r[0] for r in tones] == [0, 2, 0, -1, -1]
    members = spark.createDataFrame([("n1", ["Q", "P"]), ("n2", ["P"]), ("n3", []), ("n4", ["P", "Q"])], "id string, projects array<string>")
    at = {r.id: (round(r.x), round(r.y)) for r in graph.ring(members, "projects", "id", ["P", "Q"]).collect()}
    assert at == {"n2": (260, 130), "n4": (260, 470), "n1": (810, 130)}  # by the first membership, in the order of the groups
    around = {r.id: (r.x, round(r.y)) for r in graph.compact_ring(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), "a").collect()}
    assert around == {"a": (260, 210), "b": (475, 210), "c": (45, 210)}
    nodes = spark.createDataFrame([("a b",)], "id string")
    assert search.view_state("https://x/graph/?project=P&node=a%20b&type=z", ["P"], nodes) == {"project": "P", "node": "a b"}
    assert search.view_state("/?project=Q&node=c", ["P"], nodes) == {} and search.view_state("/?node=c", []) == {"node": "c"}


def test_schema_and_claim_rules(spark):
    ok = dict(id="A-1", title="t", shortTitle="t", type="claim", claimStanding="open", editorialState="draft", publicationStatus="draft", summary="s", projects=["P"], verification=Row(method="human", note="n"), provenance="background")
    empty = {f.name: None for f in S.NODE.fields}
    nodes = spark.createDataFrame([Row(**{**empty, **ok}), Row(**{**empty, **ok, "id": "bad", "type": "x", "arxiv": "1"})], S.NODE)
    assert sorted((x.id, x.detail) for x in validate.schema(nodes).collect()) == [("bad", "arxiv"), ("bad", "id"), ("bad", "type")]
    assert validate.claim_standing(nodes).count() == 1


def states(spark, **more):
    base = dict(paper="p", source_key="k", content_hash="h", blocked=False, warnings=[])
    props = spark.createDataFrame([Row(**{**base, **more.get("prop", {})})], "paper string, source_key string, content_hash string, blocked boolean, warnings array<string>")
    ledger = spark.createDataFrame(more.get("ledger", []), "paper string, source_key string, state string, content_hash string")
    diff = spark.createDataFrame(more.get("diff", []), "paper string, source_key string, class string")
    found = spark.createDataFrame(more.get("found", []), "paper string, source_key string, exact boolean")
    told = spark.createDataFrame(more.get("told", []), "paper string, severity string")
    before = spark.createDataFrame(more.get("before", []), "paper string, source_key string, review_state string")
    return imports.review(props, ["paper", "source_key"], ledger, diff, found, told, before).first().review_state


def test_review_cascade(spark):
    accepted = [("p", "k", "ACCEPTED", "h")]
    assert states(spark) == "NEW"
    assert states(spark, prop={"warnings": ["w"]}) == "NEEDS REVIEW"
    assert states(spark, found=[("p", "k", False)]) == "POSSIBLE DUPLICATE"
    assert states(spark, found=[("p", "k", True), ("p", "k", False)]) == "MATCHED"
    assert states(spark, found=[("p", "k", True)], diff=[("p", "k", "changed")]) == "CHANGED"
    assert states(spark, before=[("p", "k", "CHANGED")]) == "CHANGED"
    assert states(spark, ledger=accepted, before=[("p", "k", "CHANGED")]) == "ACCEPTED"
    assert states(spark, ledger=[("p", "k", "ACCEPTED", "older")]) == "CHANGED"
    assert states(spark, ledger=accepted, prop={"blocked": True}) == "NEEDS REVIEW"
    assert states(spark, ledger=accepted, told=[("p", "error")]) == "NEEDS REVIEW"
    assert states(spark, ledger=accepted, told=[("p", "warning")]) == "ACCEPTED"


def test_papers(spark):
    s = extract.scan_papers(fixtures.bundles(spark))
    rows = {(r.paper, r.source_key): r for r in extract.proposals(s).collect()}
    assert ("2701.00001", "paper") in rows and ("2701.00001", "label:lem:flat") in rows
    assert not rows["2701.00001", "label:thm:main"].blocked and any("eq:none" in w for w in rows["2701.00001", "label:thm:main"].warnings)
    broken = [r for (p, k), r in rows.items() if p == "broken" and k != "paper"]
    assert len(broken) == 4 and all(r.blocked for r in broken) and sum(":duplicate:" in r.source_key for r in broken) == 2
    said = {r.message for r in extract.diagnostics(s).filter("paper = 'broken'").collect()}
    assert any(m.startswith("Duplicate label a (2") for m in said) and any("escapes" in m for m in said)
    assert {r.key: r.used for r in extract.used_citations(extract.rows_of(s, "citation"), extract.rows_of(s, "paper")).collect()} == {"One20": True, "Spare": False}
    assert [r.key for r in extract.missing_citations(extract.rows_of(s, "citation"), extract.rows_of(s, "paper")).collect()] == ["Two21"]


def test_reimport(spark):
    one = extract.proposals(extract.scan_papers(fixtures.bundles(spark).filter("paper = '2701.00001'")))
    edited = fixtures.bundles(spark).filter("paper = '2701.00001'").withColumn("text", F.replace("text", F.lit("year = 2020"), F.lit("year = 2021"))).withColumn("text", F.replace("text", F.lit("A shape is a thing."), F.lit("A shape is a thing. % note\n")))
    two = extract.proposals(extract.scan_papers(edited))
    diff = {r.source_key: r["class"] for r in imports.compare(one, two, ["paper", "source_key"]).collect()}
    assert diff["label:thm:main"] == "changed" and diff["label:lem:flat"] == "unchanged"
    assert {c for k, c in diff.items() if k.startswith("unlabeled:definition")} == {"unchanged"}


def fragment(text, context, **place):
    sel = lambda t: Row(file=place.get("file", "f"), startLine=3, endLine=3, selectedText=t, contentHash=hashlib.sha256(t.encode()).hexdigest())
    return Row(
        id="FRAG-A", kind="source-fragment", source=Row(repository="o/r", branch="b", commit="c" * 40, file="f", paperDirectory="p"), container=Row(latexLabel="k", environment="theorem", printedNumber="1"), assertionSelections=[sel(text)],
        contextSelections=[Row(**sel(context).asDict(), role="scope")] if context else [], context=Row(sourceKey="k", title="t", paperTitle="P", section="s", statementScope="x"),
    )


def inspected(spark, statement, number="1", **frag):
    f = spark.createDataFrame([fragment("All is well.", frag.get("context", "Let x.")).asDict(recursive=True)], S.FRAGMENT)
    cols = "paperDirectory string, repository string, branch string, commit string, paperTitle string, pos int, sourceKey string, latexLabel string, environment string, printedNumber string, title string, sourceFile string, startLine int, statement string, section string"
    o = spark.createDataFrame([("p", "o/r", "b", "c" * 40, "P", 0, frag.get("key", "k"), "k" if frag.get("key", "k") == "k" else None, "theorem", number, "t", "f", 3, statement, "s")], cols)
    return provenance.inspect(provenance.snapshots(f, o)).first()


def test_freshness(spark):
    assert inspected(spark, "Let x. All is well.").state == "current"
    moved = inspected(spark, "Let x. All is well.", number="2")
    assert (moved.state, moved.locatorState, moved.assertionState) == ("locator-changed", "changed", "current")
    assert inspected(spark, "\nLet x. All is well.").state == "locator-changed"
    assert inspected(spark, "Let x. All is bad.").state == "assertion-changed"
    assert inspected(spark, "Let y. All is well.").state == "context-changed"
    gone = inspected(spark, "x", key="other", context=None)
    assert (gone.state, gone.contextState) == ("source-missing", "current")


def test_attestations(spark):
    r = spark.range(1).select(*(provenance.semantic_review(F.lit(s), F.lit(a), F.lit(c)).alias(n) for n, s, a, c in (("a", "accepted", "current", "current"), ("b", "accepted", "changed", "current"), ("c", "rejected", "current", "current")))).first()
    assert tuple(r) == ("accepted", "needs-review", "rejected")


def test_migration_is_idempotent(spark):
    n = spark.createDataFrame([("A-1", "claim", "in-progress", "P", None, "source-backed"), ("B-1", "paper", "published", "P", "2606.00001", "background")], "id string, type string, status string, project string, arxiv string, provenance string")
    once = review.migrate(n)
    assert [(r.claimStanding, r.editorialState, r.publicationStatus, r.projects) for r in once.orderBy("id").collect()] == [("conjectural", "draft", "unpublished", ["P"]), (None, "reviewed", "published", ["P"])]
    assert review.migrate(once).collect() == once.collect()


def test_curated_round_trip(spark, tmp_path):
    meta = "id: A-1\ntitle: \"A: title\"\nshortTitle: A\ntype: claim\nclaimStanding: open\neditorialState: draft\npublicationStatus: draft\nsummary: s\nprojects: [P, Q]\ndependsOn:\n  - B-1\nrelations:\n  - target: B-1\n    type: uses\n    note: because\nverification:\n  method: human\n  note: n\nprovenance: background\ntimeline: {stage: 2, note: x}\n"
    (tmp_path / "a.md").write_text(f"---\n{meta}---\n\nProse  stays.\r\n", newline="")
    (tmp_path / "skip.txt").write_text("no")
    r = curated.read_curated(spark, str(tmp_path)).first()
    assert (r.id, r.title, r.projects, r.dependsOn, r.relations[0].note, r.timeline.stage, r.sources) == ("A-1", "A: title", ["P", "Q"], ["B-1"], "because", 2, [])
    assert r.body == "\nProse  stays.\r\n"
    out = curated.serialize(curated.read_curated(spark, str(tmp_path))).first().text
    assert out.endswith("\n---\n\nProse  stays.\r\n")


def test_metadata_is_yaml():
    block = "a: >-\n  folded\n  lines\nb: |\n  kept\n  lines\n'c d': \"x: y # z\" # a remark\ne: &base {f: 1}\ng: *base\nh: [1, 'two, three']\n"
    assert curated.metadata_of(block) == {"a": "folded lines", "b": "kept\nlines\n", "c d": "x: y # z", "e": {"f": 1}, "g": {"f": 1}, "h": [1, "two, three"]}
    assert curated.metadata_of("- a\n- b") == {}


def test_sources_and_sinks(spark, tmp_path):
    root = f"file://{tmp_path}"
    for path, text in fixtures.PAPERS["2701.00001"].items():
        (tmp_path / "mirror/2701.00001" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "mirror/2701.00001" / path).write_text(text)
    b = bundles.read_bundles(spark, f"{root}/mirror")
    assert {r.path for r in b.collect()} == set(fixtures.PAPERS["2701.00001"]) and len(bundles.file_list(b).first().files) == 4
    spark.dataSource.register(bundles.Mirror)
    assert spark.read.format("paper_mirror").load(f"{root}/mirror").count() == 4
    p = extract.proposals(extract.scan_papers(b.select("paper", "path", "text")))
    bundles.stage(p, spark.createDataFrame([("2701.00001", "m", 1)], "paper string, metric string, value long"), f"{root}/staging")
    assert bundles.staged(spark, f"{root}/staging").count() == p.count() and bundles.staged(spark, f"{root}/none") is None
    assert bundles.read_ledger(spark, f"{root}/ledger").count() == 0
    bundles.write_decision(spark, f"{root}/ledger", "2701.00001", "k", {"state": "ACCEPTED", "contentHash": "h"})
    bundles.write_decision(spark, f"{root}/ledger", "2701.00001", "k", {"state": "REJECTED", "contentHash": "h"})
    bundles.write_decision(spark, f"{root}/ledger", "2701.00001", "j", {"state": "ACCEPTED", "contentHash": "i"})
    assert {r.source_key: r.state for r in bundles.read_ledger(spark, f"{root}/ledger").collect()} == {"k": "REJECTED", "j": "ACCEPTED"}
    assert files.read_json(spark, f"{root}/nothing.json", "a int").count() == 0
    with pytest.raises(TypeError):
        bundles.discover({})
    with pytest.raises(ValueError):
        bundles.discover([{"type": "dir", "name": "../x"}])
    assert bundles.discover([{"type": "dir", "name": "b"}, {"type": "file", "name": "c"}, {"type": "dir", "name": "a"}]) == ["a", "b"]


def test_atomic_write_replaces_in_one_step(spark, tmp_path):
    path = f"file://{tmp_path}/deep/a.json"
    for text in ("old", "new and longer", "ü"):
        files.atomic_write(spark, path, text)
        assert files.read_text(spark, path) == text
    assert [p.name for p in (tmp_path / "deep").iterdir()] == ["a.json"]


def test_reject_needs_a_note(spark):
    props = spark.createDataFrame([("p", "k", "h")], "paper string, source_key string, content_hash string")
    choice = spark.createDataFrame([("p", "k", " "), ("p", "k", "no"), ("p", "x", "no")], "paper string, source_key string, note string")
    assert [r.problem for r in review.reject_plan(props, choice, F.lit("c"), F.lit("t")).orderBy("source_key", "note").collect()] == ["A note is required for a rejection.", None, "no such proposal"]


def test_changed_sources_are_reported(spark):
    shape = "paper string, files array<struct<path:string,sha256:string,bytes:bigint>>"
    old = spark.createDataFrame([("a", [("m", "1", 1)]), ("b", [("m", "1", 1)])], shape)
    new = spark.createDataFrame([("a", [("m", "1", 1)]), ("b", [("m", "2", 1)]), ("c", [("m", "1", 1)])], shape)
    changed = imports.changed_papers(old, new)
    assert {r.paper: r.source_changed for r in changed.collect()} == {"a": False, "b": True, "c": True}
    none = spark.createDataFrame([], "class string, presentation_changed boolean")
    told = imports.report(none, spark.createDataFrame([], "environment string"), spark.createDataFrame([], "pid string"), changed)
    assert {r.metric: r.value for r in told.collect()}["sourceChanged"] == 2


def test_matching_by_shuffle(spark, monkeypatch):
    """Beyond what is broadcast, words are dealt out by parts; the matches are the same, one word in every title included."""
    rng = random.Random(5)
    word = lambda n: [f"w{rng.randrange(40)}" for _ in range(n)]
    props = spark.createDataFrame([(i, list(dict.fromkeys(["hot", *word(rng.choice([1, 4, 20]))])), "t", False, str(i % 7) if i % 3 else None) for i in range(60)], "pid long, words array<string>, ptype string, is_paper boolean, parxiv string")
    known = spark.createDataFrame([(j, list(dict.fromkeys(["hot", *word(5)])), list(dict.fromkeys(word(12))), [f"w{j}"], "t" if j % 2 else "u", False, f"{j % 7}v2") for j in range(30)], "cid long, title_words array<string>, body_words array<string>, tag_words array<string>, ctype string, is_paper boolean, carxiv string")
    want = {}
    for p in props.collect():
        for c in known.collect():
            share = lambda a: len(set(a) & set(p.words)) / max(1, min(len(a), len(p.words)))
            t, b, g = share(c.title_words), share(c.body_words), share(c.tag_words)
            arxiv = p.parxiv == c.carxiv[:-2]
            score = (0.16 if arxiv else 0.0) + (t * 0.45 + b * 0.22 + g * 0.08) + (0.05 if p.ptype == c.ctype else 0.0)
            if score >= 0.46 and (arxiv or t >= 0.4):
                want[p.pid, c.cid] = min(0.94, int(score * 100 + 0.5) / 100)
    for bound in (20_000, 0):
        monkeypatch.setattr(imports, "BROADCAST_RECORDS", bound)
        got = {(r.pid, r.cid): r.confidence for r in imports.fuzzy_matches(props, known).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 0.0101 for k in want) and len(want) > 50


def test_frequent_words_make_no_pairs(spark):
    """Words of nearly all titles and texts are met last, so that pairs are made of what tells records apart, and few that don't score."""
    rng = random.Random(8)
    hot = ["alpha", "beta", "gamma"]
    props = spark.createDataFrame([(i, [*hot, *{f"p{rng.randrange(3000)}" for _ in range(40)}, *(f"r{i % 50}a r{i % 50}b r{i % 50}c r{i % 50}d".split() if i % 3 else [])], "t", False, None) for i in range(600)], "pid long, words array<string>, ptype string, is_paper boolean, parxiv string")
    known = spark.createDataFrame([(j, [*hot, *f"r{j}a r{j}b r{j}c r{j}d".split()], [*hot, *f"r{j}a r{j}b r{j}c r{j}d r{j}e".split()], [f"tag{j}"], "t", False, None) for j in range(50)], "cid long, title_words array<string>, body_words array<string>, tag_words array<string>, ctype string, is_paper boolean, carxiv string")
    words = imports.vocabulary(known)
    pairs = imports.met_pairs(imports.numbered_words(props, words, True), imports.numbered_records(known, words), True).count()
    found = imports.fuzzy_matches(props, known).collect()
    assert {(r.pid, r.cid) for r in found} == {(i, i % 50) for i in range(600) if i % 3} and pairs < 3 * len(found) < 600 * 50 / 10


def test_spans_without_an_end(spark, tmp_path):
    """Ranges that lack an end come last, as in the SQL; each range but once, so that its order leaves no ties."""
    rows = [(1, 1, 3, 5), (1, 4, 2, 7), (1, 2, None, 4), (2, 1, None, None), (3, 2, 5, None), (3, 3, 5, 8), (4, 1, 16, 1), (4, 7, 0, 0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").toPandas().astype("Int64").to_parquet(tmp_path / "lineitem.parquet")
    from marginalia.plans import registry

    assert same(registry.QUERIES["q_span_merge"](spark, str(tmp_path)), connect(str(tmp_path)), registry.ORACLES["q_span_merge"]) == 7


def test_repeated_spans_are_one(spark):
    rows = [(1, 45, 49), (1, 74, 79), (1, 74, 79), (1, 74, 79)]
    merged = provenance.merge_spans(spark.createDataFrame(rows, "k long, first long, last long"), ["k"])
    assert sorted(map(tuple, merged.collect())) == [(1, 45, 49), (1, 74, 79)]


def test_page_numbers_of_any_length(spark, tmp_path):
    from marginalia.plans import registry

    pages = [(i, f"https://h/{i}") for i in (-20_000, -9_999, 0, 89_998, 89_999, 90_000, 123_456, 10**12)]
    spark.createDataFrame([*pages, (None, "x")], "page_id long, url string").toPandas().astype({"page_id": "Int64"}).to_parquet(tmp_path / "pages.parquet")
    assert same(registry.QUERIES["q_urls_and_arxiv"](spark, str(tmp_path)), connect(str(tmp_path)), registry.ORACLES["q_urls_and_arxiv"]) == 9


def test_entries_of_a_bibliography_are_not_broadcast(spark):
    objects = spark.createDataFrame([("p", "a", "f", ["K"]), ("p", "b", "g", ["*"])], "paper string, source_key string, fingerprint string, citations array<string>")
    entries = spark.createDataFrame([("p", "K", 0, {"t": "x"})], "paper string, key string, pos int, fields map<string,string>")
    hashed = extract.content_hashes(objects, entries)
    assert "BroadcastHashJoin" not in hashed._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.source_key, r.content_hash) for r in hashed.collect()) == [(k, hashlib.sha256(f'["{f}",[["K",{{"t":"x"}}]]]'.encode()).hexdigest()) for k, f in (("a", "f"), ("b", "g"))]


def test_scan_gives_the_tags_asked_for(spark):
    files_ = fixtures.bundles(spark)
    every, some = extract.scan_papers(files_), extract.kept(extract.scan_papers(files_, tags=("label", "object")))
    assert {r.tag for r in some.collect()} == {"label", "object"}
    wanted = every.filter("tag IN ('label', 'object')").select(*some.columns)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, wanted.collect()))


def _below(plan: str, upper: str, lower: str) -> bool:
    """Whether some line with `lower` stands below one with `upper`."""
    lines = plan.splitlines()
    at = [i for i, line in enumerate(lines) if upper in line]
    return bool(at) and any(lower in line for line in lines[at[0] + 1 :])


def test_relations_are_shuffled_before_they_are_combined(spark):
    rows = [("a", "b", "uses", "second", 3), ("a", "b", "uses", "first", 1), ("a", "gone", "uses", None, 0), ("c", "a", "uses", None, 0)]
    relations, depends = spark.createDataFrame(rows, "id string, target string, type string, note string, pos int"), spark.createDataFrame([("a", "b", 0)], "id string, target string, pos int")
    ids = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "id string")
    normal = graph.normalized_relations(relations, depends)
    assert not _below(normal._jdf.queryExecution().executedPlan().toString(), "Exchange", "HashAggregate")
    about = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "gone")], "id string, target string")
    early, late = graph.edges_of_all(graph.every_relation(relations, depends), about, ids), graph.all_edges(normal, about, ids)
    wanted = sorted(map(tuple, late.fillna("-").collect()))
    assert sorted(map(tuple, early.fillna("-").collect())) == wanted and len(wanted) == 5
    assert ("a:uses:b", "a", "b", "uses", "semantic", "first") in wanted


def test_edges_at_one_node_are_chosen_before_they_are_combined(spark):
    relations = spark.createDataFrame([("a", "b", "uses", "n", 0), ("c", "d", "uses", "n", 0), ("b", "a", "uses", "n", 0)], "id string, target string, type string, note string, pos int")
    edges = graph.normalized_relations(relations, spark.createDataFrame([], "id string, target string, pos int")).withColumnRenamed("id", "source").select("source", "target", "type")
    at = graph.touching(edges, "a")
    assert sorted(map(tuple, at.collect())) == [("a", "b", "uses", "in"), ("a", "b", "uses", "out")]
    assert _below(at._jdf.queryExecution().optimizedPlan().toString(), "Aggregate", "= a)")


def test_rules_over_relations_not_normalised(spark):
    """The same rows as of normalised ones, with no exchange of all relations to normalise them."""
    rel = [("A-1", "X-1", "uses", None, 0), ("A-1", "X-1", "uses", "again", 1), ("A-1", "A-1", "uses", None, 2), ("A-1", "A-1", "uses", None, 3), ("B-1", None, "uses", None, 0), ("B-1", "C-1", "depends-on", None, 1)]
    dep = [("B-1", "C-1", 0), ("C-1", "B-1", 0), ("D-1", "B-1", 0), ("E-1", "E-1", 0)]
    r, d = spark.createDataFrame(rel, "id string, target string, type string, note string, pos int"), spark.createDataFrame(dep, "id string, target string, pos int")
    ids = spark.createDataFrame([(i,) for i in ("A-1", "B-1", "C-1", "D-1", "E-1", "E-1")], "id string")
    own = spark.createDataFrame([("D-1", "D-1", "related-to")] * 2, "id string, target string, type string")
    got = validate.network(ids, own, every=graph.every_relation(r, d))
    want = validate.network(ids, own.unionByName(graph.normalized_relations(r, d).select("id", "target", "type")))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert sum(x.rule == "self-relation" and x.id == "D-1" for x in got.collect()) == 2 and {x.id for x in got.filter("rule = 'cycle'").collect()} == {"B-1", "C-1", "E-1"}
    unknown = validate.network(ids, own, cycles=False, every=graph.every_relation(r, d)).filter("rule = 'unknown-target'")
    plan = unknown._jdf.queryExecution().optimizedPlan().toString()
    # put together above the joins only
    assert "Aggregate" in plan and "Aggregate" not in plan[plan.rindex("LeftAnti") :]


def test_accept_plan_deals_out_rows_without_an_id(spark):
    """Most proposals name no node, or no new one; they don't meet in one task, and find nothing."""
    n = 4000
    choice = spark.range(n).select(F.lit("p").alias("paper"), F.col("id").alias("source_key"), F.when(F.col("id") % 100 == 0, "N-1").alias("match"), F.when(F.col("id") % 100 == 1, F.lit("N-2")).alias("new_id"), F.array(F.lit("P")).alias("projects"))
    props = choice.select("paper", "source_key", F.lit("h").alias("content_hash"), F.lit(False).alias("blocked"), F.lit(False).alias("has_error"))
    nodes = spark.createDataFrame([("N-1",), ("N-1",), ("N-2",), (None,)], "id string").unionByName(choice.select(F.xxhash64("paper", "source_key").cast("string").alias("id")))
    none = spark.createDataFrame([], "node_id string, paper string, source_key long, state string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plan = review.accept_plan(props, none, none, nodes, choice)
        assert {r.action: r["count"] for r in plan.groupBy("action").count().collect()} == {"update": n // 100, "refuse": n - n // 100} and plan.count() == n
        assert {r.problem for r in plan.filter("source_key % 100 = 1").collect()} == {"Refusing to overwrite N-2"}
        parts = [r["count"] for r in plan.groupBy(F.spark_partition_id()).count().collect()]
        assert max(parts) < n // 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
