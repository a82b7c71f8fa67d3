"""What each page of the site shows, as DataFrames: one denormalised row or a few rows for each record, all pages at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as T
from ..operators import graph, imports, provenance, ranks, search
from .review import suggested_command


def edges_of(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalised relations and about rows of nested records."""
    relations, depends, about = graph.relations_of(nodes)
    return graph.normalized_relations(relations, depends), about


def graph_data(nodes: DataFrame, base: str = "/") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the whole graph."""
    relations, about = edges_of(nodes)
    return graph.graph_nodes(nodes, base), graph.all_edges(relations, about, nodes.select("id"))


def graph_json(nodes: DataFrame, base: str = "/", per_page: int = ranks.PAGE) -> DataFrame:
    """id, page, json: JSON documents for each node, safe inside a script element. The first holds the record and its first outgoing edges; a hub has
    further ones with more edges. `next` in a document names the edge that the following one begins with."""
    n, e = graph_data(nodes, base)
    own = ranks.paged(e.withColumnRenamed("source", "id"), ["id"], ["edge_id"], ["edge_id", "target", "type", "kind", "note"], per_page)
    of = own.select("id", "page", "entries", F.col("next.edge_id").alias("next"))
    first = n.join(of.filter("page = 0").drop("page"), "id", "left").withColumnRenamed("entries", "edges")
    record = F.struct("id", "title", "shortTitle", "type", "claimStanding", "editorialState", "publicationStatus", "summary", "projects", "tags", "href", "edges", "next")
    more = of.filter("page > 0").select("id", "page", T.embed_json(F.struct("id", F.col("entries").alias("edges"), "next")).alias("json"))
    return first.select("id", F.lit(0).cast("long").alias("page"), T.embed_json(record).alias("json")).unionByName(more)


BUCKETS = ("dependencies", "consequences", "examples", "related")


def node_lists(nodes: DataFrame, per_page: int = ranks.PAGE) -> DataFrame:
    """id, list, page, pages, size, entries (other, label, title), next: what each node's page lists, in pages. Lists: the four buckets, claims about
    the node, and what it contains."""
    relations, about = edges_of(nodes)
    titles = nodes.select(F.col("id").alias("other"), "title")
    sources = nodes.select("id", F.explode("sources").alias("s")).select("id", F.concat_ws("\n", "s.repository", "s.paperDirectory").alias("source_key"), F.col("s.environment").alias("environment")).distinct()
    held = graph.contained(nodes.filter("type = 'paper'").select("id", F.lit(None).cast("string").alias("source_key")).unionByName(sources.filter("environment = 'paper'").select("id", "source_key")), relations, sources.select("id", "source_key"))
    claims = about.join(nodes.filter("type = 'claim'").select("id"), "id", "left_semi").select(F.col("target").alias("id"), F.col("id").alias("other"))
    none = F.lit(None).cast("string").alias("label")
    rows = graph.buckets(relations).select("id", F.col("bucket").alias("list"), "other", "label").unionByName(claims.select("id", F.lit("claims").alias("list"), "other", none)).unionByName(held.select("id", F.lit("contained").alias("list"), F.col("member").alias("other"), none))
    return ranks.paged(rows.join(titles, "other", "left"), ["id", "list"], ["other", "label"], ["other", "label", "title"], per_page)


def node_pages(nodes: DataFrame, base: str = "/", per_page: int = ranks.PAGE) -> DataFrame:
    """A row for each node: its record, address, neighbour count, and the first page of each list of `node_lists`, with the lists' sizes; the rest of
    a hub's lists are rows of their own there."""
    lists = node_lists(nodes, per_page).filter("page = 0").withColumn("e", F.struct("entries", "size"))
    of = lambda name: F.max(F.when(F.col("list") == name, F.col("e"))).alias(f"_{name}")
    first = lists.groupBy("id").agg(*(of(name) for name in (*BUCKETS, "claims", "contained")))
    shape = {"claims": lambda e: F.struct(e["other"].alias("claim"), e["title"].alias("title")), "contained": lambda e: F.struct(e["other"].alias("member"))}
    usual = lambda e: F.struct(e["other"].alias("other"), e["label"].alias("label"), e["title"].alias("other_title"))
    shown = [F.transform(f"_{name}.entries", shape.get(name, usual)).alias(name) for name in (*BUCKETS, "claims", "contained")]
    sizes = F.struct(*(F.coalesce(f"_{name}.size", F.lit(0)).alias(name) for name in (*BUCKETS, "claims", "contained"))).alias("sizes")
    relations, about = edges_of(nodes)
    out = nodes.drop("sources").withColumn("href", T.node_url(F.lit(base), F.col("id"))).withColumn("standing_label", T.lookup(F.col("claimStanding"), {k: v[0] for k, v in S.STANDINGS.items()})).withColumn("type_label", T.type_label(F.col("type")))
    edges = graph.all_edges(relations, about, nodes.select("id"))
    return out.join(first.select("id", *shown, sizes), "id", "left").join(graph.neighbour_counts(edges), "id", "left")


def index_view(nodes: DataFrame, **filters: str) -> tuple[DataFrame, DataFrame]:
    """The rows that an index search shows, with their section, and the sections' counts."""
    shown = search.index_filter(nodes, **filters)
    section = F.coalesce(*(F.when(F.col("type").isin(*types), F.lit(title)) for title, types in S.INDEX_SECTIONS))
    return shown.withColumn("section", section).select("section", "id", "title", "claimStanding", "editorialState", "publicationStatus", "projects"), search.bucket_counts(nodes, shown, "type")


def timeline(nodes: DataFrame) -> DataFrame:
    """Staged nodes and what they motivate; the date is that of the stage's dated paper, in long form."""
    relations, _ = edges_of(nodes)
    rows = graph.timeline(nodes.select("id", F.col("shortTitle").alias("label"), F.col("timeline.stage").alias("stage")), relations)
    dated = nodes.filter("type = 'paper' AND timeline.stage = 2 AND date IS NOT NULL").groupBy(F.col("timeline.stage").alias("stage")).agg(F.min_by("date", "id").alias("date"), F.min_by("dateNote", "id").alias("date_note"))
    return rows.join(F.broadcast(dated), "stage", "left").withColumn("date", T.long_date(F.expr("try_cast(date AS DATE)")))  # a row at most


def home(nodes: DataFrame, projects: DataFrame, preview: list[str]) -> tuple[DataFrame, DataFrame]:
    """The induced graph of the previewed ids, and a card for each project with its anchor's title."""
    _, edges = graph_data(nodes)
    cards = projects.join(nodes.select(F.col("id").alias("anchor"), F.col("title").alias("anchor_title"), "summary"), "anchor", "left")
    return graph.induced(edges, nodes.filter(F.col("id").isin(preview)).select("id")), cards


def anchors(proposals: DataFrame, references: DataFrame, citations: DataFrame) -> DataFrame:
    """paper, source_key, reference_anchors, citation_anchors: what a review page links to, in order.

    A reference (of extract.resolved_references) leads to the proposal that it resolves to, a citation key to its entry in the bibliography;
    those that lead nowhere have a null anchor.
    """
    keys = ["paper", "source_key"]
    own = proposals.select("paper", F.col("source_key").alias("target_key"), F.lit(True).alias("_known"))
    to = references.join(own, ["paper", "target_key"], "left").select(*keys, "pos", "label", F.when(F.col("_known"), F.concat(F.lit("#"), T.anchor(F.col("target_key")))).alias("anchor"))
    listed = lambda rows, name: rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "label", "anchor"))), lambda x: F.struct(x["label"].alias("label"), x["anchor"].alias("anchor"))).alias(name))
    cited = proposals.select(*keys, F.posexplode("citations").alias("pos", "label"))
    entries = citations.select("paper", F.col("key").alias("label"), F.lit(True).alias("_entry")).distinct()
    cited = cited.join(entries, ["paper", "label"], "left").select(*keys, "pos", "label", F.when(F.col("_entry"), F.concat(F.lit("#bib-"), T.encode_segment(F.col("label")))).alias("anchor"))
    return proposals.select(*keys).join(listed(to, "reference_anchors"), keys, "left").join(listed(cited, "citation_anchors"), keys, "left")


def review_page(proposals: DataFrame, states: DataFrame, found: DataFrame, diff: DataFrame) -> DataFrame:
    """A row for each proposal: state, difference, ranked candidates and the command that would accept it. Keyed by paper and source_key."""
    keys = ["paper", "source_key"]
    ranked = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "cid", "confidence", "reasons"))).alias("candidates"))
    rows = proposals.join(states, keys).join(diff.select(*keys, "class", "presentation_changed"), keys, "left").join(ranked, keys, "left")
    return rows.withColumn("command", suggested_command(F.col("paper"), F.col("source_key"), F.get("candidates", 0)["cid"].cast("string"), F.col("suggested_id")))


def import_list(proposals: DataFrame, states: DataFrame) -> DataFrame:
    """A row for each staged paper: proposals, accepted ones, and those that need a look."""
    rows = proposals.select("paper", "source_key").join(states, ["paper", "source_key"])
    return rows.groupBy("paper").agg(F.count("*").alias("proposals"), F.count_if("review_state = 'ACCEPTED'").alias("accepted"), F.count_if("review_state IN ('CHANGED', 'NEEDS REVIEW')").alias("waiting"))


def fragment_pages(fragments: DataFrame, objects: DataFrame, attestations: DataFrame, nodes: DataFrame, host: str) -> DataFrame:
    """A row for each fragment: its state, lines and links, and the attestations that rest on it with their targets' titles."""
    done = provenance.inspect(provenance.snapshots(fragments, objects))
    first, last = provenance.assertion_range(F.col("assertionSelections"))
    links = T.source_links(F.lit(host), F.col("source.repository"), F.col("source.branch"), F.col("source.commit"), F.col("source.file"), first, last)
    by = attestations.join(nodes.select(F.col("id").alias("target"), F.col("title").alias("t")), "target", "left")
    by = by.groupBy(F.col("fragment").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("id").alias("attestation"), "target", F.coalesce("t", "target").alias("title")))).alias("attestations"))
    return done.withColumns({"first_line": first, "last_line": last, **links, "locator": provenance.state_label(F.col("locatorState"))}).drop("now").join(by, "id", "left")


def attestation_pages(attestations: DataFrame, fragments: DataFrame, objects: DataFrame, nodes: DataFrame) -> DataFrame:
    done = provenance.evaluate(attestations, provenance.inspect(provenance.snapshots(fragments, objects)))
    return done.join(nodes.select(F.col("id").alias("target"), F.col("title").alias("target_title")), "target", "left")


def import_papers(files: DataFrame, curated: DataFrame, ledger: DataFrame, previous: DataFrame | None, commit: str, repository: str, entrypoint: str = "main.tex", before: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole import: proposals, diff, candidates, states, diagnostics, report, of all papers in files.

    curated: records with body; ledger: paper, source_key, state, contentHash; previous: staged proposals with review_state, or None;
    before: paper and files of the import before, by which the report says whose files changed.
    """
    from ..functions.tex import words_column
    from ..operators import extract
    from ..sources.files import cut

    scanned = extract.kept(extract.scan_papers(files, entrypoint))
    props = cut(extract.proposals(scanned))
    told = extract.diagnostics(scanned)
    papers = extract.rows_of(scanned, "paper")
    keys = ["paper", "source_key"]
    empty = props.limit(0).withColumn("review_state", F.lit(""))
    old = previous if previous is not None else empty
    diff = imports.compare(old.join(props.select("paper").distinct(), "paper", "left_semi"), props, keys)
    arxiv = papers.select("paper", F.col("arxiv").alias("parxiv"))
    asked = props.join(arxiv, "paper", "left").select(F.struct(*keys).alias("pid"), words_column(F.concat_ws(" ", F.coalesce("title", F.lit("")), "statement")).alias("words"), F.col("proposed_type").alias("ptype"), (F.col("environment") == "paper").alias("is_paper"), "parxiv")
    known = curated.select(
        F.col("id").alias("cid"), words_column(F.concat_ws(" ", "title", "shortTitle")).alias("title_words"), words_column(F.concat_ws(" ", "summary", "body")).alias("body_words"), words_column(F.array_join("tags", " ")).alias("tag_words"),
        F.col("type").alias("ctype"), (F.col("type") == "paper").alias("is_paper"), F.col("arxiv").alias("carxiv"),
    )
    sources = curated.select(F.col("id").alias("cid"), F.explode("sources").alias("s")).select("cid", "s.repository", F.col("s.paperDirectory").alias("directory"), F.col("s.sourceKey").alias("source_key"), "s.label")
    exact = imports.exact_matches(props.select(F.struct(*keys).alias("pid"), F.lit(repository).alias("repository"), F.col("paper").alias("directory"), "source_key", "latex_label"), sources)
    found = cut(imports.candidates(asked, known, exact))
    keyed = found.select("pid.paper", "pid.source_key", "cid", "confidence", "reasons", "exact", "rank")
    states = imports.review(props, keys, ledger.select(*keys, "state", F.col("contentHash").alias("content_hash")), diff, keyed, told, old)
    changed = imports.changed_papers(before, papers) if before is not None else None
    report = imports.report(diff, props.filter("environment <> 'paper'"), found.filter("pid.source_key <> 'paper'"), changed)
    return {"proposals": props, "papers": papers.withColumn("commit", F.lit(commit)), "diff": diff, "candidates": keyed, "states": states, "diagnostics": told, "report": report, "sections": extract.rows_of(scanned, "section"), "citations": extract.used_citations(extract.rows_of(scanned, "citation"), papers)}
