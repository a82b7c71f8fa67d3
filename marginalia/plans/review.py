"""Review as plans: what would change, and why not. A plan is a DataFrame; sinks are apart and write only when told to.

Every operation of the command line has a function here: accept, reject, relate, migrate, status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import pad_end, title_or

ACCEPT_NOTE = "Explicit acceptance of source metadata; manual prose, claim standing, editorial state, and semantic relations retained."
BODY = "\nThe accepted source statement and provenance are recorded below.\n"


def migrate(nodes: DataFrame) -> DataFrame:
    """Legacy columns (status, claimStatus, project) become the three axes and projects; records without them stay as they are."""
    have = set(nodes.columns)
    c = lambda name, kind="string": F.col(name) if name in have else F.lit(None).cast(kind)
    old = F.coalesce(c("claimStatus"), c("status"))
    claim = F.coalesce(c("type").isin(*S.CLAIM_LIKE), F.lit(False))
    standing = F.when(claim, F.when(old == "published", "source-claimed").when(old == "in-progress", "conjectural").otherwise(old))
    editorial = F.when(old.isin("in-progress", "open"), "draft").when(c("provenance") == "background", "reviewed").when(c("provenance") == "research-direction", "draft").otherwise("curated")
    publication = F.when(c("status") == "published", "published").when(F.coalesce(c("arxiv"), F.lit("")) != "", "preprint").otherwise("unpublished")
    blank = lambda x: F.when(x != "", x)
    out = nodes.withColumns({
        "projects": F.coalesce(c("projects", "array<string>"), F.when(c("project").isNotNull(), F.array(c("project")))), "claimStanding": F.coalesce(blank(c("claimStanding")), standing),
        "editorialState": F.coalesce(blank(c("editorialState")), editorial), "publicationStatus": F.coalesce(blank(c("publicationStatus")), publication),
    })
    return out.drop("status", "claimStatus", "project")


def find_proposal(proposals: DataFrame, key: str) -> DataFrame:
    """The proposals that a key or label names; there should be one."""
    return proposals.filter((F.col("source_key") == key) | F.array_contains("labels", key))


def _looked_up(rows: DataFrame, nodes: DataFrame, column: str, found: str, keys: list[str]) -> DataFrame:
    """rows, and in the column `found` the node of the id in a column, if there is one. Rows without an id, which may be most, are dealt out by
    their keys, as all nulls would meet in one task; the condition keeps them from finding anything."""
    known = nodes.select(F.col("id").alias(found)).repartition(found).distinct()
    own = F.coalesce(F.col(column), F.xxhash64(*keys).cast("string"))
    return rows.join(known, (own == F.col(found)) & F.col(column).isNotNull(), "left")


def accept_plan(proposals: DataFrame, sources: DataFrame, ledger: DataFrame, nodes: DataFrame, choice: DataFrame) -> DataFrame:
    """paper, source_key, action, node_id, problem of each chosen proposal.

    proposals: paper, source_key, content_hash, blocked, has_error; sources: node_id, paper, source_key; ledger: paper, source_key, state,
    node_id; nodes: id; choice: paper, source_key, match, new_id, projects. The node is the one that is asked for, or else that of an earlier
    acceptance, or else the one with this very source; a source never moves to another node, and a stable id never changes.
    """
    keys = ["paper", "source_key"]
    own = sources.groupBy(*keys).agg(F.min("node_id").alias("_exact"), F.countDistinct("node_id").alias("_owners"))
    before = ledger.filter("state = 'ACCEPTED'").select(*keys, F.col("node_id").alias("_before"))
    rows = choice.join(proposals.select(*keys, "content_hash", "blocked", "has_error"), keys, "left").join(own, keys, "left").join(before, keys, "left")
    rows = rows.withColumn("_chosen", F.coalesce("match", "_before", "_exact"))
    rows = _looked_up(rows, nodes, "_chosen", "_id", keys)
    rows = _looked_up(rows, nodes, "new_id", "_taken", keys)
    new = F.col("_chosen").isNull()
    problem = (
        F.when(F.col("content_hash").isNull(), "no such proposal")
        .when(F.col("blocked") | F.col("has_error"), "Resolve source errors/ambiguous labels and re-import before acceptance.")
        .when(F.col("_owners") > 1, "Source identity is attached to multiple curated nodes; resolve manually.")
        .when(F.col("_exact").isNotNull() & (F.col("_chosen") != F.col("_exact")), "This source already belongs to another stable node ID.")
        .when(~new & F.col("_id").isNull(), F.concat(F.lit("Unknown curated ID "), "_chosen"))
        .when(~new & F.col("new_id").isNotNull() & (F.col("new_id") != F.col("_chosen")), "Acceptance cannot change an existing stable ID.")
        .when(new & (F.col("new_id").isNull() | (F.coalesce(F.size("projects"), F.lit(0)) <= 0)), "Choose an existing ID, or supply a new ID and its projects. Candidates are suggestions only.")
        .when(new & F.col("_taken").isNotNull(), F.concat(F.lit("Refusing to overwrite "), "new_id"))
        .when(new & ~F.col("new_id").rlike(S.IDENTIFIER), F.concat(F.lit("Malformed ID "), "new_id"))
    )
    action = F.when(problem.isNotNull(), "refuse").when(new, "create").otherwise("update")
    return rows.select(*keys, action.alias("action"), F.when(problem.isNull(), F.coalesce("_chosen", "new_id")).alias("node_id"), problem.alias("problem"))


def new_nodes(plan: DataFrame, proposals: DataFrame, authors: Column, publication: str = "draft") -> DataFrame:
    """The records that a plan creates, with their defaults."""
    rows = plan.filter("action = 'create'").join(proposals, ["paper", "source_key"])
    title = title_or(F.col("title"), F.col("environment"), F.col("latex_label"), F.col("printed_number"), F.col("paper"))
    return rows.select(
        F.col("node_id").alias("id"), title.alias("title"), F.left(title, F.lit(90)).alias("shortTitle"), F.col("proposed_type").alias("type"), F.when(F.col("proposed_type").isin(*S.CLAIM_LIKE), "source-claimed").alias("claimStanding"),
        F.lit("curated").alias("editorialState"), F.lit(publication).alias("publicationStatus"),
        F.concat(F.lit("Statement attributed to the author's "), "environment", F.lit(" source; accepted for provenance, not independently verified.")).alias("summary"), authors.alias("authors"), F.lit("source-backed").alias("provenance"),
        F.concat(F.lower("node_id"), F.lit(".md")).alias("file"), F.lit(BODY).alias("body"),
    )


def upsert_source(sources: Column, new: Column) -> Column:
    """The new source in the place of that with its repository, directory and key, or behind all others."""
    same = lambda s: (s["repository"] == new["repository"]) & (s["paperDirectory"] == new["paperDirectory"]) & (s["sourceKey"] == new["sourceKey"])
    return F.when(F.exists(sources, same), F.transform(sources, lambda s: F.when(same(s), new).otherwise(s))).otherwise(F.array_append(sources, new))


def replaced(nodes: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """The network with some records replaced or added: what a plan is validated against."""
    return nodes.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed, allowMissingColumns=True)


def decisions_of(plan: DataFrame, proposals: DataFrame, commit: Column, at: Column) -> DataFrame:
    """Ledger rows of what a plan accepts."""
    rows = plan.filter("action <> 'refuse'").join(proposals.select("paper", "source_key", "content_hash"), ["paper", "source_key"])
    return rows.select("paper", "source_key", F.lit("ACCEPTED").alias("state"), "content_hash", "node_id", commit.alias("commit"), at.alias("reviewed_at"), F.lit(ACCEPT_NOTE).alias("note"))


def reject_plan(proposals: DataFrame, choice: DataFrame, commit: Column, at: Column) -> DataFrame:
    """Ledger rows of rejections, and the problem of those without a note or a proposal; choice: paper, source_key, note."""
    rows = choice.join(proposals.select("paper", "source_key", "content_hash"), ["paper", "source_key"], "left")
    problem = F.when(F.trim(F.coalesce("note", F.lit(""))) == "", "A note is required for a rejection.").when(F.col("content_hash").isNull(), "no such proposal")
    return rows.select("paper", "source_key", F.lit("REJECTED").alias("state"), "content_hash", commit.alias("commit"), at.alias("reviewed_at"), "note", problem.alias("problem"))


def relate_plan(wanted: DataFrame, ids: DataFrame, relations: DataFrame) -> DataFrame:
    """id, target, type, note, problem of each wanted relation: known type, a note, known ends, no repeat, not to itself."""
    have = relations.select("id", "target", "type").distinct().withColumn("_have", F.lit(True))
    known = ids.select("id").distinct()
    rows = wanted.join(known.withColumns({"_from": F.lit(True)}), "id", "left").join(known.select(F.col("id").alias("target"), F.lit(True).alias("_to")), "target", "left").join(have, ["id", "target", "type"], "left")
    problem = (
        F.when(~F.coalesce(F.col("type").isin(*S.RELATION_TYPES), F.lit(False)) | (F.trim(F.coalesce("note", F.lit(""))) == ""), "Choose a supported type and supply a note.")
        .when(F.col("_from").isNull(), F.concat(F.lit("Unknown node "), "id"))
        .when(F.col("_have"), "Relation already exists.")
        .when(F.col("_to").isNull(), F.concat(F.lit("unknown target "), "target"))
        .when(F.col("id") == F.col("target"), "self relation is not allowed")
    )
    return rows.select("id", "target", "type", "note", problem.alias("problem"))


def status_lines(states: DataFrame, found: DataFrame) -> DataFrame:
    """paper, source_key, line: the padded state, the key, and the candidates with their confidence."""
    named = found.groupBy("paper", "source_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat("cid", F.lit(" ("), F.format_number(F.col("confidence"), 2), F.lit(")")).alias("c")))), lambda x: x["c"]).alias("c"))
    rows = states.join(named, ["paper", "source_key"], "left")
    return rows.select("paper", "source_key", F.concat_ws(" ", pad_end(F.col("review_state"), 19), "source_key", F.array_join("c", ", ")).alias("line"))


def suggested_command(paper: Column, key: Column, first: Column, id: Column) -> Column:
    """How one would accept a proposal: with its first candidate, or under a new id."""
    return F.concat(F.lit("accept "), paper, F.lit(" "), key, F.when(first.isNotNull(), F.concat(F.lit(" --match "), first)).otherwise(F.concat(F.lit(" --id "), id, F.lit(" --projects PROJECT"))))
