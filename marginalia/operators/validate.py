"""Integrity rules as rows (rule, id, detail). Nothing is collected to find them; `raise_on` shows the first in rule order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from .circles import components
from .graph import dangling

#: Rules in the order in which a check reports them.
ORDER = ("duplicate-id", "unknown-target", "self-relation", "cycle", "empty-projects", "duplicate-project", "unknown-project", "unknown-anchor", "schema", "claim-standing", "unknown-about")


class ViolationError(ValueError):
    pass


def rule(df: DataFrame, name: str, id: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(name).alias("rule"), id.alias("id"), detail.alias("detail"))


def duplicate_ids(ids: DataFrame) -> DataFrame:
    # few repeat, so they are shuffled as they are
    n = ids.select("id").repartition("id").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    return rule(n, "duplicate-id", F.col("id"), F.concat(F.col("n").cast("string"), F.lit(" records")))


def network(ids: DataFrame, relations: DataFrame, cycles: bool = True, every: DataFrame | None = None) -> DataFrame:
    """Duplicate ids, unknown targets, self relations and dependency cycles. relations: normalised; every: further ones that aren't yet, as of
    graph.every_relation. What a rule finds among these is normalised, and not all of them."""

    def found_by(rule_of) -> DataFrame:
        own = rule_of(relations).select("id", "target", "type")
        return own if every is None else own.unionByName(rule_of(every).select("id", "target", "type").repartition("id", "target", "type").distinct())

    unknown = found_by(lambda r: dangling(r, ids))
    found = [
        duplicate_ids(ids), rule(unknown, "unknown-target", F.col("id"), F.concat_ws(" ", "type", "target")),
        rule(found_by(lambda r: r.filter("id = target")), "self-relation", F.col("id"), F.col("type")),
    ]
    if cycles:
        depends = lambda r: r.filter("type = 'depends-on'").select("id", "target")
        own = depends(relations) if every is None else depends(relations).unionByName(depends(every))
        found.append(rule(components(own, "id", "target"), "cycle", F.col("id"), F.lit("in a circle of dependencies")))
    return reduce(DataFrame.unionByName, found)


def membership(members: DataFrame, registry: DataFrame) -> DataFrame:
    """members: (id, projects array); registry: (key, anchor)."""
    empty = members.filter(F.coalesce(F.size("projects"), F.lit(0)) <= 0)
    twice = members.filter(F.size(F.array_distinct("projects")) < F.size("projects"))
    each = members.select("id", F.explode(F.array_distinct("projects")).alias("key")).join(registry.select("key"), "key", "left_anti")
    return rule(empty, "empty-projects", F.col("id"), F.lit("at least one project is required")).unionByName(rule(twice, "duplicate-project", F.col("id"), F.lit("duplicate project membership"))).unionByName(rule(each, "unknown-project", F.col("id"), F.col("key")))


def anchors(registry: DataFrame, ids: DataFrame) -> DataFrame:
    return rule(registry.join(ids.select(F.col("id").alias("anchor")).distinct(), "anchor", "left_anti"), "unknown-anchor", F.col("key"), F.col("anchor"))


def claim_standing(nodes: DataFrame, type: str = "type", standing: str = "claimStanding") -> DataFrame:
    claim = F.coalesce(F.col(type).isin(*S.CLAIM_LIKE), F.lit(False))
    wrong = nodes.filter(claim != F.col(standing).isNotNull())
    return rule(wrong, "claim-standing", F.col("id"), F.when(F.col(standing).isNull(), "Claim-like records require claimStanding").otherwise("Non-claim records must omit claimStanding"))


def unknown_about(about: DataFrame, ids: DataFrame) -> DataFrame:
    """A warning: the graph drops such targets, but a node's page would follow them."""
    return rule(about.join(ids.select(F.col("id").alias("target")).distinct(), "target", "left_anti"), "unknown-about", F.col("id"), F.col("target"))


def _all(name: str, pattern: str) -> Column:
    return F.forall(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x: x.rlike(pattern))


def schema_checks() -> dict[str, Column]:
    """What must hold for a node record, by the name of the field."""
    c = F.col
    text = lambda x: F.coalesce(F.length(x) > 0, F.lit(False))
    among = lambda x, of: F.coalesce(x.isin(*of), F.lit(False))
    return {
        "id": F.coalesce(c("id").rlike(S.IDENTIFIER), F.lit(False)), "title": text(c("title")), "shortTitle": text(c("shortTitle")), "summary": text(c("summary")),
        "type": among(c("type"), S.NODE_TYPES), "claimStanding": c("claimStanding").isNull() | c("claimStanding").isin(*S.STANDINGS), "editorialState": among(c("editorialState"), S.EDITORIAL),
        "publicationStatus": among(c("publicationStatus"), S.PUBLICATION), "date": c("date").isNull() | (c("date").rlike(r"^\d{4}-\d\d-\d\d\z") & F.expr("try_cast(date AS DATE)").isNotNull()),
        "projects": (F.coalesce(F.size("projects"), F.lit(0)) > 0) & _all("projects", S.PROJECT_KEY), "about": _all("about", S.IDENTIFIER), "dependsOn": _all("dependsOn", S.IDENTIFIER),
        "arxiv": c("arxiv").isNull() | c("arxiv").rlike(S.ARXIV),
        "relations": F.forall(F.coalesce(c("relations"), F.array().cast(S.NODE["relations"].dataType)), lambda r: r["target"].rlike(S.IDENTIFIER) & r["type"].isin(*S.RELATION_TYPES)),
        "references": F.forall(F.coalesce(c("references"), F.array().cast(S.NODE["references"].dataType)), lambda r: r["title"].isNotNull() & (r["url"].isNull() | r["url"].rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+\z"))),
        "verification": among(c("verification.method"), S.METHODS) & text(c("verification.note")), "provenance": among(c("provenance"), S.PROVENANCE),
        "timeline": c("timeline").isNull() | F.coalesce(c("timeline.stage").between(0, 4) & c("timeline.note").isNotNull(), F.lit(False)),
        "sources": F.forall(F.coalesce(c("sources"), F.array().cast(S.NODE["sources"].dataType)), lambda s: (s["kind"] == "github-latex") & s["repository"].rlike(S.REPOSITORY) & s["commit"].rlike(S.COMMIT) & (F.length(s["path"]) > 0)),
    }


def schema(nodes: DataFrame) -> DataFrame:
    """A row for each field of a record that breaks its rule: one projection and an explode, whatever the number of rules."""
    broken = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in schema_checks().items()))
    return rule(nodes.select("id", F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("field")), "schema", F.col("id"), F.col("field"))


def raise_on(violations: DataFrame) -> None:
    """Raises for the first violation in rule order, if there is one; a single row comes to the driver."""
    rank = F.coalesce(F.array_position(F.array(*(F.lit(r) for r in ORDER)), F.col("rule")), F.lit(99))
    worst = violations.orderBy(rank, "id", "detail").limit(1).collect()
    if worst:
        raise ViolationError(f"{worst[0]['id']}: {worst[0]['rule']}: {worst[0]['detail']}")
