"""Source fragments, their present state, and attestations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import first_line, line_count
from .validate import rule

LOCATOR = "source locator or presentation metadata changed"


def resolve_selections(selections: Column, statement: Column, file: Column, start: Column) -> Column:
    """Each pinned selection as it stands now: the first place where its text occurs, lines counted from the statement's first.

    Lines are approximate where the statement was trimmed, as the environment's own first line counts as line one.
    """

    def one(s: Column) -> Column:
        at = first_line(statement, s["selectedText"])
        first = start + at
        return F.struct(
            F.when(at.isNotNull(), file).alias("file"), first.cast("int").alias("startLine"), (first + line_count(s["selectedText"]) - 1).cast("int").alias("endLine"),
            F.when(at.isNotNull(), s["selectedText"]).alias("selectedText"), F.when(at.isNotNull(), F.sha2(s["selectedText"], 256)).alias("contentHash"), at.isNotNull().alias("matched"),
        )

    return F.transform(selections, one)


def selection_changed(pinned: Column, current: Column) -> Column:
    return ~F.coalesce(current["matched"], F.lit(False)) | ~pinned["selectedText"].eqNullSafe(current["selectedText"]) | ~pinned["contentHash"].eqNullSafe(current["contentHash"])


def locator_changed(pinned: Column, current: Column) -> Column:
    moved = [~pinned[f].eqNullSafe(current[f]) for f in ("file", "startLine", "endLine")]
    return F.coalesce(current["matched"], F.lit(False)) & (moved[0] | moved[1] | moved[2])


def any_pair(pinned: Column, current: Column, test) -> Column:
    return F.exists(F.arrays_zip(pinned.alias("p"), current.alias("c")), lambda z: test(z["p"], z["c"]))


def snapshots(fragments: DataFrame, objects: DataFrame) -> DataFrame:
    """fragments with `now`, the present state of their environment; null if the source is missing.

    objects: paperDirectory, repository, branch, commit, paperTitle, pos, sourceKey, latexLabel, environment, printedNumber, title, sourceFile,
    startLine, statement, section. Of the objects whose source key or label is the fragment's, the first counts.
    """
    names = objects.select("*", F.explode(F.array_compact(F.array_distinct(F.array("sourceKey", "latexLabel")))).alias("_name"))
    first = names.groupBy(F.col("paperDirectory").alias("_dir"), "_name").agg(F.min_by(F.struct(*objects.columns), "pos").alias("o"))
    f = fragments.join(first, (F.col("source.paperDirectory") == F.col("_dir")) & (F.col("context.sourceKey") == F.col("_name")), "left")
    key = F.col("context.sourceKey")
    now = F.struct(
        F.struct("o.repository", "o.branch", "o.commit", F.col("o.sourceFile").alias("file"), "o.paperDirectory").alias("source"),
        F.struct(F.coalesce("o.latexLabel", key).alias("latexLabel"), "o.environment", "o.printedNumber").alias("container"),
        resolve_selections(F.col("assertionSelections"), F.col("o.statement"), F.col("o.sourceFile"), F.col("o.startLine")).alias("assertionSelections"),
        resolve_selections(F.col("contextSelections"), F.col("o.statement"), F.col("o.sourceFile"), F.col("o.startLine")).alias("contextSelections"),
        F.struct("o.sourceKey", F.coalesce("o.title", "o.latexLabel", key).alias("title"), "o.paperTitle", "o.section").alias("context"),
    )
    return f.withColumn("now", F.when(F.col("o").isNotNull(), now)).drop("_dir", "_name", "o")


#: The fields by which a fragment is found again.
LOCATED = (
    "source.repository", "source.branch", "source.commit", "source.file", "source.paperDirectory", "container.latexLabel", "container.environment", "container.printedNumber", "context.sourceKey", "context.title",
    "context.paperTitle", "context.section",
)


def inspect(fragments: DataFrame) -> DataFrame:
    """Adds state, locatorState, assertionState, contextState and reasons to fragments with `now`."""
    missing = F.col("now").isNull()
    moved = F.lit(False)
    for f in LOCATED:
        moved = moved | ~F.col(f).eqNullSafe(F.col(f"now.{f}"))
    pairs = [(F.col(k), F.col(f"now.{k}")) for k in ("assertionSelections", "contextSelections")]
    for pinned, now in pairs:
        moved = moved | any_pair(pinned, now, locator_changed)
    asserted, context = (any_pair(p, n, selection_changed) for p, n in pairs)
    shown = lambda x: F.when(x, "changed").otherwise("current")
    state = F.when(missing, "source-missing").when(asserted, "assertion-changed").when(context, "context-changed").when(moved, "locator-changed").otherwise("current")
    reasons = F.array_compact(F.array(F.when(moved, LOCATOR), F.when(asserted, "assertion selection changed"), F.when(context, "context selection changed")))
    return fragments.withColumns({
        "state": state, "locatorState": shown(missing | moved), "assertionState": shown(missing | asserted), "contextState": F.when(missing, shown(F.size("contextSelections") > 0)).otherwise(shown(context)),
        "reasons": F.when(missing, F.array(F.lit("source environment is missing from the imported paper"))).otherwise(reasons),
    })


def semantic_review(state: Column, assertion: Column, context: Column) -> Column:
    """A rejection sticks; an acceptance holds only while assertion and context are current."""
    return F.when(state == "rejected", "rejected").when((state == "accepted") & (assertion == "current") & (context == "current"), "accepted").otherwise("needs-review")


def evaluate(attestations: DataFrame, inspected: DataFrame) -> DataFrame:
    """attestations with semanticReview and the four states of their fragment."""
    f = inspected.select(F.col("id").alias("_f"), "state", "locatorState", "assertionState", "contextState", "reasons")
    both = attestations.join(f, attestations["fragment"] == F.col("_f")).drop("_f")
    return both.withColumn("semanticReview", semantic_review(F.col("review.state"), F.col("assertionState"), F.col("contextState")))


def state_label(c: Column) -> Column:
    return F.when(c == "changed", "moved / renumbered").otherwise(c)


def assertion_range(selections: Column) -> tuple[Column, Column]:
    """First line of the first selection, last line of the last."""
    return F.get(selections, 0)["startLine"], F.element_at(selections, -1)["endLine"]


def violations(nodes: DataFrame, fragments: DataFrame, attestations: DataFrame) -> DataFrame:
    """Repeated ids, unknown fragments and targets, targets that are no claims, empty assertions, and formats."""
    twice = lambda df, name: rule(df.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), f"duplicate-{name}", F.col("id"), F.col("n").cast("string"))
    targets = attestations.select("id", "target").join(nodes.select(F.col("id").alias("target"), F.col("type").alias("_type")), "target", "left")
    bad_f = fragments.filter(~F.coalesce(F.col("id").rlike(r"^FRAG-[A-Z0-9-]+\z") & (F.col("kind") == "source-fragment") & F.col("source.repository").rlike(S.REPOSITORY) & F.col("source.commit").rlike(S.COMMIT), F.lit(False)))
    bad_a = attestations.filter(~F.coalesce(F.col("id").rlike(r"^ATT-[A-Z0-9-]+\z") & (F.col("relation") == "asserts") & F.col("review.state").isin("accepted", "needs-review", "rejected") & F.col("review.sourceCommit").rlike(S.COMMIT) & (F.length("review.note") > 0), F.lit(False)))
    digests = fragments.filter(F.exists("assertionSelections", lambda s: ~F.coalesce(s["contentHash"].rlike(S.DIGEST) & (s["startLine"] > 0) & (s["endLine"] > 0) & (F.length(s["selectedText"]) > 0), F.lit(False))))
    out = [
        twice(fragments, "fragment"), twice(attestations, "attestation"), rule(fragments.filter(F.coalesce(F.size("assertionSelections"), F.lit(0)) <= 0), "empty-assertion", F.col("id"), F.lit("assertion selection is empty")),
        rule(attestations.join(fragments.select(F.col("id").alias("fragment")).distinct(), "fragment", "left_anti"), "unknown-fragment", F.col("id"), F.col("fragment")),
        rule(targets.filter("_type IS NULL"), "unknown-claim", F.col("id"), F.col("target")), rule(targets.filter("_type <> 'claim'"), "target-not-claim", F.col("id"), F.col("target")),
        rule(bad_f, "fragment-format", F.col("id"), F.lit("fragment")), rule(bad_a, "attestation-format", F.col("id"), F.lit("attestation")), rule(digests, "selection-format", F.col("id"), F.lit("selection")),
    ]
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def merge_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first, last: ranges of lines that overlap or adjoin, made one. The running maximum of ends shows where a gap is. Ranges that lack an end
    come last."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("first"), F.asc_nulls_last("last"))
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach.isNull() | (F.col("first") > reach + 1), 1).otherwise(0)).over(w)
    return spans.withColumn("_reach", reach).withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_island")
