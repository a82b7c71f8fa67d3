"""Successive imports of a paper: differences, candidate matches, review states, and the report.

proposals: source_key, content_hash, title, printed_number, section, subsection, source_file, start_line, blocked, warnings and whatever else
passes through; keyed by `keys` (a paper and its source_key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import arxiv_base, round_half_up
from ..sources.files import cut

PRESENTATION = ("title", "printed_number", "section", "subsection", "source_file", "start_line")
TOP = 5
#: Weights and thresholds of a fuzzy match.
W_ARXIV_PAPER, W_ARXIV, W_TITLE, W_BODY, W_TAGS, W_TYPE = 0.8, 0.16, 0.45, 0.22, 0.08, 0.05
LEAST_SCORE, LEAST_TITLE, SHOW_BODY, SHOW_TAGS, MOST = 0.46, 0.4, 0.35, 0.5, 0.94
#: Curated records up to this number are broadcast; beyond, the tokens are joined by a shuffle.
BROADCAST_RECORDS = 20_000
#: Parts of the proposals by which a word's join is dealt out beyond that.
SALTS = 16


def compare(previous: DataFrame, current: DataFrame, keys: list[str], presentation: tuple[str, ...] = PRESENTATION) -> DataFrame:
    """keys, class (new, changed, unchanged, removed), presentation_changed. One full outer join; null-safe comparisons."""
    pick = lambda df, side: df.select(*keys, F.lit(True).alias(f"_{side}"), F.col("content_hash").alias(f"{side}_hash"), F.struct(*presentation).alias(f"{side}_shown"))
    both = pick(previous, "old").join(pick(current, "new"), keys, "full_outer")
    same = F.col("old_hash").eqNullSafe(F.col("new_hash"))
    kind = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return both.select(*keys, kind.alias("class"), ((kind == "unchanged") & ~F.col("old_shown").eqNullSafe(F.col("new_shown"))).alias("presentation_changed"))


def exact_matches(proposals: DataFrame, sources: DataFrame) -> DataFrame:
    """pid, cid: an accepted source with the repository, directory, and the source key or label. Two equi joins, made one by distinct."""
    at = ["repository", "directory"]
    by_key = proposals.select("pid", *at, "source_key").join(sources.select("cid", *at, "source_key"), [*at, "source_key"])
    by_label = proposals.filter("latex_label IS NOT NULL").select("pid", *at, F.col("latex_label").alias("label")).join(sources.select("cid", *at, "label"), [*at, "label"])
    return by_key.select("pid", "cid").unionByName(by_label.select("pid", "cid")).distinct()


def reasons(arxiv: Column, t: Column, b: Column, g: Column, same_type: Column) -> Column:
    percent = lambda x: F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%."))
    said = F.array(
        F.when(arxiv, F.lit("Same arXiv identifier (paper context only).")), F.when(t >= LEAST_TITLE, F.concat(F.lit("Title/statement token overlap "), percent(t))),
        F.when(b >= SHOW_BODY, F.concat(F.lit("Curated exposition/source token overlap "), percent(b))), F.when(g >= SHOW_TAGS, F.lit("Shared subject tags.")), F.when(same_type, F.lit("Same proposed object type.")),
    )
    return F.array_compact(said)


KINDS = (("title", W_TITLE), ("body", W_BODY), ("tag", W_TAGS))
#: Of a record's words, the most frequent ones whose weights together stay under this share of what a score must get from words aren't joined.
#: 1 joins the fewest; below, more is known of a pair before it is verified.
SHARE = 0.6


def vocabulary(curated: DataFrame) -> DataFrame:
    """word, w: a number for each word of the curated records."""
    every = F.flatten(F.array(*(F.col(f"{k}_words") for k, _ in KINDS)))
    return cut(curated.select(F.explode(every).alias("word")).distinct().withColumn("w", F.monotonically_increasing_id()))


def numbered_words(proposals: DataFrame, words: DataFrame, few: bool) -> DataFrame:
    """pid, is_paper, ptype, parxiv, pn (all its words), ws (the numbers of those that the records have too): texts are read here and nowhere else."""
    own = proposals.select("pid", "is_paper", "ptype", "parxiv", F.size("words").alias("pn"), F.explode("words").alias("word"))
    met = own.join(F.broadcast(words) if few else words, "word")
    return cut(met.groupBy("pid", "is_paper", "ptype", "parxiv", "pn").agg(F.collect_list("w").alias("ws")))


def numbered_records(curated: DataFrame, words: DataFrame) -> DataFrame:
    """The records, with sorted numbers in place of words."""
    out = curated.select("cid", "ctype", "is_paper", "carxiv")
    for k, _ in KINDS:
        own = curated.select("cid", "is_paper", F.explode(f"{k}_words").alias("word")).join(words, "word").groupBy("cid", "is_paper").agg(F.array_sort(F.collect_list("w")).alias(k))
        out = out.join(own, ["cid", "is_paper"], "left").withColumn(k, F.coalesce(k, F.array().cast("array<bigint>")))
    return cut(out)


def postings(known: DataFrame, asked: DataFrame) -> DataFrame:
    """cid, is_paper, ctype, number, w, sizes (of the title, body and tags), largest, `title`, `body`, `tag` (whether the word is in it, as 0 or 1), and
    for a pair without and with the same number: rare_n, whether the word is joined, and rest_n, how many of each kind aren't.

    Words are ordered by how many proposals have them, the rarest first. A record's last words, whose weights don't make up what a score needs
    from words, can be left out: a pair that shares none of the others scores too little.
    """
    frequent = asked.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    sizes = F.struct(*(F.size(k).alias(k) for k, _ in KINDS))
    every = known.select("cid", "is_paper", "ctype", arxiv_base(F.col("carxiv")).alias("number"), sizes.alias("sizes"), *(k for k, _ in KINDS), F.explode(F.array_union(F.array_union("title", "body"), "tag")).alias("w"))
    every = every.withColumns({k: F.array_contains(k, F.col("w")).cast("int") for k, _ in KINDS})
    weight = sum(F.col(k) * (weight / F.greatest(F.lit(1), F.col(f"sizes.{k}"))) for k, weight in KINDS)
    every = every.join(frequent, "w").withColumn("weight", weight)  # a word of no proposal joins nothing
    tail = Window.partitionBy("cid", "is_paper").orderBy(F.desc("df"), F.desc("w")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("cid", "is_paper")
    every = every.withColumn("upto", F.sum("weight").over(tail)).withColumn("largest", F.greatest(*(F.col(f"sizes.{k}") for k, _ in KINDS)))
    for n, given in enumerate((0.0, W_ARXIV)):
        rare = F.col("upto") >= SHARE * (LEAST_SCORE - W_TYPE - given) - 1e-9
        every = every.withColumn(f"rare_{n}", rare).withColumn(f"rest_{n}", F.struct(*(F.sum(F.when(~F.col(f"rare_{n}"), F.col(k)).otherwise(0)).over(whole).cast("int").alias(k) for k, _ in KINDS)))
    return cut(every.drop("weight", "upto", "df"))


def met_pairs(asked: DataFrame, known: DataFrame, few: bool) -> DataFrame:
    """pid, cid of the pairs that may score enough: a weighted prefix filter.

    Rare words of a record are joined with all proposals; its other words only with proposals that have fewer words than the record's
    largest set, for which words weigh more. What a pair shares of the joined words, and all that the others could add, must make up
    the score, and the title's overlap where the numbers differ. With the same number fewer words are needed, and the number is joined too.
    Where there are too many records to broadcast, words are dealt out by SALTS parts of the proposals, so that a word in a third of
    them isn't one task's.
    """
    of = postings(known, asked)
    largest = of.agg(F.max("largest")).first()[0] or 0
    words = asked.select("pid", "is_paper", "ptype", F.col("parxiv").alias("number"), "pn", F.explode("ws").alias("w"))
    pairs = None
    for n, keys in enumerate((["w", "is_paper"], ["w", "is_paper", "number"])):
        own = of.filter("number IS NOT NULL") if n else of.withColumnRenamed("number", "cnumber")
        left, on = words, keys
        if not few:
            own, left, on = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), words.withColumn("part", F.pmod(F.xxhash64("pid"), F.lit(SALTS)).cast("int")), [*keys, "part"]
        side = lambda rows: F.broadcast(rows) if few else rows
        rare = left.join(side(own.filter(f"rare_{n}")), on)
        others = left.filter(F.col("pn") < largest).join(side(own.filter(f"NOT rare_{n}")), on).filter("pn < largest")
        met = rare.unionByName(others.select(*rare.columns))
        equal = F.lit(True) if n else F.coalesce(F.col("number") == F.col("cnumber"), F.lit(False))
        met = met.groupBy("pid", "cid").agg(*(F.sum(k).alias(k) for k, _ in KINDS), F.first(F.struct("pn", "sizes", "largest", F.col(f"rest_{n}").alias("rest"), "is_paper", equal.alias("equal"), F.coalesce(F.col("ptype") == F.col("ctype"), F.lit(False)).alias("same"))).alias("of"))
        most = {k: F.least(F.lit(1.0), (F.col(k) + F.when(F.col("of.pn") < F.col("of.largest"), 0).otherwise(F.col(f"of.rest.{k}"))) / F.greatest(F.lit(1), F.least(F.col(f"of.sizes.{k}"), F.col("of.pn")))) for k, _ in KINDS}
        score = sum(weight * most[k] for k, weight in KINDS) + F.when(F.col("of.same"), W_TYPE).otherwise(0.0) + F.when(F.col("of.equal"), F.when(F.col("of.is_paper"), W_ARXIV_PAPER).otherwise(W_ARXIV)).otherwise(0.0)
        met = met.filter((score >= LEAST_SCORE - 1e-9) & (F.col("of.equal") | (most["title"] >= LEAST_TITLE - 1e-9))).select("pid", "cid")
        pairs = met if pairs is None else pairs.unionByName(met)
    return pairs.distinct()


def fuzzy_matches(proposals: DataFrame, curated: DataFrame) -> DataFrame:
    """pid, cid, confidence, reasons of every pair that scores enough.

    proposals: pid, words, ptype, is_paper, parxiv; curated: cid, title_words, body_words, tag_words, ctype, is_paper, carxiv.
    A pair counts only with the same arXiv number or a title overlap of LEAST_TITLE. Words become numbers once; pairs that may score enough
    are sought by them (`met_pairs`) and scored on the numbers, which stand for the words one to one.
    """
    few = curated.count() <= BROADCAST_RECORDS
    words = vocabulary(curated)
    asked, known = numbered_words(proposals, words, few), numbered_records(curated, words)
    # papers score enough by the number alone
    numbers = known.filter("is_paper AND carxiv IS NOT NULL").select("cid", arxiv_base(F.col("carxiv")).alias("parxiv"))
    alike = proposals.filter("is_paper AND parxiv IS NOT NULL").select("pid", "parxiv").join(F.broadcast(numbers) if few else numbers, "parxiv").select("pid", "cid")
    pairs = cut(met_pairs(asked, known, few).unionByName(alike).distinct())
    small = known.drop("is_paper")
    left = asked.unionByName(proposals.filter("is_paper AND parxiv IS NOT NULL").select("pid", "is_paper", "ptype", "parxiv", F.size("words").alias("pn"), F.array().cast("array<bigint>").alias("ws")).join(asked.select("pid"), "pid", "left_anti"))
    full = left.join(pairs, "pid").join(F.broadcast(small) if few else small, "cid")
    t, b, g = (F.size(F.array_intersect(k, "ws")) / F.greatest(F.lit(1), F.least(F.size(k), F.col("pn"))) for k, _ in KINDS)
    full = full.withColumns({"t": t, "b": b, "g": g, "arxiv": F.coalesce(F.col("parxiv") == arxiv_base(F.col("carxiv")), F.lit(False)), "same": F.coalesce(F.col("ptype") == F.col("ctype"), F.lit(False))})
    number = F.when(F.col("arxiv"), F.when(F.col("is_paper"), W_ARXIV_PAPER).otherwise(W_ARXIV)).otherwise(0.0)
    score = number + (F.col("t") * W_TITLE + F.col("b") * W_BODY + F.col("g") * W_TAGS) + F.when(F.col("same"), W_TYPE).otherwise(0.0)
    kept = full.withColumn("score", score).filter((F.col("score") >= LEAST_SCORE) & (F.col("arxiv") | (F.col("t") >= LEAST_TITLE)))
    return kept.select("pid", "cid", F.least(F.lit(MOST), round_half_up(F.col("score"), 2)).alias("confidence"), reasons(F.col("arxiv"), F.col("t"), F.col("b"), F.col("g"), F.col("same")).alias("reasons"))


def candidates(proposals: DataFrame, curated: DataFrame, exact: DataFrame | None = None, top: int = TOP) -> DataFrame:
    """pid, cid, confidence, reasons, exact, rank: the best matches of each proposal, ties by id. An exact match of a pair replaces its score."""
    found = fuzzy_matches(proposals, curated).withColumn("exact", F.lit(False))
    if exact is not None:
        sure = exact.select("pid", "cid", F.lit(1.0).alias("confidence"), F.array(F.lit("Exact accepted source key or LaTeX label in this repository and paper directory.")).alias("reasons"), F.lit(True).alias("exact"))
        found = found.join(exact, ["pid", "cid"], "left_anti").unionByName(sure)
    rank = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("confidence"), "cid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top)


def review_state(error: Column, blocked: Column, decision_hash: Column, decision_state: Column, content_hash: Column, changed: Column, exact: Column, any_candidate: Column, warned: Column) -> Column:
    """The cascade: source errors come before all, even before an earlier acceptance."""
    return (
        F.when(F.coalesce(error, F.lit(False)) | F.coalesce(blocked, F.lit(False)), "NEEDS REVIEW")
        .when(decision_hash == content_hash, decision_state)
        .when(decision_hash.isNotNull() | F.coalesce(changed, F.lit(False)), "CHANGED")
        .when(F.coalesce(exact, F.lit(False)), "MATCHED")
        .when(F.coalesce(any_candidate, F.lit(False)), "POSSIBLE DUPLICATE")
        .when(F.coalesce(warned, F.lit(False)), "NEEDS REVIEW")
        .otherwise("NEW")
    )


def review(proposals: DataFrame, keys: list[str], ledger: DataFrame, diff: DataFrame, found: DataFrame, diagnostics: DataFrame | None = None, previous: DataFrame | None = None) -> DataFrame:
    """keys, review_state of every proposal.

    ledger: keys, state, content_hash (of the decision); diff: of compare; found: keys, exact (of candidates); diagnostics: paper key,
    severity; previous: keys, review_state of the import before, whose CHANGED stays until someone decides.
    """
    rows = proposals.select(*keys, "content_hash", "blocked", (F.coalesce(F.size("warnings"), F.lit(0)) > 0).alias("_warned"))
    rows = rows.join(ledger.select(*keys, F.col("state").alias("_state"), F.col("content_hash").alias("_hash")), keys, "left")
    rows = rows.join(diff.select(*keys, (F.col("class") == "changed").alias("_now")), keys, "left")
    rows = rows.join(found.groupBy(*keys).agg(F.bool_or("exact").alias("_exact"), F.lit(True).alias("_any")), keys, "left")
    before = F.lit(False)
    if previous is not None:
        rows = rows.join(previous.filter("review_state = 'CHANGED'").select(*keys).distinct().withColumn("_sticky", F.lit(True)), keys, "left")
        before = F.coalesce("_sticky", F.lit(False))
    error = F.lit(False)
    if diagnostics is not None:
        bad = diagnostics.filter("severity = 'error'").select(keys[0]).distinct().withColumn("_error", F.lit(True))
        rows = rows.join(bad, keys[0], "left")
        error = F.col("_error")
    state = review_state(error, F.col("blocked"), F.col("_hash"), F.col("_state"), F.col("content_hash"), F.coalesce("_now", F.lit(False)) | before, F.col("_exact"), F.col("_any"), F.col("_warned"))
    return rows.select(*keys, state.alias("review_state"))


def ledger_latest(decisions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last decision for each key: a combined maximum, so a key with many decisions is one row from each task."""
    rest = [c for c in decisions.columns if c not in (*keys, *order)]
    last = decisions.groupBy(*keys).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("last"))
    return last.select(*keys, "last.*")


def source_changed(previous: Column, current: Column) -> Column:
    return ~previous.eqNullSafe(current)


def changed_papers(previous: DataFrame, current: DataFrame) -> DataFrame:
    """paper, source_changed: whether the files (paper, files: path, sha256 and bytes of each) differ from those of the import before."""
    both = current.select("paper", F.col("files").alias("_now")).join(previous.select("paper", F.col("files").alias("_old")), "paper", "left")
    return both.select("paper", source_changed(F.col("_old"), F.col("_now")).alias("source_changed"))


def report(diff: DataFrame, proposals: DataFrame, found: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """metric, value rows: differences by class, objects by environment, objects with candidates, candidate pairs; with changed (of
    changed_papers), the papers whose files changed."""
    row = lambda df, name: df.select(name.alias("metric"), F.col("value").cast("long").alias("value"))
    parts = [
        row(diff.groupBy("class").agg(F.count("*").alias("value")), F.concat(F.lit("diff:"), "class")), row(diff.agg(F.count_if("presentation_changed").alias("value")), F.lit("diff:presentationChanged")),
        row(proposals.groupBy("environment").agg(F.count("*").alias("value")), F.concat(F.lit("environment:"), "environment")), row(proposals.agg(F.count("*").alias("value")), F.lit("objects")),
        row(found.agg(F.countDistinct("pid").alias("value")), F.lit("objectsWithCandidates")), row(found.agg(F.count("*").alias("value")), F.lit("candidatePairs")),
    ]
    if changed is not None:
        parts.append(row(changed.agg(F.count_if("source_changed").alias("value")), F.lit("sourceChanged")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
