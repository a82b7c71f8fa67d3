"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, names and units become typed placeholders, case and punctuation go, and what is left is split into words: the
template. Windows of five template words are hash-joined between documents and benchmark items, and the words of what was joined are
compared. A document holds an item if it has `least` or more of the item's windows and the values that fill the placeholders are consistent:
within one alignment, a value of the item always stands for the same value of the document. So a question with new numbers and names is
caught, and a text that merely shares a frame with inconsistent values is not. Windows with fewer than three literal words don't count, as
they fit anything.

Whether a capitalised word is a name can't be told where a sentence or line begins, nor where case was changed, so a text has two templates:
in one every capitalised word is a name, in the other none is. An item's window is held if either form is; those with too few literal words
in the first don't count. An item without a window that counts is sought by what stands in its text, numbers and names included. An item
under five words is sought in windows of its own length. In scripts without spaces every character is a word.

The item side is small but grows with the benchmark: it is broadcast only while its counted windows are within BROADCAST_WINDOWS, and
joined by a shuffle otherwise; so are the documents and slots to compare.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, spread, table, unused

WINDOW, LEAST, LITERALS = 5, 0.8, 3
BROADCAST_WINDOWS = 200_000
#: Private-use characters as placeholders of number, unit and name, and as the mark of a capitalised word.
NUMBER, UNIT, NAME, CAPITAL = "\ue000", "\ue001", "\ue002", "\ue003"
#: Units of measure that may follow a number.
UNITS = "kg|mg|g|t|km|cm|mm|m|mi|ft|in|l|ml|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|kmh|mph|w|kw|v|a|hz|usd|eur|euros?|dollars?|cents?|pounds?|percent"
SPACE = " \\t\\n\\x0B\\f\\r"
#: Scripts without spaces: Thai and Lao, kana, Han.
DENSE = r"\u0e00-\u0eff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\x{20000}-\x{2fa1f}"
#: Where a capitalised word begins: at the start or after white space, quotes and brackets at its head aside.
BEGIN = r"""(?=\p{Lu})(?<=(?:^|\s)["'`\u00ab\u00bb\u2018-\u201f(\[{<*_#]{0,3})"""


def spaced(text: Column) -> Column:
    """The text without private-use characters of ours, and with spaces around what is a word by itself; ASCII has neither."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(text, f"[{NUMBER}-{CAPITAL}]|([{DENSE}])", " $1 "))


def words(text: Column, drop: str) -> Column:
    return F.array_remove(F.split(F.lower(F.regexp_replace(text, drop, "")), f"[{SPACE}]+"), "")


def marked(text: Column) -> Column:
    """The words of a text with placeholders for numbers and units, those that begin with a capital with CAPITAL before them."""
    c = F.regexp_replace(spaced(text), BEGIN, CAPITAL)
    c = F.regexp_replace(c, r"[0-9]+(?:[.,:/][0-9]+)*", NUMBER)
    c = F.regexp_replace(c, rf"(?i){NUMBER}( ?){CAPITAL}?(?:{UNITS})(?![\p{{L}}{NUMBER}])", f"{NUMBER}$1{UNIT}")
    return words(c, rf"[^\p{{L}}\p{{M}}{NUMBER}-{CAPITAL}{SPACE}]+")


def form(tokens: str | Column, names: bool) -> Column:
    """One of the templates: capitalised words are names, or literal words like all others. The mark is above what most words begin with."""
    kept = (lambda w: F.lit(NAME)) if names else (lambda w: F.substr(w, F.lit(2)))
    return F.transform(tokens, lambda w: F.when(w < CAPITAL, w).when(F.startswith(w, F.lit(CAPITAL)), kept(w)).otherwise(w))


def values(text: Column) -> Column:
    """What stands in the text at each word of its templates."""
    return words(spaced(text), rf"[^\p{{L}}\p{{M}}0-9{SPACE}]+")


#: The templates, and whether capitalised words are names in them.
FORMS = {"_t": True, "_l": False}


def formed(rows: DataFrame, text: Column) -> DataFrame:
    """Adds the two templates and the values."""
    rows = rows.withColumn("_m", marked(text))
    return rows.withColumns({k: form("_m", names) for k, names in FORMS.items()} | {"_v": values(text)}).drop("_m")


def word_hashes(tokens: str | Column, names: bool | None = None) -> Column:
    """XXH64 of each word; of marked words under a template, what `form` makes of them."""
    if names is None:
        return F.transform(tokens, lambda w: F.xxhash64(w))
    kept = (lambda w: F.xxhash64(F.lit(NAME))) if names else (lambda w: F.xxhash64(F.substr(w, F.lit(2))))
    return F.transform(tokens, lambda w: F.when(w < CAPITAL, F.xxhash64(w)).when(F.startswith(w, F.lit(CAPITAL)), kept(w)).otherwise(F.xxhash64(w)))


def window_hashes(hashes: str, size: int = WINDOW) -> Column:
    """Hash of the hashes of every `size` (five) consecutive words; of all words if they are fewer."""
    t = F.col(hashes)
    n = F.size(t)
    many = F.greatest(n - (size - 1), F.least(n, F.lit(1)))
    return F.transform(F.slice(t, F.lit(1), many), lambda w, i: F.xxhash64(w, *(F.get(t, i + j) for j in range(1, size))))


def item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, q, w, h, words, slots (offset and value of each placeholder in the window), n, size, exact.

    w stands for a window, n of which are distinct; h is the hash of its words under one of the templates or, where exact, of what stands
    in the text.
    """
    rows = spread(items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.col(text_col).alias("_text")))
    rows = formed(rows, F.col("_text"))
    rows = rows.withColumns({f"_w{k}": word_hashes(k) for k in (*FORMS, "_v")})
    rows = rows.withColumns({f"_h{k}": window_hashes(f"_w{k}") for k in (*FORMS, "_v")})
    rows = rows.select("item_id", *FORMS, "_v", "_h_l", "_h_v", F.posexplode("_h_t").alias("q", "w"))
    sliced = lambda k: F.slice(k, F.col("q") + 1, F.lit(WINDOW))

    def kind(k: str) -> list[Column]:
        """Hash and words of a window under a template, whether they count, and the slots."""
        literal = F.filter(sliced(k), lambda w: ~w.rlike(f"^[{NUMBER}-{NAME}]+$"))
        slot = lambda w, j: F.struct(F.when(w.rlike(f"[{NUMBER}-{NAME}]"), j).alias("j"), F.get(F.col("_v"), F.col("q") + j).alias("value"))
        slots = F.filter(F.transform(sliced(k), slot), lambda x: x["j"].isNotNull())
        h = F.col("w") if k == "_t" else F.get(f"_h{k}", F.col("q"))
        return [h.alias(f"h{k}"), sliced(k).alias(f"words{k}"), (F.size(literal) >= F.least(F.lit(LITERALS), F.size(sliced(k)))).alias(f"counts{k}"), slots.alias(f"slots{k}")]

    rows = rows.select("item_id", "q", "w", F.least(F.lit(WINDOW), F.size("_t")).alias("size"), *(c for k in FORMS for c in kind(k)), F.get("_h_v", F.col("q")).alias("h_v"), sliced("_v").alias("words_v"))
    rows = cut(rows)
    # an item with windows that count is sought by those alone, as before new numbers its other windows would not be held
    known = rows.groupBy("item_id").agg(F.max("counts_t").alias("_any"), F.countDistinct(F.when(F.col("counts_t"), F.col("w"))).alias("_n"), F.countDistinct("h_v").alias("_n_v"))
    rows = rows.join(known, "item_id")
    common = ["item_id", "q", "size"]
    parts = [
        rows.filter(f"counts_t and counts{k}").select(F.col(f"h{k}").alias("h"), F.col(f"words{k}").alias("words"), F.col(f"slots{k}").alias("slots"), "w", F.col("_n").alias("n"), F.lit(False).alias("exact"), *common)
        for k in FORMS
    ]
    parts.append(rows.filter("not _any").select(F.col("h_v").alias("h"), F.col("words_v").alias("words"), F.slice("slots_t", 1, 0).alias("slots"), F.col("h_v").alias("w"), F.col("_n_v").alias("n"), F.lit(True).alias("exact"), *common))
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["item_id", "q", "h"])


def document_windows(texts: DataFrame, sizes: list[int], exact: bool) -> DataFrame:
    """doc_id, tag, p, h: windows of the sizes under the templates and, where exact, of what stands in the text."""
    rows = texts.withColumn("_m", marked(F.col("_text")))
    rows = rows.withColumns({k: word_hashes("_m", names) for k, names in FORMS.items()} | ({"_v": word_hashes(values(F.col("_text")))} if exact else {}))
    forms = []
    for size in sizes:
        plain = window_hashes("_t", size)
        forms.append(plain)
        for other in ["_l", *(["_v"] if exact else [])]:  # where it differs
            forms.append(F.zip_with(plain, window_hashes(other, size), lambda a, b: F.when(a != b, b)))
    rows = rows.select("doc_id", "tag", F.explode(F.array(*forms)).alias("_h"))
    return rows.select("doc_id", "tag", F.posexplode("_h").alias("p", "h")).filter("h is not null")


def bounded(rows: DataFrame) -> DataFrame:
    """Broadcast up to a counted number of rows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_WINDOWS else rows


KEY = ["doc_id", "tag"]


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, tag, item_id, containment, held: items of which a document has windows, and whether it holds them.

    tag is XXH64 of the text, so that texts of one id are told apart.
    """
    bench = cut(item_windows(items, item_id, item_text))
    sizes = sorted({WINDOW} | {r["size"] for r in bench.select("size").distinct().collect()})
    exact = bool(bench.filter("exact").head(1))
    texts = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("_text"))
    windows = document_windows(spread(texts), sizes, exact)
    # few rows are left from here on: they are written once, and what follows reads no text but that of documents that may hold an item
    hits = cut(windows.join(bounded(bench.select("h", "item_id", "q", "w", "n")), "h"))
    shares = lambda found: found.groupBy(*KEY, "item_id", "w").agg(F.first("n").alias("n")).groupBy(*KEY, "item_id").agg((F.count("*") / F.first("n")).alias("containment"))
    seen = shares(hits)
    likely = cut(hits.join(bounded(cut(seen.filter(F.col("containment") >= least).select(*KEY, "item_id"))), [*KEY, "item_id"], "left_semi"))
    wanted, likely = likely.select(*KEY).distinct(), bounded(likely)
    # words and slots are compared in the texts themselves
    read = formed(texts.join(bounded(cut(wanted)), KEY, "left_semi"), F.col("_text")).drop("_text")
    places = likely.join(bounded(bench.select("h", "item_id", "q", "words", "slots")), ["h", "item_id", "q"])
    same = lambda k: F.slice(k, F.col("p") + 1, F.greatest(F.size("words"), F.lit(1))) == F.col("words")
    checked = cut(read.join(places, KEY).filter(same("_t") | same("_l") | same("_v")).select(*KEY, "item_id", "w", "n", "p", "q", F.transform("slots", lambda s: F.struct((F.col("p") + s["j"]).alias("at"), s["value"].alias("theirs"), F.get("_v", F.col("p") + s["j"]).alias("ours"))).alias("slots")))
    held = shares(checked).filter(F.col("containment") >= least).select(*KEY, "item_id")
    # slots by the diagonal on which document and item run alongside
    slots = checked.select(*KEY, "item_id", (F.col("p") - F.col("q")).alias("diagonal"), F.explode("slots").alias("s")).select(*KEY, "item_id", "diagonal", "s.*").distinct()
    kinds = slots.groupBy(*KEY, "item_id", "diagonal", "theirs").agg((F.min("ours") == F.max("ours")).cast("int").alias("same"))
    lines = kinds.groupBy(*KEY, "item_id", "diagonal").agg(F.avg("same").alias("share"))
    agreed = lines.groupBy(*KEY, "item_id").agg(F.max("share").alias("consistency"))
    held = held.join(agreed, [*KEY, "item_id"], "left").filter(F.coalesce("consistency", F.lit(1.0)) >= least).select(*KEY, "item_id", F.lit(True).alias("held"))
    return seen.join(held, [*KEY, "item_id"], "left").withColumn("held", F.coalesce("held", F.lit(False)))


def flag(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, contaminated, items (sorted ids), containment (the greatest of these, 0 if none), partial (the greatest share of any item's
    windows, held or not) for every row.

    A row without an id or text is never contaminated. Rows that repeat an id are judged each by its own text, repeated rows alike. An item
    without an id or words doesn't count; items of equal text are all named. Either table may be empty. Other columns are not read.
    """
    found = matches(docs, items, id_col, text_col, **options).groupBy(F.col("doc_id").alias("_d"), F.col("tag").alias("_g"))
    found = found.agg(F.sort_array(F.collect_set(F.when(F.col("held"), F.col("item_id")))).alias("items"), F.max(F.when(F.col("held"), F.col("containment"))).alias("containment"), F.max("containment").alias("partial"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tag"))
    rows = rows.join(found, (F.col("doc_id") == F.col("_d")) & (F.col("tag") == F.col("_g")), "left")
    none = F.array().cast(found.schema["items"].dataType)
    return rows.select("doc_id", (F.coalesce(F.size("items"), F.lit(0)) > 0).alias("contaminated"), F.coalesce("items", none).alias("items"), F.coalesce("containment", F.lit(0.0)).alias("containment"), F.coalesce("partial", F.lit(0.0)).alias("partial"))


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no benchmark item, all their columns untouched, whatever their names; rows as `flag` has them."""
    gone_id, gone_tag = unused(docs, "gone_id", "gone_tag")
    found = cut(matches(docs, items, id_col, text_col, **options).filter("held").select(F.col("doc_id").alias(gone_id), F.col("tag").alias(gone_tag)).distinct())
    found = bounded(found)  # whole documents needn't be shuffled then
    return docs.join(found, (docs[id_col] == found[gone_id]) & (F.xxhash64(docs[text_col]) == found[gone_tag]), "left_anti")


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
