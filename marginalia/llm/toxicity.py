"""Toxicity: gradient-boosted trees over dense features of whole texts, calibrated by isotonic regression.

Features: densities of two lexicons (a fixed list of insults, and words and word beginnings that the labelled rows show to be toxic),
lexicon hits near a second person, shares of capitals and punctuation, obfuscated words, and length. Scoring is one pass in Arrow batches
without a shuffle. Training takes at most `max_labelled` rows, the only thing that is bounded; which rows is decided by a hash of the id, so
it is the same on every run. Their texts stay on the executors, which count the words and compute the features.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, spread, table, tidy

#: The most labelled rows that training takes.
MAX_LABELLED = 10_000
#: Lengths of the word beginnings that may enter the learnt lexicon.
STEMS = (4, 5, 6)
#: A word or beginning enters the lexicon from so many toxic documents on, at this log-odds.
LEAST_DOCS, LEAST_ODDS = 4, 2.5
#: Labelled rows from which on lexicon, trees and calibration learn from rows of their own.
SPLIT_FROM = 200
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 32
NEAR = 6
#: Insults, and second-person words of the languages at hand.
INSULTS = "idiot moron stupid dumb loser scum trash garbage clown pathetic worthless disgusting filthy vermin ugly imbecile fool jerk creep freak degenerate coward liar parasite hate kill die shut".split()
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros".split())
#: Signs that stand for letters in obfuscated words.
LEET = str.maketrans("013457@$!", "oieastasi")

WORD = re.compile(r"[^\W_]+(?:[@$!*0-9][^\W_]+)*")
MIXED = re.compile(r"[^\W\d_][0-9@$!*]+[^\W\d_]")
NAMES = ("insult_density", "insult_any", "learnt_density", "learnt_any", "learnt_strength", "strongest", "near_second", "second_density", "capitals", "shouted", "punctuation", "marks", "obfuscated", "digits", "log_words", "hits")


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def marks_of(word: str) -> set[str]:
    return {word} | {word[:n] + "-" for n in STEMS if len(word) > n}


def plain(word: str) -> str:
    return word.translate(LEET) if MIXED.search(word) else word


@dataclass
class Lexicon:
    odds: dict[str, float] = field(default_factory=dict)
    known: dict[str, float] = field(default_factory=dict, compare=False)

    def strength(self, word: str) -> float:
        """The highest log-odds of a word and its beginnings; 0 if none is listed."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            clear = plain(word)
            found = self.known[word] = max(self.odds.get(m, 0.0) for m in marks_of(clear) | {clear})
        return found


def marked(text: str) -> set[str]:
    return {m for w in set(words_of(text)) for m in marks_of(plain(w))}


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Words and beginnings that toxic documents of rows (y, text) hold far more often than others.

    Counted by mark over all executors; what comes to the driver are the marks that enter the lexicon.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = sorted(marked(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([y] * len(found), pa.int32())], ["mark", "y"])

    n_toxic, n = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    counts = rows.select("y", "text").mapInArrow(tidy(run), "mark string, y int").groupBy("mark").agg(F.sum("y").alias("toxic"), F.count("*").alias("all"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("all") - F.col("toxic") + 0.5) / (n - n_toxic + 1))
    best = counts.filter(F.col("toxic") >= LEAST_DOCS).select("mark", odds.alias("odds")).filter(F.col("odds") >= LEAST_ODDS)
    return Lexicon({r["mark"]: r["odds"] for r in best.collect()})


def features(text: str, lexicon: Lexicon, insults: frozenset[str] = frozenset(INSULTS)) -> list[float]:
    """Dense features of one whole text; an empty text has zeros."""
    words = words_of(text)
    n, chars = max(1, len(words)), max(1, len(text))
    known, strength = lexicon.known, lexicon.strength
    hit_at, strongest, total, n_insults, n_second, mixed = [], 0.0, 0.0, 0, 0, 0
    for i, w in enumerate(words):
        s = known.get(w)
        if s is None:
            s = strength(w)
        if s:
            hit_at.append(i)
            total += s
            strongest = max(strongest, s)
    counts = Counter(words)
    for w, c in counts.items():
        if w in insults:
            n_insults += c
        if w in SECOND:
            n_second += c
        if not w.isalpha() and MIXED.search(w):
            mixed += c
            if w.translate(LEET) in insults:
                n_insults += c
    near = sum(1 for i in hit_at if not SECOND.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]))
    capitals = sum(map(str.isupper, text))
    shouted = sum(1 for w in text.split() if len(w) > 2 and w.isupper())
    marks = text.count("!") + text.count("?")
    signs = sum(map(text.count, ".,;:!?*#$%&\"'"))
    digits = sum(map(text.count, "0123456789"))
    return [n_insults / n, float(n_insults > 0), len(hit_at) / n, float(bool(hit_at)), total / n, strongest, near / n, n_second / n, capitals / chars, shouted / n, signs / chars, marks / chars, mixed / n, digits / chars, float(np.log1p(len(words))), float(np.log1p(len(hit_at)))]


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, bins: int = BINS) -> list[tuple[int, int, float]]:
    """A complete binary tree of the depth over binned features: (feature, last bin to the left, value) in heap order."""
    nodes: list[tuple[int, int, float]] = [(-1, 0, 0.0)] * (2 ** (depth + 1) - 1)
    rows = {0: np.arange(len(x))}
    for k in range(len(nodes)):
        own = rows.get(k, np.empty(0, np.int64))
        g, h = grad[own], hess[own]
        value = float(g.sum() / (h.sum() + 1.0))
        nodes[k] = (-1, 0, value)
        if 2 * k + 2 >= len(nodes) or len(own) < 20:
            continue
        best = (1e-6, -1, 0)
        for f in range(x.shape[1]):
            gl, hl = np.cumsum(np.bincount(x[own, f], g, bins))[:-1], np.cumsum(np.bincount(x[own, f], h, bins))[:-1]
            gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
            gain[(hl < 0.5) | (h.sum() - hl < 0.5)] = 0
            b = int(gain.argmax())
            best = max(best, (float(gain[b]), f, b))
        if best[1] >= 0:
            left = x[own, best[1]] <= best[2]
            rows[2 * k + 1], rows[2 * k + 2] = own[left], own[~left]
            nodes[k] = (best[1], best[2], value)
    return nodes


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and their calibrated probabilities, rising."""
    values, at = np.unique(score, return_inverse=True)  # ties share a value
    n, y = np.bincount(at, minlength=len(values)), np.bincount(at, label, minlength=len(values))
    pools: list[tuple[float, float, float, float]] = []  # sum of labels, rows, least and greatest score
    for v, own, total in zip(values, y, n, strict=True):
        pool = (float(own), float(total), float(v), float(v))
        while pools and pools[-1][0] * pool[1] > pool[0] * pools[-1][1]:
            last = pools.pop()
            pool = (last[0] + pool[0], last[1] + pool[1], last[2], pool[3])
        pools.append(pool)
    xs = np.array([v for p in pools for v in (p[2], p[3])])
    ys = np.array([p[0] / p[1] for p in pools for _ in (0, 1)])
    return xs, ys


@dataclass
class Model:
    lexicon: Lexicon
    edges: np.ndarray
    trees: list[list[tuple[int, int, float]]]
    base: float
    knots: tuple[np.ndarray, np.ndarray]
    depth: int = DEPTH
    rate: float = RATE

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1) if len(x) else x.astype(np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.full(len(b), self.base)
        for tree in self.trees:
            feature, split, value = (np.array(v) for v in zip(*tree, strict=True))
            at = np.zeros(len(b), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                go = 2 * at + 1 + (b[np.arange(len(b)), np.maximum(f, 0)] > split[at])
                at = np.where(f >= 0, go, at)
            out += self.rate * value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability, with a trace of the margin so that ties of the calibration keep their order."""
        m = self.margin(x)
        p = np.interp(m, *self.knots) if len(self.knots[0]) else np.full(len(m), 0.0)
        return np.clip(0.998 * p + 0.002 / (1 + np.exp(-np.clip(m, -30, 30))), 0.0, 1.0)


def fit(lexicon: Lexicon, x: np.ndarray, y: np.ndarray, part: np.ndarray) -> Model:
    """Trees from the rows of parts 2 and 3 and calibration from those of part 4, unless a part lacks one of the labels: then all rows give both."""
    split = all(0 < y[part == k].sum() < (part == k).sum() for k in range(2, 5))
    tree, cal = ((part == 2) | (part == 3), part == 4) if split else (np.ones(len(y), bool),) * 2
    edges = np.array([np.quantile(x[tree, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower") if tree.any() else np.zeros(BINS - 1) for f in range(len(NAMES))])
    mean = np.clip(y[tree].mean() if tree.any() else 0.0, 1e-3, 1 - 1e-3)
    model = Model(lexicon, edges, [], float(np.log(mean / (1 - mean))), (np.empty(0), np.empty(0)))
    if not len(y):
        return model
    b, m = model.binned(x[tree]), np.full(int(tree.sum()), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-m))
        grown = grow(b, y[tree] - p, p * (1 - p), DEPTH)
        model.trees.append(grown)
        one = Model(lexicon, edges, [grown], 0.0, model.knots)
        m += one.margin(x[tree])
    model.knots = isotonic(model.margin(x[cal]), y[cal])
    return model


def feature_rows(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    return np.array([features(t.as_py() or "", lexicon) for t in texts]).reshape(len(texts), len(NAMES))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """A model from the labelled rows that aren't held out, max_labelled of them at most: those of the smallest hash of the id.

    Rows without an id, a label, or a text teach nothing; an id with several labels counts by the largest, one with several texts by the
    least. Without any row, the model scores every text alike. Two fifths of the rows, by a hash of the id, give the lexicon, two fifths
    the trees, one fifth the calibration; under SPLIT_FROM rows, all give all. Texts stay on the executors: the driver gets the
    lexicon, and a label and a row of numbers for each of the labelled rows.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    known = known.select("_id", (F.col("_y") > 0).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())
    rows = texts.join(F.broadcast(known), "_id").groupBy("_id", "y").agg(F.min("_text").alias("text"))
    rows = cut(spread(rows.select("_id", F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(5)).cast("int").alias("part"), "y", "text")))
    lexicon = learn_lexicon(rows.filter("part < 2") if rows.count() >= SPLIT_FROM else rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_rows(batch.column(3), lexicon)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(x), pa.list_(pa.float64()))], ["_id", "part", "y", "x"])

    kind = rows.schema["_id"].dataType.simpleString()
    found = sorted(rows.mapInArrow(tidy(run), f"_id {kind}, part int, y int, x array<double>").collect())
    part = np.array([r["part"] if len(found) >= SPLIT_FROM else 0 for r in found], dtype=np.int64)
    return fit(lexicon, np.array([r["x"] for r in found]).reshape(len(found), len(NAMES)), np.array([r["y"] for r in found], dtype=float), part)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row; a null text counts as empty, a null id stays null. Other columns are not read."""
    docs = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                s = shared.value.score(feature_rows(part.column(1), shared.value.lexicon))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return docs.mapInArrow(tidy(run), T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that score under `least`, all their columns untouched, whatever their names; a null text counts as empty."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                s = shared.value.score(feature_rows(part.column(at), shared.value.lexicon))
                yield part.filter(pa.array(s < least, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def op2_toxicity_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
