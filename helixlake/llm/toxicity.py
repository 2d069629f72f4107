"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding, normalised by length, with exception phrases.

Folding lower-cases, strips accents, maps look-alike letters of other scripts and the digits and signs that stand in for
letters (``1d10t``), and turns everything else into spaces. The lexicon holds word beginnings of 4 to 7 letters, and short
whole words, which labelled toxic documents have more often than the others; the weight is the log ratio, shrunk where few documents bear it
out. Phrases of a
matched word and a neighbour that clean documents use are exceptions: a match inside one doesn't count. The weights found,
taken whole and by length, go through a logistic function fitted to the labels.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, materialize, table

LEXICON_SIZE = 5_000
EXCEPTIONS = 2_000
#: Toxic documents that an entry needs, the number of them at which its log ratio counts by half, and the least weight.
#: Cross-validated on the training folds.
MIN_DOCS, SHRINK, MIN_WEIGHT = 3, 10, 1.0
#: Labelled documents, at most, that the logistic function is fitted to.
FIT_ROWS = 20_000
THRESHOLD = 0.3

# Look-alikes of Latin letters in Cyrillic and Greek, and the digits and signs used for letters.
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ӏ": "l", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ß": "s"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        ch = chr(code).lower()
        base = unicodedata.normalize("NFKD", ch)
        base = "".join(HOMOGLYPHS.get(c, c) for c in base if not unicodedata.combining(c))
        self[code] = out = base if base.isalpha() else DIGITS.get(ch, " ") if ch in "0134578@$" else " "
        return out


_fold_table = _Fold()
_inner_bang = re.compile(r"(?<=\w)!(?=\w)")


def fold(text: str) -> str:
    """Folded letters with single spaces round each word."""
    return " " + " ".join(_inner_bang.sub("i", text).translate(_fold_table).split()) + " "


def entries_of(words: set[str]) -> set[str]:
    """What the lexicon may hold of these words: beginnings ``" begin"``, and whole words ``" word "`` of 3 to 7 letters."""
    out = set()
    for w in words:
        n = len(w)
        if n >= 3:
            if n <= 7:
                out.add(f" {w} ")
            for k in (4, 5, 6, 7):
                if n >= k:
                    out.add(" " + w[:k])
    return out


def _counts(labelled: DataFrame, keys_of, schema: str, flush: int = 300_000) -> DataFrame:
    """Documents with and without the label for each key; a task sums before it sends."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = Counter(), Counter()

        def out() -> pd.DataFrame:
            keys = list(sums[0].keys() | sums[1].keys())
            rows = pd.DataFrame({"key": keys, "pos": [sums[1][k] for k in keys], "neg": [sums[0][k] for k in keys]})
            for s in sums:
                s.clear()
            return rows

        for b in batches:
            for text, label in zip(b["text"], b["label"], strict=True):
                sums[label].update(keys_of(text or ""))
                if len(sums[0]) + len(sums[1]) > flush:
                    yield out()
        yield out()

    return labelled.mapInPandas(count, schema).groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


class Lexicon:
    """Weights of entries, exception phrases, and the logistic function's three factors. Its size is bounded by
    LEXICON_SIZE and EXCEPTIONS, so it can be sent to all executors."""

    def __init__(self, weights: dict[str, float], exceptions: set[str], factors: tuple[float, float, float] = (-3.0, 2.0, 1.0)):
        self.weights, self.exceptions, self.factors, self.key = weights, exceptions, factors, uuid.uuid4().hex

    def automaton(self):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for w, x in self.weights.items():
            auto.add_word(w, (w, x))
        if self.weights:
            auto.make_automaton()
        return auto

    def matches(self, auto, flat: str) -> dict[int, float]:
        """The greatest weight of an entry at each word's start, exceptions left out."""
        found: dict[int, float] = {}
        if self.weights:
            for end, (w, x) in auto.iter(flat):
                at = end - len(w) + 1
                found[at] = max(x, found.get(at, x))
        return {at: x for at, x in found.items() if not any(p in self.exceptions for p in phrases_at(flat, at))} if self.exceptions else found


def phrases_at(flat: str, at: int) -> list[str]:
    """The word that starts after position ``at`` with the word before it, and with the one after it."""
    end = flat.index(" ", at + 1)
    before, after = flat.rfind(" ", 0, at) if at else -1, flat.find(" ", end + 1)
    return ([flat[before + 1 : end]] if before >= 0 else []) + ([flat[at + 1 : after]] if after > 0 else [])


def features(found: dict[int, float], flat: str) -> tuple[float, float]:
    total = sum(found.values())
    return math.log1p(total), math.log1p(200 * total / (flat.count(" ") + 20))


_auto: dict[str, object] = {}


def _automaton(lexicon: Lexicon):
    if lexicon.key not in _auto:
        _auto.clear()
        _auto[lexicon.key] = lexicon.automaton()
    return _auto[lexicon.key]


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "label") -> Lexicon:
    """Learns from all rows with label 0 or 1; only the logistic function takes a sample of FIT_ROWS. Rows with another
    or a null label are left out, null texts are empty. Without labels of both kinds the lexicon is empty."""
    rows = labelled.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    rows = materialize(rows, "labelled")  # read four times; the join below it moves the texts once
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return Lexicon({}, set(), (math.log((pos + 0.5) / (neg + 0.5)) if pos + neg else -3.0, 0.0, 0.0))
    ratio = F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") + 0.5) / (neg + 1.0))
    weight = ratio * F.col("pos") / (F.col("pos") + SHRINK)
    counted = _counts(rows, lambda text: entries_of(set(fold(text).split())), "key string, pos long, neg long")
    top = counted.where((F.col("pos") >= MIN_DOCS) & (weight >= MIN_WEIGHT)).select("key", weight.alias("w"), (F.col("pos") * weight).alias("gain")).orderBy(F.desc("gain"), "key").limit(LEXICON_SIZE).collect()
    lexicon = Lexicon({r["key"]: r["w"] for r in top}, set())
    spark = labelled.sparkSession
    shared = spark.sparkContext.broadcast(lexicon)

    def phrases(text: str) -> set[str]:
        flat, lex = fold(text), shared.value
        return {p for at in lex.matches(_automaton(lex), flat) for p in phrases_at(flat, at)}

    shield = F.log((F.col("neg") + 0.5) / (neg + 1.0)) - F.log((F.col("pos") + 0.5) / (pos + 1.0))
    clean = _counts(rows, phrases, "key string, pos long, neg long").where((F.col("neg") >= MIN_DOCS) & (shield > 0)).orderBy(F.desc("neg"), "key").limit(EXCEPTIONS).collect()
    lexicon = Lexicon(lexicon.weights, {r["key"] for r in clean})
    shared2 = spark.sparkContext.broadcast(lexicon)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = shared2.value
        for b in batches:
            flats = [fold(t) for t in b["text"]]
            x = [features(lex.matches(_automaton(lex), f), f) for f in flats]
            yield pd.DataFrame({"x1": [v[0] for v in x], "x2": [v[1] for v in x], "label": b["label"].to_numpy(), "n": b["n"].to_numpy()})

    fit = sample_rows(rows, FIT_ROWS).mapInPandas(measure, "x1 double, x2 double, label int, n long").toPandas().sort_values(["x1", "x2", "label", "n"])
    return Lexicon(lexicon.weights, lexicon.exceptions, fit_logistic(fit[["x1", "x2"]].to_numpy(), fit["label"].to_numpy(), weights=fit["n"].to_numpy()))


def sample_rows(rows: DataFrame, size: int) -> DataFrame:
    """``size`` different pairs (text, label) at most, the first by hash, with how often each occurs (n): so many whatever
    the number of rows, and a text that is repeated counts as often as it stands there but takes one place."""
    key = F.xxhash64("text", "label")
    counts = rows.groupBy(key.alias("h")).agg(F.count("*").alias("n"))
    first = counts.orderBy("h").limit(size)  # ``size`` rows of two numbers
    picked = rows.withColumn("h", key).join(F.broadcast(first), "h")
    return picked.dropDuplicates(["h"]).select("text", "label", "n")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weights: np.ndarray | None = None) -> tuple[float, float, float]:
    """Newton's method on intercept and two factors."""
    v = np.ones(len(x)) if weights is None else np.asarray(weights, float)
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (v * (p - y)) + ridge * w * [0, 1, 1]
        h = (a * (v * p * (1 - p))[:, None]).T @ a + ridge * np.eye(3)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


_OUT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_matches", T.IntegerType()), T.StructField("weight", T.DoubleType())])


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """Adds struct ``out``: score (0 to 1), n_matches, weight, of whole texts. Null and empty texts have no match and take
    the score of that. A column named ``out`` is replaced; other columns and repeated rows stay as they are. An empty table
    gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf(_OUT)
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lex = shared.value
        auto, (b, w1, w2) = _automaton(lex), lex.factors
        for s in texts:
            rows = []
            for t in s:
                flat = fold(t or "")
                found = lex.matches(auto, flat)
                x1, x2 = features(found, flat)
                rows.append((1 / (1 + math.exp(-max(-30.0, min(30.0, b + w1 * x1 + w2 * x2)))), len(found), float(sum(found.values()))))
            yield pd.DataFrame(rows, columns=_OUT.names)

    return docs.withColumn(out, score(F.col(text_col)))


def training_rows(spark, sf_dir) -> DataFrame:
    """Labelled documents outside the held-out fold. Labels grow with the documents, so neither side is broadcast."""
    labels = table(spark, sf_dir, "labels").where("toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("label"), F.max("toxic").alias("other"))
    labels = labels.where("label = other").drop("other")  # a repeated id counts once, and not at all if its labels differ
    return table(spark, sf_dir, "documents").select("doc_id", "text").where(fold_of() != 2).join(labels.hint("merge"), "doc_id")


def op3_toxicity(spark, sf_dir):
    """SQL can't express it: tests hold the matcher against a search for each entry, and the query against the labels of the
    held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train(training_rows(spark, sf_dir)))
    score = F.col("toxicity.score")
    return scored.select("doc_id", (fold_of() == 2).alias("held_out"), score.alias("score"), F.when(score >= THRESHOLD, 1).otherwise(0).alias("predicted"))
