"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs to Latin letters and, in tokens that hold a letter, digits and signs to the letters
they stand for. Lexicon terms are words and beginnings of words; weights are smoothed log odds of toxic against other
documents, learned from a bounded sample of labelled rows. Exception phrases are pairs of words round a term that occur in
several documents without and in none with the label; a term inside one counts nothing. Of overlapping matches the longest
counts. Sums of weights are normalised by the number of words; a logistic curve over four such sums gives the score.

The statistics run in Spark over the sample; MAX_LABELS rows (those with the least hash of the id) bound what is learned
from, and so the lexicon: a term is in LEAST_DOCS of their toxic texts, a phrase in LEAST_CLEAN of the others. Null and empty texts get the score of a document without a match. Null
ids and null labels aren't learned from; of several labels of an id, the largest counts. Without both labels in the sample
the share of label 1 (0.5 without any label) is every document's score. The input's other columns stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

MAX_LABELS = 12_000
PREFIXES = range(3, 8)
LEAST_DOCS = 4
LEAST_CLEAN = 3
LEAST_LOG_ODDS = 1.5

# Letters that look like Latin ones, and what digits and signs stand for.
HOMOGLYPHS = str.maketrans("абвгдеёзіјкмнорстухуԁѕ" + "αβεικνορτυχ" + "ıɡ", "a6brдeeзijkmhopctyxyds" + "abeikvoptux" + "ig") | {0xFF01 + k: 0x21 + k for k in range(94)}
DIGITS = str.maketrans("0134578@$", "oieastbas")
TOKEN = re.compile(r"[^\W_]+(?:[@$]+[^\W_]+)*")
ODD = re.compile(r"[0134578@$]")
LETTER = re.compile(r"[^\W\d_]")


def fold(text: str | None) -> list[str]:
    """The folded words of a text."""
    low = (text or "").lower()
    words = TOKEN.findall(low if low.isascii() else low.translate(HOMOGLYPHS))
    return [w.translate(DIGITS) if ODD.search(w) and LETTER.search(w) else w for w in words] if ODD.search(low) else words


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # " word " or " beginning"
    exceptions: tuple[str, ...] = ()  # " one  two "
    beta: tuple[float, ...] = (0.0,) * 5

    def automaton(self) -> ahocorasick.Automaton | None:
        auto = ahocorasick.Automaton()
        for k, w in self.weights.items():
            auto.add_word(k, (w, len(k)))
        for k in self.exceptions:
            auto.add_word(k, (0.0, len(k)))
        if not len(auto):
            return None
        auto.make_automaton()
        return auto


def measures(words: list[str], auto: ahocorasick.Automaton | None) -> tuple[float, float, float, float]:
    """Sums of weights: by word, by its root, the largest, and the logarithm of the number of matches."""
    if auto is None or not words:
        return 0.0, 0.0, 0.0, 0.0
    found = [w for _, (w, _) in auto.iter_long("  ".join(["", *words, ""])) if w]
    n, s = len(words), sum(found)
    return 10 * s / (n + 10), s / math.sqrt(n + 10), max(found, default=0.0), math.log1p(len(found))


def _terms(words: set[str]) -> set[str]:
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:k]}" for w in words for k in PREFIXES if len(w) > k}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the intercept is last and free."""
    x = np.c_[x, np.ones(len(x))]
    beta, pull = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """A lexicon learned from labels (id, label), at most MAX_LABELS of them."""
    labels = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    some = labels.orderBy(F.xxhash64("_id"), "_id").limit(MAX_LABELS)  # the documented bound
    rows = df.join(F.broadcast(some), F.col(id_col) == F.col("_id")).select(F.col(text_col).alias("text"), F.col("_y").alias("y"))
    rows = materialize(rows, "labelled").repartition(8)
    n = dict(rows.groupBy("y").count().collect())
    n0, n1 = n.get(0, 0), sum(v for k, v in n.items() if k)
    if not n0 or not n1:
        p = min(max(n1 / (n0 + n1) if n0 + n1 else 0.5, 1e-3), 1 - 1e-3)
        return Lexicon(beta=(0.0,) * 4 + (math.log(p / (1 - p)),))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            of: tuple[Counter, Counter] = Counter(), Counter()
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                of[int(y > 0)].update(_terms(set(fold(text))))
            yield pd.DataFrame([(t, of[0][t], of[1][t]) for t in of[0] | of[1]], columns=["term", "n0", "n1"])

    odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    counts = rows.mapInPandas(count, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n1") >= LEAST_DOCS)
    weights = {r["term"]: r["w"] for r in counts.withColumn("w", odds).where(F.col("w") >= LEAST_LOG_ODDS).orderBy("term").collect()}

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, starts = {t.strip() for t in weights if t.endswith(" ")}, {t[1:] for t in weights if not t.endswith(" ")}
        is_term = lambda w: w in whole or any(w[:k] in starts for k in PREFIXES if len(w) > k)
        for pdf in batches:
            of: tuple[Counter, Counter] = Counter(), Counter()
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                words = fold(text)
                hit = [k for k, w in enumerate(words) if is_term(w)]
                of[int(y > 0)].update({f" {words[a]}  {words[a + 1]} " for k in hit for a in (k - 1, k) if 0 <= a < len(words) - 1})
            yield pd.DataFrame([(t, of[0][t], of[1][t]) for t in of[0] | of[1]], columns=["phrase", "n0", "n1"])

    said = rows.mapInPandas(phrases, "phrase string, n0 long, n1 long").groupBy("phrase").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    exceptions = tuple(r["phrase"] for r in said.where((F.col("n0") >= LEAST_CLEAN) & (F.col("n1") == 0)).orderBy("phrase").collect())
    lexicon = Lexicon(weights, exceptions)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = lexicon.automaton()
        for pdf in batches:
            yield pd.DataFrame([(*measures(fold(t), auto), float(y > 0)) for t, y in zip(pdf["text"], pdf["y"], strict=True)], columns=list("abcdy"))

    got = np.array(rows.mapInPandas(features, "a double, b double, c double, d double, y double").collect())  # MAX_LABELS rows at most
    got = got[np.lexsort(got.T)]
    lexicon.beta = tuple(_logistic(got[:, :4], got[:, 4]))
    return lexicon


def score(df: DataFrame, lexicon: Lexicon, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """df with the score of each text, from 0 to 1."""
    fields = [x for x in df.schema.fields if x.name != out_col]
    names = [x.name for x in fields]
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, beta = shared.value.automaton(), np.array(shared.value.beta)
        for b in batches:
            x = np.array([measures(fold(t), auto) for t in b.column(text_col).to_pylist()]).reshape(-1, 4)
            p = 1 / (1 + np.exp(-np.clip(x @ beta[:4] + beta[4], -30, 30)))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in names], pa.array(p)], [*names, out_col])

    return df.mapInArrow(run, T.StructType([*fields, T.StructField(out_col, T.DoubleType())]))
