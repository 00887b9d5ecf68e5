"""Quality by hierarchical empirical Bayes.

A logistic classifier on measures of a text gives each document's own evidence. Grouped aggregation gives each host and
each path the sum of its documents' chances; a host's posterior shrinks towards the share of all documents, a path's
towards its host's, the more the fewer documents it has. The strength of either prior comes from the spread between groups
by moments. A document's odds are its own evidence with the share of all replaced by its path's posterior, in which the
document itself doesn't count.

The classifier is fitted on at most MAX_LABELS labelled rows (the least hashes of the id). Null and empty texts have all
measures at zero and get a score like others. Null host or path is a group of its own. Null ids and labels aren't learned
from; of several labels of an id the largest counts. Without both labels the share of label 1 (else 0.5) is the evidence.
The input's other columns
aren't read; rows that repeat are rows like others.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, spread

MAX_LABELS = 12_000
SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-()?")
CAPITALS = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MEASURES = 11


def measures(text: str | None) -> list[float]:
    """Length, variety of words and lines, lengths of words, and shares of symbols, capitals, digits and marks."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * MEASURES
    raw = text.encode()
    n, size = len(words), len(raw)
    without = lambda chars: (size - len(raw.translate(None, chars))) / size
    lines = [x for x in text.split("\n") if x.strip()]
    top = Counter(words).most_common(1)[0][1] / n
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    long = sum(len(w) > 14 for w in words) / n
    return [math.log(n), len(set(words)) / n, math.log(len(set(words)) + 1) / math.log(n + 1), (size - n) / n, top, same, long, 1 - len(set(lines)) / max(1, len(lines)), without(SYMBOLS), without(CAPITALS), without(DIGITS)]


def _measured(df: DataFrame, text_col: str) -> DataFrame:
    fields = [f for f in df.schema.fields if f.name not in (text_col, "_x")]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [measures(t) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in names], pa.array(x, pa.list_(pa.float64()))], [*names, "_x"])

    return df.mapInArrow(run, T.StructType([*fields, T.StructField("_x", T.ArrayType(T.DoubleType()))]))


def _expand(x: np.ndarray) -> np.ndarray:
    return np.c_[x, x * x, np.ones(len(x))]


def fit(measured: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, spreads and coefficients of the classifier."""
    labels = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    some = labels.orderBy(F.xxhash64("_id"), "_id").limit(MAX_LABELS)  # the documented bound
    rows = measured.join(F.broadcast(some), F.col(id_col) == F.col("_id")).select("_x", "_y").collect()
    x, y = np.array([r["_x"] for r in rows]).reshape(-1, MEASURES), np.array([float(r["_y"] > 0) for r in rows])
    order = np.lexsort(np.c_[x, y].T) if len(x) else np.zeros(0, int)
    x, y = x[order], y[order]
    mean, spread_ = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(MEASURES), np.ones(MEASURES))
    z = _expand(np.clip((x - mean) / spread_, -6, 6))
    beta = np.zeros(2 * MEASURES + 1)
    p = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    beta[-1] = math.log(p / (1 - p))
    if 0 < y.sum() < len(y):
        pull = np.r_[np.full(2 * MEASURES, 1.0), 1e-6]
        for _ in range(40):
            q = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + np.diag(pull), z.T @ (y - q) - pull * beta)
            beta += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
    return mean, spread_, beta


def _evidence(model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Column:
    """The classifier's log odds as a Spark expression over the measures."""
    mean, spread_, beta = model
    total: Column = F.lit(float(beta[-1]))
    for k in range(MEASURES):
        z = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (F.col("_x")[k] - float(mean[k])) / float(spread_[k])))
        total = total + z * float(beta[k]) + z * z * float(beta[MEASURES + k])
    return F.greatest(F.lit(-8.0), F.least(F.lit(8.0), total))


def _strength(groups: DataFrame, mean: float) -> float:
    """Prior observations: those that give the spread of the groups' means, beyond what chance gives."""
    n, s = F.col("n"), F.col("s")
    r = groups.agg(F.sum(n), F.sum(n * (s / n - mean) ** 2), F.count("*")).first()
    if not r[0] or mean <= 0 or mean >= 1:
        return 10.0
    between = max(r[1] / r[0] - mean * (1 - mean) * r[2] / r[0], 1e-6)
    return min(1e4, max(1.0, mean * (1 - mean) / between - 1))


def quality(df: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, evidence (the classifier's chance), host_posterior, path_posterior, quality (the posterior) and kept."""
    rows = _measured(df.select(id_col, text_col, host.alias("_host"), path.alias("_path")), text_col)
    rows = materialize(rows, "measured")
    model = fit(rows, labels, id_col, label_col)
    odds = _evidence(model)
    rows = rows.select(id_col, "_host", "_path", odds.alias("_odds"), (1 / (1 + F.exp(-odds))).alias("evidence"))
    paths = materialize(rows.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("evidence").alias("s")), "paths")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    n, s = paths.agg(F.sum("n"), F.sum("s")).first()
    mean = s / n if n else 0.5
    a, b = _strength(hosts, mean), _strength(paths, mean)
    hosts = hosts.select(F.col("_host").alias("_h"), ((F.col("s") + a * mean) / (F.col("n") + a)).alias("host_posterior"))
    paths = paths.join(hosts, F.col("_host").eqNullSafe(F.col("_h"))).select(F.col("_host").alias("_h"), F.col("_path").alias("_p"), "n", "s", "host_posterior")
    out = rows.join(spread(paths), F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p")))
    others = (F.col("s") - F.col("evidence") + F.col("host_posterior") * b) / (F.col("n") - 1 + b)
    others = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), others))
    prior = math.log(min(max(mean, 1e-6), 1 - 1e-6) / (1 - min(max(mean, 1e-6), 1 - 1e-6)))
    final = F.col("_odds") - prior + F.log(others / (1 - others))
    score = 1 / (1 + F.exp(-final))
    return out.select(id_col, "evidence", "host_posterior", others.alias("path_posterior"), score.alias("quality"), (score >= 0.5).alias("kept"))
