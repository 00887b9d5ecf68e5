"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies that each of its documents should have. The whole part is certain;
the fraction is rounded dependently: within a node of about NODE_ROWS documents, two fractional documents at a time
exchange mass (chance times size) in a random direction that keeps the expectation, until one of them is integral. Each
node leaves one fractional document at most; those meet in the next level of a reduction tree of fan-in FAN_IN, and the
last one of a source is decided by a draw. So a source's words miss its target by less than one document.

Rows equal in id and text are one document with a number of rows: among equals an exchange leaves all of them integral but
one, so their number times the fraction counts, however many they are. Sources are ranked and their level is found by
grouped reductions, so neither their number nor their sizes matter.

Nodes, order and draws follow from hashes of id and text, so reruns agree however the rows are partitioned. Null text has
no words; documents without words take part in no exchange. Null source is a source. An empty table gives an empty result.
The input's other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize, placed, spread, text_or_empty

NODE_ROWS = 4_000
FAN_IN = 64
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
#: Quantiles that a pass over the sources tries.
STEPS = 32


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sizes (source, source_size, ...) with sid (place by code point, null last) and target.

    All words are shared by weight; a source stops at `most` times its size, and what it can't take is shared anew. That
    ends at one level: a source gets the smaller of its limit and level * weight, all of them together as many words as there
    are. A source is full at the level of its limit over its weight. STEPS quantiles of these levels, then of those between
    the two quantiles that enclose the sum, and so on, narrow it to an interval in which no source becomes full.
    """
    out = placed(sizes, "sid", F.col("source").asc_nulls_last()).withColumn("_w", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights)))
    out = materialize(out.withColumns({"_cap": F.col("source_size") * F.lit(float(most)), "_full": F.col("source_size") * F.lit(float(most)) / F.col("_w")}), "limits")
    total = float(out.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    low, high = 0.0, float("inf")  # levels: too low or right, too high or right
    while True:
        inside = out.where((F.col("_full") > low) & (F.col("_full") < high))
        levels = inside.agg(F.percentile_approx("_full", [k / STEPS for k in range(1, STEPS)], 10_000)).first()[0]
        if not levels:
            break
        levels = sorted(set(levels))
        taken = out.agg(*[F.sum(F.least(F.col("_cap"), F.col("_w") * level)) for level in levels]).first()
        low = max([low, *[x for x, t in zip(levels, taken, strict=True) if t <= total]])
        high = min([high, *[x for x, t in zip(levels, taken, strict=True) if t > total]])
    full = F.col("_full") <= low
    filled, weight = out.agg(F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0.0))).first()
    level = (total - filled) / weight if weight else 0.0
    return out.withColumn("target", F.when(full, F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * level))).drop("_w", "_cap", "_full")


def _round_node(pdf: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    """One node: chance becomes 0 or 1 for all rows but one, and for all rows if it's the last node of the source."""
    pdf = pdf.sort_values(["size", "h", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)  # what is left over is small
    rng = np.random.default_rng([seed, int(pdf["sid"].iloc[0]), int(pdf["node"].iloc[0]) & 0xFFFFFFFF, int(pdf["level"].iloc[0])])
    p, w = pdf["chance"].to_numpy(float).copy(), pdf["size"].to_numpy(float)
    draws = rng.random(len(p) + 1)
    empty = w == 0
    p[empty] = (draws[:-1][empty] < p[empty]).astype(float)
    i = -1
    for j in np.flatnonzero((p > 0) & (p < 1)).tolist():
        if i < 0:
            i = j
            continue
        up, down = min((1 - p[i]) * w[i], p[j] * w[j]), min(p[i] * w[i], (1 - p[j]) * w[j])
        mass = up if draws[j] * (up + down) < down else -down
        p[i], p[j] = p[i] + mass / w[i], p[j] - mass / w[j]
        p[[i, j]] = [min(1.0, max(0.0, round(x, 12))) for x in (p[i], p[j])]
        i = next((k for k in (i, j) if 0 < p[k] < 1), -1)
    if last and i >= 0:
        p[i] = float(draws[-1] < p[i])
    return pdf.assign(chance=p)


def _rounder(seed: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: _round_node(pdf, seed, last)


def _decided(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """doc_id, h (hash of id and text), size, source_size, target, equal (rows of that id and text) and copies of all of them."""
    text = text_or_empty(text_col)
    rows = df.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.col(id_col), text).alias("h"),
    )
    rows = materialize(rows, "sizes").groupBy("doc_id", "h", "source", "size").agg(F.count("*").alias("equal"))
    rows = materialize(rows, "documents")
    sources = targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("equal")).alias("source_size"), F.count("*").alias("_rows")))
    sources = materialize(sources.withColumn("_nodes", F.ceil(F.col("_rows") / NODE_ROWS)), "targets")
    most_nodes = sources.agg(F.max("_nodes")).first()[0] or 1
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    part = F.col("equal") * (ratio - F.floor(ratio))  # of all equal rows together
    joined = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).select(
        "doc_id", "h", "size", "equal", "source_size", "target", "sid", (F.col("equal") * F.floor(ratio) + F.floor(part)).cast("long").alias("base"), (part - F.floor(part)).alias("chance"), F.pmod(F.col("h"), "_nodes").alias("node"), F.lit(0).alias("level"),
    )
    schema = joined.schema
    done, levels, nodes = [], joined, most_nodes
    level = 0
    while True:
        last = nodes <= 1
        now = materialize(levels.groupBy("sid", "node").applyInPandas(_rounder(seed, last), schema), f"level{level}")
        if last:
            done.append(now)
            break
        open_ = (F.col("chance") > 0) & (F.col("chance") < 1)
        done.append(now.where(~open_))
        level, nodes = level + 1, -(-nodes // FAN_IN)
        levels = now.where(open_).withColumns({"node": F.floor(F.col("node") / FAN_IN), "level": F.lit(level)})
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "h", "size", "source_size", "target", "equal", (F.col("base") + F.round("chance").cast("long")).alias("copies"))


def _share(place: Column) -> Column:
    """Of the copies of equal rows, those of the row at a place from 0."""
    return (F.expr("copies div equal") + F.when(place < F.expr("copies % equal"), 1).otherwise(0)).cast("int")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 5) -> DataFrame:
    """doc_id, h (hash of id and text), size, source_size, target, copies and taken of each row."""
    out = _decided(df, id_col, text_col, source_col, seed)
    out = out.withColumn("copies", F.explode(F.transform(F.sequence(F.lit(0), F.col("equal") - 1), _share)))
    return out.select("doc_id", "h", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 5) -> DataFrame:
    """The rows of df as the mix takes them, each as often as it has copies, with df's columns."""
    decided = _decided(df, id_col, text_col, source_col, seed).groupBy("doc_id", "h").agg(F.sum("copies").alias("copies"), F.sum("equal").alias("equal")).where("copies > 0")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), text_or_empty(text_col)).alias("_h"))
    both = rows.join(spread(decided), (F.col("_h") == F.col("h")) & F.col("_id").eqNullSafe(F.col("doc_id")))
    single = both.where("equal = 1").withColumn("_n", F.col("copies").cast("int"))
    place = F.row_number().over(Window.partitionBy("_h", "_id").orderBy(F.lit(1))) - 1
    equal = both.where("equal > 1").withColumn("_n", _share(place)).where("_n > 0")  # repeated rows share their copies
    return single.unionByName(equal).select("_row", F.explode(F.sequence(F.lit(1), "_n"))).select("_row.*")
