"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to DIMS dimensions CURVES times, by blocks of random rotations, shifted at random and put on a grid;
a Hilbert curve orders each grid. Spark range-partitions and sorts all (curve, key); an exact place on its curve gives each
vector a block of BLOCK neighbours. A query looks into the blocks round its own on every curve: windows of neighbouring
keys. Each block's vectors and the queries that look into it meet in one group, at most BLOCK vectors and the queries of the
blocks round it. Both sides bring their blocks on all curves, so a pair is measured on the first curve only that brings it
together. Distances are taken in double precision; the nearest, ties by the least id, are merged over curves and ranked.

The number of blocks to each side is fitted on FIT_QUERIES queries against all vectors, to reach TARGET recall: clustered
vectors need few; vectors without structure need windows that are a share of the table, whatever the index.

Equal vectors are one node, which holds the k + 1 least ids, so a group of copies costs as much as one vector and no nearer
or earlier neighbour is lost within the windows. Vectors that are null, zero, of a length other than the commonest, or that
hold null or non-finite components take no part. Null ids take no part. Rows that repeat an id are separate candidates and
separate queries; a query row leaves out itself only. Other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, placed

CURVES, DIMS, BITS = 8, 8, 6
BLOCK = 1_024
FIT_QUERIES = 64
SAMPLE = 4_000
TARGET = 0.95


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """The places of grid points (n x dims, each below 2 ** bits) on the Hilbert curve.

    Axes are turned into the transposed key from the top bit down: where a bit of an axis is set, the lower bits of the
    first axis are inverted, else exchanged with that axis; a Gray decoding follows, and bits are interleaved.
    """
    x = grid.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(dims):
            set_ = (x[i] >> b & 1).astype(bool)
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Curves:
    """The projections, their scale and the shifts, fitted on a sample of vectors."""

    def __init__(self, sample: np.ndarray, seed: int) -> None:
        rng = np.random.default_rng(seed)
        n = sample.shape[1]
        dims = min(DIMS, n)
        axes: list[np.ndarray] = []
        while len(axes) < CURVES * dims:
            axes += list(np.linalg.qr(rng.normal(size=(n, n)))[0].T)
        self.axes = np.array(axes[: CURVES * dims]).reshape(CURVES, dims, n)
        seen = np.einsum("cdn,sn->cds", self.axes, sample)
        self.low, high = seen.min(2), seen.max(2)
        self.span = np.maximum(high - self.low, 1e-12)
        self.shift = rng.random((CURVES, dims))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """n x CURVES."""
        out = []
        for c in range(CURVES):
            at = ((x @ self.axes[c].T - self.low[c]) / self.span[c] + self.shift[c]) / 2
            out.append(hilbert_keys((np.clip(at, 0, 1 - 1e-9) * (1 << BITS)).astype(np.int64), BITS))
        return np.stack(out, 1)


def nearest(q: np.ndarray, x: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the k nearest to q in x and their distances; of equal distances, those with the least ids."""
    at = np.arange(len(x))
    if len(x) > k:
        far = (x * x).sum(1) - 2 * (x @ q)
        cut = np.partition(far, k - 1)[k - 1]
        at = np.flatnonzero(far <= cut + 1e-9 * (1 + abs(cut) + float(q @ q)))  # all that may be within the k-th distance
    d = np.sqrt(((x[at] - q) ** 2).sum(1))
    order = np.lexsort((least[at], d))[:k]
    return at[order], d[order]


def _stack(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64) if len(col) else np.zeros((0, 1))


def _usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vec.isNotNull() & ~bad & F.exists(vec, lambda v: v != 0)


def search(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 3) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found of each row that is_query holds for."""
    spark = df.sparkSession
    rows = df.where(F.col(id_col).isNotNull() & _usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), is_query.alias("q"))
    rows = materialize(rows, "vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == widths[0]["w"])
    # nodes: distinct vectors; Spark applies the limit of the rank before the shuffle
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    nodes = rows.select("id", "v").withColumn("_n", place).where(F.col("_n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    nodes = materialize(nodes.select(F.col("ids")[0].alias("node"), F.xxhash64("v", "ids").alias("node_key"), "ids", "v"), "nodes")
    asked = materialize(rows.where("q").select("id", "v").join(nodes.select("v", "node_key"), "v").select(F.monotonically_increasing_id().alias("row"), "id", "node_key"), "asked")
    n = nodes.count()
    sample = _stack(nodes.orderBy("node_key").limit(SAMPLE).toPandas()["v"])  # the documented bound
    curves = Curves(sample, seed)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                keys = curves.keys(_stack(pdf["v"]))
                for c in range(CURVES):
                    yield pdf[["node_key"]].assign(curve=c, key=keys[:, c])

    keys = nodes.select("node_key", "v").mapInPandas(keyed, "node_key long, curve int, key long")
    # every curve holds all n nodes, so a place in the whole order gives the place on the curve
    blocks = -(-n // BLOCK)
    order = placed(keys, "_spot", F.col("curve").asc(), F.col("key").asc(), F.col("node_key").asc())
    order = order.select("node_key", "curve", F.floor(F.col("_spot") % F.lit(n) * F.lit(blocks) / F.lit(n)).cast("int").alias("block"))
    order = materialize(order, "blocks")
    side = _fit_side(nodes, order, asked, blocks, k)

    # the blocks of a vector on all curves, in one row
    places = order.groupBy("node_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("curve", "block"))), lambda x: x["block"]).alias("blocks"))
    index = nodes.join(places, "node_key").select("node_key", "v", F.col("node"), "blocks", F.posexplode("blocks").alias("curve", "block"))
    wanted = asked.select("node_key").distinct().join(nodes.select("node_key", "v"), "node_key").join(places, "node_key").select(F.col("node_key").alias("asks"), F.col("v").alias("qv"), F.col("blocks").alias("q_blocks"), F.posexplode("blocks").alias("to_curve", "own"))
    around = F.explode(F.sequence(F.greatest(F.lit(0), F.col("own") - side), F.least(F.lit(blocks - 1), F.col("own") + side)))
    wanted = wanted.withColumn("to_block", around)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        asks, found, score = [], [], []
        if len(left) and len(right):
            x, least, keys = _stack(left["v"]), left["node"].to_numpy(), left["node_key"].to_numpy()
            curve, spots = int(left["curve"].iloc[0]), np.stack(left["blocks"].to_numpy())
            for name, v, own in zip(right["asks"], right["qv"], right["q_blocks"], strict=True):
                new = np.flatnonzero((np.abs(spots[:, :curve] - own[:curve]) > side).all(1))  # not met on a curve before
                at, d = nearest(np.asarray(v, np.float64), x[new], least[new], k + 1)
                asks.append(np.full(len(at), name))
                found.append(keys[new[at]])
                score.append(d)
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        return pd.DataFrame({"asks": join(asks, np.int64), "node_key": join(found, np.int64), "score": join(score, np.float64)})

    near = index.groupBy("curve", "block").cogroup(wanted.groupBy("to_curve", "to_block")).applyInPandas(meet, "asks long, node_key long, score double")
    near = near.join(nodes.select("node_key", "ids"), "node_key")
    best = F.row_number().over(Window.partitionBy("asks").orderBy("score", F.col("ids")[0]))
    near = near.withColumn("_n", best).where(F.col("_n") <= k + 1).select("asks", "score", F.explode("ids").alias("vec_id"))
    lists = near.groupBy("asks").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))  # (k + 1) ** 2 at most
    # a query's own row is the first with its id at distance 0; it may be beyond the ids that its node holds
    own = F.array_position(F.col("found"), F.struct(F.lit(0.0).alias("score"), F.col("id").alias("vec_id"))).cast("int")
    others = F.filter("found", lambda x, i: (i + 1) != own)
    out = asked.join(lists, asked["node_key"] == lists["asks"]).select("row", F.col("id").alias("query_id"), F.slice(others, 1, k).alias("found"))
    return out.select("query_id", F.posexplode("found").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _fit_side(nodes: DataFrame, order: DataFrame, asked: DataFrame, blocks: int, k: int) -> int:
    """Blocks to each side so that a sample of queries finds TARGET of its true neighbours on some curve."""
    some = asked.select("node_key").distinct().orderBy("node_key").limit(FIT_QUERIES).join(nodes, "node_key").select("node_key", "v").toPandas()  # the documented bound
    if not len(some) or blocks == 1:
        return 0
    names, qv = some["node_key"].to_numpy(), _stack(some["v"])

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, keys = _stack(pdf["v"]), pdf["node_key"].to_numpy()
                for name, q in zip(names, qv, strict=True):
                    at, d = nearest(q, x, keys, k + 1)
                    yield pd.DataFrame({"asks": name, "node_key": keys[at], "score": d})

    true = nodes.select("node_key", "v").mapInPandas(exact, "asks long, node_key long, score double").where("asks <> node_key")
    true = true.withColumn("_n", F.row_number().over(Window.partitionBy("asks").orderBy("score", "node_key"))).where(F.col("_n") <= k).select("asks", "node_key")
    a = order.select(F.col("node_key").alias("asks"), "curve", F.col("block").alias("_own"))
    b = order.select("node_key", "curve", F.col("block").alias("_its"))
    gap = true.join(b, "node_key").join(a, ["asks", "curve"]).groupBy("asks", "node_key").agg(F.min(F.abs(F.col("_its") - F.col("_own"))).alias("gap"))
    gaps = np.sort([r["gap"] for r in gap.select("gap").collect()])
    return int(gaps[max(0, math.ceil(TARGET * len(gaps)) - 1)]) if len(gaps) else 0
