"""Connected components of a table of links.

Links are first reduced to forests by union-find within their tasks. If ONE_TASK links or fewer are left, which is counted,
one more task unites them. Beyond that, large-star and small-star steps alternate: every node sends its larger, then its
smaller neighbours to the least one, until all links point to the least id of their component. Neighbours are never
gathered: a step takes a minimum by node, combined before the shuffle, and joins it back, with both sides exchanged so that
Spark can split the partition of a node with very many links.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, spread


#: Links that one task unites: the bound on its memory, and the number of links after which a task passes on a forest.
ONE_TASK = 1 << 18


def united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links as forests: a link from every node to the least one of its tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p] = parent.setdefault(p, p)
            x = parent[x]
        return x

    def forest() -> pd.DataFrame:
        own = [(x, root(x)) for x in list(parent)]
        return pd.DataFrame([(x, r) for x, r in own if x != r], columns=["a", "b"], dtype="int64")

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        if len(parent) > 2 * ONE_TASK:
            yield forest()
            parent.clear()
    yield forest()


def _down(df: DataFrame) -> DataFrame:
    return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of links (a, b: long): component is the least id that links reach. Links with a null count for nothing."""
    links = links.select("a", "b").where("a is not null and b is not null")
    now = materialize(_down(links.mapInPandas(united, "a long, b long")), "links")
    state, before = _state(now), None
    if state[0] <= ONE_TASK:
        now, before = materialize(now.repartition(1).mapInPandas(united, "a long, b long"), "links"), state
    while state != before:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = spread(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = _down(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        least = spread(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select("a", "b", "m")
        new = materialize(_down(small.select("a", F.col("m").alias("b")).union(small.select("b", "m"))), "links")
        drop_table(now)
        now, before, state = new, state, _state(new)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
