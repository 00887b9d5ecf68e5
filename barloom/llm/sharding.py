"""Sharding by sampled splitters, with DataFrame functions only.

Keys are sampled with a chance in proportion to their record's size, so that quantiles of the sample cut the table into
ranges of about equal bytes. Exact counts by range follow; a range that is overfull is sampled again and subdivided. Each
range is then one group of a window, and the exact bytes and rows before it turn places within it into places in the whole
table: shards are contiguous runs of the key order whose bytes differ by less than two records, and slots have no gaps.

The number of ranges grows with the rows, up to MOST_RANGES, so that a range stays one task's work. What reaches the driver or
is broadcast is bounded by it: SAMPLED keys a range in a pass, a cut and two counts a range.

The order is (id, position in the written table), so equal ids, repeated rows and null ids (first) can be subdivided too.
Null text has no bytes. An empty table gives an empty result. The input may have any other columns; they aren't read.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, text_or_empty

RANGES_PER_SHARD, RANGE_ROWS, MOST_RANGES = 8, 1_000_000, 16_384
#: Sampled keys a range in a pass.
SAMPLED = 30
#: Cuts that an expression compares with; more are looked up in two steps.
INLINE = 255
#: A range is overfull beyond so many times the mean range, in bytes or rows.
OVERFULL = 2.5
PASSES = 4
LEAST = -(1 << 63)


def _below(cut: tuple[int, int]) -> Column:
    key, row = cut
    return (F.col("_key") < F.lit(key)) | ((F.col("_key") == F.lit(key)) & (F.col("_row") < F.lit(row)))


def _number_of(cuts: list[tuple[int, int]]) -> Column:
    """The number of cuts that are at most (_key, _row), as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(_below(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def _ranged(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """rows with _range, the number of cuts that are at most (_key, _row)."""
    if len(cuts) <= INLINE:
        return rows.withColumn("_range", _number_of(cuts))
    size = -(-len(cuts) // INLINE)
    groups = [cuts[k : k + size] for k in range(0, len(cuts), size)]
    table = rows.sparkSession.createDataFrame([(k, k * size, [{"k": key, "r": row} for key, row in g]) for k, g in enumerate(groups)], "_group int, _first int, _cuts array<struct<k: bigint, r: bigint>>")
    here = F.size(F.filter("_cuts", lambda c: c <= F.struct(F.col("_key").alias("k"), F.col("_row").alias("r"))))
    first = _number_of([g[0] for g in groups[1:]])  # the group that a row falls into
    out = rows.withColumn("_group", first).join(F.broadcast(table), "_group")  # MOST_RANGES cuts at most
    return out.withColumn("_range", F.col("_first") + here).drop("_group", "_first", "_cuts")


def _sampled(rows: DataFrame, total: int, keys: int, seed: int) -> list[tuple[int, int]]:
    chance = F.col("size") * F.lit(keys / max(total, 1))
    return sorted((r[0], r[1]) for r in rows.where(F.rand(seed) < chance).select("_key", "_row").collect())


def _quantiles(keys: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    return [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []


def shard_by_bytes(df: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """id, size (UTF-8 bytes + 8), text_crc32, shard and slot of each row."""
    text = text_or_empty(text_col)
    rows = df.select(
        F.col(id_col), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("_key"), F.monotonically_increasing_id().alias("_row"),
    )
    rows = materialize(rows, "records")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    parts = max(1, min(n_shards * RANGES_PER_SHARD, n // 50), min(MOST_RANGES, n // RANGE_ROWS))
    keys = SAMPLED * max(parts, 200)
    cuts = sorted(set(_quantiles(_sampled(rows, total, keys, seed), parts)))
    for again in range(PASSES):
        ranged = _ranged(rows, cuts)
        stats = {r[0]: (r[1], r[2]) for r in ranged.groupBy("_range").agg(F.sum("size"), F.count("*")).collect()}
        over = {k: v for k, v in stats.items() if v[0] > OVERFULL * total / parts + 1 or v[1] > OVERFULL * n / parts + 1}
        if not over or again == PASSES - 1:
            break
        inside = ranged.where(F.col("_range").isin(list(over)))
        more: dict[int, list] = {k: [] for k in over}
        for key in _sampled(inside, sum(v[0] for v in over.values()), keys, seed + again + 1):
            more[bisect.bisect_right(cuts, key)].append(key)
        new = {c for k, keys in more.items() for c in _quantiles(keys, 1 + int(max(over[k][0] * parts / total, over[k][1] * parts / n)))}
        if new <= set(cuts):
            break
        cuts = sorted(new | set(cuts))
    before, b, r = [], 0, 0
    for k in range(len(cuts) + 1):
        before.append((k, b, r))
        b, r = b + stats.get(k, (0, 0))[0], r + stats.get(k, (0, 0))[1]
    starts = df.sparkSession.createDataFrame(before, "_range int, _bytes long, _rows long")
    w = Window.partitionBy("_range").orderBy("_key", "_row")
    placed = (
        ranged.withColumns({"_cum": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_place": F.row_number().over(w)})
        .join(F.broadcast(starts), "_range")  # one row a range
        .withColumns({"_cum": F.col("_cum") + F.col("_bytes"), "_place": F.col("_place") + F.col("_rows")})
        .withColumn("shard", F.expr(f"cast(least({n_shards - 1}, ((2 * _cum - size) * {n_shards}) div {2 * max(total, 1)}) as int)"))
        .select(id_col, "size", "text_crc32", "shard", "_place")
    )
    placed = materialize(placed, "placed")
    counts, first, at = dict(placed.groupBy("shard").count().collect()), [], 1
    for k in range(n_shards):
        first.append(F.lit(at))
        at += counts.get(k, 0)
    return placed.withColumn("slot", F.col("_place") - F.get(F.array(*first), F.col("shard"))).drop("_place")
