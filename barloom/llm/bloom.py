"""Blocked Bloom filters built and tested with DataFrame functions only.

A key's 64-bit hash picks a block of 32,768 bits and two bits in it. A filter is a table (block, bits), one row a block,
with BITS_PER_KEY bits or more for each key at any size. RANGE_BITS is the proven bound of what is broadcast at once: a
larger filter is cut into ranges of blocks, and a test goes range by range, each with the rows of that range only.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BLOCK_BITS = 32_768
BITS_PER_KEY = 16
RANGE_BITS = 1 << 28

Filter = tuple[DataFrame, int]


def blocks_for(n_keys: int) -> int:
    bits = BLOCK_BITS
    while bits < BITS_PER_KEY * n_keys:
        bits *= 2
    return bits // BLOCK_BITS


def _places(key: Column, blocks: int) -> tuple[Column, Column, Column]:
    h = F.xxhash64(key)
    bit = lambda shift: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(BLOCK_BITS - 1))
    return F.pmod(h, F.lit(blocks)), bit(34), bit(49)


def _bitmaps(df: DataFrame, key: str, blocks: int, least: int) -> DataFrame:
    """The bits that `least` rows or more set: counted by bit, combined before the shuffle; then each block's in one place."""
    block, one, two = _places(F.col(key), blocks)
    slot = lambda bit: block * BLOCK_BITS + bit
    taken = df.select(F.explode(F.array(slot(one), slot(two))).alias("_slot")).groupBy("_slot").count().where(F.col("count") >= least)
    bits = taken.select(F.expr(f"_slot div {BLOCK_BITS}").alias("_block"), (F.col("_slot") % BLOCK_BITS).alias("_bit")).repartition("_block")
    return bits.groupBy("_block").agg(F.expr("bitmap_construct_agg(_bit)").alias("_bits"))


def filter_of_repeated(df: DataFrame, key: str, n_keys: int) -> Filter:
    """First pass: the bits that two rows or more set. A key with both its bits here may be repeated; others occur once."""
    blocks = blocks_for(n_keys)
    return _bitmaps(df, key, blocks, 2), blocks


def filter_of(df: DataFrame, key: str, n_keys: int) -> Filter:
    """The bits that any row sets."""
    blocks = blocks_for(n_keys)
    return _bitmaps(df, key, blocks, 1), blocks


def written(make: Callable[[DataFrame, str, int], Filter], df: DataFrame, key: str) -> Filter:
    """The filter that make() gives of all rows of df, written once."""
    table, blocks = make(df, key, df.count())
    return materialize(table, "filter"), blocks


def _tested(df: DataFrame, key: str, table: DataFrame, blocks: int, flag: str) -> DataFrame:
    block, one, two = _places(F.col(key), blocks)

    def is_set(bit: Column) -> Column:
        byte = F.substring("_bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
        return F.call_function("shiftright", F.conv(F.hex(byte), 16, 10).cast("int"), bit.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1

    joined = df.withColumn("_block", block).join(F.broadcast(table), "_block", "left")
    return joined.withColumn(flag, F.coalesce(is_set(one) & is_set(two), F.lit(False))).drop("_block", "_bits")


def test(df: DataFrame, key: str, found: Filter, flag: str) -> DataFrame:
    """Second pass: df with a boolean, false only where the filter rules the key out. No row is shuffled.

    A filter of several ranges is tested one range after the other, each written before the next is broadcast.
    """
    table, blocks = found
    per = RANGE_BITS // BLOCK_BITS
    if blocks <= per:
        return _tested(df, key, table, blocks, flag)
    mine = F.floor(_places(F.col(key), blocks)[0] / per)
    part = lambda k: _tested(df.where(mine == k), key, table.where(F.floor(F.col("_block") / per) == k), blocks, flag)
    return functools.reduce(DataFrame.union, [materialize(part(k), "tested") for k in range(blocks // per)])
