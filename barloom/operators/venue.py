"""Choice among sources at one time: rows of (time, source, price), ranked within the time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(bars: DataFrame, sources: list[str], price: str = "close") -> DataFrame:
    """rank_asc and rank_desc of each source with a price; ties go by the order of sources."""
    order = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source"))
    rows = bars.where(F.col("source").isin(sources) & F.col(price).isNotNull()).withColumn("_arg", order)
    at = Window.partitionBy("time")
    up, down = (F.row_number().over(at.orderBy(p, "_arg")) for p in (F.col(price), F.col(price).desc()))
    return rows.withColumns({"rank_asc": up, "rank_desc": down}).drop("_arg")


def selected(bars: DataFrame, sources: list[str], rank: int, descending: bool = False, price: str = "close") -> DataFrame:
    """The source at a rank (from 1) of each time; NULL where fewer have a price, and for every time if rank is no whole number from 1."""
    place = F.col("rank_desc" if descending else "rank_asc")
    hit = (place == rank) if rank == int(rank) and rank >= 1 else F.lit(False)
    return ranked(bars, sources, price).groupBy("time").agg(F.max(F.when(hit, F.col("source"))).alias("selected"))


def in_top_n(n: int) -> Column:
    """Of ranked(): among the n highest."""
    return F.col("rank_desc") <= n


def in_bottom_n(n: int) -> Column:
    return F.col("rank_asc") <= n


def chosen(bars: DataFrame, sources: list[str], price: str = "close") -> DataFrame:
    """cheapest and richest source of each time: a grouped minimum, combined before the shuffle."""
    order = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source"))
    rows = bars.where(F.col("source").isin(sources) & F.col(price).isNotNull())
    pick = lambda p: F.min(F.struct(p.alias("p"), order.alias("o"), F.col("source").alias("s")))["s"]
    return rows.groupBy("time").agg(pick(F.col(price)).alias("cheapest"), pick(-F.col(price)).alias("richest"))


def spread_bps(buy: Column, sell: Column) -> Column:
    return F.when(buy > 0, (sell - buy) / F.nullif(buy, F.lit(0.0)) * 10_000)
