"""Reports on equity curves, trades and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import by, running

YEAR_MS = 365.25 * 86_400_000


def sharpe(equity: DataFrame) -> DataFrame:
    """By source: the annualised Sharpe ratio, by the median step between points; NULL with few or flat returns."""
    r = equity.select("source", "time", (F.col("equity") / F.nullif(F.lag("equity").over(by()), F.lit(0.0)) - 1).alias("r"), (F.col("time") - F.lag("time").over(by())).alias("d"))
    out = r.groupBy("source").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.percentile("d", 0.5).alias("d"), F.count("r").alias("n"))
    return out.select("source", F.when((F.col("n") >= 2) & (F.col("s") * F.col("s") > 1e-9), F.col("m") / F.col("s") * F.sqrt(YEAR_MS / F.col("d"))).alias("sharpe"))


def drawdown(equity: DataFrame) -> DataFrame:
    """By source: the largest absolute drawdown, the longest run of points below a peak (islands between new peaks), the run at
    the end (which is also the longest stagnation since the last peak), and the mean length of runs that ended."""
    top = equity.withColumn("_peak", F.max("equity").over(running()))
    top = top.withColumn("_island", F.sum(F.when(F.col("equity") >= F.col("_peak"), 1).otherwise(0)).over(running()))
    runs = top.groupBy("source", "_island").agg(F.max(F.col("_peak") - F.col("equity")).alias("drop"), F.sum(F.when(F.col("equity") < F.col("_peak"), 1).otherwise(0)).alias("bars"))
    last = F.max(F.struct("_island", "bars"))
    runs = runs.withColumn("_ended", F.lead("_island").over(Window.partitionBy("source").orderBy("_island")).isNotNull())
    mean = F.avg(F.when(F.col("_ended") & (F.col("bars") > 0), F.col("bars")))
    return runs.groupBy("source").agg(
        F.max("drop").alias("max_drawdown"), F.max("bars").alias("longest_drawdown"), last["bars"].alias("current_drawdown"), last["bars"].alias("longest_stagnation"), F.coalesce(mean, F.lit(0.0)).alias("mean_recovery"),
    )


def forward_returns(bars: DataFrame, horizons: tuple[int, ...] = (1, 6, 24)) -> DataFrame:
    """close some bars on over close; beyond the end the last close, and not complete."""
    last = F.last("close").over(by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cols = {f"forward_{h}": F.coalesce(F.lead("close", h).over(by()), last) / F.col("close") - 1 for h in horizons}
    return bars.withColumns(cols | {f"complete_{h}": F.lead("close", h).over(by()).isNotNull() for h in horizons})


def export_stats(df: DataFrame, value: str, **at: Column) -> DataFrame:
    """By source: samples, missing ones, least, greatest and mean; and the mean where each condition of `at` holds (entries, exits)."""
    means = [F.avg(F.when(c, F.col(value))).alias(f"mean_at_{k}") for k, c in at.items()]
    return df.groupBy("source").agg(F.count("*").alias("samples"), F.count(F.when(F.col(value).isNull(), 1)).alias("missing"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.avg(value).alias("mean"), *means)


def overlap(a: Column, b: Column) -> list[Column]:
    """Counts of two flags being both on, one on, none on."""
    n = lambda c: F.count(F.when(c, 1))
    return [n(a & b).alias("both"), n(a & ~b).alias("only_a"), n(~a & b).alias("only_b"), n(~a & ~b).alias("neither")]


def overlap_of(a: DataFrame, b: DataFrame, flag: str = "flag") -> DataFrame:
    """overlap() of flags of two tables (source, time, flag), by source; times of either side count, as missing in the other."""
    both = a.select("source", "time", F.col(flag).alias("_a")).join(b.select("source", "time", F.col(flag).alias("_b")), ["source", "time"], "full")
    return both.groupBy("source").agg(*overlap(F.col("_a"), F.col("_b")), F.count(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1)).alias("missing"))


def held_bucket(bars_held: Column) -> Column:
    """Holding times of 0-1, 2-5, 6-15, 16-31 and 32 bars or more."""
    return F.when(bars_held < 2, "0-1").when(bars_held < 6, "2-5").when(bars_held < 16, "6-15").when(bars_held < 32, "16-31").otherwise("32+")


def segments(n: int, train: int, test: int, step: int) -> list[tuple[int, int, int, int]]:
    """Walk-forward segments: (number, start, test start, end)."""
    return [(k, s, s + train, s + train + test) for k, s in enumerate(range(0, max(0, n - train - test + 1), step))]
