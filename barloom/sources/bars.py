"""OHLCV bars: (source, time, open, high, low, close, volume), time being the open time in UTC milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MINUTE = 60_000
FIXED_MS = {"1s": 1_000, "1m": MINUTE, "3m": 3 * MINUTE, "5m": 5 * MINUTE, "15m": 15 * MINUTE, "30m": 30 * MINUTE, "1h": 60 * MINUTE, "2h": 120 * MINUTE, "4h": 240 * MINUTE, "6h": 360 * MINUTE, "8h": 480 * MINUTE, "12h": 720 * MINUTE, "1d": 1440 * MINUTE, "3d": 4320 * MINUTE, "1w": 7 * 1440 * MINUTE}
#: Monday 1970-01-05.
MONDAY = 4 * 1440 * MINUTE


def bucket_open(time: Column, interval: str) -> Column:
    """The open time of the bucket that holds a time; weeks open on Mondays, months on their first day."""
    if interval == "1M":
        return F.unix_millis(F.date_trunc("MONTH", F.timestamp_millis(time)))
    shift, ms = (MONDAY if interval == "1w" else 0), FIXED_MS[interval]
    return (F.floor((time - shift) / ms) * ms + shift).cast("long")


def next_open(time: Column, interval: str) -> Column:
    """The open time of the bucket after the one that opens at time."""
    if interval == "1M":
        return F.unix_millis(F.timestamp_millis(time) + F.expr("INTERVAL 1 MONTH"))
    return time + FIXED_MS[interval]


def opens(first: Column, last: Column, interval: str) -> Column:
    """The array of open times from first to last."""
    if interval == "1M":
        return F.transform(F.sequence(F.timestamp_millis(first), F.timestamp_millis(last), F.expr("INTERVAL 1 MONTH")), F.unix_millis)
    return F.sequence(first, last, F.lit(FIXED_MS[interval]))


def resample(bars: DataFrame, interval: str, auxiliary: tuple[str, ...] = ()) -> DataFrame:
    """Bars of a longer interval, a trailing part included; one partial aggregation and one shuffle. Auxiliary fields: the last value that isn't NULL."""
    at = F.struct("time", "open", "close")
    out = bars.groupBy("source", bucket_open(F.col("time"), interval).alias("bucket")).agg(
        F.min(at)["open"].alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max(at)["close"].alias("close"), F.sum("volume").alias("volume"),
        *[F.max(F.when(F.col(c).isNotNull(), F.struct("time", c)))[c].alias(c) for c in auxiliary],
    )
    return out.withColumnRenamed("bucket", "time")


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order prices, one source for each priority; volume is the number of orders."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = (F.unix_date(F.to_date("o_orderdate")).cast("long") * FIXED_MS["1d"]).alias("time")
    at = F.struct("o_orderkey", "o_totalprice")
    return o.groupBy(F.col("o_orderpriority").alias("source"), day).agg(
        F.min(at)["o_totalprice"].alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max(at)["o_totalprice"].alias("close"), F.count("*").cast("double").alias("volume"),
    )


def invalid_bars(bars: DataFrame, interval: str) -> DataFrame:
    """Rows off the interval's grid or repeated, with the reason. (Rows of a table have no order that could be wrong.)"""
    return bars.withColumn("reason", _fault(interval)).where("reason is not null").select("source", "time", "reason")


def _fault(interval: str) -> Column:
    time = F.col("time").cast("double")
    whole = F.when((time == F.floor(time)) & (F.abs(time) < 2.0**53), F.col("time").cast("long"))
    repeated = F.count("*").over(Window.partitionBy("source", "time")) > 1
    return F.when(whole.isNull() | (whole != bucket_open(whole, interval)), "unaligned").when(repeated, "repeated")


def validated(bars: DataFrame, interval: str) -> DataFrame:
    """bars; reading a row that invalid_bars() would give raises an error. The check is part of the plan."""
    said = F.concat(F.lit(f"{interval} bar of "), F.coalesce("source", F.lit("NULL")), F.lit(" at "), F.coalesce(F.col("time").cast("string"), F.lit("NULL")), F.lit(" is "), F.col("_fault"))
    checked = F.when(F.col("_fault").isNull(), F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))
    return bars.withColumn("_fault", _fault(interval)).where(checked).drop("_fault")


def densify(bars: DataFrame, samples: DataFrame, interval: str, value: str) -> DataFrame:
    """bars with the last sample (source, time, value) before each bar closes."""
    close = next_open(F.col("time"), interval)
    rows = bars.withColumns({"_at": close, "_bar": F.lit(1), value: F.lit(None).cast("double")}).unionByName(samples.select("source", "time", value).withColumns({"_at": F.col("time") + 1, "_bar": F.lit(0)}), True)
    w = Window.partitionBy("source").orderBy("_at", "_bar").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, True).over(w)).where("_bar = 1").drop("_at", "_bar")


def overlay(base: DataFrame, over: DataFrame, field: str) -> DataFrame:
    """base with field from over where that is finite, by source and time; times of either side stay."""
    new = over.select("source", "time", F.when(~F.isnan(field) & (F.abs(field) != float("inf")), F.col(field)).alias("_new"))
    return base.join(new, ["source", "time"], "full").withColumn(field, F.coalesce("_new", field)).drop("_new")
