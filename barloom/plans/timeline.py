"""The union timeline of sources, and longer intervals seen without looking ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.bars import next_open, opens


def union_timeline(bars: DataFrame) -> DataFrame:
    """The distinct open times of all sources."""
    return bars.select("time").distinct()


def align(bars: DataFrame, sources: list[str], field: str = "close") -> DataFrame:
    """A row for each time of any source and a column for each source, NULL where it has no bar: one grouped pivot."""
    return bars.groupBy("time").pivot("source", sources).agg(F.first(field))


def attach_longer(base: DataFrame, longer: DataFrame, base_interval: str, long_interval: str, fields: list[str]) -> DataFrame:
    """base with the fields of the last bar of the longer interval that has closed by the close of the base bar.

    Opens that are expected but missing count as NULL bars. One window by source, no range join. An interval equal to the
    base's shows the base bar itself.
    """
    values = F.struct(*fields)
    ends = base.groupBy("source").agg(F.max("time").alias("_end"))
    span = longer.groupBy("source").agg(F.min("time").alias("_lo")).join(ends, "source")
    expected = span.select("source", F.explode(opens(F.col("_lo"), F.greatest("_lo", "_end"), long_interval)).alias("time"))
    seen = expected.join(longer.select("source", "time", values.alias("_v")), ["source", "time"], "left").select("source", F.struct("_v").alias("_box"), next_open(F.col("time"), long_interval).alias("_at"), F.lit(0).alias("_base"))
    rows = base.withColumns({"_at": next_open(F.col("time"), base_interval), "_base": F.lit(1)}).unionByName(seen, True)
    w = Window.partitionBy("source").orderBy("_at", "_base").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_last", F.last("_box", True).over(w)).where("_base = 1")
    return out.select(*base.columns, *[F.col(f"_last._v.{f}").alias(f"{long_interval}_{f}") for f in fields])


def diagnostics(bars: DataFrame) -> DataFrame:
    """By source: bars it has, and steps of the union timeline without one."""
    steps = union_timeline(bars).agg(F.count("*")).scalar()  # a subquery of the plan
    return bars.groupBy("source").agg(F.countDistinct("time").alias("actual")).withColumn("gaps", steps - F.col("actual"))
