"""Named feeds: which alias has bars of which interval, checked when a plan is made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bars import FIXED_MS, resample

#: Intervals from short to long.
INTERVALS = [*sorted(FIXED_MS, key=FIXED_MS.get), "1M"]


class Feeds:
    """Aliases with bars of a base interval, and longer intervals that are declared for them.

    add() takes what is given; an alias may also be an execution target. use() declares an interval, taken from a feed that
    is given or else aggregated from the base; a shorter one than the base is rejected.
    """

    def __init__(self, base: str) -> None:
        self.base = base
        self.given: dict[tuple[str, str], DataFrame] = {}
        self.declared: dict[tuple[str, str], tuple[str, ...]] = {}
        self.targets: list[str] = []

    def add(self, alias: str, bars: DataFrame, interval: str | None = None, target: bool = False) -> Feeds:
        key = (alias, interval or self.base)
        if key in self.given:
            raise ValueError(f"feed {key} is given twice")
        self.given[key] = bars.drop("source").withColumn("source", F.lit(alias))
        self.declared.setdefault((alias, self.base), ())
        if target:
            self.targets.append(alias)
        return self

    def use(self, alias: str, interval: str, *auxiliary: str) -> Feeds:
        if INTERVALS.index(interval) < INTERVALS.index(self.base):
            raise ValueError(f"{interval} is shorter than the base interval {self.base}")
        self.declared[alias, interval] = auxiliary
        return self

    def check(self) -> Feeds:
        """Raises for aliases without base bars, and for feeds that are given but not declared."""
        if lacking := sorted({a for a, _ in self.declared if (a, self.base) not in self.given}):
            raise ValueError(f"no {self.base} bars of {', '.join(lacking)}")
        if odd := sorted(set(self.given) - set(self.declared)):
            raise ValueError(f"feeds that nothing uses: {odd}")
        return self

    def bars(self, alias: str, interval: str | None = None) -> DataFrame:
        """The bars of an alias; the base interval by another name is the base feed itself."""
        key = (alias, interval or self.base)
        if key not in self.declared:
            raise ValueError(f"{key} isn't declared")
        return self.given[key] if key in self.given else resample(self.given[alias, self.base], key[1], self.declared[key])

    def all_bars(self) -> DataFrame:
        """Base bars of all aliases, one table; current_execution is the alias where it is a target."""
        out = None
        for (_, interval), bars in self.given.items():
            if interval == self.base:
                out = bars if out is None else out.unionByName(bars, True)
        if out is None:
            raise ValueError("no feed is given")
        return out.withColumn("current_execution", F.when(F.col("source").isin(self.targets), F.col("source")))


def window(bars: DataFrame, start: int, end: int) -> DataFrame:
    """Bars that open within [start, end)."""
    return bars.where((F.col("time") >= start) & (F.col("time") < end))


def scalar_field(bars: DataFrame, name: str) -> DataFrame:
    """The close of a feed as one field (a mark price, say), to overlay or densify others with."""
    return bars.select("source", "time", F.col("close").alias(name))


def save(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Writes a result as files of a kind (parquet, json, csv), one for each partition."""
    df.write.mode(mode).format(kind).save(path)
