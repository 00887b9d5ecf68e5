"""Rolling, lagging, crossing, event and running operators as window columns.

All share one window specification by source and time, so that Spark sorts once for all of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.scalar import ge, gt, le, lt

def by() -> WindowSpec:
    return Window.partitionBy("source").orderBy("time")


def running() -> WindowSpec:
    return by().rowsBetween(Window.unboundedPreceding, 0)


def rows(n: int) -> WindowSpec:
    return by().rowsBetween(-(n - 1), 0)


def full(x: Column, n: int, value: Column) -> Column:
    """value where the last n samples of x are all there."""
    return F.when(F.count(x).over(rows(n)) == n, value)


def prepared(bars: DataFrame, anchor: Column | None = None) -> DataFrame:
    """bars with what some operators read: _i (row number), _tp and _tp0 (typical price, now and before), _c0 (close before),
    _traded (close before among rows with close and volume); with an anchor also _anchor, _epoch (running number of anchors)
    and _e (running number of rows whose anchor isn't NULL)."""
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    traded = F.when(F.col("close").isNotNull() & F.col("volume").isNotNull(), F.col("close"))
    before = by().rowsBetween(Window.unboundedPreceding, -1)
    out = bars.withColumns({"_i": F.row_number().over(by()), "_tp": tp, "_tp0": F.lag(tp).over(by()), "_c0": F.lag("close").over(by()), "_traded": F.last(traded, True).over(before)})
    if anchor is None:
        return out
    out = out.withColumn("_anchor", anchor)
    return out.withColumns({"_epoch": F.sum(F.when(F.col("_anchor"), 1).otherwise(0)).over(running()), "_e": F.count("_anchor").over(running())})


def ratio(a: Column, b: Column, zero: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(zero)).otherwise(a / F.nullif(b, F.lit(0.0)))


def lag(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(by())


def place() -> Column:
    """The 0-based number of a row in its source."""
    return F.row_number().over(by()) - 1


# lag and rate of change


def change(x: Column, n: int) -> Column:
    return x - lag(x, n)


def roc(x: Column, n: int = 10) -> Column:
    return rocp(x, n) * 100


def rocp(x: Column, n: int = 10) -> Column:
    p = lag(x, n)
    return F.when(p != 0, (x - p) / F.nullif(p, F.lit(0.0)))


def rocr(x: Column, n: int = 10) -> Column:
    p = lag(x, n)
    return F.when(p != 0, x / F.nullif(p, F.lit(0.0)))


def rocr100(x: Column, n: int = 10) -> Column:
    return rocr(x, n) * 100


# rolling, one input


def sma(x: Column, n: int) -> Column:
    return full(x, n, F.avg(x).over(rows(n)))


def total(x: Column, n: int = 30) -> Column:
    return full(x, n, F.sum(x).over(rows(n)))


def highest(x: Column, n: int = 30) -> Column:
    return full(x, n, F.max(x).over(rows(n)))


def lowest(x: Column, n: int = 30) -> Column:
    return full(x, n, F.min(x).over(rows(n)))


def midpoint(x: Column, n: int = 14) -> Column:
    return (highest(x, n) + lowest(x, n)) / 2


def _by_weights(x: Column, weights: list[float]) -> Column:
    """Weights from the newest sample back."""
    n = len(weights)
    value = sum((lag(x, k) if k else x) * w for k, w in enumerate(weights)) / sum(weights)
    return full(x, n, value)


def wma(x: Column, n: int = 30) -> Column:
    return _by_weights(x, [float(n - k) for k in range(n)])


def trima(x: Column, n: int = 30) -> Column:
    """Weights rise to the middle and fall again."""
    return _by_weights(x, [float(min(k + 1, n - k)) for k in range(n)])


def highest_bars(x: Column, n: int) -> Column:
    """Bars since the maximum of the window, the newest if several."""
    w = F.reverse(F.collect_list(x).over(rows(n)))
    return full(x, n, (F.array_position(w, F.array_max(w)) - 1).cast("double"))


def lowest_bars(x: Column, n: int) -> Column:
    w = F.reverse(F.collect_list(x).over(rows(n)))
    return full(x, n, (F.array_position(w, F.array_min(w)) - 1).cast("double"))


def max_index(x: Column, n: int = 30) -> Column:
    return place() - highest_bars(x, n)


def min_index(x: Column, n: int = 30) -> Column:
    return place() - lowest_bars(x, n)


def rising(x: Column, n: int) -> Column:
    """Above each of the n samples before, from the newest back: false at the first that isn't below, NULL at a missing one before that."""
    return _above_all(x, n, lambda a, b: a > b)


def falling(x: Column, n: int) -> Column:
    return _above_all(x, n, lambda a, b: a < b)


def _above_all(x: Column, n: int, beats: Callable[[Column, Column], Column]) -> Column:
    out = F.lit(True)
    for k in range(n, 0, -1):  # the newest is decided last, so it comes first
        out = F.when(lag(x, k).isNull(), None).when(~beats(x, lag(x, k)), False).otherwise(out)
    return F.when(x.isNotNull() & (F.count(F.lit(1)).over(rows(n + 1)) == n + 1), out)


def avgdev(x: Column, n: int = 14) -> Column:
    w, mean = F.collect_list(x).over(rows(n)), F.avg(x).over(rows(n))
    return full(x, n, F.aggregate(w, F.lit(0.0), lambda t, v: t + F.abs(v - mean)) / n)


def var(x: Column, n: int = 5) -> Column:
    return full(x, n, F.var_pop(x).over(rows(n)))


def stddev(x: Column, n: int = 5, deviations: float = 1.0) -> Column:
    return full(x, n, F.stddev_pop(x).over(rows(n)) * deviations)


def zscore(x: Column, n: int = 20) -> Column:
    return full(x, n, ratio(x - F.avg(x).over(rows(n)), F.stddev_pop(x).over(rows(n))))


def percentile(x: Column, n: int = 20, percentage: float = 50.0) -> Column:
    return full(x, n, F.percentile(x, min(100.0, max(0.0, percentage)) / 100).over(rows(n)))


def ulcer_index(x: Column, n: int = 14) -> Column:
    start = F.struct(F.lit(-math.inf).alias("peak"), F.lit(0.0).alias("sum"))

    def step(t: Column, v: Column) -> Column:
        peak = F.greatest(t["peak"], v)
        return F.struct(peak.alias("peak"), (t["sum"] + F.when(peak == 0, 0.0).otherwise(F.pow(100 * (v - peak) / F.nullif(peak, F.lit(0.0)), F.lit(2)))).alias("sum"))

    return full(x, n, F.sqrt(F.aggregate(F.collect_list(x).over(rows(n)), start, step)["sum"] / n))


def regression(x: Column, n: int = 14) -> tuple[Column, Column]:
    """Slope and intercept of the last n samples on 0 to n - 1, oldest first."""
    slope, mean = F.regr_slope(x, _row()).over(rows(n)), F.avg(x).over(rows(n))
    return full(x, n, slope), full(x, n, mean - slope * (n - 1) / 2)


def _row() -> Column:
    """The row's number as a column made before the windows (see prepared)."""
    return F.col("_i")


def linearreg(x: Column, n: int = 14) -> Column:
    slope, start = regression(x, n)
    return start + slope * (n - 1)


def tsf(x: Column, n: int = 14) -> Column:
    slope, start = regression(x, n)
    return start + slope * n


def linearreg_angle(x: Column, n: int = 14) -> Column:
    return F.degrees(F.atan(regression(x, n)[0]))


# rolling, several inputs


def midprice(n: int = 14) -> Column:
    return (highest(F.col("high"), n) + lowest(F.col("low"), n)) / 2


def willr(n: int = 14) -> Column:
    top, bottom = highest(F.col("high"), n), lowest(F.col("low"), n)
    return ratio(-100 * (top - F.col("close")), top - bottom)


def correl(x: Column, y: Column, n: int = 30) -> Column:
    both = F.when(x.isNotNull() & y.isNotNull(), 1)
    sums = [F.sum(v).over(rows(n)) for v in (x, y, x * x, y * y, x * y)]
    under = (n * sums[2] - sums[0] * sums[0]) * (n * sums[3] - sums[1] * sums[1])
    return full(both, n, F.when(under > 0, (n * sums[4] - sums[0] * sums[1]) / F.sqrt(F.when(under > 0, under))).otherwise(0.0))


def mfi(n: int = 14) -> Column:
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    flow = tp * F.col("volume")
    up, down = F.when(F.col("_tp") > F.col("_tp0"), flow).otherwise(0.0), F.when(F.col("_tp") < F.col("_tp0"), flow).otherwise(0.0)
    pos, neg = F.sum(up).over(rows(n)), F.sum(down).over(rows(n))
    return F.when(F.count(F.when(F.col("_tp0").isNotNull(), flow)).over(rows(n)) == n, F.when(neg == 0, 100.0).otherwise(100 * pos / F.nullif(pos + neg, F.lit(0.0))))


def imi(n: int = 14) -> Column:
    d = F.col("close") - F.col("open")
    up, down = F.sum(F.greatest(d, F.lit(0.0))).over(rows(n)), F.sum(F.greatest(-d, F.lit(0.0))).over(rows(n))
    return full(d, n, ratio(100 * up, up + down))


def aroon(n: int = 14) -> tuple[Column, Column]:
    """Down and up, over n + 1 rows."""
    return tuple(100 * (n - f(F.col(c), n + 1)) / n for f, c in ((lowest_bars, "low"), (highest_bars, "high")))


def cci(n: int = 14) -> Column:
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    gap, dev = tp - F.avg(tp).over(rows(n)), avgdev(tp, n)
    return full(tp, n, ratio(gap, 0.015 * dev))


# crossings


def crossover(a: Column, b: Column) -> Column:
    """a above b now, not above before. A NaN compares as false."""
    pa, pb = lag(a), lag(b)
    return F.when(a.isNotNull() & b.isNotNull() & pa.isNotNull() & pb.isNotNull(), gt(a, b) & le(pa, pb))


def crossunder(a: Column, b: Column) -> Column:
    pa, pb = lag(a), lag(b)
    return F.when(a.isNotNull() & b.isNotNull() & pa.isNotNull() & pb.isNotNull(), lt(a, b) & ge(pa, pb))


# events


def activated(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)) & ~F.coalesce(lag(c), F.lit(False))


def deactivated(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(True)) & F.coalesce(lag(c), F.lit(False))


def state(enter: Column, leave: Column) -> Column:
    e, x = F.coalesce(enter, F.lit(False)), F.coalesce(leave, F.lit(False))
    return F.coalesce(F.last(F.when(e & ~x, True).when(x & ~e, False), True).over(running()), F.lit(False))


def bars_since(c: Column) -> Column:
    i = F.row_number().over(by())
    return F.when(c.isNotNull(), (i - F.last(F.when(c, _row()), True).over(running())).cast("double"))


def value_when(c: Column, x: Column) -> Column:
    """The last captured value; a captured NULL counts."""
    return F.when(c.isNotNull(), F.last(F.when(c, F.struct(x.alias("v"))), True).over(running())["v"])


def cum(x: Column) -> Column:
    return F.when(x.isNotNull(), F.sum(x).over(running()))


def obv() -> Column:
    """Rows without close or volume give NULL and count for nothing; the first of the others adds its volume."""
    c, v, p = F.col("close"), F.col("volume"), F.col("_traded")
    return F.when(c.isNotNull() & v.isNotNull(), F.sum(F.when(c.isNull(), 0.0).when(p.isNull(), v).when(c > p, v).when(c < p, -v).otherwise(0.0)).over(running()))


def ad() -> Column:
    wide = F.col("high") - F.col("low")
    part = F.when(wide > 0, (2 * F.col("close") - F.col("low") - F.col("high")) / F.nullif(wide, F.lit(0.0)) * F.col("volume")).otherwise(0.0)
    return F.when((wide + F.col("close") + F.col("volume")).isNotNull(), F.sum(part).over(running()))


# epochs: rows from an anchor to the next (see prepared). A row whose anchor is NULL gives NULL and isn't part of its epoch.


def epoch() -> WindowSpec:
    return Window.partitionBy("source", "_epoch").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)


def _taken(x: Column) -> Column:
    return F.when(F.col("_anchor").isNotNull(), x)


def _since(x: Column, value: Column) -> Column:
    return F.when((F.col("_epoch") > 0) & _taken(x).isNotNull(), value)


def highest_since(x: Column) -> Column:
    return _since(x, F.max(_taken(x)).over(epoch()))


def lowest_since(x: Column) -> Column:
    return _since(x, F.min(_taken(x)).over(epoch()))


def count_since(c: Column) -> Column:
    """How often c held; NULL where c is NULL."""
    return _since(c, F.sum(F.when(_taken(c), 1.0).otherwise(0.0)).over(epoch()))


def anchored_vwap(price: Column, volume: Column) -> Column:
    """From the first row, before any anchor too. A row without price or volume gives NULL and counts for nothing."""
    v = F.sum(F.when(_taken(price).isNotNull(), volume)).over(epoch())
    return F.when((v != 0) & _taken(price * volume).isNotNull(), F.sum(_taken(price * volume)).over(epoch()) / F.nullif(v, F.lit(0.0)))


def highest_bars_since(x: Column) -> Column:
    """Rows since the maximum of the epoch, the newest if several."""
    e = F.col("_e")
    return _since(x, (e - F.max(F.when(_taken(x).isNotNull(), F.struct(x.alias("x"), e.alias("e")))).over(epoch())["e"]).cast("double"))


def lowest_bars_since(x: Column) -> Column:
    return highest_bars_since(-x)


def with_value_when(df: DataFrame, c: Column, x: Column, out: str, occurrence: int = 0, since_anchor: bool = False) -> DataFrame:
    """df with the value x had at the condition's last occurrence but `occurrence`; since_anchor forgets at each anchor (see prepared).

    The occurrences are numbered among themselves by one lag, so no row carries a list of those before it.
    """
    keys = ["source", "_epoch"] if since_anchor else ["source"]
    hits = Window.partitionBy(*keys, "_hit").orderBy("time")
    rows = df.withColumn("_hit", F.coalesce(_taken(c) if since_anchor else c, F.lit(False)))
    rows = rows.withColumn("_caught", F.when(F.col("_hit"), F.struct(F.lag(x, occurrence).over(hits).alias("v"))))
    last = F.last("_caught", True).over(Window.partitionBy(*keys).orderBy("time").rowsBetween(Window.unboundedPreceding, 0))["v"]
    seen = _taken(c).isNotNull() & (F.col("_epoch") > 0) if since_anchor else c.isNotNull()
    return rows.withColumn(out, F.when(seen, last)).drop("_hit", "_caught")


# more of the above, by what they are made of


def mom(x: Column, n: int = 10) -> Column:
    return change(x, n)


def cross(a: Column, b: Column) -> Column:
    return crossover(a, b) | crossunder(a, b)


def minmax(x: Column, n: int = 30) -> tuple[Column, Column]:
    return lowest(x, n), highest(x, n)


def minmax_index(x: Column, n: int = 30) -> tuple[Column, Column]:
    return min_index(x, n), max_index(x, n)


def trange() -> Column:
    """The range of a row with the close before it (see prepared); NULL in the first row."""
    h, lo, p = F.col("high"), F.col("low"), F.col("_c0")
    return F.when(h.isNotNull() & lo.isNotNull() & p.isNotNull(), F.greatest(h - lo, F.abs(p - h), F.abs(p - lo)))


def donchian(n: int = 20) -> tuple[Column, Column, Column]:
    """Upper, middle, lower."""
    top, bottom = highest(F.col("high"), n), lowest(F.col("low"), n)
    return top, (top + bottom) / 2, bottom


def bbands(x: Column, n: int = 5, up: float = 2.0, down: float = 2.0) -> tuple[Column, Column, Column]:
    """Upper, middle, lower round the plain mean."""
    m, d = sma(x, n), stddev(x, n)
    return m + up * d, m, m - down * d


def accbands(n: int = 20) -> tuple[Column, Column, Column]:
    """Upper, middle, lower: means of prices widened by their relative range."""
    h, lo = F.col("high"), F.col("low")
    wide = F.when(h + lo == 0, 0.0).otherwise(4 * (h - lo) / F.nullif(h + lo, F.lit(0.0)))
    return sma(h * (1 + wide), n), sma(F.col("close"), n), sma(lo * (1 - wide), n)


def aroon_osc(n: int = 14) -> Column:
    down, up = aroon(n)
    return up - down


def apo(x: Column, fast: int = 12, slow: int = 26) -> Column:
    """Of plain means."""
    return sma(x, min(fast, slow)) - sma(x, max(fast, slow))


def ppo(x: Column, fast: int = 12, slow: int = 26) -> Column:
    m = sma(x, max(fast, slow))
    return ratio(100 * (sma(x, min(fast, slow)) - m), m)


def with_returns(df: DataFrame, **of: Column) -> DataFrame:
    """df with the one-row returns of columns; after a zero the return counts as 0."""
    return df.withColumns({k: F.when(lag(x) == 0, 0.0).otherwise(x / F.nullif(lag(x), F.lit(0.0)) - 1) for k, x in of.items()})


def beta(x: Column, y: Column, n: int = 5) -> Column:
    """The slope of y on x over n rows; both are returns (see with_returns)."""
    sx, sy, sxx, sxy = (F.sum(v).over(rows(n)) for v in (x, y, x * x, x * y))
    under = n * sxx - sx * sx
    return full(F.when(x.isNotNull() & y.isNotNull(), 1), n, ratio(n * sxy - sx * sy, under))
