"""Grids of parameters, walk-forward segments, and reports on trades, flags and coverage.

Runs (a candidate, a segment) are made by exploding each row into the runs it takes part in, without a join: rows grow by the
number of candidates, which MAX_CANDIDATES bounds, or by (train + test) / step. A run is scored by the returns of the bars in
which its position is held: windows and grouped sums over (source, run), so that runs of one source go side by side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import analytics
from .windows import by

MAX_CANDIDATES = 10_000


def grid(df: DataFrame, **values: list[float]) -> DataFrame:
    """df once for each combination of values, with its number as candidate; the last parameter varies fastest."""
    n = math.prod(map(len, values.values()))
    if not 0 < n <= MAX_CANDIDATES:
        raise ValueError(f"a grid has 1 to {MAX_CANDIDATES} candidates, not {n}")
    cols, stride = {}, 1
    for name, options in reversed(values.items()):
        k = F.pmod(F.floor(F.col("candidate") / stride), F.lit(len(options))).cast("int")
        cols[name] = F.element_at(F.array(*map(F.lit, options)), k + 1)
        stride *= len(options)
    return df.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns(cols)


def walk_forward(df: DataFrame, train: int, test: int, step: int) -> DataFrame:
    """df's rows once for each complete segment that holds them, with segment (from 0) and held_out (in its last test rows)."""
    if min(train, test, step) < 1:
        raise ValueError("train, test and step are positive")
    i, n, span = F.col("_i"), F.col("_n"), train + test
    rows = df.withColumns({"_i": F.row_number().over(by()) - 1, "_n": F.count("*").over(Window.partitionBy("source"))})
    first = F.greatest(F.lit(0), F.ceil((i - span + 1) / step)).cast("int")
    last = F.least(F.floor(i / step), F.floor((n - span) / step)).cast("int")
    rows = rows.withColumns({"_first": first, "_last": last}).where("_first <= _last and _n >= " + str(span))
    out = rows.withColumn("segment", F.explode(F.sequence("_first", "_last")))
    return out.withColumn("held_out", i - F.col("segment") * step >= train).drop("_i", "_n", "_first", "_last")


def positions(df: DataFrame, held: Column, before: Column, value: str = "close") -> DataFrame:
    """df with r, the return of a bar whose bar before ended with a position (else 0), and entry, whether it was new there.

    held and before: whether there was a position at the end of the bar before, and of the one before that (NULL: none).
    """
    on, was = F.coalesce(held, F.lit(False)), F.coalesce(before, F.lit(False))
    gain = F.col(value) / F.nullif(F.lag(value).over(by()), F.lit(0.0)) - 1
    return df.withColumns({"_gain": gain}).withColumns({"r": F.when(on, F.coalesce("_gain", F.lit(0.0))).otherwise(0.0), "entry": on & ~was}).drop("_gain")


def scores(rows: DataFrame, *runs: str, capital: float = 10_000.0) -> DataFrame:
    """By source and run of rows (time, r, entry): trades, share of winners, return, ending equity, largest drawdown, objectives."""
    w = Window.partitionBy("source", *runs).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_g", F.log1p("r")).withColumns({"_sum": F.sum("_g").over(w), "_trade": F.count(F.when(F.col("entry"), 1)).over(w)})
    out = out.withColumn("_fall", capital * (F.exp(F.greatest(F.lit(0.0), F.max("_sum").over(w))) - F.exp("_sum")))
    trades = out.groupBy("source", *runs, "_trade").agg(F.sum("_g").alias("g"), F.max("_fall").alias("fall"))
    won = F.count(F.when((F.col("_trade") > 0) & (F.col("g") > 0), 1))
    n = F.count(F.when(F.col("_trade") > 0, 1))
    out = trades.groupBy("source", *runs).agg(n.alias("trades"), F.when(n > 0, won / n).otherwise(0.0).alias("win_rate"), F.sum("g").alias("growth"), F.max("fall").alias("max_drawdown"))
    out = out.withColumns({"total_return": F.exp("growth") - 1, "ending_equity": capital * F.exp("growth")})
    fall = F.col("max_drawdown") / capital
    lost, idle = (F.col("total_return") < 0).cast("double"), (F.col("trades") == 0).cast("double")
    return out.withColumns({"return_over_drawdown": F.when(fall > 0, F.col("total_return") / fall), "robust_return": robust_return(F.col("total_return"), fall, lost, idle)})


def robust_return(total: Column, drawdown: Column, negative: Column, idle: Column) -> Column:
    """Return less half of the drawdown, a quarter of the share of losing segments and a tenth of that without trades."""
    return total - 0.5 * drawdown - 0.25 * negative - 0.1 * idle


def best(scored: DataFrame, objective: str, top: int, *keys: str, passed: Column | None = None) -> DataFrame:
    """By keys (source, if none), the top candidates: those that pass constraints first, then score and equity, falling; then the number."""
    order = [] if passed is None else [passed.cast("int").desc_nulls_last()]
    order += [F.col(objective).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in ("ending_equity",) if c in scored.columns], F.col("candidate")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*(keys or ("source",))).orderBy(*order))).where(F.col("rank") <= top)


def drift_flags(segments: DataFrame) -> DataFrame:
    """segments (source, trades, wins, total_return, max_drawdown, stitched_drawdown) with flags of those that fare worse than all."""
    whole = Window.partitionBy("source")
    trades, rate = F.sum("trades").over(whole), F.sum("wins").over(whole) / F.nullif(F.sum("trades").over(whole), F.lit(0))
    own = F.col("wins") / F.nullif(F.col("trades"), F.lit(0))
    return segments.withColumns({
        "zero_trades": F.col("trades") == 0, "negative_return": F.col("total_return") < -1e-9, "high_drawdown": F.col("max_drawdown") > F.greatest("stitched_drawdown", F.lit(1.0)),
        "win_rate_collapse": F.coalesce((trades > 0) & (F.col("trades") > 0) & (own + 0.15 < rate), F.lit(False)),
    })


def baseline(scored: DataFrame, bars: DataFrame, value: str = "close") -> DataFrame:
    """scored with the return of holding the asset over all bars, and what a run returned beyond cash and beyond the asset."""
    at = F.struct("time", value)
    asset = bars.groupBy("source").agg((F.max(at)[value] / F.nullif(F.min(at)[value], F.lit(0.0)) - 1).alias("asset_return"))
    out = scored.join(asset, "source", "left")
    return out.withColumns({"excess_over_cash": F.col("total_return"), "excess_over_asset": F.col("total_return") - F.col("asset_return")})


def stitched(equity: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """Held-out equity of segments (source, segment, time, equity), each scaled to start where the one before ended."""
    at = F.struct("time", "equity")
    ends = equity.groupBy("source", "segment").agg(F.min(at)["equity"].alias("_from"), F.max(at)["equity"].alias("_to"))
    before = Window.partitionBy("source").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    grown = F.exp(F.coalesce(F.sum(F.log(F.col("_to") / F.col("_from"))).over(before), F.lit(0.0)))
    return equity.join(ends.select("source", "segment", (grown * capital / F.col("_from")).alias("_scale")), ["source", "segment"]).withColumn("stitched", F.col("equity") * F.col("_scale")).drop("_scale")


def trade_groups(trades: DataFrame, pnl: str, **keys: Column) -> DataFrame:
    """By every key on its own, in one pass: trades, gains, and the sum and mean of pnl. Groups without trades are absent."""
    labels = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("label")) for k, v in keys.items()]))
    rows = trades.select(F.col(pnl).cast("double").alias("_pnl"), labels.alias("_l"))
    return rows.groupBy("_l.key", "_l.label").agg(F.count("*").alias("trades"), F.count(F.when(F.col("_pnl") > 0, 1)).alias("gains"), F.sum("_pnl").alias("total"), F.avg("_pnl").alias("mean"))


def exit_keys(time: Column, held: Column) -> dict[str, Column]:
    """The keys of trades by their exit: weekday from Monday as 0, hour, four-hour bucket, and holding time."""
    at = F.timestamp_millis(time)
    return {"weekday": F.weekday(at), "hour": F.hour(at), "four_hours": (F.floor(F.hour(at) / 4) * 4).cast("int"), "held": analytics.held_bucket(held)}


def capture(df: DataFrame, state: Column, value: str = "close") -> DataFrame:
    """By source and state at the bar before: bars, their returns compounded, and the logarithm of that as growth. NULL states and first bars count nowhere."""
    rows = df.select("source", F.lag(state).over(by()).alias("state"), (F.col(value) / F.nullif(F.lag(value).over(by()), F.lit(0.0)) - 1).alias("r")).where("state is not null")
    growth = F.sum(F.when(F.col("r") > -1, F.log1p("r")))
    return rows.groupBy("source", "state").agg(F.count("*").alias("bars"), growth.alias("growth"), (F.exp(growth) - 1).alias("compounded"))


def flag_stats(df: DataFrame, flag: Column) -> DataFrame:
    """By source: bars on, off and missing, and edges between known neighbours."""
    before = F.lag("_f").over(by())
    rows = df.select("source", "time", flag.alias("_f")).withColumns({"_up": F.col("_f") & ~before, "_down": ~F.col("_f") & before})
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("source").agg(n(F.col("_f")).alias("on"), n(~F.col("_f")).alias("off"), n(F.col("_f").isNull()).alias("missing"), n(F.col("_up")).alias("rising"), n(F.col("_down")).alias("falling"))


def forward_extremes(bars: DataFrame, horizon: int = 24) -> DataFrame:
    """The best high and the worst low of the next bars, relative to close; NULL at the last bar."""
    w = by().rowsBetween(1, horizon)
    return bars.withColumns({"favorable": F.max("high").over(w) / F.col("close") - 1, "adverse": F.min("low").over(w) / F.col("close") - 1})


def missing_windows(bars: DataFrame, interval_ms: int) -> DataFrame:
    """Half-open windows (source, start, end) between bars that lack bars of the interval."""
    rows = bars.select("source", (F.col("time") + interval_ms).alias("start"), F.lead("time").over(by()).alias("end"))
    return rows.where(F.col("end") > F.col("start"))


def maintenance(notional: Column, tiers: list[tuple[float, float | None, float, float]]) -> Column:
    """Maintenance margin by tiers (lower, upper or None, rate, amount): the literals are part of the plan, no join is needed."""
    out = F.lit(None).cast("double")
    for low, high, rate, amount in tiers:
        inside = (notional >= low) & (F.lit(True) if high is None else notional < high)
        out = F.when(inside, notional * rate - amount).otherwise(out)
    return out
