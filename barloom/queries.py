"""Queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import recursive_sql
from .functions import scalar as S
from .operators import analytics, averages, cycle, evaluate, recursive, venue
from .operators import windows as W
from .plans import timeline
from .sources import bars as B
from .sources.registry import Feeds, scalar_field, window
from .streaming import stream_bars

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def close() -> Column:
    return F.col("close")


def volume() -> Column:
    return F.col("volume")


def r(x: Column, digits: int = 5) -> Column:
    return F.round(x.cast("double"), digits)


def _out(df: DataFrame, **cols: Column) -> DataFrame:
    return df.select("source", "time", *[v.alias(k) for k, v in cols.items()])


def daily_sma_cross(spark: SparkSession, d: str) -> DataFrame:
    df = B.order_bars(spark, d).withColumn("m", W.sma(close(), 20))
    return _out(df, close=close(), sma20=r(F.col("m")), crossed=W.crossover(close(), F.col("m")), crossed_under=W.crossunder(close(), F.col("m")), zscore20=r(W.zscore(close(), 20), 4))


def weekly_bars(spark: SparkSession, d: str) -> DataFrame:
    return B.resample(B.order_bars(spark, d), "1w")


def rolling(spark: SparkSession, d: str) -> DataFrame:
    df = W.prepared(B.order_bars(spark, d))
    return _out(df, sum10=r(W.total(close(), 10), 3), wma5=r(W.wma(close(), 5), 3), trima5=r(W.trima(close(), 5), 3), hi20=W.highest(close(), 20), lo20=W.lowest(close(), 20), mid14=r(W.midpoint(close())), hb10=W.highest_bars(close(), 10), lb10=W.lowest_bars(close(), 10), imax10=W.max_index(close(), 10), rising3=W.rising(close(), 3), falling3=W.falling(close(), 3), dev14=r(W.avgdev(close()), 3), sd5=r(W.stddev(close(), 5), 3), med20=r(W.percentile(close(), 20, 50.0), 3))


def regression(spark: SparkSession, d: str) -> DataFrame:
    df = W.prepared(B.order_bars(spark, d))
    slope, start = W.regression(close(), 14)
    return _out(df, slope=r(slope, 4), intercept=r(start, 4), forecast=r(W.tsf(close(), 14), 4), value=r(W.linearreg(close(), 14), 4))


def rates(spark: SparkSession, d: str) -> DataFrame:
    return _out(B.order_bars(spark, d), change3=r(W.change(close(), 3)), roc10=r(W.roc(close())), rocp5=r(W.rocp(close(), 5)), rocr5=r(W.rocr(close(), 5)), rocr100=r(W.rocr100(close(), 5)))


def prices(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("time")
    return _out(B.order_bars(spark, d), avg=r(S.avgprice(), 4), med=r(S.medprice(), 3), typ=r(S.typprice(), 3), wcl=r(S.wclprice(), 4), bop=r(S.bop()), weekday=S.weekday_utc(t), hour=S.hour_utc(t), session=S.session_utc(t, 22, 4), div0=F.when(S.ieee_div(close() - close(), close()) == 0, 1.0), log=r(S.ln(close())), inside=S.between(close(), F.col("low"), F.col("high")), stop=r(S.trail_stop(close(), F.col("high") - F.col("low"), 1), 3))


def oscillators(spark: SparkSession, d: str) -> DataFrame:
    df = W.prepared(B.order_bars(spark, d))
    down, up = W.aroon(14)
    return _out(df, willr=r(W.willr()), cci=r(W.cci(), 3), imi=r(W.imi(), 4), mfi=r(W.mfi(), 4), aroon_up=r(up), aroon_down=r(down), correl=r(W.correl(close(), volume(), 30), 4), donchian=r(W.midprice(20), 3))


def event_memory(spark: SparkSession, d: str) -> DataFrame:
    up = close() > F.col("open")
    df = W.prepared(B.order_bars(spark, d).withColumn("c", up), anchor=volume() >= 3)
    c = F.col("c")
    return _out(df, on=W.activated(c), off=W.deactivated(c), latch=W.state(close() > 200_000, close() < 100_000), since=W.bars_since(c), last_up=W.value_when(c, close()), total=r(W.cum(close()), 2), hi=W.highest_since(close()), lo=W.lowest_since(close()), n=W.count_since(c), vwap=r(W.anchored_vwap(close(), volume()), 3), obv=W.obv(), ad=r(W.ad(), 3) + 0.0)


def venue_choice(spark: SparkSession, d: str) -> DataFrame:
    return venue.chosen(B.order_bars(spark, d), PRIORITIES)


def venue_ranks(spark: SparkSession, d: str) -> DataFrame:
    return venue.ranked(B.order_bars(spark, d), PRIORITIES).select("source", "time", "close", "rank_asc", "rank_desc", (F.col("rank_desc") <= 2).alias("in_top_2"))


def aligned(spark: SparkSession, d: str) -> DataFrame:
    out = timeline.align(B.order_bars(spark, d), PRIORITIES[:2])
    a, b = F.col(PRIORITIES[0]), F.col(PRIORITIES[1])
    return out.select("time", a.alias("a"), b.alias("b"), r(a - b, 2).alias("difference"), r(venue.spread_bps(a, b), 3).alias("bps"))


def three_day_view(spark: SparkSession, d: str) -> DataFrame:
    bars = B.order_bars(spark, d)
    return timeline.attach_longer(bars.select("source", "time", "close"), B.resample(bars, "3d"), "1d", "3d", ["close", "volume"])


def alignment_report(spark: SparkSession, d: str) -> DataFrame:
    return timeline.diagnostics(B.order_bars(spark, d))


def recursive_set(spark: SparkSession, d: str) -> DataFrame:
    c, hlc = ["close"], ["high", "low", "close"]
    makers: dict = {
        "ema": (lambda: recursive.ema(20), c, ["ema20"]), "dema": (lambda: recursive.dema(10), c, ["dema10"]), "tema": (lambda: recursive.tema(10), c, ["tema10"]), "trix": (lambda: recursive.trix(10), c, ["trix10"]),
        "kama": (lambda: recursive.kama(10), c, ["kama10"]), "rsi": (lambda: recursive.rsi(14), c, ["rsi14"]), "cmo": (lambda: recursive.cmo(14), c, ["cmo14"]), "macd": (recursive.macd, c, ["macd", "macd_signal", "macd_hist"]),
        "atr": (recursive.atr, hlc, ["atr14"]), "di": (recursive.directional, hlc, ["plus_di", "minus_di", "dx", "adx"]), "adosc": (recursive.adosc, [*hlc, "volume"], ["adosc"]), "st": (recursive.supertrend, hlc, ["supertrend", "bullish"]),
    }
    exact = ("trix10", "rsi14", "cmo14", "plus_di", "minus_di", "dx", "adx")
    return _rounded(recursive.fold(B.order_bars(spark, d), makers), dict.fromkeys(exact, 4) | {"ema20": 4, "adosc": 3}, {"supertrend"})


def _rounded(df: DataFrame, digits: dict[str, int], relative: set[str]) -> DataFrame:
    """df with the outputs of folds rounded, those not named to 2 digits; no zero is negative. Lines that often end in a 5 are given over the close."""
    value = lambda c: r(F.col(c) / close(), 6) if c in relative else r(F.col(c), digits.get(c, 2))
    return df.select("source", "time", "open", "high", "low", "close", "volume", *[(value(c) + 0.0).alias(c) for c in df.columns[7:]])


def ema_series(spark: SparkSession, d: str) -> DataFrame:
    out = recursive.fold(B.order_bars(spark, d), {"ema": (lambda: recursive.ema(10), ["close"], ["ema10"])})
    return out.select("source", "time", r(F.col("ema10"), 3).alias("ema10"))


def bands(spark: SparkSession, d: str) -> DataFrame:
    df = W.with_returns(W.prepared(B.order_bars(spark, d)), _rx=close(), _ry=volume())
    (top, _, bottom), (dt, dm, db), (at, am, ab) = W.bbands(close(), 5), W.donchian(20), W.accbands(10)
    return _out(df, bb_up=r(top, 3), bb_low=r(bottom, 3), don_up=dt, don_mid=r(dm, 3), don_low=db, acc_up=r(at, 3), acc_mid=r(am, 3), acc_low=r(ab, 3), tr=r(W.trange(), 3), mom10=r(W.mom(close()), 3), apo=r(W.apo(close(), 5, 10), 3), ppo=r(W.ppo(close(), 5, 10), 3), beta5=r(W.beta(F.col("_rx"), F.col("_ry"), 5), 4), crossed=W.cross(close(), F.col("open")))


def event_history(spark: SparkSession, d: str) -> DataFrame:
    df = W.prepared(B.order_bars(spark, d).withColumn("c", close() > F.col("open")), anchor=volume() >= 3)
    df = W.with_value_when(df, F.col("c"), close(), "before", 1)
    df = W.with_value_when(df, F.col("c"), close(), "before_since", 1, since_anchor=True)
    return _out(df, before=F.col("before"), before_since=F.col("before_since"), hb=W.highest_bars_since(close()), lb=W.lowest_bars_since(close()))


def stochastics(spark: SparkSession, d: str) -> DataFrame:
    hlc = ["high", "low", "close"]
    out = recursive.fold(B.order_bars(spark, d), {"f": (lambda: averages.stochf(5, 3), hlc, ["fk", "fd"]), "s": (lambda: averages.stoch(5, 3, slow_d=3), hlc, ["sk", "sd"]), "n": (lambda: averages.ma(7, "wma"), ["close"], ["w7"])})
    return _out(out, **{c: r(F.col(c), 3) for c in ("fk", "fd", "sk", "sd", "w7")})


def cycles(spark: SparkSession, d: str) -> DataFrame:
    c, hl, hlc = ["close"], ["high", "low"], ["high", "low", "close"]
    makers: dict = {
        "period": (cycle.ht_dcperiod, c, ["period"]), "phase": (cycle.ht_dcphase, c, ["phase"]), "phasor": (cycle.ht_phasor, c, ["in_phase", "quadrature"]), "sine": (cycle.ht_sine, c, ["sine", "lead"]),
        "line": (cycle.ht_trendline, c, ["trendline"]), "mode": (cycle.ht_trendmode, c, ["mode"]), "mama": (cycle.mama, c, ["mama", "fama"]), "t3": (averages.t3, c, ["t3"]), "sar": (averages.sar, hl, ["sar"]),
        "sarext": (averages.sarext, hl, ["sarext"]), "natr": (averages.natr, hlc, ["natr"]), "adxr": (averages.adxr, hlc, ["adxr"]), "dm": (averages.moves, hl, ["plus_dm", "minus_dm"]),
        "stochrsi": (averages.stochrsi, c, ["rk", "rd"]), "macdext": (averages.macdext, c, ["xl", "xs", "xh"]), "macdfix": (averages.macdfix, c, ["ml", "ms", "mh"]), "bb": (lambda: averages.bbands(5, kind="ema"), c, ["b_up", "b_mid", "b_low"]),
        "mavp": (lambda: averages.mavp(2, 10, "ema"), ["close", "volume"], ["mavp"]), "apo": (lambda: averages.apo(5, 10, "ema"), c, ["apo"]), "ppo": (lambda: averages.ppo(5, 10, "kama"), c, ["ppo"]),
    }
    return _rounded(recursive.fold(B.order_bars(spark, d), makers), dict.fromkeys(("period", "sine", "lead", "natr", "adxr", "ppo"), 4) | dict.fromkeys(("phase", "rk", "rd"), 3) | {"mavp": 5}, {"trendline", "sar", "sarext", "xl", "xs", "xh"})


def drawdowns(spark: SparkSession, d: str) -> DataFrame:
    return analytics.drawdown(B.order_bars(spark, d).withColumn("equity", W.cum(close() - F.col("open")))).select("source", r(F.col("max_drawdown"), 2).alias("max_drawdown"), F.col("longest_drawdown").cast("long"))


def forward(spark: SparkSession, d: str) -> DataFrame:
    df = analytics.forward_returns(B.order_bars(spark, d))
    return _out(df, f1=r(F.col("forward_1")), f6=r(F.col("forward_6")), f24=r(F.col("forward_24")), complete=F.col("complete_24"))


def hourly_event_bars(spark: SparkSession, d: str) -> DataFrame:
    return stream_bars(spark.read.parquet(f"{d}/events.parquet"), "1h")


def _candidates(bars: DataFrame) -> DataFrame:
    """Nine candidates of a crossing of two means: a position while the fast one was above the slow one."""
    lengths = [3, 5, 8, 15, 20, 30]
    bars = bars.withColumns({f"m{n}": W.sma(close(), n) for n in lengths}).withColumns({f"{k}{n}": F.lag(f"m{n}", j).over(W.by()) for n in lengths for j, k in ((1, "p"), (2, "q"))})
    bars = evaluate.positions(bars, F.lit(True), F.lit(True)).drop("entry")  # the return of each bar; whether a candidate has it follows
    one, two = (F.create_map(*[x for n in lengths for x in (F.lit(n), F.col(f"{k}{n}"))]) for k in "pq")
    bars = bars.withColumns({"held_out": F.lit(None).cast("boolean"), "segment": F.lit(None).cast("int")} if "segment" not in bars.columns else {}).select("source", "time", "close", "r", "segment", "held_out", one.alias("one"), two.alias("two"))
    runs = evaluate.grid(bars, fast=[3, 5, 8], slow=[15, 20, 30])
    on, was = (F.coalesce(F.element_at(m, F.col("fast")) > F.element_at(m, F.col("slow")), F.lit(False)) for m in ("one", "two"))
    return runs.withColumns({"r": F.when(on, F.col("r")).otherwise(0.0), "entry": on & ~was}).drop("one", "two")


def sweep(spark: SparkSession, d: str) -> DataFrame:
    """The three best of nine candidates for each source, with what holding the asset returned."""
    bars = B.order_bars(spark, d)
    top = evaluate.best(evaluate.scores(_candidates(bars), "candidate", "fast", "slow"), "growth", 3)
    top = evaluate.baseline(top, bars)
    return top.select("source", "rank", "candidate", "fast", "slow", "trades", r(F.col("win_rate"), 6).alias("win_rate"), r(F.col("growth"), 6).alias("growth"), r(F.log1p("asset_return"), 6).alias("asset_growth"), r(F.log(F.col("max_drawdown")), 5).alias("drawdown_log"))


def walk_forward_sweep(spark: SparkSession, d: str) -> DataFrame:
    """For each segment the candidate that did best on its training bars, what it did on those held out, and its drift flags."""
    bars = B.order_bars(spark, d)
    runs = evaluate.walk_forward(_candidates(bars).drop("segment", "held_out").withColumn("base", F.col("source")).withColumn("source", F.concat_ws("/", "source", "candidate")), 60, 20, 20)
    g, out = F.log1p("r"), F.col("held_out")
    keys = ["base", "segment", "candidate", "fast", "slow"]
    scored = runs.groupBy(*keys).agg(F.sum(F.when(~out, g)).alias("train"), F.sum(F.when(out, g)).alias("test"), F.count(F.when(out & F.col("entry"), 1)).alias("trades"))
    top = evaluate.best(scored, "train", 1, "base", "segment").withColumnsRenamed({"base": "source"})
    flags = evaluate.drift_flags(top.select("source", "segment", "fast", "slow", "train", "test", "trades", F.col("trades").alias("wins"), F.expm1("test").alias("total_return"), F.lit(0.0).alias("max_drawdown"), F.lit(0.0).alias("stitched_drawdown")))
    return flags.select("source", F.col("segment").cast("long"), "fast", "slow", r(F.col("train"), 6).alias("train"), r(F.col("test"), 6).alias("test"), "trades", "zero_trades", "negative_return", "high_drawdown")


def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Held-out closes of segments, stitched; growth is the logarithm of the stitched value over the capital."""
    rows = evaluate.walk_forward(B.order_bars(spark, d).select("source", "time", close().alias("equity")), 30, 10, 10).where("held_out")
    out = evaluate.stitched(rows)
    return out.select("source", "time", F.col("segment").cast("long"), r(F.log(F.col("stitched") / 10_000)).alias("growth"))


def forward_extremes(spark: SparkSession, d: str) -> DataFrame:
    return _out(evaluate.forward_extremes(B.order_bars(spark, d)), favorable=r(F.col("favorable")), adverse=r(F.col("adverse")))


def flag_stats(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.flag_stats(B.order_bars(spark, d), close() > W.sma(close(), 5))


def flag_overlap(spark: SparkSession, d: str) -> DataFrame:
    return B.order_bars(spark, d).groupBy("source").agg(*analytics.overlap(close() > F.col("open"), volume() >= 3))


def export_stats(spark: SparkSession, d: str) -> DataFrame:
    out = analytics.export_stats(B.order_bars(spark, d).withColumn("m", W.sma(close(), 5)), "m")
    return out.select("source", "samples", "missing", *[r(F.col(c), 3).alias(c) for c in ("least", "greatest", "mean")])


def capture(spark: SparkSession, d: str) -> DataFrame:
    """Every bar of orders by the state of its volume at the bar before."""
    return evaluate.capture(B.order_bars(spark, d), volume() >= 3).select("source", "state", "bars", r(F.col("growth")).alias("growth"))


def capture_daily(spark: SparkSession, d: str) -> DataFrame:
    """Every bar of orders by its state at the bar before; growth is the logarithm of the compounded returns."""
    return evaluate.capture(B.order_bars(spark, d), close() > F.col("open")).select("source", "state", "bars", r(F.col("growth")).alias("growth"))


def missing_windows(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.missing_windows(B.order_bars(spark, d), B.FIXED_MS["1d"])


def event_groups(spark: SparkSession, d: str) -> DataFrame:
    """Events as trades: their value by weekday, hour, four-hour bucket and holding time."""
    rows = spark.read.parquet(f"{d}/events.parquet").select((F.col("value") - 50).alias("pnl"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time"), (F.col("user_id") % 40).alias("held"))
    out = evaluate.trade_groups(rows, "pnl", **evaluate.exit_keys(F.col("time"), F.col("held")))
    return out.select("key", "label", "trades", "gains", r(F.col("total"), 2).alias("total"), r(F.col("mean"), 3).alias("mean"))


def maintenance(spark: SparkSession, d: str) -> DataFrame:
    tiers = [(0.0, 50_000.0, 0.004, 0.0), (50_000.0, 200_000.0, 0.005, 50.0), (200_000.0, None, 0.01, 1_050.0)]
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.groupBy(F.col("o_orderpriority").alias("source")).agg(r(F.sum(evaluate.maintenance(F.col("o_totalprice"), tiers)), 2).alias("margin"))


def elementary(spark: SparkSession, d: str) -> DataFrame:
    """Elementary functions of event values, scaled into their domains."""
    x = F.col("value") / (F.abs("value") + 1)
    big = lambda k: F.col("value") / 10 if k in ("ceil", "floor", "exp", "sqrt", "cos", "sin", "tan", "sinh", "cosh") else x
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", *[r(f(F.abs(big(k)) if k == "sqrt" else big(k)) / (F.exp(F.abs(big(k))) if k in ("sinh", "cosh", "exp") else 1), 7).alias(f"{k}_") for k, f in S.ELEMENTARY.items()], r(S.log10(F.abs("value") + 1), 7).alias("log10_"))


def comparisons(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons and fallbacks, of closes some of which are NaN or missing."""
    i = F.row_number().over(W.by())
    odd = F.when(i % 7 == 0, float("nan")).when(i % 11 == 0, None).otherwise(close())
    c, o, h, lo = F.col("c"), F.col("open"), F.col("high"), F.col("low")
    return _out(B.order_bars(spark, d).withColumn("c", odd), gt=S.gt(c, o), ge=S.ge(c, o), lt=S.lt(c, o), le=S.le(c, o), above=S.above(c, o), below=S.below(c, o), outside=S.outside(c, lo, h), between=S.between(c, lo, h), missing=S.na(c), filled=F.when(~F.isnan(S.nz(c, -1.0)), S.nz(c, -1.0)), either=F.when(~F.isnan(S.coalesce(c, o)), S.coalesce(c, o)), crossed=W.crossover(c, o), crossed_under=W.crossunder(c, o))


def stops(spark: SparkSession, d: str) -> DataFrame:
    wide = F.col("open") - close()
    return _out(B.order_bars(spark, d), trail_long=r(S.trail_stop_long(close(), wide), 2), trail_short=r(S.trail_stop_short(close(), wide), 2), even_long=r(S.break_even_long(close(), wide), 2), even_short=r(S.break_even_short(close(), wide), 2))


def more_windows(spark: SparkSession, d: str) -> DataFrame:
    df = W.prepared(B.order_bars(spark, d))
    (low, high), (low_at, high_at) = W.minmax(close(), 10), W.minmax_index(close(), 10)
    return _out(df, var=r(F.log(W.var(close(), 6)), 6), ulcer=r(W.ulcer_index(close(), 7), 5), angle=r(W.linearreg_angle(F.log(close()), 9), 5), low_at=low_at, high_at=high_at, low=low, high=high, first_low=W.min_index(close(), 10), aroon=r(W.aroon_osc(9), 6))


def _gapped(spark: SparkSession, d: str) -> DataFrame:
    """Bars of orders, some without close or volume, with a condition c and an anchor that are missing at times."""
    i = F.row_number().over(W.by())
    bars = B.order_bars(spark, d).withColumns({"_k": i, "_day": F.floor(F.col("time") / B.FIXED_MS["1d"])})
    bars = bars.withColumns({"close": F.when(F.col("_k") % 7 != 3, close()), "volume": F.when(F.col("_k") % 11 != 5, volume())})
    return bars.withColumns({"anchor": F.when(F.col("_k") % 13 != 4, F.col("_day") % 9 == 0), "c": F.when(F.col("_k") % 17 != 6, close() > F.col("open"))})


def gap_memory(spark: SparkSession, d: str) -> DataFrame:
    """Anchored and cumulative operators on bars with gaps."""
    df = W.prepared(_gapped(spark, d), anchor=F.col("anchor"))
    df = W.with_value_when(df, F.col("c"), close(), "caught", 1, since_anchor=True)
    return _out(df, hi=W.highest_since(close()), lo=W.lowest_since(close()), hb=W.highest_bars_since(close()), lb=W.lowest_bars_since(close()), n=W.count_since(F.col("c")), vwap=r(W.anchored_vwap(close(), volume()) / F.col("open"), 6), caught=F.col("caught"), obv=W.obv(), ad=r(W.ad(), 3) + 0.0, mfi=r(W.mfi(5), 5), rising=W.rising(close(), 2), falling=W.falling(close(), 2), total=r(W.cum(volume()), 1))


def venue_selected(spark: SparkSession, d: str) -> DataFrame:
    bars = B.order_bars(spark, d)
    low, high = (venue.selected(bars, PRIORITIES, 2, x).withColumnRenamed("selected", k) for x, k in ((False, "second_lowest"), (True, "second_highest")))
    return low.join(high, "time")


def venue_members(spark: SparkSession, d: str) -> DataFrame:
    return venue.ranked(B.order_bars(spark, d), PRIORITIES).select("source", "time", venue.in_top_n(2).alias("in_top"), venue.in_bottom_n(2).alias("in_bottom"))


def week_month_view(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars with the last closed week and month."""
    bars = B.order_bars(spark, d)
    out = timeline.attach_longer(bars.select("source", "time", "close"), B.resample(bars, "1w"), "1d", "1w", ["close", "volume"])
    return timeline.attach_longer(out, B.resample(bars, "1M"), "1d", "1M", ["close", "volume"])


def monthly_bars(spark: SparkSession, d: str) -> DataFrame:
    """Monthly bars with an auxiliary field, the last that isn't missing."""
    bars = B.order_bars(spark, d).withColumn("mark_price", F.when(volume() >= 3, close()))
    return B.resample(bars, "1M", ("mark_price",))


def densified(spark: SparkSession, d: str) -> DataFrame:
    """Bars of the first priority with the last close of the second before each bar closes, and its closes laid over theirs."""
    bars = B.order_bars(spark, d)
    one, two = (bars.where(F.col("source") == x).withColumn("source", F.lit("x")) for x in PRIORITIES[:2])
    weekly = two.where(F.col("volume") >= 3)
    out = B.densify(one.select("source", "time", "close"), weekly.select("source", "time", F.col("close").alias("mark_price")), "1d", "mark_price")
    return B.overlay(out, scalar_field(two, "mark_price"), "mark_price")


def invalid_rows(spark: SparkSession, d: str) -> DataFrame:
    """What validation finds wrong with bars of orders by the day if they were by the week, half of them twice."""
    bars = B.order_bars(spark, d)
    return B.invalid_bars(bars.unionByName(bars.where(volume() >= 2)), "1w")


def feeds(spark: SparkSession, d: str) -> DataFrame:
    """Two named feeds, one of them a target, within a span of time, joined by their weeks."""
    bars = B.order_bars(spark, d)
    made = Feeds("1d").add("a", bars.where(F.col("source") == PRIORITIES[0]), target=True).add("b", bars.where(F.col("source") == PRIORITIES[1])).use("a", "1w").use("b", "1w").check()
    weeks = made.bars("a", "1w").unionByName(made.bars("b", "1w")).select("source", B.bucket_open(F.col("time"), "1w").alias("week"), F.col("close").alias("week_close"))
    days = window(made.all_bars(), 725_846_400_000, 820_454_400_000)  # 1993 to 1995
    return days.withColumn("week", B.bucket_open(F.col("time"), "1w")).join(weeks, ["source", "week"]).select("source", "time", "close", "week_close", "current_execution")


def sharpe_ratios(spark: SparkSession, d: str) -> DataFrame:
    return analytics.sharpe(B.order_bars(spark, d).select("source", "time", close().alias("equity"))).select("source", r(F.col("sharpe"), 6).alias("sharpe"))


def drawdown_report(spark: SparkSession, d: str) -> DataFrame:
    out = analytics.drawdown(B.order_bars(spark, d).withColumn("equity", r(W.cum(close() - F.col("open")), 2)))
    return out.select("source", F.col("longest_drawdown").cast("long"), F.col("current_drawdown").cast("long"), F.col("longest_stagnation").cast("long"), r(F.col("mean_recovery"), 4).alias("mean_recovery"))


def trade_reports(spark: SparkSession, d: str) -> DataFrame:
    """Events as trades by side, classification, module and whether a flag was on."""
    rows = spark.read.parquet(f"{d}/events.parquet").select((F.col("value") - 50).alias("pnl"), "event_type", "user_id", "event_id")
    side, module = F.when(F.col("event_id") % 3 == 0, "short").otherwise("long"), F.concat(F.lit("m"), F.col("user_id") % 5)
    out = evaluate.trade_groups(rows, "pnl", side=side, classification=F.col("event_type"), module=module, active=F.when(F.col("user_id") % 2 == 0, "on").otherwise("off"))
    return out.select("key", "label", "trades", "gains", r(F.col("total"), 2).alias("total"), r(F.col("mean"), 4).alias("mean"))


def export_means(spark: SparkSession, d: str) -> DataFrame:
    """A mean of closes, also at crossings."""
    df = B.order_bars(spark, d).withColumn("m", W.sma(close(), 5)).withColumns({"up": W.crossover(close(), F.col("m")), "down": W.crossunder(close(), F.col("m"))})
    out = analytics.export_stats(df, "m", entry=F.col("up"), exit=F.col("down"))
    return out.select("source", r(F.col("mean_at_entry"), 3).alias("mean_at_entry"), r(F.col("mean_at_exit"), 3).alias("mean_at_exit"))


def overlap_tables(spark: SparkSession, d: str) -> DataFrame:
    bars = B.order_bars(spark, d)
    one, two = bars.where(volume() >= 2).select("source", "time", (close() > F.col("open")).alias("flag")), bars.where(volume() <= 3).select("source", "time", (volume() >= 3).alias("flag"))
    return analytics.overlap_of(one, two)


def sliding_event_bars(spark: SparkSession, d: str) -> DataFrame:
    return stream_bars(spark.read.parquet(f"{d}/events.parquet"), "1h", slide="15m")


def event_bars_by_week_and_month(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    return stream_bars(events, "1w").withColumn("key", F.lit("1w")).unionByName(stream_bars(events, "1M").withColumn("key", F.lit("1M")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (daily_sma_cross, weekly_bars, rolling, regression, rates, prices, oscillators, event_memory, venue_choice, venue_ranks, aligned, three_day_view, alignment_report, recursive_set, ema_series, bands, event_history, stochastics, cycles, drawdowns, forward, hourly_event_bars, sweep, walk_forward, forward_extremes, flag_stats, flag_overlap, export_stats, capture, capture_daily, missing_windows, event_groups, maintenance, elementary, comparisons, stops, more_windows, gap_memory, venue_selected, venue_members, week_month_view, monthly_bars, densified, invalid_rows, feeds, sharpe_ratios, drawdown_report, trade_reports, export_means, overlap_tables, sliding_event_bars, event_bars_by_week_and_month, walk_forward_sweep)
}

_BARS = """WITH RECURSIVE bars AS (
  SELECT o_orderpriority AS source, epoch_ms(date_trunc('day', o_orderdate)::TIMESTAMP) AS time,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
         arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume
  FROM orders GROUP BY ALL)"""


def _w(n: int, lead: int = 0) -> str:
    return f"(PARTITION BY source ORDER BY time ROWS BETWEEN {n - 1 + lead} PRECEDING AND {f'{lead} PRECEDING' if lead else 'CURRENT ROW'})"


def _full(value: str, n: int) -> str:
    return f"CASE WHEN count(close) OVER {_w(n)} = {n} THEN {value} END"


_BY = "(PARTITION BY source ORDER BY time)"
_ALL = "(PARTITION BY source ORDER BY time ROWS UNBOUNDED PRECEDING)"
_LAGS = lambda ws: " + ".join(f"{w} * lag(close, {k}) OVER {_BY}" if k else f"{w} * close" for k, w in enumerate(ws))

_MEANS = "[" + ", ".join(f"{_full(f'avg(close) OVER {_w(n)}', n)}" for n in (3, 5, 8, 15, 20, 30)) + "]"
_CANDIDATES = f"""{_BARS}, m AS (SELECT *, {_MEANS} AS m, coalesce(close / lag(close) OVER {_BY} - 1, 0) AS gain FROM bars), p AS (SELECT *, lag(m) OVER {_BY} AS one, lag(m, 2) OVER {_BY} AS two FROM m),
    c AS (SELECT *, unnest(range(0, 9))::INT AS candidate FROM p), f AS (SELECT *, [3, 5, 8][candidate // 3 + 1] AS fast, [15, 20, 30][candidate % 3 + 1] AS slow,
        coalesce(one[candidate // 3 + 1] > one[candidate % 3 + 4], false) AS held, coalesce(two[candidate // 3 + 1] > two[candidate % 3 + 4], false) AS was FROM c),
    runs AS (SELECT source, time, close, candidate, fast, slow, CASE WHEN held THEN gain ELSE 0 END AS r, held AND NOT was AS entry FROM f)"""

ORACLE_SQL: dict[str, str] = {
    "recursive_set": recursive_sql.recursive_set(_BARS),
    "cycles": recursive_sql.cycles(_BARS),
    "daily_sma_cross": f"""{_BARS}, m AS (SELECT *, {_full(f'avg(close) OVER {_w(20)}', 20)} AS m FROM bars),
        p AS (SELECT *, lag(close) OVER {_BY} AS c0, lag(m) OVER {_BY} AS m0, {_full(f'(close - m) / nullif(stddev_pop(close) OVER {_w(20)}, 0)', 20)} AS z FROM m)
        SELECT source, time, close, round(m, 5) AS sma20, CASE WHEN m0 IS NOT NULL THEN close > m AND c0 <= m0 END AS crossed,
               CASE WHEN m0 IS NOT NULL THEN close < m AND c0 >= m0 END AS crossed_under, round(z, 4) AS zscore20 FROM p""",
    "weekly_bars": f"""{_BARS} SELECT source, time - (time - 345600000) % 604800000 AS time, arg_min(open, time) AS open, max(high) AS high,
        min(low) AS low, arg_max(close, time) AS close, sum(volume) AS volume FROM bars GROUP BY source, 2""",
    "rates": f"""{_BARS} SELECT source, time, round(close - lag(close, 3) OVER {_BY}, 5) AS change3, round((close / lag(close, 10) OVER {_BY} - 1) * 100, 5) AS roc10,
        round(close / lag(close, 5) OVER {_BY} - 1, 5) AS rocp5, round(close / lag(close, 5) OVER {_BY}, 5) AS rocr5, round(close / lag(close, 5) OVER {_BY} * 100, 5) AS rocr100 FROM bars""",
    "rolling": f"""{_BARS}, i AS (SELECT *, row_number() OVER {_BY} - 1 AS i FROM bars), l AS (SELECT *, list(close) OVER {_w(10)} AS l10, list(close) OVER {_w(14)} AS l14, list(close) OVER {_w(20)} AS l20 FROM i)
        SELECT source, time, round({_full(f'sum(close) OVER {_w(10)}', 10)}, 3) AS sum10, round(({_LAGS([5, 4, 3, 2, 1])}) / 15, 3) AS wma5, round(({_LAGS([1, 2, 3, 2, 1])}) / 9, 3) AS trima5,
        {_full(f'max(close) OVER {_w(20)}', 20)} AS hi20, {_full(f'min(close) OVER {_w(20)}', 20)} AS lo20, round({_full(f'(max(close) OVER {_w(14)} + min(close) OVER {_w(14)}) / 2', 14)}, 5) AS mid14,
        CASE WHEN len(l10) = 10 THEN (list_position(list_reverse(l10), list_max(l10)) - 1)::DOUBLE END AS hb10, CASE WHEN len(l10) = 10 THEN (list_position(list_reverse(l10), list_min(l10)) - 1)::DOUBLE END AS lb10,
        CASE WHEN len(l10) = 10 THEN (i - list_position(list_reverse(l10), list_max(l10)) + 1)::DOUBLE END AS imax10,
        CASE WHEN i >= 3 THEN close > max(close) OVER {_w(3, 1)} END AS rising3, CASE WHEN i >= 3 THEN close < min(close) OVER {_w(3, 1)} END AS falling3,
        round(CASE WHEN len(l14) = 14 THEN list_sum(list_transform(l14, lambda v: abs(v - list_avg(l14)))) / 14 END, 3) AS dev14,
        round({_full(f'stddev_pop(close) OVER {_w(5)}', 5)}, 3) AS sd5, round(CASE WHEN len(l20) = 20 THEN list_aggregate(l20, 'quantile_cont', 0.5) END, 3) AS med20 FROM l""",
    "regression": f"""{_BARS}, i AS (SELECT *, row_number() OVER {_BY}::DOUBLE AS i FROM bars), s AS (SELECT *, regr_slope(close, i) OVER {_w(14)} AS b, avg(close) OVER {_w(14)} AS m FROM i)
        SELECT source, time, round(CASE WHEN i >= 14 THEN b END, 4) AS slope, round(CASE WHEN i >= 14 THEN m - 6.5 * b END, 4) AS intercept,
               round(CASE WHEN i >= 14 THEN m + 7.5 * b END, 4) AS forecast, round(CASE WHEN i >= 14 THEN m + 6.5 * b END, 4) AS value FROM s""",
    "bands": f"""{_BARS}, p AS (SELECT *, lag(close) OVER {_BY} AS p, lag(open) OVER {_BY} AS po, close / lag(close) OVER {_BY} - 1 AS x, volume / lag(volume) OVER {_BY} - 1 AS y, 4 * (high - low) / (high + low) AS k FROM bars)
        SELECT source, time, round({_full(f'avg(close) OVER {_w(5)} + 2 * stddev_pop(close) OVER {_w(5)}', 5)}, 3) AS bb_up, round({_full(f'avg(close) OVER {_w(5)} - 2 * stddev_pop(close) OVER {_w(5)}', 5)}, 3) AS bb_low,
        {_full(f'max(high) OVER {_w(20)}', 20)} AS don_up, round({_full(f'(max(high) OVER {_w(20)} + min(low) OVER {_w(20)}) / 2', 20)}, 3) AS don_mid, {_full(f'min(low) OVER {_w(20)}', 20)} AS don_low,
        round({_full(f'avg(high * (1 + k)) OVER {_w(10)}', 10)}, 3) AS acc_up, round({_full(f'avg(close) OVER {_w(10)}', 10)}, 3) AS acc_mid, round({_full(f'avg(low * (1 - k)) OVER {_w(10)}', 10)}, 3) AS acc_low,
        round(CASE WHEN p IS NOT NULL THEN greatest(high - low, abs(p - high), abs(p - low)) END, 3) AS tr, round(close - lag(close, 10) OVER {_BY}, 3) AS mom10,
        round({_full(f'avg(close) OVER {_w(5)} - avg(close) OVER {_w(10)}', 10)}, 3) AS apo, round({_full(f'100 * (avg(close) OVER {_w(5)} / avg(close) OVER {_w(10)} - 1)', 10)}, 3) AS ppo,
        round(CASE WHEN count(x) OVER {_w(5)} = 5 THEN coalesce((5 * sum(x * y) OVER {_w(5)} - sum(x) OVER {_w(5)} * sum(y) OVER {_w(5)}) / nullif(5 * sum(x * x) OVER {_w(5)} - (sum(x) OVER {_w(5)}) ** 2, 0), 0) END, 4) AS beta5,
        CASE WHEN p IS NOT NULL THEN (close > open AND p <= po) OR (close < open AND p >= po) END AS crossed FROM p""",
    "event_history": f"""{_BARS}, a AS (SELECT *, close > open AS c, row_number() OVER {_BY} AS i, sum((volume >= 3)::INT) OVER {_ALL} AS ep FROM bars),
        h AS (SELECT *, lag(close) OVER (PARTITION BY source, c ORDER BY time) AS v, lag(close) OVER (PARTITION BY source, ep, c ORDER BY time) AS ve FROM a)
        SELECT source, time, last_value(CASE WHEN c THEN v END IGNORE NULLS) OVER {_ALL} AS before, CASE WHEN ep > 0 THEN last_value(CASE WHEN c THEN ve END IGNORE NULLS) OVER e END AS before_since,
        CASE WHEN ep > 0 THEN (i - arg_max(i, close) OVER e)::DOUBLE END AS hb, CASE WHEN ep > 0 THEN (i - arg_min(i, close) OVER e)::DOUBLE END AS lb FROM h WINDOW e AS (PARTITION BY source, ep ORDER BY time ROWS UNBOUNDED PRECEDING)""",
    "stochastics": f"""{_BARS}, k AS (SELECT *, {_full(f'coalesce(100 * (close - min(low) OVER {_w(5)}) / nullif(max(high) OVER {_w(5)} - min(low) OVER {_w(5)}, 0), 0)', 5)} AS k FROM bars),
        s AS (SELECT *, CASE WHEN count(k) OVER {_w(3)} = 3 THEN avg(k) OVER {_w(3)} END AS s FROM k), t AS (SELECT *, CASE WHEN count(s) OVER {_w(3)} = 3 THEN avg(s) OVER {_w(3)} END AS t FROM s)
        SELECT source, time, round(CASE WHEN s IS NOT NULL THEN k END, 3) AS fk, round(s, 3) AS fd, round(CASE WHEN t IS NOT NULL THEN s END, 3) AS sk, round(t, 3) AS sd, round(({_LAGS([7, 6, 5, 4, 3, 2, 1])}) / 28, 3) AS w7 FROM t""",
    "venue_choice": f"{_BARS} SELECT time, arg_min(source, (close, source)) AS cheapest, arg_min(source, (-close, source)) AS richest FROM bars GROUP BY time",
    "venue_ranks": f"""{_BARS} SELECT source, time, close, (row_number() OVER (PARTITION BY time ORDER BY close, source))::INT AS rank_asc,
        (row_number() OVER (PARTITION BY time ORDER BY close DESC, source))::INT AS rank_desc, row_number() OVER (PARTITION BY time ORDER BY close DESC, source) <= 2 AS in_top_2 FROM bars""",
    "aligned": f"""{_BARS}, t AS (SELECT DISTINCT time FROM bars) SELECT t.time, a.close AS a, b.close AS b, round(a.close - b.close, 2) AS difference, round((b.close - a.close) / a.close * 10000, 3) AS bps
        FROM t LEFT JOIN bars a ON a.time = t.time AND a.source = '1-URGENT' LEFT JOIN bars b ON b.time = t.time AND b.source = '2-HIGH'""",
    "alignment_report": f"{_BARS} SELECT source, count(DISTINCT time) AS actual, (SELECT count(DISTINCT time) FROM bars) - count(DISTINCT time) AS gaps FROM bars GROUP BY source",
    "three_day_view": f"""{_BARS}, l AS (SELECT source, time - time % 259200000 AS t3, arg_max(close, time) AS close, sum(volume) AS volume FROM bars GROUP BY ALL)
        SELECT b.source, b.time, b.close, l.close AS "3d_close", l.volume AS "3d_volume" FROM bars b LEFT JOIN l
        ON l.source = b.source AND l.t3 = (b.time + 86400000) - (b.time + 86400000) % 259200000 - 259200000""",
    "ema_series": f"""{_BARS}, i AS (SELECT *, row_number() OVER {_BY} AS i, avg(close) OVER {_w(10)} AS m FROM bars),
        e AS (SELECT source, i, m AS e FROM i WHERE i = 10 UNION ALL SELECT i.source, i.i, close * 2 / 11 + e.e * 9 / 11 FROM e JOIN i ON i.source = e.source AND i.i = e.i + 1)
        SELECT i.source, i.time, round(e.e, 3) AS ema10 FROM i LEFT JOIN e ON e.source = i.source AND e.i = i.i""",
    "event_memory": f"""{_BARS}, a AS (SELECT *, close > open AS c, row_number() OVER {_BY} AS i FROM bars),
        b AS (SELECT *, lag(c) OVER {_BY} AS c0, lag(close) OVER {_BY} AS p, sum((volume >= 3)::INT) OVER {_ALL} AS ep FROM a)
        SELECT source, time, c AND NOT coalesce(c0, false) AS "on", NOT c AND coalesce(c0, false) AS off,
        coalesce(last_value(CASE WHEN close > 200000 THEN true WHEN close < 100000 THEN false END IGNORE NULLS) OVER {_ALL}, false) AS latch,
        (i - last_value(CASE WHEN c THEN i END IGNORE NULLS) OVER {_ALL})::DOUBLE AS since, last_value(CASE WHEN c THEN close END IGNORE NULLS) OVER {_ALL} AS last_up,
        round(sum(close) OVER {_ALL}, 2) AS total, CASE WHEN ep > 0 THEN max(close) OVER e END AS hi, CASE WHEN ep > 0 THEN min(close) OVER e END AS lo, CASE WHEN ep > 0 THEN (sum(c::INT) OVER e)::DOUBLE END AS n,
        round(sum(close * volume) OVER e / sum(volume) OVER e, 3) AS vwap, sum(CASE WHEN p IS NULL OR close > p THEN volume WHEN close < p THEN -volume ELSE 0 END) OVER {_ALL} AS obv,
        round(sum(CASE WHEN high > low THEN (2 * close - low - high) / (high - low) * volume ELSE 0 END) OVER {_ALL}, 3) + 0.0 AS ad
        FROM b WINDOW e AS (PARTITION BY source, ep ORDER BY time ROWS UNBOUNDED PRECEDING)""",
    "drawdowns": f"""{_BARS}, q AS (SELECT source, time, sum(close - open) OVER {_ALL} AS e FROM bars), p AS (SELECT *, max(e) OVER {_ALL} AS peak FROM q), k AS (SELECT *, sum((e >= peak)::INT) OVER {_ALL} AS island FROM p),
        g AS (SELECT source, island, max(peak - e) AS d, sum((e < peak)::INT) AS n FROM k GROUP BY ALL) SELECT source, round(max(d), 2) AS max_drawdown, max(n)::BIGINT AS longest_drawdown FROM g GROUP BY source""",
    "hourly_event_bars": """SELECT event_type AS source, epoch_ms(date_trunc('hour', ts)) AS time, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
        arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY ALL""",
    "walk_forward": f"""{_BARS}, i AS (SELECT *, row_number() OVER {_BY} - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM bars),
        s AS (SELECT source, unnest(range(0, max(n) - 39, 10)) AS start FROM i GROUP BY source),
        h AS (SELECT i.source, time, close, start // 10 AS segment FROM s JOIN i ON i.source = s.source AND i.i >= start + 30 AND i.i < start + 40),
        e AS (SELECT source, segment, arg_min(close, time) AS a, arg_max(close, time) AS b FROM h GROUP BY ALL),
        k AS (SELECT source, segment, 10000 / a * coalesce(exp(sum(ln(b / a)) OVER (PARTITION BY source ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS k FROM e)
        SELECT h.source, h.time, h.segment::BIGINT AS segment, round(ln(h.close * k.k / 10000), 5) AS growth FROM h JOIN k ON k.source = h.source AND k.segment = h.segment""",
    "forward_extremes": f"""{_BARS} SELECT source, time, round(max(high) OVER n / close - 1, 5) AS favorable, round(min(low) OVER n / close - 1, 5) AS adverse
        FROM bars WINDOW n AS (PARTITION BY source ORDER BY time ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING)""",
    "flag_stats": f"""{_BARS}, f AS (SELECT source, time, close > {_full(f'avg(close) OVER {_w(5)}', 5)} AS f FROM bars), p AS (SELECT *, lag(f) OVER {_BY} AS p FROM f)
        SELECT source, count(*) FILTER (f) AS "on", count(*) FILTER (NOT f) AS off, count(*) FILTER (f IS NULL) AS missing, count(*) FILTER (f AND NOT p) AS rising, count(*) FILTER (NOT f AND p) AS falling FROM p GROUP BY source""",
    "flag_overlap": f"""{_BARS}, f AS (SELECT source, close > open AS a, volume >= 3 AS b FROM bars) SELECT source, count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS only_a,
        count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither FROM f GROUP BY source""",
    "export_stats": f"""{_BARS}, f AS (SELECT source, {_full(f'avg(close) OVER {_w(5)}', 5)} AS m FROM bars)
        SELECT source, count(*) AS samples, count(*) - count(m) AS missing, round(min(m), 3) AS least, round(max(m), 3) AS greatest, round(avg(m), 3) AS mean FROM f GROUP BY source""",
    "capture": f"""{_BARS}, p AS (SELECT source, lag(volume >= 3) OVER {_BY} AS state, close / lag(close) OVER {_BY} - 1 AS r FROM bars)
        SELECT source, state, count(*) AS bars, round(sum(ln(1 + r)), 5) AS growth FROM p WHERE state IS NOT NULL GROUP BY source, state""",
    "capture_daily": f"""{_BARS}, p AS (SELECT source, lag(close > open) OVER {_BY} AS state, close / lag(close) OVER {_BY} - 1 AS r FROM bars)
        SELECT source, state, count(*) AS bars, round(sum(ln(1 + r)), 5) AS growth FROM p WHERE state IS NOT NULL GROUP BY source, state""",
    "missing_windows": f"""{_BARS}, w AS (SELECT source, time + 86400000 AS start, lead(time) OVER {_BY} AS "end" FROM bars) SELECT * FROM w WHERE "end" > start""",
    "event_groups": """WITH t AS (SELECT value - 50 AS pnl, ts, user_id % 40 AS h FROM events), l AS (SELECT pnl, 'weekday' AS key, (isodow(ts) - 1)::VARCHAR AS label FROM t
        UNION ALL SELECT pnl, 'hour', hour(ts)::VARCHAR FROM t UNION ALL SELECT pnl, 'four_hours', (hour(ts) // 4 * 4)::VARCHAR FROM t
        UNION ALL SELECT pnl, 'held', CASE WHEN h < 2 THEN '0-1' WHEN h < 6 THEN '2-5' WHEN h < 16 THEN '6-15' WHEN h < 32 THEN '16-31' ELSE '32+' END FROM t)
        SELECT key, label, count(*) AS trades, count(*) FILTER (pnl > 0) AS gains, round(sum(pnl), 2) AS total, round(avg(pnl), 3) AS mean FROM l GROUP BY key, label""",
    "maintenance": """SELECT o_orderpriority AS source, round(sum(CASE WHEN o_totalprice < 50000 THEN o_totalprice * 0.004 WHEN o_totalprice < 200000 THEN o_totalprice * 0.005 - 50 ELSE o_totalprice * 0.01 - 1050 END), 2) AS margin FROM orders GROUP BY 1""",
    "prices": f"""{_BARS} SELECT source, time, round((open + high + low + close) / 4, 4) AS avg, round((high + low) / 2, 3) AS med, round((high + low + close) / 3, 3) AS typ, round((high + low + close * 2) / 4, 4) AS wcl,
        round(CASE WHEN high > low THEN (close - open) / (high - low) ELSE 0 END, 5) AS bop, (isodow(make_timestamp(time * 1000)) - 1)::DOUBLE AS weekday, hour(make_timestamp(time * 1000))::DOUBLE AS hour,
        hour(make_timestamp(time * 1000)) >= 22 OR hour(make_timestamp(time * 1000)) < 4 AS session, CASE WHEN close <> 0 THEN 1.0 END AS div0, round(ln(close), 5) AS log, low < close AND close < high AS inside, round(close - (high - low), 3) AS stop FROM bars""",
    "oscillators": f"""{_BARS}, t AS (SELECT *, (high + low + close) / 3 AS tp, row_number() OVER {_BY} AS i FROM bars),
        u AS (SELECT *, lag(tp) OVER {_BY} AS tp0, list(tp) OVER {_w(14)} AS l14, list(high) OVER {_w(15)} AS lh, list(low) OVER {_w(15)} AS ll,
            count(*) OVER {_w(30)} * sum(close * volume) OVER {_w(30)} - sum(close) OVER {_w(30)} * sum(volume) OVER {_w(30)} AS cxy,
            (count(*) OVER {_w(30)} * sum(close * close) OVER {_w(30)} - (sum(close) OVER {_w(30)}) ** 2) * (count(*) OVER {_w(30)} * sum(volume * volume) OVER {_w(30)} - (sum(volume) OVER {_w(30)}) ** 2) AS cu FROM t),
        f AS (SELECT *, sum(CASE WHEN tp > tp0 THEN tp * volume ELSE 0 END) OVER {_w(14)} AS pos, sum(CASE WHEN tp < tp0 THEN tp * volume ELSE 0 END) OVER {_w(14)} AS neg,
            list_sum(list_transform(l14, lambda v: abs(v - list_avg(l14)))) / 14 AS dev FROM u)
        SELECT source, time, round(CASE WHEN i >= 14 THEN CASE WHEN max(high) OVER {_w(14)} > min(low) OVER {_w(14)} THEN -100 * (max(high) OVER {_w(14)} - close) / (max(high) OVER {_w(14)} - min(low) OVER {_w(14)}) ELSE 0 END END, 5) + 0.0 AS willr,
        round(CASE WHEN i >= 14 THEN CASE WHEN dev = 0 THEN 0 ELSE (tp - list_avg(l14)) / (0.015 * dev) END END, 3) AS cci,
        round(CASE WHEN i >= 14 THEN CASE WHEN sum(abs(close - open)) OVER {_w(14)} = 0 THEN 0 ELSE 100 * sum(greatest(close - open, 0)) OVER {_w(14)} / sum(abs(close - open)) OVER {_w(14)} END END, 4) AS imi,
        round(CASE WHEN i >= 15 THEN CASE WHEN neg = 0 THEN 100 ELSE 100 * pos / (pos + neg) END END, 4) AS mfi,
        round(CASE WHEN i >= 15 THEN 100 * (15 - list_position(list_reverse(lh), list_max(lh))) / 14.0 END, 5) AS aroon_up, round(CASE WHEN i >= 15 THEN 100 * (15 - list_position(list_reverse(ll), list_min(ll))) / 14.0 END, 5) AS aroon_down,
        round(CASE WHEN i >= 30 THEN CASE WHEN cu > 0 THEN cxy / sqrt(cu) ELSE 0 END END, 4) AS correl, round(CASE WHEN i >= 20 THEN (max(high) OVER {_w(20)} + min(low) OVER {_w(20)}) / 2 END, 3) AS donchian FROM f""",
    "forward": f"""{_BARS}, e AS (SELECT *, arg_max(close, time) OVER (PARTITION BY source) AS z FROM bars) SELECT source, time, round(coalesce(lead(close) OVER {_BY}, z) / close - 1, 5) AS f1, round(coalesce(lead(close, 6) OVER {_BY}, z) / close - 1, 5) AS f6,
        round(coalesce(lead(close, 24) OVER {_BY}, z) / close - 1, 5) AS f24, lead(close, 24) OVER {_BY} IS NOT NULL AS complete FROM e""",
    "elementary": """WITH v AS (SELECT event_id, value / (abs(value) + 1) AS x, value / 10 AS b, value FROM events) SELECT event_id, round(acos(x), 7) AS acos_, round(asin(x), 7) AS asin_, round(atan(x), 7) AS atan_, ceil(b) AS ceil_, round(cos(b), 7) AS cos_,
        round((exp(b) + exp(-b)) / 2 / exp(abs(b)), 7) AS cosh_, round(exp(b) / exp(abs(b)), 7) AS exp_, floor(b) AS floor_, round(sin(b), 7) AS sin_, round((exp(b) - exp(-b)) / 2 / exp(abs(b)), 7) AS sinh_, round(sqrt(abs(b)), 7) AS sqrt_, round(tan(b), 7) AS tan_,
        round((exp(x) - exp(-x)) / (exp(x) + exp(-x)), 7) AS tanh_, round(log10(abs(value) + 1), 7) AS log10_ FROM v""",
    "comparisons": f"""{_BARS}, i AS (SELECT *, row_number() OVER {_BY} AS i FROM bars), c AS (SELECT *, i % 7 = 0 AS odd, CASE WHEN i % 7 <> 0 AND i % 11 = 0 THEN NULL ELSE close END AS c FROM i),
        g AS (SELECT *, CASE WHEN c IS NOT NULL THEN NOT odd AND c > open END AS gt, CASE WHEN c IS NOT NULL THEN NOT odd AND c >= open END AS ge, CASE WHEN c IS NOT NULL THEN NOT odd AND c < open END AS lt, CASE WHEN c IS NOT NULL THEN NOT odd AND c <= open END AS le FROM c),
        h AS (SELECT *, lag(ge) OVER {_BY} AS ge0, lag(le) OVER {_BY} AS le0 FROM g)
        SELECT source, time, gt, ge, lt, le, gt AS above, lt AS below, CASE WHEN c IS NOT NULL THEN NOT odd AND (c < low OR c > high) END AS outside, CASE WHEN c IS NOT NULL THEN NOT odd AND low < c AND c < high END AS "between", c IS NULL AS missing,
        CASE WHEN NOT odd THEN coalesce(c, -1) END AS filled, CASE WHEN NOT odd THEN coalesce(c, open) END AS either, CASE WHEN gt IS NOT NULL AND le0 IS NOT NULL THEN gt AND le0 END AS crossed, CASE WHEN lt IS NOT NULL AND ge0 IS NOT NULL THEN lt AND ge0 END AS crossed_under FROM h""",
    "stops": f"""{_BARS} SELECT source, time, CASE WHEN open >= close THEN round(2 * close - open, 2) END AS trail_long, CASE WHEN open >= close THEN round(open, 2) END AS trail_short,
        CASE WHEN open >= close THEN round(open, 2) END AS even_long, CASE WHEN open >= close THEN round(2 * close - open, 2) END AS even_short FROM bars""",
    "more_windows": f"""{_BARS}, i AS (SELECT *, row_number() OVER {_BY}::DOUBLE AS i FROM bars), l AS (SELECT *, list(close) OVER {_w(10)} AS l, list(close) OVER {_w(7)} AS l7, list(high) OVER {_w(10)} AS lh, list(low) OVER {_w(10)} AS ll, regr_slope(ln(close), i) OVER {_w(9)} AS b FROM i)
        SELECT source, time, CASE WHEN i >= 6 THEN round(ln(var_pop(close) OVER {_w(6)}), 6) END AS var,
        CASE WHEN i >= 7 THEN round(sqrt(list_sum(list_transform(range(1, 8), lambda k: (100 * (l7[k] / list_max(l7[1:k]) - 1)) ** 2)) / 7), 5) END AS ulcer, CASE WHEN i >= 9 THEN round(degrees(atan(b)), 5) END AS angle,
        CASE WHEN i >= 10 THEN i - list_position(list_reverse(l), list_min(l)) END AS low_at, CASE WHEN i >= 10 THEN i - list_position(list_reverse(l), list_max(l)) END AS high_at,
        CASE WHEN i >= 10 THEN list_min(l) END AS low, CASE WHEN i >= 10 THEN list_max(l) END AS high, CASE WHEN i >= 10 THEN i - list_position(list_reverse(l), list_min(l)) END AS first_low,
        CASE WHEN i >= 10 THEN round(100 * (list_position(list_reverse(ll), list_min(ll)) - list_position(list_reverse(lh), list_max(lh))) / 9.0, 6) END AS aroon FROM l""",
    "gap_memory": f"""{_BARS}, k AS (SELECT *, row_number() OVER {_BY} AS k FROM bars),
        g AS (SELECT source, time, k, open, high, low, CASE WHEN k % 7 <> 3 THEN close END AS close, CASE WHEN k % 11 <> 5 THEN volume END AS volume, CASE WHEN k % 13 <> 4 THEN (time // 86400000) % 9 = 0 END AS a FROM k),
        n AS (SELECT *, CASE WHEN k % 17 <> 6 THEN close > open END AS c, (high + low + close) / 3 AS tp, coalesce(sum(a::INT) OVER {_ALL}, 0) AS ep, a IS NOT NULL AS live, count(a) OVER {_ALL} AS e,
            last_value(CASE WHEN volume IS NOT NULL THEN close END IGNORE NULLS) OVER (PARTITION BY source ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, lag(close) OVER {_BY} AS c1, lag(close, 2) OVER {_BY} AS c2 FROM g),
        m AS (SELECT *, lag(tp) OVER {_BY} AS tp0, coalesce(live AND c, false) AS hit, CASE WHEN live THEN close END AS x, CASE WHEN live AND close IS NOT NULL THEN volume END AS v FROM n),
        q AS (SELECT *, CASE WHEN hit THEN lag(close) OVER (PARTITION BY source, ep, hit ORDER BY time) END AS was, tp * volume AS flow, sum(hit::INT) OVER (PARTITION BY source, ep ORDER BY time) AS hits FROM m),
        h AS (SELECT *, CASE WHEN hits > 0 THEN last_value(CASE WHEN hit THEN struct_pack(v := was) END IGNORE NULLS) OVER (PARTITION BY source, ep ORDER BY time ROWS UNBOUNDED PRECEDING) END AS caught FROM q)
        SELECT source, time, CASE WHEN ep > 0 AND x IS NOT NULL THEN max(x) OVER w END AS hi, CASE WHEN ep > 0 AND x IS NOT NULL THEN min(x) OVER w END AS lo,
        CASE WHEN ep > 0 AND x IS NOT NULL THEN (e - arg_max(e, x) OVER w)::DOUBLE END AS hb, CASE WHEN ep > 0 AND x IS NOT NULL THEN (e - arg_min(e, x) OVER w)::DOUBLE END AS lb,
        CASE WHEN ep > 0 AND live AND c IS NOT NULL THEN (sum(hit::INT) OVER w)::DOUBLE END AS n, CASE WHEN v IS NOT NULL THEN round(sum(x * v) OVER w / nullif(sum(v) OVER w, 0) / open, 6) END AS vwap,
        CASE WHEN ep > 0 AND live AND c IS NOT NULL THEN caught.v END AS caught,
        CASE WHEN close IS NOT NULL AND volume IS NOT NULL THEN sum(CASE WHEN close IS NULL THEN 0 WHEN p IS NULL OR close > p THEN volume WHEN close < p THEN -volume ELSE 0 END) OVER {_ALL} END AS obv,
        CASE WHEN close IS NOT NULL AND volume IS NOT NULL THEN round(sum(CASE WHEN high > low THEN (2 * close - low - high) / (high - low) * volume ELSE 0 END) OVER {_ALL}, 3) + 0.0 END AS ad,
        CASE WHEN count(CASE WHEN tp0 IS NOT NULL THEN flow END) OVER {_w(5)} = 5 THEN CASE WHEN sum(CASE WHEN tp < tp0 THEN flow ELSE 0 END) OVER {_w(5)} = 0 THEN 100.0
            ELSE round(100 * sum(CASE WHEN tp > tp0 THEN flow ELSE 0 END) OVER {_w(5)} / sum(CASE WHEN tp <> tp0 THEN flow ELSE 0 END) OVER {_w(5)}, 5) END END AS mfi,
        CASE WHEN k < 3 OR close IS NULL OR c1 IS NULL THEN NULL WHEN close <= c1 THEN false WHEN c2 IS NULL THEN NULL ELSE close > c2 END AS rising, CASE WHEN k < 3 OR close IS NULL OR c1 IS NULL THEN NULL WHEN close >= c1 THEN false WHEN c2 IS NULL THEN NULL ELSE close < c2 END AS falling,
        CASE WHEN volume IS NOT NULL THEN round(sum(volume) OVER {_ALL}, 1) END AS total FROM h WINDOW w AS (PARTITION BY source, ep ORDER BY time ROWS UNBOUNDED PRECEDING)""",
    "venue_selected": f"""{_BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY time ORDER BY close, source) AS a, row_number() OVER (PARTITION BY time ORDER BY close DESC, source) AS d FROM bars)
        SELECT time, max(CASE WHEN a = 2 THEN source END) AS second_lowest, max(CASE WHEN d = 2 THEN source END) AS second_highest FROM k GROUP BY time""",
    "venue_members": f"{_BARS} SELECT source, time, row_number() OVER (PARTITION BY time ORDER BY close DESC, source) <= 2 AS in_top, row_number() OVER (PARTITION BY time ORDER BY close, source) <= 2 AS in_bottom FROM bars",
    "week_month_view": f"""{_BARS}, s AS (SELECT *, make_timestamp(time * 1000) AS ts FROM bars), w AS (SELECT source, date_trunc('week', ts) AS t, arg_max(close, time) AS close, sum(volume) AS volume FROM s GROUP BY ALL),
        m AS (SELECT source, date_trunc('month', ts) AS t, arg_max(close, time) AS close, sum(volume) AS volume FROM s GROUP BY ALL)
        SELECT s.source, s.time, s.close, w.close AS "1w_close", w.volume AS "1w_volume", m.close AS "1M_close", m.volume AS "1M_volume" FROM s LEFT JOIN w ON w.source = s.source AND w.t = date_trunc('week', s.ts + INTERVAL 1 DAY) - INTERVAL 7 DAY
        LEFT JOIN m ON m.source = s.source AND m.t = date_trunc('month', s.ts + INTERVAL 1 DAY) - INTERVAL 1 MONTH""",
    "monthly_bars": f"""{_BARS} SELECT source, epoch_ms(date_trunc('month', make_timestamp(time * 1000))::TIMESTAMP) AS time, arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close, sum(volume) AS volume,
        arg_max(close, time) FILTER (volume >= 3) AS mark_price FROM bars GROUP BY source, 2""",
    "densified": f"""{_BARS}, a AS (SELECT time, close FROM bars WHERE source = '1-URGENT'), b AS (SELECT time, close, volume FROM bars WHERE source = '2-HIGH'),
        f AS (SELECT a.time, a.close, (SELECT arg_max(b.close, b.time) FROM b WHERE b.volume >= 3 AND b.time < a.time + 86400000) AS m FROM a)
        SELECT 'x' AS source, coalesce(f.time, b.time) AS time, f.close, coalesce(b.close, f.m) AS mark_price FROM f FULL JOIN b ON b.time = f.time""",
    "invalid_rows": f"""{_BARS}, u AS (SELECT source, time FROM bars UNION ALL SELECT source, time FROM bars WHERE volume >= 2), c AS (SELECT *, count(*) OVER (PARTITION BY source, time) AS n FROM u)
        SELECT source, time, CASE WHEN (time - 345600000) % 604800000 <> 0 THEN 'unaligned' ELSE 'repeated' END AS reason FROM c WHERE (time - 345600000) % 604800000 <> 0 OR n > 1""",
    "feeds": f"""{_BARS}, w AS (SELECT source, date_trunc('week', make_timestamp(time * 1000)) AS t, arg_max(close, time) AS week_close FROM bars GROUP BY ALL)
        SELECT CASE b.source WHEN '1-URGENT' THEN 'a' ELSE 'b' END AS source, time, close, week_close, CASE WHEN b.source = '1-URGENT' THEN 'a' END AS current_execution FROM bars b JOIN w ON w.source = b.source AND w.t = date_trunc('week', make_timestamp(time * 1000))
        WHERE b.source IN ('1-URGENT', '2-HIGH') AND time >= 725846400000 AND time < 820454400000""",
    "sharpe_ratios": f"""{_BARS}, r AS (SELECT source, close / lag(close) OVER {_BY} - 1 AS r, time - lag(time) OVER {_BY} AS d FROM bars)
        SELECT source, round(avg(r) / stddev_samp(r) * sqrt(31557600000 / quantile_cont(d, 0.5)), 6) AS sharpe FROM r GROUP BY source""",
    "drawdown_report": f"""{_BARS}, q AS (SELECT source, time, round(sum(close - open) OVER {_ALL}, 2) AS e FROM bars), p AS (SELECT *, max(e) OVER {_ALL} AS peak FROM q), k AS (SELECT *, sum((e >= peak)::INT) OVER {_ALL} AS island FROM p),
        g AS (SELECT source, island, sum((e < peak)::INT) AS n FROM k GROUP BY ALL), l AS (SELECT *, max(island) OVER (PARTITION BY source) AS last FROM g) SELECT source, max(n)::BIGINT AS longest_drawdown, max(CASE WHEN island = last THEN n END)::BIGINT AS current_drawdown,
        max(CASE WHEN island = last THEN n END)::BIGINT AS longest_stagnation, round(coalesce(avg(CASE WHEN island < last AND n > 0 THEN n END), 0), 4) AS mean_recovery FROM l GROUP BY source""",
    "trade_reports": """WITH l AS (SELECT value - 50 AS pnl, unnest([{'key': 'side', 'label': CASE WHEN event_id % 3 = 0 THEN 'short' ELSE 'long' END}, {'key': 'classification', 'label': event_type}, {'key': 'module', 'label': 'm' || (user_id % 5)},
        {'key': 'active', 'label': CASE WHEN user_id % 2 = 0 THEN 'on' ELSE 'off' END}], recursive := true) FROM events) SELECT key, label, count(*) AS trades, count(*) FILTER (pnl > 0) AS gains, round(sum(pnl), 2) AS total, round(avg(pnl), 4) AS mean FROM l GROUP BY key, label""",
    "export_means": f"""{_BARS}, m AS (SELECT *, {_full(f'avg(close) OVER {_w(5)}', 5)} AS m FROM bars), p AS (SELECT *, lag(close) OVER {_BY} AS c0, lag(m) OVER {_BY} AS m0 FROM m)
        SELECT source, round(avg(m) FILTER (close > m AND c0 <= m0), 3) AS mean_at_entry, round(avg(m) FILTER (close < m AND c0 >= m0), 3) AS mean_at_exit FROM p GROUP BY source""",
    "overlap_tables": f"""{_BARS}, a AS (SELECT source, time, close > open AS f FROM bars WHERE volume >= 2), b AS (SELECT source, time, volume >= 3 AS f FROM bars WHERE volume <= 3), j AS (SELECT coalesce(a.source, b.source) AS source, a.f AS x, b.f AS y FROM a FULL JOIN b ON a.source = b.source AND a.time = b.time)
        SELECT source, count(*) FILTER (x AND y) AS "both", count(*) FILTER (x AND NOT y) AS only_a, count(*) FILTER (NOT x AND y) AS only_b, count(*) FILTER (NOT x AND NOT y) AS neither, count(*) FILTER (x IS NULL OR y IS NULL) AS missing FROM j GROUP BY source""",
    "sliding_event_bars": """WITH k AS (SELECT *, unnest([0, 1, 2, 3]) AS k FROM events) SELECT event_type AS source, epoch_ms(time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE) AS time, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
        arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM k GROUP BY ALL""",
    "event_bars_by_week_and_month": """WITH k AS (SELECT *, unnest(['1w', '1M']) AS key FROM events) SELECT key, event_type AS source, epoch_ms((CASE WHEN key = '1w' THEN date_trunc('week', ts) ELSE date_trunc('month', ts) END)::TIMESTAMP) AS time,
        arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM k GROUP BY ALL""",
    "sweep": f"""{_CANDIDATES}, w AS (SELECT *, sum(ln(1 + r)) OVER t AS s, sum(entry::INT) OVER t AS trade FROM runs WINDOW t AS (PARTITION BY source, candidate ORDER BY time ROWS UNBOUNDED PRECEDING)),
        x AS (SELECT *, 10000 * (exp(greatest(0, max(s) OVER (PARTITION BY source, candidate ORDER BY time ROWS UNBOUNDED PRECEDING))) - exp(s)) AS fall FROM w),
        y AS (SELECT source, candidate, fast, slow, trade, sum(ln(1 + r)) AS g, max(fall) AS fall FROM x GROUP BY ALL), z AS (SELECT source, candidate, fast, slow, count(*) FILTER (trade > 0) AS trades, count(*) FILTER (trade > 0 AND g > 0) AS won, sum(g) AS growth, max(fall) AS fall FROM y GROUP BY ALL),
        n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY growth DESC, candidate) AS rank FROM z), a AS (SELECT source, ln(arg_max(close, time) / arg_min(close, time)) AS asset FROM bars GROUP BY source)
        SELECT n.source, rank::INT AS rank, candidate, fast, slow, trades, round(CASE WHEN trades > 0 THEN won / trades ELSE 0 END, 6) AS win_rate, round(growth, 6) AS growth, round(asset, 6) AS asset_growth, round(ln(fall), 5) AS drawdown_log FROM n JOIN a ON a.source = n.source WHERE rank <= 3""",
    "walk_forward_sweep": f"""{_CANDIDATES}, i AS (SELECT *, row_number() OVER t - 1 AS i, count(*) OVER (PARTITION BY source, candidate) AS n FROM runs WINDOW t AS (PARTITION BY source, candidate ORDER BY time)),
        s AS (SELECT source, unnest(range(0, max(n) - 79, 20)) AS start FROM i GROUP BY source),
        h AS (SELECT i.source, start // 20 AS segment, candidate, fast, slow, sum(ln(1 + r)) FILTER (i < start + 60) AS train, sum(ln(1 + r)) FILTER (i >= start + 60) AS test, count(*) FILTER (i >= start + 60 AND entry) AS trades FROM s JOIN i ON i.source = s.source AND i.i >= start AND i.i < start + 80 GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY source, segment ORDER BY train DESC, candidate) AS place FROM h)
        SELECT source, segment::BIGINT AS segment, fast, slow, round(train, 6) AS train, round(test, 6) AS test, trades, trades = 0 AS zero_trades, exp(test) - 1 < -1e-9 AS negative_return, false AS high_drawdown FROM k WHERE place = 1""",
}
