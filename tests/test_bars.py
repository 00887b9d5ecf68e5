"""Bar operators against DuckDB on the smallest tables, and folds against plain loops."""

import math
import os
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from barloom import queries
from barloom.functions import scalar
from barloom.operators import analytics, averages, cycle, evaluate, recursive, windows
from barloom.plans import timeline
from barloom.sources import bars as sources
from barloom.sources.registry import Feeds
from barloom.streaming import stream_bars

SF = "/root/testdata/sf0.001"
SCHEMA = "source string, time long, open double, high double, low double, close double, volume double"


def by_duckdb(sql):
    con = duckdb.connect()
    for t in ("orders", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con.sql(sql).df()


def keyed(df):
    keys = [c for c in ("source", "key", "label", "state", "time", "start", "segment", "rank", "event_id") if c in df.columns]
    return df[sorted(df.columns)].sort_values(keys).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    a, b = keyed(queries.QUERIES[name](spark, SF).toPandas()), keyed(by_duckdb(queries.ORACLE_SQL[name]))
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        x, y = a[c], b[c]
        assert (x.isna() == y.isna()).all(), c
        x, y = x[~x.isna()], y[~y.isna()]
        if x.map(lambda v: isinstance(v, str)).any():
            assert (x == y).all(), c
        else:
            assert np.allclose(x.astype(float), y.astype(float), atol=2e-3), c


def make(spark, closes, source="a"):
    rows = [(source, 60_000 * i, c - 0.5, c + 1.0, c - 1.0, float(c), 1000.0 + i) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, SCHEMA)


CLOSES = [0.56 + 0.18 * math.sin(0.37 * i) + 0.12 * math.cos(0.19 * i) for i in range(48)]


def values(df, *cols):
    rows = df.orderBy("source", "time").select(*cols).collect()
    return [tuple(r) if len(cols) > 1 else r[0] for r in rows]


def test_ema_and_rsi_equal_plain_loops(spark):
    out = recursive.fold(make(spark, CLOSES), {"e": (lambda: recursive.ema(5), ["close"], ["e"]), "r": (lambda: recursive.rsi(7), ["close"], ["r"])})
    ema, seen = [], None
    for i, c in enumerate(CLOSES):
        seen = sum(CLOSES[:5]) / 5 if i == 4 else None if i < 4 else seen + (c - seen) * 2 / 6
        ema.append(seen)
    moves = np.diff(CLOSES)
    g, b = np.maximum(moves, 0), np.maximum(-moves, 0)
    ag, ab, rsi = g[:7].mean(), b[:7].mean(), [None] * 7
    rsi.append(100 - 100 / (1 + ag / ab))
    for k in range(7, len(moves)):
        ag, ab = (ag * 6 + g[k]) / 7, (ab * 6 + b[k]) / 7
        rsi.append(100 - 100 / (1 + ag / ab))
    for got, want in zip(values(out, "e", "r"), zip(ema, rsi, strict=True), strict=True):
        assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(got, want, strict=True))


def test_folds_do_not_look_ahead_and_restart_by_source(spark):
    folds = {"m": (lambda: recursive.macd(3, 6, 4), ["close"], ["line", "signal", "hist"]), "d": (lambda: recursive.directional(5), ["high", "low", "close"], ["p", "m", "dx", "adx"]), "s": (lambda: recursive.supertrend(4, 2.0), ["high", "low", "close"], ["st", "bull"])}
    cols = ["line", "signal", "hist", "p", "m", "dx", "adx", "st", "bull"]
    whole = values(recursive.fold(make(spark, CLOSES).union(make(spark, CLOSES[::-1], "b")), folds), *cols)
    part = values(recursive.fold(make(spark, CLOSES[:30]), folds), *cols)
    assert whole[:30] == part
    assert whole[48:78] == values(recursive.fold(make(spark, CLOSES[::-1], "b"), folds), *cols)[:30]


def test_missing_input_holds_state(spark):
    df = make(spark, CLOSES[:12]).withColumn("close", F.when(F.col("time") != 60_000 * 6, F.col("close")))
    got = values(recursive.fold(df, {"e": (lambda: recursive.ema(3), ["close"], ["e"])}), "e")
    assert got[6] is None and abs(got[7] - (got[5] + (CLOSES[7] - got[5]) * 0.5)) < 1e-12


def test_division_and_logarithms_are_ieee(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in rows.select(scalar.ieee_div(F.col("a"), F.col("b"))).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == 2 and got[4] is None
    logs = [r[0] for r in rows.select(scalar.ln(F.col("a"))).collect()]
    assert logs[0] == 0 and math.isnan(logs[1]) and logs[2] == -math.inf


def test_sources_align_on_the_union_of_times(spark):
    a, b = [("A", 0, 10.0), ("A", 60_000, 11.0)], [("B", 60_000, 7.0), ("B", 120_000, 8.0)]
    df = timeline.align(spark.createDataFrame(a + b, "source string, time long, close double"), ["A", "B"])
    assert [r[0] for r in df.orderBy("time").select(F.col("A") - F.col("B")).collect()] == [None, 4.0, None]


def test_longer_bars_show_after_their_close_and_gaps_are_null(spark):
    base = make(spark, range(1, 10))
    longer = spark.createDataFrame([("a", 0, 1.0), ("a", 360_000, 3.0)], "source string, time long, close double")
    got = values(timeline.attach_longer(base, longer, "1m", "3m", ["close"]), "3m_close")
    assert got == [None, None, 1.0, 1.0, 1.0, None, None, None, 3.0]


def test_crossing_and_windows_on_short_series(spark):
    df = make(spark, [1, 3, 2, 4])
    out = df.select("source", "time", windows.crossover(F.col("close"), F.lit(2.0)).alias("x"), windows.sma(F.col("close"), 3).alias("m"))
    assert values(out, "x", "m") == [(None, None), (True, None), (False, 2.0), (True, 3.0)]


def test_resample_keeps_a_trailing_part(spark):
    got = values(sources.resample(make(spark, [1, 2, 3, 4]), "3m"), "time", "open", "high", "low", "close", "volume")
    assert got == [(0, 0.5, 4.0, 0.0, 3.0, 3003.0), (180_000, 3.5, 5.0, 3.0, 4.0, 1003.0)]


def run(step, *series):
    return [step(*x) for x in zip(*series, strict=True)]


def test_cycles_find_a_sine():
    wave = [100 + 5 * math.sin(2 * math.pi * k / 20) for k in range(300)]
    period, sine, mode, phase = (run(f(), wave) for f in (cycle.ht_dcperiod, cycle.ht_sine, cycle.ht_trendmode, cycle.ht_dcphase))
    assert period[31] is None and period[32] is not None and phase[62] is None and phase[63] is not None
    assert abs(period[-1] - 20) < 1 and all(-1 <= a <= 1 for a, _ in sine[63:]) and set(mode[63:]) <= {0.0, 1.0}
    assert run(cycle.mama(), wave)[32] is not None and run(cycle.ht_phasor(), wave)[31] == (None, None)
    line = run(cycle.ht_trendline(), wave)
    assert line[62] is None and abs(line[-1] - 100) < 1.5


def test_averages_equal_plain_ones():
    x = [float(v) for v in (3, 5, 4, 6, 9, 8, 7, 10, 12, 11)]
    assert run(averages.sma(4), x)[3:5] == [4.5, 6.0] and run(averages.wma(3), x)[2] == (3 + 10 + 12) / 6 and run(averages.trima(4), x)[3] == (3 + 10 + 8 + 6) / 6
    assert run(averages.sma(2), [1.0, None, 3.0, 5.0]) == [None, None, None, 4.0]
    assert run(averages.t3(1, 0.7), x) == pytest.approx(x)
    assert run(averages.apo(2, 4), x)[3] == 5 - 4.5 == run(averages.apo(4, 2), x)[3]
    assert run(averages.bbands(2), x)[1] == pytest.approx((6, 4, 2))
    assert run(averages.mavp(1, 3), x, [9.0] * 10)[2] == 4.0 and run(averages.mavp(1, 3), x, [0.0] * 10)[2] == 4.0
    with pytest.raises(ValueError):
        averages.ma(3, "cdl")
    flat = [5.0] * 40
    assert run(averages.stochrsi(), flat)[-1] == (0.0, 0.0) and run(averages.natr(3), flat, flat, flat)[-1] == 0


def test_parabolic_stop_follows_and_turns():
    up = [10.0 + k for k in range(10)]
    got = run(averages.sar(), [v + 1 for v in up], [v - 1 for v in up])
    assert got[0] is None and got[1] == 9.0 and got[2] == pytest.approx(9 + 0.02 * (12 - 9)) and got == [got[0], *sorted(got[1:])]
    down = [v + 1 for v in up] + [5.0], [v - 1 for v in up] + [3.0]
    assert run(averages.sar(), *down)[-1] == 20.0 and run(averages.sarext(), *down)[-1] == -20.0


def test_reports(spark):
    eq = spark.createDataFrame([("a", k * 86_400_000, v) for k, v in enumerate([10.0, 12.0, 9.0, 11.0, 13.0])], "source string, time long, equity double")
    assert tuple(analytics.drawdown(eq).first()) == ("a", 3.0, 2, 0, 0, 2.0)
    assert analytics.sharpe(eq).first()["sharpe"] > 0
    assert analytics.segments(10, 4, 2, 2) == [(0, 0, 4, 6), (1, 2, 6, 8), (2, 4, 8, 10)]


def test_grids_and_scores(spark):
    """A position over rows 2 and 3, then one over row 6: two trades, one of them a winner."""
    bars = make(spark, [10, 11, 12, 15, 14, 13, 11.7]).withColumns({"before": F.col("time").isin(60_000 * 2, 60_000 * 3, 60_000 * 6), "earlier": F.col("time").isin(60_000 * 3)})
    runs = evaluate.grid(evaluate.positions(bars, F.col("before"), F.col("earlier")), kind=[1, 2], share=[0.5, 0.98, 0.99])
    got = evaluate.scores(runs, "candidate", "kind", "share").collect()
    assert len(got) == 6 and sorted(r.candidate for r in got) == list(range(6)) and {r.kind for r in got if r.candidate < 3} == {1}
    for r in got:
        assert r.trades == 2 and r.win_rate == 0.5 and r.total_return == pytest.approx(15 / 11 * 0.9 - 1) and r.max_drawdown == pytest.approx(10_000 * 15 / 11 * 0.1)
        assert r.robust_return == pytest.approx(r.total_return - 0.5 * r.max_drawdown / 10_000)
    top = evaluate.best(spark.createDataFrame(got), "total_return", 2, passed=F.col("kind") == 2).orderBy("rank").collect()
    assert [(r["rank"], r.candidate) for r in top] == [(1, 3), (2, 4)]
    with pytest.raises(ValueError):
        evaluate.grid(bars, kind=[])


def test_drift_flags(spark):
    rows = [("a", 0, 10, 8, 0.1, 1.0, 5.0), ("a", 1, 0, 0, 0.0, 1.0, 5.0), ("a", 2, 10, 1, -0.2, 9.0, 5.0)]
    got = evaluate.drift_flags(spark.createDataFrame(rows, "source string, segment int, trades int, wins int, total_return double, max_drawdown double, stitched_drawdown double")).orderBy("segment")
    flags = [tuple(r) for r in got.select("zero_trades", "negative_return", "high_drawdown", "win_rate_collapse").collect()]
    assert flags == [(False,) * 4, (True, False, False, False), (False, True, True, True)]


def test_lengths_may_be_swapped_and_the_first_side_follows_the_close():
    h, lo, c, v = ([x + k for x in CLOSES] for k in (1.0, -1.0, 0.0, 100.0))
    assert run(recursive.macd(6, 3, 2), c) == run(recursive.macd(3, 6, 2), c) and run(recursive.adosc(10, 3), h, lo, c, v) == run(recursive.adosc(3, 10), h, lo, c, v)
    assert run(recursive.supertrend(3), (11, 12, 13, 20), (9, 10, 11, 10), (10, 11, 12, 14))[-1][1] is True


def test_nan_is_a_number_to_folds(spark):
    df = make(spark, [1, 2, 3, 4]).withColumn("close", F.when(F.col("time") == 60_000, float("nan")).when(F.col("time") == 120_000, None).otherwise(F.col("close")))
    got = values(recursive.fold(df, {"e": (lambda: recursive.ema(1), ["close"], ["e"])}), "e")
    assert got[0] == 1 and math.isnan(got[1]) and got[2] is None and math.isnan(got[3])


def test_anchored_operators_skip_rows_without_anchor_or_value(spark):
    rows = [("a", k, 0.0, 0.0, 0.0, c, v, a, q) for k, (c, v, a, q) in enumerate([(10.0, 1.0, True, True), (None, 9.0, False, None), (12.0, 1.0, None, True), (13.0, 2.0, False, True)])]
    df = windows.prepared(spark.createDataFrame(rows, SCHEMA + ", a boolean, q boolean"), anchor=F.col("a"))
    c, v = F.col("close"), F.col("volume")
    out = df.select("source", "time", windows.highest_since(c).alias("hi"), windows.count_since(F.col("q")).alias("n"), windows.anchored_vwap(c, v).alias("vwap"), windows.highest_bars_since(c).alias("hb"), windows.obv().alias("obv"))
    assert values(out, "hi", "n", "vwap", "hb", "obv") == [(10, 1, 10, 0, 1), (None, None, None, None, None), (None, None, None, None, 2), (13, 2, 12, 0, 4)]


def test_validation_raises_where_the_table_is_read(spark):
    bars = make(spark, [1, 2, 3])
    assert sources.validated(bars, "1m").count() == 3 and sources.invalid_bars(bars, "1m").count() == 0
    for bad in (bars.union(bars.limit(1)), bars.withColumn("time", F.col("time") + 5), bars.withColumn("time", F.col("time") + 0.5)):
        assert sources.invalid_bars(bad, "1m").count() > 0
        with pytest.raises(Exception, match="1m bar of a at"):
            sources.validated(bad, "1m").collect()


def test_feeds_are_checked(spark):
    bars = make(spark, range(6))
    feeds = Feeds("1m").add("x", bars, target=True).use("x", "3m")
    assert feeds.check().bars("x", "3m").count() == 2 and feeds.bars("x").count() == 6
    assert {r.current_execution for r in feeds.all_bars().collect()} == {"x"}
    for wrong in (lambda: feeds.add("x", bars), lambda: feeds.use("x", "1s"), lambda: feeds.bars("y"), lambda: Feeds("1m").add("x", bars, "3m").check(), lambda: Feeds("1m").add("x", bars).add("x", bars, "5m").check()):
        with pytest.raises(ValueError):
            wrong()


@pytest.mark.parametrize("every", ["hour", "week"])
def test_bars_of_a_stream_equal_those_of_the_table(spark, tmp_path, every):
    """Events come in two files; repeated ones count once, and one that is too late for its closed bar is left out."""
    step = {"hour": 3_600, "week": 7 * 86_400}[every]
    rows = [(k, 345_600 + k * step // 4, "a", float(k)) for k in range(40)]
    late = (99, 345_600 + 1, "a", 1e9)
    schema = "event_id long, at long, event_type string, value double"
    for n, part in enumerate([rows[:20] + rows[:3], rows[20:], [late, (100, 345_600 + 40 * step, "a", 0.0)], [(101, 345_600 + 60 * step, "a", 0.0)]]):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("at")).drop("at").coalesce(1).write.parquet(f"{tmp_path}/{n}.parquet")
        time.sleep(1.1)  # files are read in order of their time
    table = spark.read.parquet(*[f"{tmp_path}/{n}.parquet" for n in range(4)])
    interval = {"hour": "1h", "week": "1w"}[every]
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*.parquet")
    q = stream_bars(stream, interval).writeStream.format("memory").queryName(f"bars_{every}").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table(f"bars_{every}").where("time < " + str((345_600 + 40 * step) * 1000)).collect()}
    want = {tuple(r) for r in stream_bars(table.where("event_id < 99"), interval).collect()}
    assert got == want and len(want) == 10


def test_segments_hold_what_the_plain_list_says(spark):
    rows = evaluate.walk_forward(make(spark, range(23)), 6, 3, 4).select((F.col("time") / 60_000).cast("int"), "segment", "held_out").collect()
    assert {tuple(r) for r in rows} == {(i, k, i >= test) for k, start, test, end in analytics.segments(23, 6, 3, 4) for i in range(start, end)} and len(rows) == 9 * 4
    assert evaluate.walk_forward(make(spark, range(8)), 6, 3, 4).count() == 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_capture_reads_every_bar(spark):
    bars = queries.B.order_bars(spark, SF)
    want = bars.count() - bars.select("source").distinct().count()
    assert sum(r.bars for r in queries.QUERIES["capture_daily"](spark, SF).collect()) == want
