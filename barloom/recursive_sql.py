"""DuckDB's SQL for the recursive operators: each step is a row of a recursive table that carries the state as a struct."""

from __future__ import annotations

import re

BY = "(PARTITION BY source ORDER BY time)"

#: Bars numbered from 1 in their source, with what steps read of rows before.
ROWS = f"""i AS MATERIALIZED (SELECT *, row_number() OVER {BY} AS i, lag(close) OVER {BY} AS c0, lag(high) OVER {BY} AS h0, lag(low) OVER {BY} AS l0,
    lag(close, 5) OVER {BY} AS c5, lag(close, 10) OVER {BY} AS c10,
    avg(close) OVER (PARTITION BY source ORDER BY time ROWS 11 PRECEDING) AS m12, avg(close) OVER (PARTITION BY source ORDER BY time ROWS 25 PRECEDING) AS m26,
    stddev_pop(close) OVER (PARTITION BY source ORDER BY time ROWS 4 PRECEDING) AS dev5, (4 * close + 3 * lag(close) OVER {BY} + 2 * lag(close, 2) OVER {BY} + lag(close, 3) OVER {BY}) / 10 AS sm FROM bars),
  b AS MATERIALIZED (SELECT *, greatest(high - low, abs(c0 - high), abs(c0 - low)) AS tr, greatest(close - c0, 0) AS up, greatest(c0 - close, 0) AS fall,
    CASE WHEN high - h0 > greatest(l0 - low, 0) THEN high - h0 ELSE 0 END AS pm, CASE WHEN l0 - low > greatest(high - h0, 0) THEN l0 - low ELSE 0 END AS mm,
    sum(abs(close - c0)) OVER (PARTITION BY source ORDER BY time ROWS 4 PRECEDING) AS noise5, sum(abs(close - c0)) OVER (PARTITION BY source ORDER BY time ROWS 9 PRECEDING) AS noise10 FROM i)"""


class Steps:
    """Columns of a step in order; each may read row columns, columns before it, and as p.name those of the row before."""

    def __init__(self) -> None:
        self.columns: dict[str, str] = {}
        self.first: dict[str, str] = {}

    def put(self, name: str, sql: str, first: str = "NULL::DOUBLE") -> str:
        self.columns[name], self.first[name] = sql, first
        return name

    def ema(self, name: str, x: str, n: int, start: int = 1) -> tuple[str, int]:
        """A mean seeded by the plain mean of the n values from row `start` on; its name and its first row."""
        at = start + n - 1
        self.put(f"{name}_s", f"CASE WHEN i >= {start} AND i < {at} THEN coalesce(p.{name}_s, 0) + {x} END")
        self.put(name, f"CASE WHEN i = {at} THEN (coalesce(p.{name}_s, 0) + {x}) / {n} WHEN i > {at} THEN 2.0 / {n + 1} * {x} + (1 - 2.0 / {n + 1}) * p.{name} END")
        return name, at

    def wilder(self, name: str, x: str, n: int, start: int) -> str:
        at = start + n - 1
        self.put(f"{name}_s", f"CASE WHEN i >= {start} AND i < {at} THEN coalesce(p.{name}_s, 0) + {x} END")
        return self.put(name, f"CASE WHEN i = {at} THEN (coalesce(p.{name}_s, 0) + {x}) / {n} WHEN i > {at} THEN (p.{name} * {n - 1} + {x}) / {n} END")

    def chain(self, name: str, n: int, times: int) -> list[str]:
        x, at, out = "close", 1, []
        for k in range(1, times + 1):
            x, at = self.ema(f"{name}{k}", x, n, at)
            out.append(x)
        return out

    def kama(self, name: str, n: int) -> str:
        er = f"CASE WHEN noise{n} = 0 THEN 1 ELSE least(1, abs(close - c{n}) / noise{n}) END"
        base = f"(CASE WHEN i = {n + 1} THEN c0 ELSE p.{name} END)"
        return self.put(name, f"CASE WHEN i > {n} THEN {base} + (({er}) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31) ** 2 * (close - {base}) END")

    def table(self, name: str, start: int = 0, first: str = "SELECT DISTINCT source") -> str:
        """The recursive table (source, i, p), p being the struct of all columns."""
        pack = lambda d: "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in d.items()) + ")"
        rows = f"(SELECT b.*, {name}.p FROM {name} JOIN b ON b.source = {name}.source AND b.i = {name}.i + 1)"
        level: dict[str, int] = {}
        for k, v in self.columns.items():  # a column is a level above those that it reads: a select list can't share its own columns
            level[k] = 1 + max((level[w] for w in re.findall(r"(?<![.\w])[a-z_]\w*", v) if w in level), default=0)
        for n in range(1, max(level.values()) + 1):
            rows = f"(SELECT *, {', '.join(f'{v} AS {k}' for k, v in self.columns.items() if level[k] == n)} FROM {rows})"
        return f"""{name} AS ({first}, {start}::BIGINT AS i, {pack(self.first)} AS p FROM b{f" WHERE i <= {start} GROUP BY source" if start else ""} UNION ALL
            SELECT source, i, {pack({k: k for k in self.columns})} FROM {rows})"""


def averages() -> Steps:
    s = Steps()
    s.ema("ema20", "close", 20)
    s.chain("d", 10, 3)
    s.kama("kama10", 10)
    for name, x in (("g", "up"), ("f", "fall")):  # means of gains and losses, from row 2
        s.put(name, f"CASE WHEN i = 1 THEN 0 WHEN i <= 15 THEN p.{name} + {x} / 14 ELSE (p.{name} * 13 + {x}) / 14 END")
    s.put("fast", "CASE WHEN i = 26 THEN m12 WHEN i > 26 THEN p.fast + (close - p.fast) * 2 / 13 END")
    s.put("slow", "CASE WHEN i = 26 THEN m26 WHEN i > 26 THEN p.slow + (close - p.slow) * 2 / 27 END")
    s.ema("signal", "(fast - slow)", 9, 26)
    s.wilder("atr14", "tr", 14, 2)
    for name, x in (("sp", "pm"), ("sm_", "mm"), ("st", "tr")):
        s.put(name, f"CASE WHEN i = 1 THEN 0 WHEN i < 15 THEN p.{name} + {x} ELSE p.{name} - p.{name} / 14 + {x} END")
    s.put("pdi", "CASE WHEN i >= 15 THEN CASE WHEN st <> 0 THEN 100 * sp / st ELSE 0 END END")
    s.put("mdi", "CASE WHEN i >= 15 THEN CASE WHEN st <> 0 THEN 100 * sm_ / st ELSE 0 END END")
    s.put("dx", "CASE WHEN i >= 15 THEN CASE WHEN pdi + mdi <> 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) ELSE 0 END END")
    s.wilder("adx", "dx", 14, 15)
    s.put("ad", "coalesce(p.ad, 0) + CASE WHEN high > low THEN (2 * close - low - high) / (high - low) * volume ELSE 0 END")
    s.put("ad3", "CASE WHEN i = 1 THEN ad ELSE 0.5 * ad + 0.5 * p.ad3 END")
    s.put("ad10", "CASE WHEN i = 1 THEN ad ELSE 2.0 / 11 * ad + 9.0 / 11 * p.ad10 END")
    s.wilder("atr10", "tr", 10, 2)
    top, bottom = ("((high + low) / 2 + 3 * atr10)", "((high + low) / 2 - 3 * atr10)")
    s.put("top", f"CASE WHEN i = 11 OR {top} < p.top OR c0 > p.top THEN {top} ELSE p.top END")
    s.put("bottom", f"CASE WHEN i = 11 OR {bottom} > p.bottom OR c0 < p.bottom THEN {bottom} ELSE p.bottom END")
    s.put("bull", "CASE WHEN i = 11 THEN close >= c0 WHEN i > 11 THEN CASE WHEN p.bull THEN close >= bottom ELSE close > top END END", "NULL::BOOLEAN")
    return s


def recursive_set(bars: str) -> str:
    return f"""{bars}, {ROWS}, {averages().table("r")}
        SELECT b.source, b.time, b.open, b.high, b.low, b.close, b.volume, round(p.ema20, 4) AS ema20, round(2 * p.d1 - p.d2, 2) AS dema10, round(3 * p.d1 - 3 * p.d2 + p.d3, 2) AS tema10,
        round(100 * (p.d3 / nullif(lag(p.d3) OVER w, 0) - 1), 4) AS trix10, round(p.kama10, 2) AS kama10, round(CASE WHEN b.i >= 15 THEN CASE WHEN p.f = 0 THEN 100 ELSE 100 - 100 / (1 + p.g / p.f) END END, 4) AS rsi14,
        round(CASE WHEN b.i >= 15 THEN CASE WHEN p.g + p.f = 0 THEN 0 ELSE 100 * (p.g - p.f) / (p.g + p.f) END END, 4) AS cmo14, round(CASE WHEN p.signal IS NOT NULL THEN p.fast - p.slow END, 2) AS macd, round(p.signal, 2) AS macd_signal,
        round(p.fast - p.slow - p.signal, 2) AS macd_hist, round(p.atr14, 2) AS atr14, round(p.pdi, 4) AS plus_di, round(p.mdi, 4) AS minus_di, round(p.dx, 4) AS dx, round(p.adx, 4) AS adx,
        round(CASE WHEN b.i >= 10 THEN p.ad3 - p.ad10 END, 3) + 0.0 AS adosc, round(CASE WHEN p.bull THEN p.bottom WHEN NOT p.bull THEN p.top END / close, 6) AS supertrend, p.bull::INT::DOUBLE AS bullish
        FROM b JOIN r ON r.source = b.source AND r.i = b.i WINDOW w AS (PARTITION BY b.source ORDER BY b.time)"""


def stops() -> Steps:
    s = averages()
    s.chain("t", 5, 6)
    s.kama("kama5", 5)
    for n in range(2, 11):
        s.ema(f"m{n}", "close", n)
    for name, x in (("dp", "pm"), ("dm", "mm")):
        s.put(name, f"CASE WHEN i = 1 THEN 0 ELSE p.{name} + {x} - CASE WHEN i >= 15 THEN p.{name} / 14 ELSE 0 END END")
    # the parabolic stop: _0 is what a step starts from, chosen in row 2
    s.put("side_0", "CASE WHEN i = 2 THEN CASE WHEN l0 - low > greatest(high - h0, 0) THEN -1.0 ELSE 1.0 END ELSE p.side END")
    s.put("stop_0", "CASE WHEN i = 2 THEN CASE WHEN side_0 > 0 THEN l0 ELSE h0 END ELSE p.stop END")
    s.put("ext_0", "CASE WHEN i = 2 THEN CASE WHEN side_0 > 0 THEN high ELSE low END ELSE p.ext END")
    s.put("pace_0", "CASE WHEN i = 2 THEN 0.02 ELSE p.pace END")
    s.put("turns", "side_0 * CASE WHEN side_0 > 0 THEN low ELSE high END <= side_0 * stop_0", "NULL::BOOLEAN")
    s.put("side", "CASE WHEN turns THEN -side_0 ELSE side_0 END")
    s.put("worst", "CASE WHEN side > 0 THEN least(low, CASE WHEN i = 2 THEN low ELSE l0 END) ELSE -greatest(high, CASE WHEN i = 2 THEN high ELSE h0 END) END")
    s.put("sar", "CASE WHEN turns THEN side * least(side * ext_0, worst) ELSE stop_0 END")
    s.put("better", "NOT turns AND side * CASE WHEN side > 0 THEN high ELSE low END > side * ext_0", "NULL::BOOLEAN")
    s.put("ext", "CASE WHEN turns THEN CASE WHEN side > 0 THEN high ELSE low END WHEN better THEN CASE WHEN side > 0 THEN high ELSE low END ELSE ext_0 END")
    s.put("pace", "CASE WHEN turns THEN 0.02 WHEN better THEN least(pace_0 + 0.02, 0.2) ELSE pace_0 END")
    s.put("stop", "side * least(side * (sar + pace * (ext - sar)), worst)")
    return s


def cycle(start: int) -> Steps:
    """The dominant cycle from the row after `start` on; lists hold the newest value first."""
    s, zeros = Steps(), lambda n: f"list_value({', '.join(['0.0::DOUBLE'] * n)})"
    zero = "0.0::DOUBLE"
    taps = lambda t: f"(0.0962 * ({t}[1] - {t}[7]) + 0.5769 * ({t}[3] - {t}[5])) * stretch"
    s.put("prices", "list_prepend(close, p.prices)[1:50]", f"list_concat(list(close ORDER BY i DESC), {zeros(50)})[1:50]")
    s.put("smooth", "list_prepend(sm, p.smooth)[1:50]", zeros(50))
    s.put("stretch", "0.075 * p.period + 0.54", zero)
    s.put("t1", "list_prepend(sm, p.t1)[1:7]", zeros(7))
    s.put("det", taps("t1"), zero)
    s.put("dets", "list_prepend(det, p.dets)[1:7]", zeros(7))
    s.put("quad", taps("dets"), zero)
    s.put("inp", "dets[4]", zero)
    s.put("t3", "list_prepend(inp, p.t3)[1:7]", zeros(7))
    s.put("t4", "list_prepend(quad, p.t4)[1:7]", zeros(7))
    s.put("quad2", f"0.2 * (quad + {taps('t3')}) + 0.8 * p.quad2", zero)
    s.put("in2", f"0.2 * (inp - {taps('t4')}) + 0.8 * p.in2", zero)
    s.put("re", "0.2 * (in2 * p.in2 + quad2 * p.quad2) + 0.8 * p.re", zero)
    s.put("im", "0.2 * (in2 * p.quad2 - quad2 * p.in2) + 0.8 * p.im", zero)
    s.put("raw", "CASE WHEN re <> 0 AND im <> 0 THEN 360 / degrees(atan(im / re)) ELSE p.period END", zero)
    s.put("period", "0.2 * least(greatest(greatest(least(raw, 1.5 * p.period), 0.67 * p.period), 6), 50) + 0.8 * p.period", zero)
    s.put("sp", "0.33 * period + 0.67 * p.sp", zero)
    if start < 30:
        s.put("angle", "CASE WHEN inp <> 0 THEN degrees(atan(quad / inp)) ELSE 0 END", zero)
        s.put("step", "greatest(0.5 / greatest(p.angle - angle, 1), 0.05)", zero)
        s.put("mama", "p.mama + step * (close - p.mama)", zero)
        s.put("fama", "p.fama + step / 2 * (mama - p.fama)", zero)
        return s
    s.put("n", "floor(sp + 0.5)::BIGINT", "0::BIGINT")
    for name, f in (("real", "sin"), ("imag", "cos")):
        s.put(name, f"coalesce(list_sum(list_transform(range(0, n), lambda k: {f}(radians(360.0 * k / n)) * smooth[k + 1])), 0)", zero)
    s.put("turned", "CASE WHEN imag <> 0 THEN degrees(atan(real / imag)) WHEN real > 0 THEN 90 WHEN real < 0 THEN -90 ELSE 0 END + 90 + 360 / nullif(sp, 0) + CASE WHEN imag < 0 THEN 180 ELSE 0 END", zero)
    s.put("phase", "CASE WHEN n = 0 THEN 0 WHEN turned > 315 THEN turned - 360 ELSE turned END", zero)
    s.put("flat", "CASE WHEN n = 0 THEN 0 ELSE list_sum(prices[1:n]) / n END", zero)
    s.put("flats", "list_prepend(flat, p.flats)[1:4]", zeros(4))
    s.put("line", "(4 * flats[1] + 3 * flats[2] + 2 * flats[3] + flats[4]) / 10", zero)
    s.put("gap", "sin(radians(phase)) - sin(radians(phase + 45))", zero)
    s.put("crossed", "(gap > 0 AND p.gap <= 0) OR (gap < 0 AND p.gap >= 0)", "NULL::BOOLEAN")
    s.put("days", "CASE WHEN crossed THEN 1 ELSE p.days + 1 END", zero)
    s.put("cyclic", "crossed OR days < 0.5 * sp OR (phase - p.phase > 0.67 * 360 / nullif(sp, 0) AND phase - p.phase < 1.5 * 360 / nullif(sp, 0))", "NULL::BOOLEAN")
    s.put("mode", "CASE WHEN NOT coalesce(cyclic, false) OR (line <> 0 AND abs((smooth[1] - line) / line) >= 0.015) THEN 1.0 ELSE 0.0 END", zero)
    return s


def cycles(bars: str) -> str:
    mavp = "CASE " + " ".join(f"WHEN greatest(2, least(10, b.volume::INT)) = {n} THEN p.m{n}" for n in range(2, 11)) + " END"
    w = lambda n: f"(PARTITION BY source ORDER BY time ROWS {n - 1} PRECEDING)"
    return f"""{bars}, {ROWS}, {stops().table("r")}, {cycle(12).table("s", 12, "SELECT source")}, {cycle(37).table("l", 37, "SELECT source")},
        k AS (SELECT b.*, p, CASE WHEN b.i >= 15 THEN CASE WHEN p.f = 0 THEN 100 ELSE 100 - 100 / (1 + p.g / p.f) END END AS rsi, CASE WHEN b.i >= 26 THEN m12 - m26 END AS xl, {mavp} AS mavp,
            p.fast - p.slow AS line FROM b JOIN r ON r.source = b.source AND r.i = b.i),
        x AS (SELECT *, CASE WHEN i >= 19 THEN CASE WHEN max(rsi) OVER {w(5)} > min(rsi) OVER {w(5)} THEN 100 * (rsi - min(rsi) OVER {w(5)}) / (max(rsi) OVER {w(5)} - min(rsi) OVER {w(5)}) ELSE 0 END END AS rk,
            CASE WHEN i >= 34 THEN avg(xl) OVER {w(9)} END AS xs, lag(p.adx, 13) OVER {BY} AS adx0 FROM k),
        y AS (SELECT *, CASE WHEN i >= 21 THEN avg(rk) OVER {w(3)} END AS rd FROM x)
        SELECT y.source, y.time, y.open, y.high, y.low, y.close, y.volume, CASE WHEN y.i > 32 THEN round(s.p.sp, 4) END AS period, CASE WHEN y.i > 63 THEN round(l.p.phase, 3) END AS phase,
        CASE WHEN y.i > 32 THEN round(s.p.inp, 2) + 0.0 END AS in_phase, CASE WHEN y.i > 32 THEN round(s.p.quad, 2) + 0.0 END AS quadrature, CASE WHEN y.i > 63 THEN round(sin(radians(l.p.phase)), 4) + 0.0 END AS sine,
        CASE WHEN y.i > 63 THEN round(sin(radians(l.p.phase + 45)), 4) + 0.0 END AS lead, CASE WHEN y.i > 63 THEN round(l.p.line / y.close, 6) END AS trendline, CASE WHEN y.i > 63 THEN l.p.mode END AS mode,
        CASE WHEN y.i > 32 THEN round(s.p.mama, 2) END AS mama, CASE WHEN y.i > 32 THEN round(s.p.fama, 2) END AS fama,
        round((1 + 3 * 0.7 + 3 * 0.7 ** 2 + 0.7 ** 3) * y.p.t3 + (-3 * 0.7 - 6 * 0.7 ** 2 - 3 * 0.7 ** 3) * y.p.t4 + (3 * 0.7 ** 2 + 3 * 0.7 ** 3) * y.p.t5 - 0.7 ** 3 * y.p.t6, 2) AS t3,
        CASE WHEN y.i > 1 THEN round(y.p.sar / y.close, 6) END AS sar, CASE WHEN y.i > 1 THEN round(y.p.sar * y.p.side / y.close, 6) END AS sarext, round(CASE WHEN y.close = 0 THEN 0 ELSE 100 * y.p.atr14 / y.close END, 4) AS natr,
        CASE WHEN y.i >= 41 THEN round((y.p.adx + adx0) / 2, 4) END AS adxr, CASE WHEN y.i >= 14 THEN round(y.p.dp, 2) END AS plus_dm, CASE WHEN y.i >= 14 THEN round(y.p.dm, 2) END AS minus_dm,
        CASE WHEN rd IS NOT NULL THEN round(rk, 3) END AS rk, round(rd, 3) AS rd, CASE WHEN xs IS NOT NULL THEN round(xl / y.close, 6) END AS xl, round(xs / y.close, 6) AS xs, round((xl - xs) / y.close, 6) AS xh,
        CASE WHEN y.p.signal IS NOT NULL THEN round(line, 2) END AS ml, round(y.p.signal, 2) AS ms, round(line - y.p.signal, 2) AS mh,
        round(y.p.m5 + 2 * dev5, 2) AS b_up, round(y.p.m5, 2) AS b_mid, round(y.p.m5 - 2 * dev5, 2) AS b_low, round(mavp, 5) AS mavp, round(y.p.m5 - y.p.m10, 2) AS apo,
        round(CASE WHEN y.p.kama10 = 0 THEN 0 ELSE (y.p.kama5 - y.p.kama10) / y.p.kama10 * 100 END, 4) AS ppo
        FROM y LEFT JOIN s ON s.source = y.source AND s.i = y.i LEFT JOIN l ON l.source = y.source AND l.i = y.i"""
