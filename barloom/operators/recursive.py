"""Operators that depend on their own past, as folds over rows in time order.

Rows are hash-partitioned by source and sorted within partitions; each task steps through its rows in batches and carries
a fold's state from one to the next, so memory doesn't grow with the length of a series. A missing input (NULL; NaN is a
number) gives a missing output and holds the state. All folds of a query share one exchange and one pass.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Step = Callable[..., float | None]


def ema(n: int, seed: str = "mean") -> Step:
    """Seeded by the mean of the first n samples (or by the first one), then a * x + (1 - a) * value."""
    a, seen, value = 2 / (n + 1), [], None

    def step(x: float | None) -> float | None:
        nonlocal value
        if x is None:
            seen.clear() if value is None else None
            return None
        if value is None:
            seen.append(x)
            if len(seen) < n and seed == "mean":
                return None
            value = sum(seen) / len(seen)
        else:
            value = a * x + (1 - a) * value
        return value

    return step


def _through(*steps: Step) -> Callable[[float | None], list]:
    def run(x: float | None) -> list:
        out = []
        for s in steps:
            x = s(x) if x is not None else None
            out.append(x)
        return out

    return run


def dema(n: int) -> Step:
    chain = _through(ema(n), ema(n))
    return lambda x: None if None in (e := chain(x)) else 2 * e[0] - e[1]


def tema(n: int) -> Step:
    chain = _through(ema(n), ema(n), ema(n))
    return lambda x: None if None in (e := chain(x)) else 3 * e[0] - 3 * e[1] + e[2]


def trix(n: int) -> Step:
    chain, last = _through(ema(n), ema(n), ema(n)), [None]

    def step(x: float | None) -> float | None:
        e = chain(x)[2]
        if e is None:
            return None
        before, last[0] = last[0], e
        return None if not before else 100 * (e - before) / before

    return step


def kama(n: int) -> Step:
    """Efficiency of the last n moves sets the pace between 2/3 and 2/31; seeded by the price before."""
    past: deque = deque(maxlen=n + 1)
    value = None

    def step(x: float | None) -> float | None:
        nonlocal value
        if x is None:
            return None
        past.append(x)
        if len(past) <= n:
            return None
        p = list(past)
        noise = sum(abs(b - a) for a, b in zip(p, p[1:], strict=False))
        er = 1.0 if noise == 0 else min(1.0, abs(x - p[0]) / noise)
        pace = (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2
        base = p[-2] if value is None else value
        value = base + pace * (x - base)
        return value

    return step


def _gains(n: int, make: Callable[[float, float], float]) -> Step:
    """Wilder's means of gains and losses, seeded by the first n moves."""
    last, moves, g, b = None, 0, 0.0, 0.0

    def step(x: float | None) -> float | None:
        nonlocal last, moves, g, b
        if x is None:
            return None
        if last is None:
            last = x
            return None
        d, last = x - last, x
        up, down = max(d, 0.0), max(-d, 0.0)
        moves += 1
        if moves <= n:
            g, b = g + up / n, b + down / n
        else:
            g, b = (g * (n - 1) + up) / n, (b * (n - 1) + down) / n
        return make(g, b) if moves >= n else None

    return step


def rsi(n: int) -> Step:
    return _gains(n, lambda g, b: 100.0 if b == 0 else 100 - 100 / (1 + g / b))


def cmo(n: int) -> Step:
    return _gains(n, lambda g, b: 0.0 if g + b == 0 else 100 * (g - b) / (g + b))


def macd(fast: int = 12, slow: int = 26, signal: int = 9) -> Step:
    """(line, signal, difference). Both means start at the slow one's first full window, the fast one on its last samples."""
    fast, slow = min(fast, slow), max(fast, slow)
    past: deque = deque(maxlen=slow)
    f = s = None
    sig = ema(signal)

    def step(x: float | None) -> tuple:
        nonlocal f, s
        if x is None:
            return None, None, None
        past.append(x)
        if len(past) < slow:
            return None, None, None
        if s is None:
            p = list(past)
            f, s = sum(p[-fast:]) / fast, sum(p) / slow
        else:
            f, s = f + (x - f) * 2 / (fast + 1), s + (x - s) * 2 / (slow + 1)
        line = f - s
        g = sig(line)
        return (None, None, None) if g is None else (line, g, line - g)

    return step


def atr(n: int = 14) -> Step:
    last, seen, value = None, [], None

    def step(h: float | None, lo: float | None, c: float | None) -> float | None:
        nonlocal last, value
        if None in (h, lo, c):
            return None
        before, last = last, c
        if before is None:
            return None
        tr = max(h - lo, abs(before - h), abs(before - lo))
        if value is None:
            seen.append(tr)
            if len(seen) < n:
                return None
            value = sum(seen) / n
        else:
            value += (tr - value) / n
        return value

    return step


def directional(n: int = 14) -> Step:
    """(plus_di, minus_di, dx, adx): sums of n - 1 moves seed, Wilder's smoothing follows; adx starts on the mean of n dx."""
    last, count, sums, dxs, value = None, 0, [0.0, 0.0, 0.0], [], None

    def step(h: float | None, lo: float | None, c: float | None) -> tuple:
        nonlocal last, count, value
        none = (None, None, None, None)
        if None in (h, lo, c):
            return none
        before, last = last, (h, lo, c)
        if before is None:
            return none
        up, down = h - before[0], before[1] - lo
        moves = (up if up > down and up > 0 else 0.0, down if down > up and down > 0 else 0.0, max(h - lo, abs(before[2] - h), abs(before[2] - lo)))
        count += 1
        for k in range(3):
            sums[k] = sums[k] + moves[k] if count < n else sums[k] - sums[k] / n + moves[k]
        if count < n:
            return none
        p, m = (100 * sums[k] / sums[2] if sums[2] else 0.0 for k in (0, 1))
        dx = 100 * abs(p - m) / (p + m) if p + m else 0.0
        if value is None:
            dxs.append(dx)
            value = sum(dxs) / n if len(dxs) == n else None
        else:
            value = (value * (n - 1) + dx) / n
        return p, m, dx, value

    return step


def adosc(fast: int = 3, slow: int = 10) -> Step:
    fast, slow = min(fast, slow), max(fast, slow)
    total, count, f, s = 0.0, 0, ema(fast, "first"), ema(slow, "first")

    def step(h: float | None, lo: float | None, c: float | None, v: float | None) -> float | None:
        nonlocal total, count
        if None in (h, lo, c, v):
            return None
        if h - lo > 0:
            total += (2 * c - lo - h) / (h - lo) * v
        count += 1
        a, b = f(total), s(total)
        return a - b if count >= slow else None

    return step


def supertrend(n: int = 10, multiplier: float = 3.0) -> Step:
    """(line, bullish): bands of the mean price and the average range that only tighten until the close breaks one."""
    mean, up, down, bull, close = atr(n), None, None, True, None

    def step(h: float | None, lo: float | None, c: float | None) -> tuple:
        nonlocal up, down, bull, close
        a = mean(h, lo, c)
        if a is None:
            close = close if None in (h, lo, c) else c
            return None, None
        top, bottom = (h + lo) / 2 + multiplier * a, (h + lo) / 2 - multiplier * a
        if up is None:
            up, down, bull = top, bottom, close is not None and c >= close
        else:
            up = top if top < up or close > up else up
            down = bottom if bottom > down or close < down else down
            bull = c >= down if bull else c > up
        close = c
        return (down if bull else up), bull

    return step


def fold(df: DataFrame, folds: dict[str, tuple[Callable[[], Step], list[str], list[str]]], parts: int | None = None) -> DataFrame:
    """df with the outputs of folds: name -> (maker of a step, input columns, output columns of double)."""
    outputs = [c for _, _, outs in folds.values() for c in outs]
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in outputs]])
    inputs = {name: ins for name, (_, ins, _) in folds.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, steps = object(), {}
        for b in batches:
            made: dict[str, list] = {c: [] for c in outputs}
            cols = {c: b.column(c).cast(pa.float64()).to_pylist() for ins in inputs.values() for c in ins}  # NULL is None, NaN a number
            for k, at in enumerate(b.column("source").to_pylist()):
                if at != source:
                    source, steps = at, {name: make() for name, (make, _, _) in folds.items()}
                for name, (_, ins, outs) in folds.items():
                    got = steps[name](*[cols[c][k] for c in ins])
                    for c, v in zip(outs, got if isinstance(got, tuple) else (got,), strict=True):
                        made[c].append(None if v is None else float(v))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(made[c], pa.float64()) for c in outputs]], [*b.schema.names, *outputs])

    by = df.repartition("source") if parts is None else df.repartition(parts, "source")
    return by.sortWithinPartitions("source", "time").mapInArrow(run, schema)
