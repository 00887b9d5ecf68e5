"""Moving averages by name, and the oscillators made of them, as steps for recursive.fold; parabolic stops too."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

from . import cycle
from . import recursive as R

Step = Callable[..., object]


def _over(n: int, value: Callable[[list[float]], float]) -> Step:
    """A value of the last n samples, NULL while one of them is missing."""
    past: deque = deque(maxlen=n)

    def step(x: float | None) -> float | None:
        past.append(x)
        return None if len(past) < n or None in past else value(list(past))

    return step


def sma(n: int) -> Step:
    return _over(n, lambda p: math.fsum(p) / n)


def wma(n: int) -> Step:
    return _over(n, lambda p: sum(w * v for w, v in enumerate(p, 1)) * 2 / (n * (n + 1)))


def trima(n: int) -> Step:
    weights = [min(k + 1, n - k) for k in range(n)]
    return _over(n, lambda p: sum(w * v for w, v in zip(weights, p, strict=True)) / sum(weights))


def t3(n: int = 5, volume_factor: float = 0.7) -> Step:
    """Six means in a row; the last four are weighted by the powers of the factor."""
    chain, v = R._through(*[R.ema(n) for _ in range(6)]), volume_factor
    weights = (1 + 3 * v + 3 * v**2 + v**3, -3 * v - 6 * v**2 - 3 * v**3, 3 * v**2 + 3 * v**3, -(v**3))
    return lambda x: None if None in (e := chain(x)) else sum(w * m for w, m in zip(weights, e[2:], strict=True))


def _mama_only() -> Step:
    step = cycle.mama()
    return lambda x: step(x)[0]


#: Moving averages by name; mama has no length.
KINDS: dict[str, Callable[[int], Step]] = {"sma": sma, "ema": R.ema, "wma": wma, "dema": R.dema, "tema": R.tema, "trima": trima, "kama": R.kama, "mama": lambda _: _mama_only(), "t3": t3}


def ma(n: int, kind: str = "sma") -> Step:
    if kind not in KINDS:
        raise ValueError(f"no moving average {kind!r}; known: {', '.join(KINDS)}")
    return KINDS[kind](n)


def mavp(least: int, most: int, kind: str = "sma") -> Step:
    """(x, period): the average over the period, whole and held between least and most."""
    steps = {n: ma(n, kind) for n in range(least, most + 1)}

    def step(x: float | None, period: float | None) -> float | None:
        values = {n: s(x) for n, s in steps.items()}
        return None if period is None else values[min(max(int(period), least), most)]

    return step


def _fast_slow(fast: int, slow: int, kind: str, value: Callable[[float, float], float]) -> Step:
    if kind == "mama":
        raise ValueError("mama has no length to compare")
    a, b = ma(min(fast, slow), kind), ma(max(fast, slow), kind)

    def step(x: float | None) -> float | None:
        f, s = a(x), b(x)
        return None if f is None or s is None else value(f, s)

    return step


def apo(fast: int = 12, slow: int = 26, kind: str = "sma") -> Step:
    return _fast_slow(fast, slow, kind, lambda f, s: f - s)


def ppo(fast: int = 12, slow: int = 26, kind: str = "sma") -> Step:
    return _fast_slow(fast, slow, kind, lambda f, s: (f - s) / s * 100 if s else 0.0)


def macdfix(signal: int = 9) -> Step:
    return R.macd(12, 26, signal)


def macdext(fast: int = 12, fast_kind: str = "sma", slow: int = 26, slow_kind: str = "sma", signal: int = 9, signal_kind: str = "sma") -> Step:
    """(line, signal, difference) of three averages of any kind."""
    a, b, c = ma(fast, fast_kind), ma(slow, slow_kind), ma(signal, signal_kind)

    def step(x: float | None) -> tuple:
        f, s = a(x), b(x)
        line = None if f is None or s is None else f - s
        g = c(line) if line is not None else None
        return (None, None, None) if g is None else (line, g, line - g)

    return step


def bbands(n: int = 5, up: float = 2.0, down: float = 2.0, kind: str = "sma") -> Step:
    """(upper, middle, lower): deviations of the last n samples round an average of any kind."""

    def deviation(p: list[float]) -> float:
        m = math.fsum(p) / n
        return math.sqrt(math.fsum((v - m) ** 2 for v in p) / n)

    mean, dev = ma(n, kind), _over(n, deviation)

    def step(x: float | None) -> tuple:
        m, d = mean(x), dev(x)
        return (None, None, None) if m is None or d is None else (m + up * d, m, m - down * d)

    return step


def _place(n: int) -> Step:
    """Where the last of (high, low, close) stands in the range of n, in percent; 0 in a flat range."""
    past: deque = deque(maxlen=n)

    def step(h: float | None, lo: float | None, c: float | None) -> float | None:
        past.append((h, lo, c))
        if len(past) < n or any(None in p for p in past):
            return None
        top, bottom = max(p[0] for p in past), min(p[1] for p in past)
        return 100 * (c - bottom) / (top - bottom) if top > bottom else 0.0

    return step


def stochf(fast_k: int = 5, fast_d: int = 3, kind: str = "sma") -> Step:
    """(fast k, fast d)."""
    place, mean = _place(fast_k), ma(fast_d, kind)

    def step(h: float | None, lo: float | None, c: float | None) -> tuple:
        k = place(h, lo, c)
        d = mean(k) if k is not None else None
        return (None, None) if d is None else (k, d)

    return step


def stoch(fast_k: int = 5, slow_k: int = 3, slow_k_kind: str = "sma", slow_d: int = 3, slow_d_kind: str = "sma") -> Step:
    """(slow k, slow d)."""
    place, chain = _place(fast_k), R._through(ma(slow_k, slow_k_kind), ma(slow_d, slow_d_kind))

    def step(h: float | None, lo: float | None, c: float | None) -> tuple:
        k, d = chain(place(h, lo, c))
        return (None, None) if d is None else (k, d)

    return step


def stochrsi(n: int = 14, fast_k: int = 5, fast_d: int = 3, kind: str = "sma") -> Step:
    """(fast k, fast d) of the relative strength."""
    strength, fast = R.rsi(n), stochf(fast_k, fast_d, kind)

    def step(x: float | None) -> tuple:
        r = strength(x)
        return (None, None) if r is None else fast(r, r, r)

    return step


def natr(n: int = 14) -> Step:
    mean = R.atr(n)

    def step(h: float | None, lo: float | None, c: float | None) -> float | None:
        a = mean(h, lo, c)
        return None if a is None else 100 * a / c if c else 0.0

    return step


def moves(n: int = 14) -> Step:
    """(plus_dm, minus_dm): sums of n - 1 moves, then Wilder's smoothing; raw moves for n of 1."""
    last, count, sums = None, 0, [0.0, 0.0]

    def step(h: float | None, lo: float | None) -> tuple:
        nonlocal last, count
        if None in (h, lo):
            return None, None
        before, last = last, (h, lo)
        if before is None:
            return None, None
        up, down = h - before[0], before[1] - lo
        now = (up if up > max(down, 0) else 0.0, down if down > max(up, 0) else 0.0)
        if n <= 1:
            return now
        count += 1
        for k in (0, 1):
            sums[k] += now[k] - (sums[k] / n if count >= n else 0.0)
        return tuple(sums) if count >= n - 1 else (None, None)

    return step


def adxr(n: int = 14) -> Step:
    """The mean of adx and that of n - 1 samples before."""
    way, past = R.directional(n), deque(maxlen=n)

    def step(h: float | None, lo: float | None, c: float | None) -> float | None:
        a = way(h, lo, c)[3]
        if a is None:
            return None
        past.append(a)
        return (a + past[0]) / 2 if len(past) == n else None

    return step


def sarext(start: float = 0.0, offset: float = 0.0, long: tuple[float, float, float] = (0.02, 0.02, 0.2), short: tuple[float, float, float] = (0.02, 0.02, 0.2), signed: bool = True) -> Step:
    """Parabolic stop: (first, step, most) of the acceleration by side. Prices of a short are mirrored, so one rule serves both sides."""
    paces = {s: (min(first, most), min(add, most), most) for s, (first, add, most) in ((1, long), (-1, short))}
    before = stop = extreme = None
    side, pace = 1, 0.0

    def step(h: float | None, lo: float | None) -> float | None:
        nonlocal before, stop, extreme, side, pace
        if None in (h, lo):
            return None
        if before is None:
            before = (h, lo)
            return None
        if stop is None:  # the first move chooses the side
            fall = before[1] - lo
            side = (1 if start > 0 else -1) if start else -1 if fall > max(h - before[0], 0) else 1
            stop = abs(start) if start else before[1] if side > 0 else before[0]
            extreme, pace, before = (h if side > 0 else lo), paces[side][0], (h, lo)
        worst = lambda s: min(s * v for p in (before, (h, lo)) for v in p)  # noqa: E731  (of both rows, mirrored)
        best, adverse = (h, lo) if side > 0 else (lo, h)
        if side * adverse <= side * stop:  # turns over, onto the extreme but outside both rows
            side = -side
            stop = side * min(side * extreme, worst(side))
            stop -= side * stop * offset
            out, extreme, pace = stop, adverse, paces[side][0]
        else:
            out = stop
            if side * best > side * extreme:
                extreme, pace = best, min(pace + paces[side][1], paces[side][2])
        shown = out * side if signed else out
        stop = side * min(side * (stop + pace * (extreme - stop)), worst(side))
        before = (h, lo)
        return shown

    return step


def sar(acceleration: float = 0.02, maximum: float = 0.2) -> Step:
    pace = (acceleration, acceleration, maximum)
    return sarext(0.0, 0.0, pace, pace, signed=False)
