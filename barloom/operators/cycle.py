"""Dominant cycles by the Hilbert transform, as steps for recursive.fold.

Prices are smoothed by weights 4, 3, 2, 1; four taps of the Hilbert transform, stretched by the period found so far, give
the detrended price and its quadrature. The phase step between samples gives the period, held between 6 and 50 samples.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

#: Fixed values of the transform: taps, and the samples before it starts and before it gives a result.
NEAR, FAR = 0.0962, 0.5769
SHORT, LONG = (12, 32), (37, 63)


class _Taps:
    """The last seven samples, zero before the first."""

    def __init__(self) -> None:
        self.past: deque = deque([0.0] * 7, maxlen=7)

    def __call__(self, x: float, stretch: float) -> float:
        self.past.appendleft(x)
        p = self.past
        return (NEAR * (p[0] - p[6]) + FAR * (p[2] - p[4])) * stretch


class Cycle:
    """What is known of the cycle after each price."""

    def __init__(self, start: int) -> None:
        self.start, self.n = start, 0
        self.price: deque = deque([0.0] * 50, maxlen=50)
        self.smooth: deque = deque([0.0] * 50, maxlen=50)
        self.detrended: deque = deque([0.0] * 4, maxlen=4)
        self.taps = [_Taps() for _ in range(4)]
        self.in2 = self.quad2 = self.re = self.im = self.period = self.smooth_period = 0.0
        self.in_phase = self.quadrature = 0.0

    def push(self, x: float) -> bool:
        """Takes a price; true once the transform has started."""
        self.price.appendleft(x)
        self.n += 1
        if self.n <= self.start:
            return False
        p = self.price
        value = (4 * p[0] + 3 * p[1] + 2 * p[2] + p[3]) / 10
        self.smooth.appendleft(value)
        stretch = 0.075 * self.period + 0.54
        d = self.taps[0](value, stretch)
        self.detrended.appendleft(d)
        self.quadrature, self.in_phase = self.taps[1](d, stretch), self.detrended[3]
        turned_in, turned_quad = self.taps[2](self.in_phase, stretch), self.taps[3](self.quadrature, stretch)
        soft = lambda new, old: 0.2 * new + 0.8 * old
        quad2, in2 = soft(self.quadrature + turned_in, self.quad2), soft(self.in_phase - turned_quad, self.in2)
        self.re = soft(in2 * self.in2 + quad2 * self.quad2, self.re)
        self.im = soft(in2 * self.quad2 - quad2 * self.in2, self.im)
        self.in2, self.quad2 = in2, quad2
        before = period = self.period
        if self.re and self.im:
            period = 360 / math.degrees(math.atan(self.im / self.re))
        period = max(min(period, 1.5 * before), 0.67 * before)
        self.period = soft(min(max(period, 6.0), 50.0), before)
        self.smooth_period = 0.33 * self.period + 0.67 * self.smooth_period
        return True

    def span(self) -> int:
        return int(self.smooth_period + 0.5)


class _Phase:
    """The phase of the dominant cycle in degrees; 0 while the cycle has no length."""

    def __call__(self, c: Cycle) -> float:
        n = c.span()
        if not n:
            return 0.0
        angles = [math.radians(360 * k / n) for k in range(n)]
        real = sum(math.sin(a) * c.smooth[k] for k, a in enumerate(angles))
        imag = sum(math.cos(a) * c.smooth[k] for k, a in enumerate(angles))
        turned = math.degrees(math.atan(real / imag)) if imag else math.copysign(90, real) if real else 0.0
        turned += 90 + 360 / c.smooth_period + (180 if imag < 0 else 0)
        return turned - 360 if turned > 315 else turned


class _Trend:
    """The mean price over one cycle, smoothed by weights 4, 3, 2, 1."""

    def __init__(self) -> None:
        self.past: deque = deque([0.0] * 4, maxlen=4)

    def __call__(self, c: Cycle) -> float:
        n = c.span()
        self.past.appendleft(sum(list(c.price)[:n]) / n if n else 0.0)
        p = self.past
        return (4 * p[0] + 3 * p[1] + 2 * p[2] + p[3]) / 10


def _stepped(times: tuple[int, int], width: int, make: Callable[[], Callable[[Cycle, float], object]]) -> Callable:
    cycle, value, none = Cycle(times[0]), make(), (None,) * width if width > 1 else None

    def step(x: float | None) -> object:
        if x is None or not cycle.push(x):
            return none
        out = value(cycle, x)
        return out if cycle.n > times[1] else none

    return step


def ht_dcperiod() -> Callable:
    """The smoothed period."""
    return _stepped(SHORT, 1, lambda: lambda c, _: c.smooth_period)


def ht_phasor() -> Callable:
    """(in phase, quadrature)."""
    return _stepped(SHORT, 2, lambda: lambda c, _: (c.in_phase, c.quadrature))


def ht_dcphase() -> Callable:
    def make() -> Callable:
        phase = _Phase()
        return lambda c, _: phase(c)

    return _stepped(LONG, 1, make)


def ht_sine() -> Callable:
    """(sine, the sine 45 degrees ahead)."""

    def make() -> Callable:
        phase = _Phase()
        return lambda c, _: (math.sin(math.radians(p := phase(c))), math.sin(math.radians(p + 45)))

    return _stepped(LONG, 2, make)


def ht_trendline() -> Callable:
    def make() -> Callable:
        trend = _Trend()
        return lambda c, _: trend(c)

    return _stepped(LONG, 1, make)


def ht_trendmode() -> Callable:
    """1 in a trend, 0 in a cycle: after sines cross for half a period, while the phase moves as a cycle's; 1.5 % off the trend line is a trend."""

    def make() -> Callable:
        phase, trend, days, before, above = _Phase(), _Trend(), 0, 0.0, 0.0

        def value(c: Cycle, _: float) -> float:
            nonlocal days, before, above
            p, line = phase(c), trend(c)
            gap = math.sin(math.radians(p)) - math.sin(math.radians(p + 45))
            crossed = (gap > 0 >= above) or (gap < 0 <= above)
            days = 1 if crossed else days + 1
            moved, sp = p - before, c.smooth_period
            cyclic = crossed or days < 0.5 * sp or (sp and 0.67 * 360 / sp < moved < 1.5 * 360 / sp)
            before, above = p, gap
            return 1.0 if not cyclic or (line and abs((c.smooth[0] - line) / line) >= 0.015) else 0.0

        return value

    return _stepped(LONG, 1, make)


def mama(fast: float = 0.5, slow: float = 0.05) -> Callable:
    """(mean, following mean): the faster the phase turns, the slower they move."""

    def make() -> Callable:
        mean = follow = last = 0.0

        def value(c: Cycle, x: float) -> tuple[float, float]:
            nonlocal mean, follow, last
            angle = math.degrees(math.atan(c.quadrature / c.in_phase)) if c.in_phase else 0.0
            turn, last = max(last - angle, 1.0), angle
            pace = max(fast / turn, slow)
            mean += pace * (x - mean)
            follow += pace / 2 * (mean - follow)
            return mean, follow

        return value

    return _stepped(SHORT, 2, make)
