"""Scalar functions: IEEE arithmetic, strict comparisons and time predicates. NULL is a missing sample, NaN is a number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
DAY, HOUR = 86_400_000, 3_600_000


def ieee_div(a: Column, b: Column) -> Column:
    """a / b as IEEE has it: a zero divisor gives an infinity or NaN, NULL gives NULL."""
    zero = F.when((a == 0) | F.isnan(a), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def _real(a: Column, b: Column, out: Column) -> Column:
    """out, false if a or b is NaN; NULL if either is NULL. (Spark by itself takes NaN as the largest number.)"""
    return F.when(a.isNull() | b.isNull(), None).otherwise(out & ~F.isnan(a) & ~F.isnan(b))


def gt(a: Column, b: Column) -> Column:
    return _real(a, b, a > b)


def ge(a: Column, b: Column) -> Column:
    return _real(a, b, a >= b)


def lt(a: Column, b: Column) -> Column:
    return _real(a, b, a < b)


def le(a: Column, b: Column) -> Column:
    return _real(a, b, a <= b)


def above(a: Column, b: Column) -> Column:
    return gt(a, b)


def below(a: Column, b: Column) -> Column:
    return lt(a, b)


def na(x: Column) -> Column:
    """Whether the sample is missing; NaN isn't."""
    return x.isNull()


def coalesce(x: Column, fallback: Column) -> Column:
    return F.coalesce(x, fallback)


def _elementary(f: Callable[[Column], Column], outside: Callable[[Column], Column] | None = None) -> Callable[[Column], Column]:
    """f of a double as a double; NaN outside its domain."""

    def apply(x: Column) -> Column:
        x = x.cast("double")
        return f(x).cast("double") if outside is None else F.when(outside(x), NAN).otherwise(f(x))

    return apply


def _whole(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """f to a whole double; what has no fraction (from 2 ** 52 on, and what isn't finite) stays."""
    return lambda x: F.when((F.abs(x) < F.lit(2.0**52)) & ~F.isnan(x), f(x).cast("double")).otherwise(x.cast("double"))


#: Elementary functions by name, as IEEE has them.
ELEMENTARY: dict[str, Callable[[Column], Column]] = {
    "acos": _elementary(F.acos, lambda x: F.abs(x) > 1), "asin": _elementary(F.asin, lambda x: F.abs(x) > 1), "atan": _elementary(F.atan), "ceil": _whole(F.ceil), "cos": _elementary(F.cos), "cosh": _elementary(F.cosh),
    "exp": _elementary(F.exp), "floor": _whole(F.floor), "sin": _elementary(F.sin), "sinh": _elementary(F.sinh), "sqrt": _elementary(F.sqrt, lambda x: x < 0), "tan": _elementary(F.tan), "tanh": _elementary(F.tanh),
}


def ln(x: Column) -> Column:
    return F.when(x == 0, -INF).when(x < 0, NAN).otherwise(F.log(x))


def log10(x: Column) -> Column:
    return F.when(x == 0, -INF).when(x < 0, NAN).otherwise(F.log10(x))


def between(x: Column, low: Column, high: Column) -> Column:
    """Strictly inside."""
    return lt(low, x) & lt(x, high)


def outside(x: Column, low: Column, high: Column) -> Column:
    return lt(x, low) | gt(x, high)


def nz(x: Column, fallback: Column | float | bool = 0.0) -> Column:
    """x, or the fallback where it is missing (for a condition, give False)."""
    return F.coalesce(x, fallback if isinstance(fallback, Column) else F.lit(fallback))


def hour_utc(ms: Column) -> Column:
    return F.floor((ms % DAY) / HOUR).cast("double")


def weekday_utc(ms: Column) -> Column:
    """Monday is 0; day 0 of the epoch was a Thursday."""
    return ((F.floor(ms / DAY) + 3) % 7).cast("double")


def session_utc(ms: Column, start: int, end: int) -> Column:
    """[start, end) hours; start > end wraps over midnight, equal hours are always on."""
    h = hour_utc(ms)
    if start == end:
        return F.lit(True)
    return (h >= start) & (h < end) if start < end else (h >= start) | (h < end)


def avgprice() -> Column:
    return (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4


def medprice() -> Column:
    return (F.col("high") + F.col("low")) / 2


def typprice() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def wclprice() -> Column:
    return (F.col("high") + F.col("low") + F.col("close") * 2) / 4


def bop() -> Column:
    wide = F.col("high") - F.col("low")
    return F.when(wide > 0, (F.col("close") - F.col("open")) / F.nullif(wide, F.lit(0.0))).otherwise(0.0)


def trail_stop_long(anchor: Column, offset: Column) -> Column:
    return trail_stop(anchor, offset, 1)


def trail_stop_short(anchor: Column, offset: Column) -> Column:
    return trail_stop(anchor, offset, -1)


def break_even_long(entry: Column, offset: Column) -> Column:
    """Above the entry."""
    return trail_stop(entry, offset, -1)


def break_even_short(entry: Column, offset: Column) -> Column:
    return trail_stop(entry, offset, 1)


def trail_stop(anchor: Column, offset: Column, side: int) -> Column:
    """anchor - side * offset (side 1 long, -1 short); NULL if the offset is negative or anything isn't finite."""
    out = anchor - offset * side
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != INF)
    return F.when((offset >= 0) & finite(anchor) & finite(offset) & finite(out), out)
