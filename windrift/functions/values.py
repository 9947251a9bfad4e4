"""Rules for numbers, angles and time frames as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: A tie-safe order key is t_ms * TICK + seq, so rows of a session must be fewer than this.
TICK = 1 << 20
KNOTS = {"N": 1.0, "M": 1.9438444924406, "K": 1 / 1.852}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """A number that is neither null, NaN nor infinite."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Halves go up; null for what is not finite."""
    c = col(c)
    return F.when(finite(c), F.floor(c * 10.0**digits + 0.5) / 10.0**digits)


def ratio(a: Column, b: Column, zero: bool = False) -> Column:
    """a / b; null (or 0 with ``zero``) for a denominator of zero."""
    out = F.when(b != 0, a / b)
    return F.coalesce(out, F.lit(0.0)) if zero else out


def wrap360(c: Column) -> Column:
    """The angle in [0, 360). 360 is added to every angle, as SQL has it, and not to negative ones alone (``pmod``): last bits decide whether a value that equals a threshold reaches it."""
    return (c % 360.0 + 360.0) % 360.0


def turn(a: Column, b: Column) -> Column:
    """The signed angle from a to b, in [-180, 180)."""
    return wrap360(b - a + 180.0) - 180.0


def to_knots(speed: Column | str, unit: Column | str) -> Column:
    """Knots from knots (N), metres a second (M) or kilometres an hour (K); another unit changes nothing."""
    speed, unit = col(speed), col(unit)
    return F.when(unit == "M", speed * KNOTS["M"]).when(unit == "K", speed / 1.852).otherwise(speed)


def circ_mean(sin: Column, cos: Column) -> Column:
    """The mean direction, in [0, 360), from the means of sine and cosine."""
    return wrap360(F.degrees(F.atan2(sin, cos)))


def circ_std(sin: Column, cos: Column) -> Column:
    """The circular standard deviation in degrees from the means of sine and cosine; 180 where they vanish."""
    r = F.least(F.sqrt(sin * sin + cos * cos), F.lit(1.0))
    return F.when(r <= 0, 180.0).otherwise(F.degrees(F.sqrt(F.lit(-2.0) * F.ln(F.when(r > 0, r)))))


def level(c: Column | str, thresholds: Sequence[float]) -> Column:
    """How many of the ascending thresholds are reached."""
    out = F.lit(0)
    for t in thresholds:
        out = out + (col(c) >= t).cast("int")
    return out


def whole(by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by)


def ordered(by: Sequence[str], time: str = "t_ms") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(F.col(time) * TICK + F.col("seq"))


def trailing(by: Sequence[str], ms: int, time: str = "t_ms") -> WindowSpec:
    """The rows of the last ``ms``, the edge included; of rows at the same time, only those before."""
    return ordered(by, time).rangeBetween(-(ms * TICK + TICK - 1), 0)


def before(by: Sequence[str], time: str = "t_ms") -> WindowSpec:
    return ordered(by, time).rowsBetween(Window.unboundedPreceding, -1)
