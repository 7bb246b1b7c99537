"""Numeric helpers with the reference semantics that SQL leaves open: missing values, ties, rounding."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """The number, or null if it isn't finite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_float(text: Column, default: float | None = None) -> Column:
    """A text as a finite number, else the default."""
    return F.coalesce(finite(text.try_cast("double")), F.lit(default).cast("double"))


def clip01(x: Column) -> Column:
    """Within 0 and 1; what isn't finite counts as 0."""
    return F.least(F.greatest(F.coalesce(finite(x), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def half_up(x: Column, digits: int) -> Column:
    """Rounded as SQL engines round doubles: the product with the power of ten to a whole number, halves away from 0. Spark's own `round` goes by the shortest text of x."""
    return F.round(x * 10.0**digits) / 10.0**digits


def _halves(x: Column) -> tuple[Column, Column]:
    """x as a sum of two numbers of at most 26 bits."""
    c = x * 134_217_729.0
    high = c - (c - x)
    return high, x - high


def multiply_add(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded once: the product's own rounding error is worked out from halves of a and b, and added last."""
    p, (a1, a2), (b1, b2) = a * b, _halves(a), _halves(b)
    lost = ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2
    s = p + c
    back = s - p
    return s + ((p - (s - back)) + (c - back) + lost)


def between(low: Column, high: Column, share: Column) -> Column:
    """What lies at the share of the way from low to high, never off by more than the rounding of high * share."""
    return F.when(low == high, low).otherwise(multiply_add(low, 1 - share, high * share))


def norm(x: Column, low: Column, high: Column) -> Column:
    """Position between two bounds, clipped; 0 where they coincide."""
    return F.when(high > low, clip01((x - low) / (high - low))).otherwise(0.0)


def first_positive(*xs: Column) -> Column:
    """The first value that is finite and above 0."""
    return F.coalesce(*(F.when(finite(x) > 0, x) for x in xs))


def sigmoid(x: Column, temperature: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-x / temperature))


def fold_tempo(bpm: Column, low: float = 80.0, high: float = 200.0) -> Column:
    """The tempo doubled or halved into [low, high]."""
    up = F.greatest(F.ceil(F.log2(low / bpm)), F.lit(0))
    down = F.greatest(F.ceil(F.log2(bpm / high)), F.lit(0))
    return F.when(bpm > 0, bpm * F.pow(F.lit(2.0), up - down))


def rank_norm(order: WindowSpec, whole: WindowSpec, x: Column) -> Column:
    """Rank in a stable order from 0 to 1; 0.5 where all values are equal, 1 where there is one."""
    n = F.count(F.lit(1)).over(whole)
    flat = F.min(x).over(whole) == F.max(x).over(whole)
    return F.when(n == 1, 1.0).when(flat, 0.5).otherwise((F.row_number().over(order) - 1) / (n - 1))


def interpolate(t: Column, t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    """Linear between two points, clamped at the ends."""
    share = F.when(t1 > t0, (t - t0) / (t1 - t0)).otherwise(0.0)
    return v0 + (v1 - v0) * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
