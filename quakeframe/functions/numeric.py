"""Null-safe numeric columns: what is missing is null, never NaN."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | str | float | int


def col(x: Num) -> Column:
    """A column from a column, a column's name, or a number."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def clean(x: Num) -> Column:
    """NaN and infinities as null."""
    c = col(x)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def safe_log(x: Num) -> Column:
    """Natural log, null for what has none."""
    return F.when(col(x) > 0, F.log(col(x)))


def ratio(a: Num, b: Num) -> Column:
    """a / b, null where b is 0."""
    return F.when(col(b) != 0, col(a) / col(b))


def between(x: Num, lo: Num, hi: Num) -> Column:
    """Inclusive range; a null counts as outside."""
    return F.coalesce(col(x).between(col(lo), col(hi)), F.lit(False))


def unit_hash(*keys: Num, seed: int = 42) -> Column:
    """A number in (0, 1) that depends on the keys and the seed alone, not on the partitioning."""
    return (F.pmod(F.xxhash64(*[col(k) for k in keys], F.lit(seed)), F.lit(2**53 - 1).cast("long")).cast("double") + 1.0) / float(2**53)


def nearest_second(time: Num) -> Column:
    """Whole seconds since 1970 that a timestamp is nearest to (halves: the even one)."""
    return F.rint(F.unix_micros(col(time).cast("timestamp")) / 1e6).cast("long")


def ramp(x: Num, start: Num, end: Num) -> Column:
    """Raised-cosine ramp from 0 at ``start`` to 1 at ``end``."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (col(x) - col(start)) / (col(end) - col(start))))
    return F.lit(0.5) * (F.lit(1.0) - F.cos(F.pi() * t))


def rms(x: Num) -> Column:
    """Root mean square aggregate over what is finite."""
    v = clean(x)
    return F.sqrt(F.avg(v * v))


def array_rms(samples: Num) -> Column:
    """Root mean square of an array's finite samples."""
    kept = F.filter(col(samples), lambda v: ~F.isnan(v))
    return F.when(F.size(kept) > 0, F.sqrt(F.aggregate(kept, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")) / F.size(kept)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for each row, however often it is named there (in nested lambdas too)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def array_median(a: Column) -> Column:
    """Median of an array, the mean of the middle two."""
    n = F.size(a)
    return let(F.array_sort(a), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)


def glitch_ratio(samples: Num, threshold: float = 10.0) -> Column:
    """Share of an array's samples further than ``threshold`` robust deviations (1.4826 times the median absolute one; the standard deviation where that is 0) from the median."""
    def share(x: Column, off: Column) -> Column:
        mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, e: a + e) / F.size(v)
        std = let(mean(x), lambda m: F.sqrt(mean(F.transform(x, lambda v: (v - m) * (v - m)))))
        scale = let(array_median(off) * 1.4826, lambda mad: F.when(mad > 0, mad).otherwise(std))
        return let(scale, lambda s: F.when(s <= 0, 0.0).otherwise(F.size(F.filter(off, lambda v: v > threshold * s)) / F.size(x)))

    x = F.transform(col(samples), lambda v: v.cast("double"))
    return F.when(F.size(col(samples)) > 0, let(x, lambda a: let(array_median(a), lambda mid: let(F.transform(a, lambda v: F.abs(v - mid)), lambda off: share(a, off)))))
