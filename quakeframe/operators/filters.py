"""Filters that keep account of what they reject."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.functions.geo import Box
from quakeframe.functions.numeric import Num, col

Rules = Sequence[tuple[str, Column]]


def with_reason(df: DataFrame, rules: Rules, name: str = "reject_reason") -> DataFrame:
    """The first rule that a row fails (null: is not known to pass) as a column; null for rows that pass all."""
    reason = F.lit(None).cast("string")
    for rule, passes in reversed(list(rules)):
        reason = F.when(~F.coalesce(passes, F.lit(False)), rule).otherwise(reason)
    return df.withColumn(name, reason)


def reject_counts(df: DataFrame, rules: Rules) -> DataFrame:
    """Rows by first failed rule; ``accepted`` for those that pass."""
    return with_reason(df, rules).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def cascade_counts(df: DataFrame, rules: Rules) -> DataFrame:
    """One row with the count after each stage of a filter cascade, from one pass."""
    passed, out = F.lit(True), [F.count("*").alias("n_all")]
    for rule, passes in rules:
        passed = passed & F.coalesce(passes, F.lit(False))
        out.append(F.count_if(passed).alias(f"n_{rule}"))
    return df.agg(*out)


def accept(df: DataFrame, rules: Rules) -> DataFrame:
    """Rows that pass all rules."""
    for _, passes in rules:
        df = df.filter(F.coalesce(passes, F.lit(False)))
    return df


def valid_coordinates(lat: Num = "latitude", lon: Num = "longitude", depth: Num | None = None) -> Column:
    ok = col(lat).between(-90, 90) & col(lon).between(-180, 360)
    return ok & col(depth).between(0, 1000) if depth is not None else ok


def clean_stations(df: DataFrame, lat: str, lon: str, elevation: str, text: Sequence[str] = ()) -> DataFrame:
    """Rows with valid coordinates; elevations that are no number are 0, missing text is empty."""
    out = df.filter(F.coalesce(valid_coordinates(lat, lon), F.lit(False)))
    number = F.coalesce(F.col(elevation).try_cast("double"), F.lit(0.0))
    return out.withColumn(elevation, F.when(F.isnan(number), 0.0).otherwise(number)).fillna("", subset=list(text)) if text else out.withColumn(elevation, F.when(F.isnan(number), 0.0).otherwise(number))


def active_at(start: Num, end: Num, t: Num) -> Column:
    """Validity interval holds a time; an open end is null."""
    return (col(start).isNull() | (col(start) <= col(t))) & (col(end).isNull() | (col(end) >= col(t)))


def permanent(start: Num, end: Num, now: Num, years: float) -> Column:
    """Open-ended and in operation for more than a number of years."""
    return col(end).isNull() & (F.datediff(col(now), col(start)) / 365.25 > years)


def crop(df: DataFrame, box: Box, first: str, others: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Voxels of a box (with a tolerance); all parameters are null where the first is."""
    out = df.filter(box.contains(depth="depth" if box.depth_min is not None else None, pad=tolerance))
    return out.withColumns({p: F.when(F.col(first).isNotNull(), F.col(p)) for p in others})


def range_report(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """For each parameter its rows outside a range; the data stay as they are."""
    parts = [F.struct(F.lit(p).alias("param"), F.count_if(~F.col(p).between(lo, hi)).alias("n_outside"), F.count(p).alias("n_valid")) for p, (lo, hi) in ranges.items()]
    return df.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def depth_band(depth: Num, bands: Sequence[tuple[str, float, float]], offset: Num = 0.0) -> Column:
    """Name of the band [lo, hi) that a depth is in, the last one closed; ``offset`` (such as a Moho depth) shifts the bounds."""
    out = F.lit(None).cast("string")
    for k, (name, lo, hi) in reversed(list(enumerate(bands))):
        d = col(depth) - col(offset)
        out = F.when((d >= lo) & ((d <= hi) if k == len(bands) - 1 else (d < hi)), name).otherwise(out)
    return out


def trace_quality(samples: Num, least: int, most_glitch: float = 0.005, threshold: float = 10.0) -> Column:
    """Enough finite samples and few glitches in an array of samples."""
    from quakeframe.functions.numeric import glitch_ratio

    finite = F.forall(col(samples), lambda v: v.isNotNull() & ~F.isnan(v))
    return F.coalesce((F.size(col(samples)) >= least) & finite & (glitch_ratio(samples, threshold) <= most_glitch), F.lit(False))


def amplitude_quality(samples: Num, lo: float, hi: float, most_missing: float = 0.01) -> Column:
    """Peak amplitude in a range and few samples missing."""
    missing = F.size(F.filter(col(samples), lambda v: v.isNull() | F.isnan(v)))
    peak = F.array_max(F.transform(F.filter(col(samples), lambda v: ~F.isnan(v)), lambda v: F.abs(v)))
    return F.coalesce((F.size(col(samples)) > 0) & (missing <= F.size(col(samples)) * most_missing) & peak.between(lo, hi), F.lit(False))
