"""Weighted, two-level, per-depth and interval aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.functions.numeric import Num, clean, col, ratio
from quakeframe.operators.common import checked_broadcast


def weighted_mean(value: Num, weight: Num) -> Column:
    """Aggregate: mean of the values that are there, by weight; null without any weight."""
    v = clean(value)
    w = F.when(v.isNotNull(), col(weight))
    return ratio(F.sum(w * v), F.sum(w))


def weighted_spread(df: DataFrame, group: Sequence[str], value: str, count: str) -> DataFrame:
    """n, mean and sd (of all, about the mean) of values that occur ``count`` times each."""
    g = Window.partitionBy(*group)
    n = F.sum(count).over(g)
    about = df.withColumn("_mean", F.sum(F.col(value) * F.col(count)).over(g) / n)
    off = F.col(value) - F.col("_mean")
    return about.groupBy(*group).agg(F.sum(count).alias("n"), F.first("_mean").alias("mean"), F.sqrt(F.sum(off * off * F.col(count)) / F.sum(count)).alias("sd"))


def weighted_median(df: DataFrame, group: Sequence[str], value: str, weight: str, out: str = "wmedian") -> DataFrame:
    """Lower weighted median: the first value at which the running weight reaches half of the total.

    Equal values are summed first, so that a group's window holds its different values, not its rows.
    """
    per_value = df.filter(clean(value).isNotNull() & (F.col(weight) > 0)).groupBy(*group, value).agg(F.sum(weight).alias("_w"))
    run = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = per_value.withColumns({"_c": F.sum("_w").over(run), "_t": F.sum("_w").over(Window.partitionBy(*group))})
    return cum.filter(F.col("_c") >= F.col("_t") * 0.5 - 1e-9).groupBy(*group).agg(F.min(value).alias(out))


def two_level(df: DataFrame, group: Sequence[str], klass: str, value: str, weight: str, out: str = "score") -> DataFrame:
    """Weighted median within each class, then the mean of the classes."""
    return weighted_median(df, [*group, klass], value, weight, "_m").groupBy(*group).agg(F.avg("_m").alias(out), F.count("*").alias("n_classes"))


def event_equal(df: DataFrame, group: Sequence[str], event: str, value: Column, out: str = "value") -> DataFrame:
    """Mean over events of each event's mean."""
    return df.groupBy(*group, event).agg(F.avg(value).alias("_m")).groupBy(*group).agg(F.avg("_m").alias(out), F.count("*").alias("n_events"))


def pooled_fraction(df: DataFrame, group: Sequence[str], condition: Column, out: str = "fraction") -> DataFrame:
    return df.groupBy(*group).agg((F.count_if(condition) / F.count("*")).alias(out), F.count("*").alias("n"))


def station_weights(df: DataFrame, group: Sequence[str], station: str, cell: Sequence[str]) -> DataFrame:
    """One over the number of different stations in each cell, for every (group, cell, station)."""
    stations = df.select(*group, *cell, station).distinct()
    n = stations.groupBy(*group, *cell).agg(F.count("*").alias("n_stations"))
    return stations.join(n, [*group, *cell]).withColumn("weight", F.lit(1.0) / F.col("n_stations"))


def depth_profile(df: DataFrame, group: Sequence[str], depth: str, value: str) -> DataFrame:
    """Per-depth unweighted mean, population deviation, median and count of what is there."""
    v = clean(value)
    return df.groupBy(*group, depth).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.median(v).alias("median"), F.count(v).alias("n"))


def weighted_profile(df: DataFrame, group: Sequence[str], depth: str, value: str, lat: str) -> DataFrame:
    """Per-depth mean weighted by the cosine of latitude."""
    w = F.cos(F.radians(F.col(lat)))
    return df.groupBy(*group, depth).agg(weighted_mean(value, w).alias("mean"), F.count(clean(value)).alias("n"))


def area_rms(value: Num, lat: Num) -> Column:
    """Aggregate: root mean square by the cosine of latitude."""
    v = clean(value)
    w = F.when(v.isNotNull(), F.cos(F.radians(col(lat))))
    return F.sqrt(ratio(F.sum(w * v * v), F.sum(w)))


def trapezoid_mean(df: DataFrame, group: Sequence[str], depth: str, value: str, out: str = "mean") -> DataFrame:
    """Mean over depth by the trapezoid rule; a single level is its own mean."""
    w = Window.partitionBy(*group).orderBy(depth)
    seg = df.filter(clean(value).isNotNull()).withColumns({"_dz": F.lead(depth).over(w) - F.col(depth), "_m": (F.lead(value).over(w) + F.col(value)) / 2.0})
    total = ratio(F.sum(F.col("_m") * F.col("_dz")), F.sum("_dz"))
    return seg.groupBy(*group).agg(F.coalesce(total, F.avg(value)).alias(out))


def interpolate_profile(profile: DataFrame, group: Sequence[str], depth: str, value: str, levels: DataFrame, level: str, least: int = 3) -> DataFrame:
    """A profile on other depths by linear interpolation; depths outside its range, and groups of fewer than ``least`` levels, are left out."""
    w = Window.partitionBy(*group).orderBy(depth)
    seg = profile.filter(clean(value).isNotNull()).withColumns({"_n": F.count("*").over(Window.partitionBy(*group)), "_d2": F.lead(depth).over(w), "_v2": F.lead(value).over(w)}).filter(F.col("_n") >= least)
    last = F.col("_d2").isNull()
    inside = F.when(last, F.col(level) == F.col(depth)).otherwise((F.col(level) >= F.col(depth)) & (F.col(level) < F.col("_d2")))
    part = (F.col(level) - F.col(depth)) / (F.col("_d2") - F.col(depth))
    # levels are a grid of a few hundred depths
    return seg.join(checked_broadcast(levels.select(level).distinct()), inside).select(*group, level, F.when(last, F.col(value)).otherwise(F.col(value) + part * (F.col("_v2") - F.col(value))).alias(value))


def param_ranges(df: DataFrame, params: Sequence[str], digits: int = 4) -> DataFrame:
    """For each parameter minimum, maximum, mean, population deviation and share of valid values, rounded half-even; one pass."""
    rows = []
    for p in params:
        v = clean(p)
        rows.append(F.struct(F.lit(p).alias("param"), F.bround(F.min(v), digits).alias("min"), F.bround(F.max(v), digits).alias("max"), F.bround(F.avg(v), digits).alias("mean"), F.bround(F.stddev_pop(v), digits).alias("std"), F.bround(F.count(v) * 100.0 / F.count("*"), 2).alias("valid_pct")))
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def summary(df: DataFrame, value: str, key: str) -> DataFrame:
    """Count, different keys, bounds, mean and sample deviation of a column."""
    return df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_keys"), F.count(value).alias("n_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.avg(value).alias("mean_value"), F.stddev_samp(value).alias("std_value"))


def top_counts(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The most frequent keys (ties: the smaller key)."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def common_region(df: DataFrame, group: str, lat: str, lon: str, depth: str, valid: Column) -> DataFrame:
    """The box that all groups' valid rows share (one row), and whether there is one."""
    ext = df.filter(valid).groupBy(group).agg(*[f(c).alias(f"_{n}_{c}") for c in (lat, lon, depth) for n, f in (("lo", F.min), ("hi", F.max))])
    out = ext.agg(*[f(f"_{n}_{c}").alias(f"{c}_{m}") for c in (lat, lon, depth) for n, m, f in (("lo", "min", F.max), ("hi", "max", F.min))], F.count("*").alias("n_groups"))
    ok = (F.col(f"{lat}_min") <= F.col(f"{lat}_max")) & (F.col(f"{lon}_min") <= F.col(f"{lon}_max")) & (F.col(f"{depth}_min") <= F.col(f"{depth}_max"))
    return out.withColumn("has_common", F.coalesce(ok, F.lit(False)))


def mean_spacing(df: DataFrame, group: Sequence[str], axis: str) -> DataFrame:
    """Mean and median distance between neighbouring values of a grid axis."""
    values = df.select(*group, axis).distinct()
    step = F.col(axis) - F.lag(axis).over(Window.partitionBy(*group).orderBy(axis))
    return values.withColumn("_s", step).groupBy(*group).agg(F.avg("_s").alias("mean_step"), F.median("_s").alias("median_step"), F.count("*").alias("n_values"))


def misfit_stats(value: Num) -> list[Column]:
    """Aggregates over finite values: count, median, median of the absolute, mean, 95th percentile of the absolute."""
    v = clean(value)
    return [F.count(v).alias("n"), F.median(v).alias("median"), F.median(F.abs(v)).alias("median_abs"), F.avg(v).alias("mean"), F.percentile(F.abs(v), F.lit(0.95)).alias("p95_abs")]


def group_stats(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Mean, deviation, bounds and median of a feature by group, and the group's share of all rows."""
    total = df.groupBy().agg(F.count("*").alias("_all"))
    v = clean(value)
    by = df.groupBy(*group).agg(F.count("*").alias("n_points"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.median(v).alias("median"))
    return by.crossJoin(F.broadcast(total)).withColumn("percentage", F.col("n_points") * 100.0 / F.col("_all")).drop("_all")  # one row


def radial_stats(df: DataFrame, group: Sequence[str], depth: str) -> DataFrame:
    """5th and 95th percentile, mean of depth and share of rows, by group."""
    total = df.groupBy().agg(F.count("*").alias("_all"))
    by = df.groupBy(*group).agg(F.percentile(depth, F.lit(0.05)).alias("p05"), F.avg(depth).alias("mean"), F.percentile(depth, F.lit(0.95)).alias("p95"), F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(total)).withColumn("volume_frac", F.col("n") / F.col("_all")).drop("_all")  # one row


def bbox_area(df: DataFrame, group: Sequence[str], lat: str, lon: str, floor: float = 0.02) -> DataFrame:
    """Area in square degrees of each group's bounding box, sides of ``floor`` at least."""
    side = lambda c: F.greatest(F.max(c) - F.min(c), F.lit(floor))
    return df.groupBy(*group).agg((side(lat) * side(lon)).alias("area"), F.count("*").alias("n"))


def active_per_year(df: DataFrame, start: str, end: str, last_year: int) -> DataFrame:
    """Per year the rows whose interval holds it, and those that begin in it; an open end runs to ``last_year``; an interval that ends before it begins is new and never active.

    Counts of beginnings and ends are summed over the years, so that no row is expanded into its years.
    """
    begin = df.filter(F.col(start).isNotNull()).select(F.year(start).alias("a"), F.greatest(F.coalesce(F.year(end), F.lit(last_year)), F.year(start) - 1).alias("b"))
    moves = begin.groupBy(F.col("a").alias("year")).agg(F.count("*").alias("n_new")).join(begin.groupBy((F.col("b") + 1).alias("year")).agg(F.count("*").alias("n_gone")), "year", "full_outer")
    span = begin.agg(F.min("a").alias("lo"), F.max("b").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("year"))
    full = span.join(moves, "year", "left").fillna(0)
    run = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each year
    return full.withColumn("n_active", (F.sum("n_new").over(run) - F.sum("n_gone").over(run)).cast("long")).select("year", "n_new", "n_active")


def coverage(active: DataFrame, found: DataFrame, event: str, station: str, parts: int) -> DataFrame:
    """Per event: active stations, those with any and with all ``parts`` (channels), and the shares."""
    have = found.groupBy(event, station).agg(F.count_distinct("part").alias("_p"))
    j = active.select(event, station).distinct().join(have, [event, station], "left")
    n = F.count("*")
    return j.groupBy(event).agg(n.alias("n_active"), F.count("_p").alias("n_present"), F.count_if(F.col("_p") >= parts).alias("n_complete"), (F.count("_p") / n).alias("present_frac"), (F.count_if(F.col("_p") >= parts) / n).alias("complete_frac"), (F.lit(1.0) - F.count("_p") / n).alias("missing_frac"))


def block_mean(df: DataFrame, group: Sequence[str], lat: str, lon: str, value: str, size: float, area_weighted: bool = True) -> DataFrame:
    """Mean in cells of ``size`` degrees, by the cosine of latitude if asked."""
    w = F.cos(F.radians(F.col(lat))) if area_weighted else F.lit(1.0)
    cell = [F.floor(F.col(lat) / size).cast("long").alias("cell_lat"), F.floor(F.col(lon) / size).cast("long").alias("cell_lon")]
    return df.groupBy(*group, *cell).agg(weighted_mean(value, w).alias(value), F.count(clean(value)).alias("n"))


def class_of_cluster(df: DataFrame, value: str, band: str, thresholds: dict[str, tuple[float, float]]) -> Column:
    """+1 fast, -1 slow, 0 neutral by the band's thresholds; null without a value."""
    out = F.lit(None).cast("int")
    for name, (slow, fast) in thresholds.items():
        v = clean(value)
        out = F.when((F.col(band) == name) & v.isNotNull(), F.when(v >= fast, 1).when(v <= slow, -1).otherwise(0)).otherwise(out)
    return out
