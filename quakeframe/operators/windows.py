"""Ordered operators: deduplication, gaps, best windows, elbows, quotas, renumbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quakeframe.functions.numeric import Num, col
from quakeframe.operators.common import checked_broadcast, stored


def keep_one(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key in a full order: an aggregate over structs, so a hot key is combined where it is read."""
    names = [c.name for c in df.schema if c.name not in key]
    ranks = [F.col(o) if isinstance(o, str) else o for o in order]
    pick = (F.max_by if last else F.min_by)(F.struct(*names), F.struct(*[r.alias(f"_{k}") for k, r in enumerate(ranks)]))
    return df.groupBy(*key).agg(pick.alias("_row")).select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def upsert(existing: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union in which the newest row of a key stays (of rows of one side, the last in ``order``)."""
    both = existing.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return keep_one(both, key, ["_src", *order], last=True).drop("_src")


def tolerance_dedup(df: DataFrame, order: Sequence[str], near: list[tuple[str, float]], back: int = 50, within: Sequence[str] = (), bucket: int = 10_000) -> DataFrame:
    """Rows without a near one (in every column of ``near``) among the ``back`` rows before them, dropped ones included.

    ``within`` names columns whose groups (days, say) are searched on their own; without it all rows are one group, cut
    by rank into buckets of about ``bucket`` rows, each handed the last ``back`` rows of the one before it.
    """
    if not within:
        ranked = _ranked(df, order)
        rows = max(bucket, back, 1)
        home = F.floor(F.col("_rank") / rows)
        copies = ranked.filter(F.col("_rank") % rows >= rows - back).withColumns({"_bucket": home + 1, "_copy": F.lit(True)})
        both = ranked.withColumns({"_bucket": home, "_copy": F.lit(False)}).unionByName(copies)
        marked = _near_before(both, Window.partitionBy("_bucket").orderBy("_rank").rowsBetween(-back, -1), near)
        return marked.filter(~F.col("_copy") & ~F.col("_near")).select(*df.columns)
    marked = _near_before(df, Window.partitionBy(*within).orderBy(*order).rowsBetween(-back, -1), near)
    return marked.filter(~F.col("_near")).drop("_near")


def _near_before(df: DataFrame, w: WindowSpec, near: list[tuple[str, float]]) -> DataFrame:
    """``_near``: whether a row of the window is near."""
    before = F.collect_list(F.struct(*[F.col(c) for c, _ in near])).over(w)
    same = lambda s: _all([F.abs(s[c] - F.col(c)) <= t for c, t in near])
    return df.withColumn("_before", before).withColumn("_near", F.coalesce(F.exists("_before", same), F.lit(False))).drop("_before")


def _ranked(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``_rank`` from 0 in the order of all rows: ranks within range partitions, and the counts of those before (one number a partition)."""
    dealt = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts, total = [], 0
    for part, n in sorted(map(tuple, dealt.groupBy("_part").count().collect())):
        counts.append((part, total))
        total += n
    starts = df.sparkSession.createDataFrame(counts, "_part int, _start long")
    inside = dealt.withColumn("_inside", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    return stored(inside.join(F.broadcast(starts), "_part").withColumn("_rank", F.col("_start") + F.col("_inside")).drop("_part", "_start", "_inside"), "ranks")


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def chronological(df: DataFrame, date: str, time: str, tie: Sequence[str]) -> DataFrame:
    """Rows in order of origin time; what cannot be read comes first (as 1970)."""
    from quakeframe.functions.text import sort_time

    return df.withColumn("origin", sort_time(date, time)).orderBy("origin", *tie)


def azimuthal_gap(df: DataFrame, group: Sequence[str], azimuth: str) -> DataFrame:
    """Largest gap between neighbouring azimuths, around the circle; 360 for fewer than two."""
    az = df.select(*group, F.pmod(F.col(azimuth), F.lit(360.0)).alias("_az"))
    step = F.lead("_az").over(Window.partitionBy(*group).orderBy("_az")) - F.col("_az")
    gaps = az.withColumn("_g", step).groupBy(*group).agg(F.max("_g").alias("_g"), F.min("_az").alias("_lo"), F.max("_az").alias("_hi"), F.count("*").alias("n"))
    return gaps.select(*group, F.when(F.col("n") < 2, 360.0).otherwise(F.greatest(F.coalesce("_g", F.lit(0.0)), F.lit(360.0) - F.col("_hi") + F.col("_lo"))).alias("gap"), "n")


def best_window(df: DataFrame, year: str, weight: str, count: str, years: int, least: int) -> DataFrame:
    """The ``years`` long window of the highest mean weight among those with at least ``least`` counts; the first wins ties. A row for each year comes in."""
    w = Window.orderBy(year).rangeBetween(0, years - 1)  # one row a year
    windows = df.withColumns({"_mean": F.avg(weight).over(w), "_n": F.sum(count).over(w), "_last": F.max(year).over(Window.partitionBy())})
    ok = windows.filter((F.col("_n") >= least) & (F.col(year) + years - 1 <= F.col("_last")))
    best = ok.agg(F.max_by(F.struct(F.col(year).alias("y"), F.col("_mean").alias("m"), F.col("_n").alias("n")), F.struct("_mean", -F.col(year))).alias("b"))
    return best.select(F.col("b.y").alias("start_year"), (F.col("b.y") + years - 1).alias("end_year"), F.col("b.m").alias("mean_weight"), F.col("b.n").alias("n")).filter(F.col("start_year").isNotNull())


def elbow(df: DataFrame, group: Sequence[str], k: str, value: str, out: str = "k_elbow") -> DataFrame:
    """K of the largest distance below the chord from first to last point, both axes scaled to one (ties: the smaller K).

    Fewer than three points, or a flat curve, give none.
    """
    g = Window.partitionBy(*group)
    scaled = df.filter(F.col(value).isNotNull()).withColumns({"_k0": F.min(k).over(g), "_k1": F.max(k).over(g), "_v0": F.min(value).over(g), "_v1": F.max(value).over(g), "_n": F.count("*").over(g), "_first": F.min_by(value, k).over(g), "_last": F.max_by(value, k).over(g)})
    x = (F.col(k) - F.col("_k0")) / (F.col("_k1") - F.col("_k0"))
    at = lambda v: (F.col(v) - F.col("_v0")) / (F.col("_v1") - F.col("_v0"))
    chord = at("_first") + (at("_last") - at("_first")) * x
    found = scaled.filter((F.col("_n") >= 3) & (F.col("_v1") > F.col("_v0"))).withColumn("_d", F.round(chord - at(value), 12))
    return found.groupBy(*group).agg(F.max_by(k, F.struct("_d", -F.col(k))).alias(out))


def first_small_gain(df: DataFrame, group: Sequence[str], k: str, value: str, threshold: float, out: str = "k_gain") -> DataFrame:
    """First K whose relative gain over the one before is under a threshold."""
    prev = F.lag(value).over(Window.partitionBy(*group).orderBy(k))
    gain = (prev - F.col(value)) / F.when(prev != 0, prev)
    return df.withColumn("_g", gain).groupBy(*group).agg(F.min(F.when(F.col("_g") < threshold, F.col(k))).alias(out))


def local_maxima(df: DataFrame, group: Sequence[str], k: str, value: str) -> DataFrame:
    """Interior rows above both neighbours."""
    w = Window.partitionBy(*group).orderBy(k)
    return df.withColumns({"_a": F.lag(value).over(w), "_b": F.lead(value).over(w)}).filter((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b"))).drop("_a", "_b")


def monotone(df: DataFrame, group: Sequence[str], k: str, value: str, out: str = "repaired") -> DataFrame:
    """Running maximum of a column in order of k."""
    return df.withColumn(out, F.max(value).over(Window.partitionBy(*group).orderBy(k).rowsBetween(Window.unboundedPreceding, 0)))


def bic(loglik: Num, parameters: Num, n: Num) -> Column:
    return col(parameters) * F.log(col(n)) - col(loglik) * 2.0


def renumber(df: DataFrame, group: Sequence[str], label: str, value: str, out: str = "new_label") -> DataFrame:
    """Labels renumbered from 0 by the mean of a value (ties: the old label); negative labels stay."""
    means = df.filter(F.col(label) >= 0).groupBy(*group, label).agg(F.avg(value).alias("_m"))
    ranked = means.withColumn(out, (F.row_number().over(Window.partitionBy(*group).orderBy("_m", label)) - 1).cast("int")).drop("_m")
    return df.join(ranked, [*group, label], "left").withColumn(out, F.coalesce(F.col(out), F.col(label)).cast("int"))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def top_then_fill(df: DataFrame, group: str, value: str, key: str, per_group: int, total: int) -> DataFrame:
    """The ``per_group`` best of each group, then the best of the rest up to ``total`` rows; ``rank`` orders the result."""
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), F.asc(key)))
    marked = df.withColumn("_b", F.when(best <= per_group, 0).otherwise(1))
    # only the first ``total`` rows are ranked on their own
    top = marked.orderBy("_b", F.desc(value), F.asc(key)).limit(total)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("_b", F.desc(value), F.asc(key)))).drop("_b")


def quotas(df: DataFrame, group: Sequence[str], key: str, weight: str, total: str, out: str = "quota") -> DataFrame:
    """Largest-remainder shares of a total by weight (ties: the smaller key)."""
    g = Window.partitionBy(*group)
    raw = df.withColumn("_raw", F.col(total) * F.col(weight) / F.sum(weight).over(g)).withColumn("_f", F.floor(F.round("_raw", 9)))
    rest = F.col(total) - F.sum("_f").over(g)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(F.round(F.col("_raw") - F.col("_f"), 9)), key))
    return raw.withColumns({"_rest": rest, "_r": rank}).withColumn(out, (F.col("_f") + F.when(F.col("_r") <= F.col("_rest"), 1).otherwise(0)).cast("long")).drop("_raw", "_f", "_rest", "_r")


def boundary_depths(df: DataFrame, column: Sequence[str], depth: str, label: str, k: int) -> DataFrame:
    """First depth of each column at which the label reaches k."""
    return df.groupBy(*column).agg(F.min(F.when(F.col(label) >= k, F.col(depth))).alias("boundary"))


def boundary_table(boundaries: DataFrame) -> DataFrame:
    """Median and 5-95 % spread of boundary depths."""
    return boundaries.agg(F.count("boundary").alias("n"), F.median("boundary").alias("median"), (F.percentile("boundary", F.lit(0.95)) - F.percentile("boundary", F.lit(0.05))).alias("spread"))


def unique_points(df: DataFrame, keys: dict[str, Column], order: Sequence[str]) -> DataFrame:
    """Points shared by shards once: the first in order of each rounded key."""
    named = df.withColumns({f"_{k}": c for k, c in keys.items()})
    return keep_one(named, [f"_{k}" for k in keys], list(order)).drop(*[f"_{k}" for k in keys])


def pick_spread(df: DataFrame, group: Sequence[str], azimuth: str, distance: str, score: str, key: str, n_azimuth: int, n_distance: int, most: float) -> DataFrame:
    """The best-scored row of each azimuth x distance cell (ties: the smaller key)."""
    a = F.floor(F.pmod(F.col(azimuth), F.lit(360.0)) / (360.0 / n_azimuth)).cast("int")
    d = F.least(F.floor(F.col(distance) / (most / n_distance)).cast("int"), F.lit(n_distance - 1))
    cells = df.withColumns({"az_bin": a, "dist_bin": d})
    return keep_one(cells, [*group, "az_bin", "dist_bin"], [-F.col(score), key])


def max_scaled(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """A value over its group's maximum."""
    top = F.col("_top")
    return _with_group(df, group, F.max(value).alias("_top")).withColumn(out, F.when(top > 0, F.col(value) / top).otherwise(0.0)).drop("_top")


def min_max_scaled(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """A value between its group's minimum (0) and maximum (1); 1 where all are equal."""
    lo, hi = F.col("_lo"), F.col("_hi")
    both = _with_group(df, group, F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return both.withColumn(out, F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(1.0)).drop("_lo", "_hi")


def _with_group(df: DataFrame, group: Sequence[str], *values: Column) -> DataFrame:
    """``df`` with aggregates of its group (null keys are one group): combined where rows are read and joined back, so one key is not one task."""
    keys = [f"_key{k}" for k in range(len(group))]
    found = checked_broadcast(df.groupBy(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)]).agg(*values))
    if not keys:
        return df.crossJoin(found)
    return df.join(found, _all([F.col(g).eqNullSafe(F.col(k)) for g, k in zip(group, keys, strict=True)])).drop(*keys)
