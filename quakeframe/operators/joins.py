"""Joins that SQL has no word for, as equi-joins on buckets: as-of, interval, spatial and matching in phases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.functions.geo import haversine_deg
from quakeframe.functions.numeric import Num, clean


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, right_key: str, most: float, nearest: bool = True) -> DataFrame:
    """Each left row with the right row of its keys nearest in time (or the latest not after it), ``most`` away at most.

    Times are numbers. Both sides are filed by time // most, and a left row looks into its own and the neighbouring
    buckets, so that what a row is compared with is bounded by the density, not by the size of its key. Ties go to
    the earlier right row, then to the smaller ``right_key``. Left rows without a partner stay, with nulls.
    """
    # a partner depends on keys and time alone, so that left rows need no number of their own
    asked = left.select(*by, F.col(left_time).alias("_t")).filter(F.col("_t").isNotNull()).distinct()
    bucket = lambda c: F.floor(F.col(c) / F.lit(float(most))).cast("long")
    offsets = F.array(F.lit(-1), F.lit(0), F.lit(1)) if nearest else F.array(F.lit(-1), F.lit(0))
    probe = asked.select("*", F.explode(offsets).alias("_o")).withColumn("_b", bucket("_t") + F.col("_o"))
    filed = right.withColumn("_b", bucket(right_time))
    gap = F.abs(F.col(right_time) - F.col("_t"))
    near = probe.join(filed, [*by, "_b"]).filter((gap <= most) & (F.lit(nearest) | (F.col(right_time) <= F.col("_t"))))
    rest = [c for c in right.columns if c not in by]
    best = near.groupBy(*by, "_t").agg(F.min_by(F.struct(*rest), F.struct(gap.alias("gap"), F.col(right_time).alias("t"), F.col(right_key).alias("k"))).alias("_m"))
    return left.withColumn("_t", F.col(left_time)).join(best, [*by, "_t"], "left").select(*left.columns, *[F.col(f"_m.{c}").alias(c) for c in rest])


def match_in_hour(left: DataFrame, right: DataFrame, by: Sequence[str], left_minute: str, right_minute: str, right_key: str, tolerance: int, left_key: str) -> DataFrame:
    """Equi-join on keys that end with the hour, minutes within a tolerance, the nearest taken (ties: the smaller key). Matches do not cross the hour.

    A partner depends on keys and minute alone, and of one minute's right rows only that of the smallest key can be
    taken: minutes meet, at most sixty on either side of an hour, and rows are joined with what their minute found.
    """
    rest = [c for c in right.columns if c not in by]
    gap = F.abs(F.col(left_minute) - F.col(right_minute))
    firsts = right.groupBy(*by, F.col(right_minute).alias("_minute")).agg(F.min_by(F.struct(*rest), right_key).alias("_m"))
    asked = left.select(*by, left_minute).distinct()
    away = F.abs(F.col(left_minute) - F.col("_minute"))
    near = asked.join(firsts, list(by)).filter(away <= tolerance)
    best = near.groupBy(*by, left_minute).agg(F.min_by("_m", F.struct(away.alias("gap"), F.col(f"_m.{right_key}").alias("k"))).alias("_m"))
    pairs = left.join(best, [*by, left_minute]).select(*by, *[c for c in left.columns if c not in by], *[F.col(f"_m.{c}").alias(c) for c in rest])
    rank = F.row_number().over(Window.partitionBy(left_key).orderBy(gap, F.col(right_key)))
    return pairs.withColumn("_r", rank).filter("_r = 1").drop("_r")


def within_window(df: DataFrame, key: str, time: str, half: float) -> DataFrame:
    """Rows that have another row (of a different key) with a time in [t - half, t + half)."""
    bucket = F.floor(F.col(time) / F.lit(float(half))).cast("long")
    a = df.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_o"), bucket.alias("_own")).withColumn("_b", F.col("_own") + F.col("_o"))
    b = df.select(F.col(key).alias("_k2"), F.col(time).alias("_t2"), bucket.alias("_b"))
    # of each bucket the first two rows of a time would do, but keys may repeat: the join is narrow and ends in keys
    hit = a.join(b, "_b").filter((F.col("_k") != F.col("_k2")) & (F.col("_t2") >= F.col("_t") - half) & (F.col("_t2") < F.col("_t") + half)).select(F.col("_k").alias(key)).distinct()
    return df.join(hit, key, "left_semi")


def without_interference(df: DataFrame, key: str, time: str, half: float) -> DataFrame:
    """Interval anti-join: rows without another one in [t - half, t + half).

    A row's neighbours in time order decide: the previous and the next distinct row are the nearest. One sort, no pairs.
    """
    bucket = F.floor(F.col(time) / F.lit(float(half))).cast("long")
    # each bucket needs its own rows, and the first and last times of the buckets beside it
    own = Window.partitionBy("_b").orderBy(time, key)
    rows = df.withColumn("_b", bucket)
    ends = rows.groupBy("_b").agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    before = ends.select((F.col("_b") + 1).alias("_b"), F.col("_hi").alias("_before"))
    after = ends.select((F.col("_b") - 1).alias("_b"), F.col("_lo").alias("_after"))
    near = rows.withColumns({"_p": F.lag(time).over(own), "_n": F.lead(time).over(own)}).join(before, "_b", "left").join(after, "_b", "left")
    prev, nxt = F.coalesce("_p", "_before"), F.coalesce("_n", "_after")
    clash = F.coalesce(prev >= F.col(time) - half, F.lit(False)) | F.coalesce(nxt < F.col(time) + half, F.lit(False))
    return near.filter(~clash).select(*df.columns)


def two_phase(left: DataFrame, right: DataFrame, strict: Sequence[str], loose: Sequence[str]) -> DataFrame:
    """Match on the strict keys, then what is left on the loose keys where those are unique on both sides.

    left_id and right_id name the rows. Returns left_id, right_id, phase; unmatched rows of either side with a null partner and phase.
    """
    first = left.join(right, list(strict)).select("left_id", "right_id", F.lit("strict").alias("phase"))
    rest_l = left.join(first, "left_id", "left_anti")
    rest_r = right.join(first, "right_id", "left_anti")
    lone = lambda d, k: d.groupBy(*loose).agg(F.min(k).alias(k), F.count("*").alias("n")).filter("n = 1").drop("n")
    second = lone(rest_l, "left_id").join(lone(rest_r, "right_id"), list(loose)).select("left_id", "right_id", F.lit("loose").alias("phase"))
    open_l = rest_l.join(second, "left_id", "left_anti").select("left_id", F.lit(None).cast(right.schema["right_id"].dataType).alias("right_id"), F.lit(None).cast("string").alias("phase"))
    open_r = rest_r.join(second, "right_id", "left_anti").select(F.lit(None).cast(left.schema["left_id"].dataType).alias("left_id"), "right_id", F.lit(None).cast("string").alias("phase"))
    return first.unionByName(second).unionByName(open_l).unionByName(open_r)


def division(df: DataFrame, group: Sequence[str], key: Sequence[str], member: str) -> DataFrame:
    """Relational division: (group, key) that occur with every member that the group has."""
    members = df.groupBy(*group).agg(F.count_distinct(member).alias("_all"))
    have = df.groupBy(*group, *key).agg(F.count_distinct(member).alias("_have"))
    return have.join(members, list(group)).filter(F.col("_have") == F.col("_all")).select(*group, *key)


def nearest_level(left: DataFrame, right: DataFrame, left_depth: str, right_depth: str, tolerance: float) -> DataFrame:
    """Each left depth with the nearest right depth within a tolerance (ties: the smaller); depths are distinct levels."""
    b = lambda c: F.floor(F.col(c) / F.lit(float(tolerance))).cast("long")
    probe = left.select(left_depth, F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_o"), b(left_depth).alias("_own")).withColumn("_b", F.col("_own") + F.col("_o"))
    gap = F.abs(F.col(left_depth) - F.col(right_depth))
    pairs = probe.join(right.select(right_depth, b(right_depth).alias("_b")), "_b").filter(gap <= tolerance)
    return pairs.groupBy(left_depth).agg(F.min_by(right_depth, F.struct(gap.alias("g"), F.col(right_depth).alias("d"))).alias(right_depth))


def cells(lat: Num, lon: Num, size: float) -> list[Column]:
    """Row and column of the cell of ``size`` degrees that a point is in; longitudes wrap."""
    from quakeframe.functions.numeric import col

    return [F.floor((col(lat) + 90.0) / size).cast("long"), F.floor(F.pmod(col(lon), F.lit(360.0)) / size).cast("long")]


def places(df: DataFrame, at: tuple[str, str], count: str | None = None) -> DataFrame:
    """The different finite places of a table, with how many rows each has where ``count`` names a column for it."""
    there = df.filter(clean(at[0]).isNotNull() & clean(at[1]).isNotNull())
    return there.groupBy(*at).agg(F.count("*").alias(count)) if count else there.select(*at).distinct()


def place_pairs(left: DataFrame, right: DataFrame, radius: float, left_at: tuple[str, str] = ("lat1", "lon1"), right_at: tuple[str, str] = ("lat2", "lon2")) -> DataFrame:
    """All pairs within ``radius`` degrees, with ``distance``, of tables with a row for each place (see ``places``).

    Points are filed in cells of the radius' size. A left point looks into the rows next to its own, and in each into
    the columns that the radius can reach at that latitude (all of them near a pole), past the antimeridian too. Few
    points make many pairs, so cells are dealt to all tasks, however few bytes they are.
    """
    columns = int(-(-360.0 // radius))
    row, column = cells(*left_at, radius)
    lat = F.radians(F.least(F.lit(90.0), F.abs(F.col(left_at[0])) + radius))
    reach = F.when(F.cos(lat) * columns <= 2.0, F.lit(columns // 2 + 1)).otherwise(F.least(F.ceil(F.lit(1.0) / F.cos(lat)) + 1, F.lit(columns // 2 + 1))).cast("long")
    probe = left.withColumns({"_row": row, "_col": column, "_reach": reach})
    probe = probe.withColumn("_r", F.explode(F.array(F.col("_row") - 1, F.col("_row"), F.col("_row") + 1)))
    probe = probe.withColumn("_c", F.explode(F.array_distinct(F.transform(F.sequence(F.col("_col") - F.col("_reach"), F.col("_col") + F.col("_reach")), lambda c: F.pmod(c, F.lit(columns).cast("long"))))))
    r, c = cells(*right_at, radius)
    filed = right.withColumns({"_r": r, "_c": c})
    distance = haversine_deg(*left_at, *right_at)
    return probe.repartition(tasks(left), "_r", "_c").join(filed, ["_r", "_c"]).withColumn("distance", distance).filter(F.col("distance") <= radius).drop("_r", "_c", "_row", "_col", "_reach")


def tasks(df: DataFrame) -> int:
    """Tasks of a shuffle; a number given to repartition keeps few bytes of much work from being put into one task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spatial_pairs(left: DataFrame, right: DataFrame, radius: float, left_at: tuple[str, str] = ("lat1", "lon1"), right_at: tuple[str, str] = ("lat2", "lon2")) -> DataFrame:
    """All pairs within ``radius`` degrees, with ``distance``: places are compared once, and each pair of them is joined with its rows on both sides."""
    near = place_pairs(places(left, left_at), places(right, right_at), radius, left_at, right_at)
    one = near.repartition(tasks(left), *left_at).join(left, list(left_at))
    both = one.repartition(tasks(left), *right_at).join(right, list(right_at))
    return both.select(*left.columns, *right.columns, "distance")


def _nearest(left: DataFrame, right: DataFrame, right_key: str, k: int, radius: float, left_at: tuple[str, str], right_at: tuple[str, str]) -> DataFrame:
    """The ``k`` nearest right rows of each place of the left rows: the place, the right columns, distance and rank.

    Of the rows of one place those of the ``k`` smallest keys can be among the nearest, no others.
    """
    there = right.filter(clean(right_at[0]).isNotNull() & clean(right_at[1]).isNotNull())
    first = there.withColumn("_k", F.row_number().over(Window.partitionBy(*right_at).orderBy(right_key))).filter(F.col("_k") <= k).drop("_k")
    near = place_pairs(places(left, left_at), places(right, right_at), radius, left_at, right_at)
    # the k nearest places hold the k nearest rows, with all other places that are as far as the last of them
    order = Window.partitionBy(*left_at).orderBy("distance")
    near = near.withColumn("_p", F.rank().over(order)).filter(F.col("_p") <= k).drop("_p")
    rows = near.join(first, list(right_at)).select(*left_at, *right.columns, "distance")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*left_at).orderBy("distance", right_key))).filter(F.col("rank") <= k)


def knn(left: DataFrame, right: DataFrame, left_key: str, right_key: str, k: int, radius: float, left_at: tuple[str, str] = ("lat1", "lon1"), right_at: tuple[str, str] = ("lat2", "lon2")) -> DataFrame:
    """The k nearest right points of each left one within ``radius`` degrees, with distance and rank (ties: the smaller key).

    They are found once for each place of the left points, whose rows then join theirs; ``left_key`` names the rows.
    """
    near = _nearest(left, right, right_key, k, radius, left_at, right_at)
    return left.join(near, list(left_at)).select(*left.columns, *right.columns, "distance", "rank")


def idw(left: DataFrame, right: DataFrame, left_key: str, right_key: str, value: str, k: int = 8, radius: float = 1.5, power: float = 2.0, left_at: tuple[str, str] = ("lat1", "lon1"), right_at: tuple[str, str] = ("lat2", "lon2")) -> DataFrame:
    """Inverse-distance mean of the k nearest values; a point at zero distance counts alone; null where none is near. A mean for each place of the left points, which ``left_key`` names."""
    near = _nearest(left, right.filter(F.col(value).isNotNull()), right_key, k, radius, left_at, right_at)
    w = F.when(F.col("distance") > 1e-9, F.pow(F.col("distance"), F.lit(-power)))
    hit = F.max(F.when(F.col("distance") <= 1e-9, F.col(value)))
    mean = near.groupBy(*left_at).agg(F.coalesce(hit, F.sum(w * F.col(value)) / F.sum(w)).alias(value), F.count("*").alias("n_near"))
    return left.join(mean, list(left_at), "left").select(*left.columns, value, "n_near")


def not_near(df: DataFrame, spots: DataFrame, at: tuple[str, str], spot_at: tuple[str, str], radius: float) -> DataFrame:
    """Rows without a spot within ``radius`` degrees: places near one are found once each."""
    there = spots.select(F.col(spot_at[0]).alias("_elat"), F.col(spot_at[1]).alias("_elon"))
    near = place_pairs(places(df, at), places(there, ("_elat", "_elon")), radius, at, ("_elat", "_elon")).select(*at).distinct()
    return df.join(near, list(at), "left_anti").select(*df.columns)


def exclude_near(df: DataFrame, excluded: DataFrame, key: str, at: tuple[str, str], excluded_at: tuple[str, str], radius: float, names: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Anti-join by any of several equal columns or by distance; each condition is an equi-join of its own. ``key`` names the rows."""
    out = df
    for mine, theirs in names:
        out = out.join(excluded.select(F.col(theirs).alias(mine)).filter(F.col(mine).isNotNull()), mine, "left_anti")
    return not_near(out, excluded, at, excluded_at, radius).select(*df.columns)


def catalog_diff(ours: DataFrame, theirs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys by membership: common, ours_only, theirs_only."""
    a = ours.select(*key).distinct().withColumn("_a", F.lit(1))
    b = theirs.select(*key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, list(key), "full_outer")
    return both.select(*key, F.when(F.col("_b").isNull(), "ours_only").when(F.col("_a").isNull(), "theirs_only").otherwise("common").alias("membership"))


def by_priority(parts: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Union of sources of which later ones win for a key."""
    tagged = None
    for k, part in enumerate(parts):
        one = part.withColumn("_prio", F.lit(k))
        tagged = one if tagged is None else tagged.unionByName(one, allowMissingColumns=True)
    rest = [c for c in tagged.columns if c not in (*key, "_prio")]
    return tagged.groupBy(*key).agg(F.max_by(F.struct(*rest), "_prio").alias("_v")).select(*key, "_v.*")


def values_diff(a: DataFrame, b: DataFrame, key: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Differences of two tables of one mesh: counts of rows missing on either side and over a tolerance, and the largest."""
    both = a.select(*key, F.col(value).alias("_x")).join(b.select(*key, F.col(value).alias("_y")), list(key), "full_outer")
    d = F.abs(F.col("_x") - F.col("_y"))
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("_x").isNull()).alias("n_missing_left"), F.count_if(F.col("_y").isNull()).alias("n_missing_right"), F.count_if(d > tolerance).alias("n_over"), F.max(d).alias("max_abs_diff"))
