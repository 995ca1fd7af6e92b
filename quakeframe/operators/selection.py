"""Order-dependent selections as Spark jobs: spacing by priority, farthest points, weighted samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.functions.geo import haversine_deg
from quakeframe.functions.numeric import clean, unit_hash
from quakeframe.operators.common import stored
from quakeframe.operators.joins import not_near, place_pairs, tasks


def spaced(df: DataFrame, key: str, priority: str, radius: float, lat: str = "lat", lon: str = "lon", most: int | None = None, taken: DataFrame | None = None) -> DataFrame:
    """Greedy thinning: rows in order of priority (largest first; ties: the smaller key), each taken unless a taken one is within ``radius`` degrees.

    The greedy result is settled in rounds without ordering all rows: a row whose undecided neighbours all come after
    it is taken, its neighbours are dropped. Rows that have no neighbour never enter a round. ``most`` keeps the first
    of the result, which is what a greedy run that stops early takes; rows near ``taken`` (lat, lon) are dropped first.
    """
    rows = df.select(key, priority, lat, lon)
    if taken is not None:
        rows = not_near(rows, taken, (lat, lon), ("lat", "lon"), radius)
    # of the rows of one place only the first can be taken: what keeps it out keeps the others out, and else it does
    there = rows.filter(clean(lat).isNotNull() & clean(lon).isNotNull() & F.col(priority).isNotNull() & F.col(key).isNotNull())
    first = there.withColumn("_k", F.row_number().over(Window.partitionBy(lat, lon).orderBy(F.desc(priority), F.asc(key)))).filter("_k = 1").drop("_k")
    rows, first = stored(rows, "spaced-rows"), stored(first, "spaced-places")
    behind = first.select(lat, lon, F.col(key).alias("_first"))
    out = there.join(behind, [lat, lon]).filter(F.col(key) != F.col("_first")).select(F.col(key).alias("x"))
    side = lambda s: first.select(F.col(key).alias(f"k{s}"), F.col(priority).alias(f"p{s}"), F.col(lat).alias(f"lat{s}"), F.col(lon).alias(f"lon{s}"))
    pairs = place_pairs(side(1), side(2), radius).filter(F.col("k1") != F.col("k2"))
    ahead = (F.col("p1") > F.col("p2")) | ((F.col("p1") == F.col("p2")) & (F.col("k1") < F.col("k2")))
    # an edge from each row to its neighbours that come after it
    edges = stored(pairs.filter(ahead).select(F.col("k1").alias("a"), F.col("k2").alias("b")), "spaced-edges")
    while True:  # each round settles at least the first of every chain of neighbours
        firsts = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = stored(edges.join(firsts, "a").select(F.col("b").alias("x")).distinct(), "spaced-gone")
        if gone.isEmpty():
            break
        out = out.union(gone)
        left = edges.join(gone.withColumnRenamed("x", "a"), "a", "left_anti")
        edges = stored(left.join(gone.withColumnRenamed("x", "b"), "b", "left_anti").select("a", "b"), "spaced-edges")
    kept = rows.join(out.withColumnRenamed("x", key), key, "left_anti")
    result = df.join(kept.select(key), key, "left_semi")
    return result.orderBy(F.desc(priority), F.asc(key)).limit(most) if most is not None else result


def farthest_points(df: DataFrame, key: str, n: int, score: str | None = None, lat: str = "lat", lon: str = "lon", seeds: DataFrame | None = None, weight: float = 1.0) -> DataFrame:
    """``n`` rows, each in turn the one of the largest distance to those before (plus ``weight`` x score); the first is the best-scored. Ties: the smaller key.

    All ``seeds`` count as points before the first pick. One aggregate a pick, which brings back one row; ``n`` is a small number such as a quota of events.
    """
    rows = df.select(key, lat, lon, *([score] if score else []))
    if seeds is None:
        rows = rows.withColumn("_seed", F.lit(None).cast("double"))
    else:  # each row against all seeds, in blocks: the nearest one's distance stays
        to = seeds.select(F.col("lat").alias("_slat"), F.col("lon").alias("_slon")).distinct()
        near = rows.crossJoin(to).groupBy(key).agg(F.min(haversine_deg(lat, lon, F.col("_slat"), F.col("_slon"))).alias("_seed"))
        rows = rows.join(near, key, "left")
    rows = stored(rows, "farthest")
    points: list[tuple] = []
    picks: list[tuple] = []
    value = F.col(score) * weight if score else F.lit(0.0)
    for k in range(n):
        near = F.coalesce(F.least(F.col("_seed"), F.lit(None).cast("double"), *[haversine_deg(lat, lon, a, b) for a, b in points]), F.lit(0.0))
        free = ~F.col(key).isin([p[0] for p in picks]) if picks else F.lit(True)
        best = rows.filter(free).agg(F.max_by(F.struct(key, lat, lon), F.struct(F.round(near + value, 9), -F.col(key))).alias("b"), F.max(near).alias("_d")).first()
        if best is None or best["b"] is None:
            break
        picks.append((best["b"][key], k + 1))
        points.append((best["b"][lat], best["b"][lon]))
    order = df.sparkSession.createDataFrame(picks, f"{key} {df.schema[key].dataType.simpleString()}, pick int")
    return df.join(F.broadcast(order), key)  # n rows


def weighted_sample(df: DataFrame, keys: Sequence[str], weight: Column, n: int, group: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """``n`` rows (of each group) without replacement, by weight: the largest of ln(u) / weight, u a hash of the keys."""
    drawn = df.withColumn("_k", F.log(unit_hash(*keys, seed=seed)) / F.when(weight > 0, weight)).filter(F.col("_k").isNotNull())
    if not group:
        return drawn.orderBy(F.desc("_k"), *keys).limit(n).drop("_k")
    return drawn.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_k"), *keys))).filter(F.col("_r") <= n).drop("_k", "_r")


def dense_groups(df: DataFrame, group: str, key: str, lat: str, lon: str, radius: float, least: int = 3, share: float = 0.6) -> DataFrame:
    """Groups whose members have, on average, over ``share`` of the others within ``radius`` degrees (planar): group, n, density, is_dense.

    Places of a group are compared once each and count as often as they have rows; rows of one key are then taken off again.
    """
    from quakeframe.functions.geo import planar_degrees

    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    side = F.array(F.lit(-1), F.lit(0), F.lit(1))
    rows = df.filter(F.col(key).isNotNull() & clean(lat).isNotNull() & clean(lon).isNotNull())
    spots = rows.groupBy(group, lat, lon).agg(F.count("*").alias("_n"))
    of = lambda d, s, *more: d.select(group, *more, F.col("_n").alias(f"_n{s}"), F.col(lat).alias(f"_lat{s}"), F.col(lon).alias(f"_lon{s}"))
    within = planar_degrees("_lat1", "_lon1", "_lat2", "_lon2") <= radius
    a = of(spots, 1, cell(lat).alias("_r"), cell(lon).alias("_c"))
    a = a.withColumn("_o", F.explode(side)).withColumn("_r", F.col("_r") + F.col("_o")).withColumn("_o", F.explode(side)).withColumn("_c", F.col("_c") + F.col("_o")).drop("_o")
    b = of(spots, 2, cell(lat).alias("_r"), cell(lon).alias("_c"))
    pairs = a.repartition(tasks(df), group, "_r", "_c").join(b, [group, "_r", "_c"]).filter(within).select(group, (F.col("_n1") * F.col("_n2")).alias("_near"))
    own = rows.groupBy(group, key, lat, lon).agg(F.count("*").alias("_n"))
    same = of(own, 1, key).join(of(own, 2, key), [group, key]).filter(within).select(group, (-F.col("_n1") * F.col("_n2")).alias("_near"))
    near = pairs.unionByName(same).groupBy(group).agg(F.sum("_near").alias("_near"))
    n = df.groupBy(group).agg(F.count("*").alias("n")).join(near, group, "left")
    density = F.when(F.col("n") > 1, F.coalesce("_near", F.lit(0)) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return n.select(group, "n", density.alias("density"), ((F.col("n") >= least) & (density > share)).alias("is_dense"))


def smaller_of_two(df: DataFrame, group: str, first: str, second: str, area: DataFrame) -> DataFrame:
    """Rows without the one of two groups of the smaller area (ties: the second goes), where both are there."""
    a = area.filter(F.col(group).isin(first, second)).select(group, "area")
    ranked = a.withColumn("_r", F.row_number().over(Window.partitionBy().orderBy(F.desc("area"), F.when(F.col(group) == first, 0).otherwise(1))))  # two rows
    return df.join(F.broadcast(ranked.filter("_r = 2").select(group)), group, "left_anti")


def pack_chunks(df: DataFrame, group: Sequence[str], key: str, per_chunk: int, most_chars: int) -> DataFrame:
    """Keys of a group in request chunks of at most ``per_chunk`` names and ``most_chars`` characters, in order of the key.

    The chunk size is settled by the group's longest name, so that positions alone give the chunk.
    """
    g = Window.partitionBy(*group)
    width = F.max(F.length(key)).over(g) + 1
    size = F.greatest(F.lit(1), F.least(F.lit(per_chunk), F.floor(F.lit(most_chars) / width))).cast("int")
    at = F.row_number().over(Window.partitionBy(*group).orderBy(key)) - 1
    return df.withColumn("_size", size).withColumn("chunk", F.floor(at / F.col("_size")).cast("int")).drop("_size")

