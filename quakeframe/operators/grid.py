"""Gridded models as long tables of voxels: slices, regridding, perturbations, masks, patches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.functions.numeric import Num, clean, col, safe_log
from quakeframe.functions.seismic import voigt_vp, voigt_vs
from quakeframe.operators.common import stored


def slice_at(df: DataFrame, axis: str, at: float, group: Sequence[str] = ()) -> DataFrame:
    """The voxels of the level of ``axis`` nearest to ``at`` (ties: the smaller); a horizontal slice on depth, a section on latitude or longitude.

    The level is found on the different values of the axis, a short table.
    """
    levels = df.groupBy(*group, axis).agg(F.lit(1).alias("_"))
    best = levels.groupBy(*group).agg(F.min_by(axis, F.struct(F.abs(F.col(axis) - at).alias("g"), F.col(axis).alias("a"))).alias("_at"))
    j = df.crossJoin(F.broadcast(best)) if not group else df.join(best, list(group))  # without groups: one row
    return j.filter(F.col(axis) == F.col("_at")).drop("_at")


def canonical(df: DataFrame, rho: float = 3300.0, eta: float = 1.0, qmu: float = 600.0) -> DataFrame:
    """All standard parameters of a model: isotropic speeds stand in for missing anisotropic ones, defaults for rho, eta, qmu; Voigt means as vs and vp."""
    have = set(df.columns)
    pick = lambda *names: F.coalesce(*[clean(n) for n in names if n in have], F.lit(None).cast("double"))
    out = df.select(*[c for c in df.columns if c not in {"vpv", "vph", "vsv", "vsh", "eta", "rho", "qmu", "vs", "vp"}], pick("vpv", "vp").alias("vpv"), pick("vph", "vp").alias("vph"), pick("vsv", "vs").alias("vsv"), pick("vsh", "vs").alias("vsh"), F.coalesce(pick("eta"), F.lit(eta)).alias("eta"), F.coalesce(pick("rho"), F.lit(rho)).alias("rho"), F.coalesce(pick("qmu"), F.lit(qmu)).alias("qmu"))
    return out.withColumns({"vs": voigt_vs("vsv", "vsh"), "vp": voigt_vp("vpv", "vph")})


def lateral_perturbation(df: DataFrame, group: Sequence[str], depth: str, value: str, lat: str | None = None, relative: bool = True, out: str = "perturbation") -> DataFrame:
    """A value less its level's mean (by the cosine of latitude if ``lat`` is given), over that mean if relative; values pass where the mean is under 1e-9.

    The means are a short table that is joined, not a window that sorts the voxels of a level in one task.
    """
    v = clean(value)
    w = F.when(v.isNotNull(), F.cos(F.radians(F.col(lat))) if lat else F.lit(1.0))
    means = df.groupBy(*group, depth).agg((F.sum(w * v) / F.sum(w)).alias("_mean"))
    m = F.col("_mean")
    change = (v - m) / F.when(F.abs(m) >= 1e-9, m) if relative else v - m
    return df.join(means, [*group, depth], "left").withColumn(out, F.when(F.abs(m) < 1e-9, v).otherwise(change)).drop("_mean")


def log_perturbation(df: DataFrame, group: Sequence[str], depth: str, value: str, reference: str | None = None, scale: float = 1.0, out: str = "dlnv") -> DataFrame:
    """ln of a value over its native reference, else over its level's mean."""
    means = df.groupBy(*group, depth).agg(F.avg(clean(value)).alias("_mean"))
    base = F.coalesce(clean(reference), F.col("_mean")) if reference else F.col("_mean")
    return df.join(means, [*group, depth], "left").withColumn(out, safe_log(clean(value) / F.when(base > 0, base)) * scale).drop("_mean")


def unified_grid(df_one: DataFrame, lat: tuple[float, float, float], lon: tuple[float, float, float], depths: Sequence[float]) -> DataFrame:
    """All nodes of a regular grid: (first, last, step) of latitude and longitude, and depths, with integer indices."""
    spark = df_one.sparkSession
    axis = lambda lo, hi, step, n: spark.range(int(round((hi - lo) / step)) + 1).select(F.col("id").cast("int").alias(f"i{n}"), (F.col("id") * step + lo).alias(n))
    levels = spark.createDataFrame([(k, float(d)) for k, d in enumerate(depths)], "idepth int, depth double")
    return axis(*lat, "lat").crossJoin(axis(*lon, "lon")).crossJoin(levels)  # a grid is the product of its axes


def trilinear(points: DataFrame, grid: DataFrame, key: str, value: str, origin: tuple[float, float, float], step: tuple[float, float, float], group: Sequence[str] = (), axes: tuple[str, str, str] = ("lat", "lon", "depth"), index: tuple[str, str, str] = ("ilat", "ilon", "idepth")) -> DataFrame:
    """Trilinear interpolation of a regular grid at points: an equi-join with the eight corners; null outside and where a corner of weight is missing.

    Corners without weight (points on a face) are not needed, so that points on the last plane are inside.
    """
    frac, low = [], []
    for a, o, s in zip(axes, origin, step, strict=True):
        at = (F.col(a) - o) / s
        low.append(F.floor(F.round(at, 9)).cast("int"))
        frac.append(F.greatest(F.lit(0.0), F.round(at, 9) - F.floor(F.round(at, 9))))
    corners = []
    for k in range(8):
        bits = [(k >> b) & 1 for b in range(3)]
        w = F.lit(1.0)
        for f, b in zip(frac, bits, strict=True):
            w = w * (f if b else F.lit(1.0) - f)
        corners.append(F.struct(*[(i + b).alias(n) for i, b, n in zip(low, bits, index, strict=True)], w.alias("_w")))
    probe = points.select(key, *group, F.explode(F.filter(F.array(*corners), lambda c: c["_w"] > 0)).alias("_c")).select(key, *group, "_c.*")
    hit = probe.join(grid.select(*group, *index, value), [*group, *index], "left")
    v = clean(value)
    mean = hit.groupBy(key, *group).agg(F.when(F.count(v) == F.count("*"), F.sum(F.col("_w") * v)).alias(value))
    return points.join(mean, [key, *group], "left")


def nearest_sample(points: DataFrame, grid: DataFrame, value: str, origin: tuple[float, float], step: tuple[float, float], axes: tuple[str, str] = ("lat", "lon"), index: tuple[str, str] = ("ilat", "ilon")) -> DataFrame:
    """Value of the nearest node of a regular grid; null beyond it."""
    ix = [F.floor((F.col(a) - o) / s + 0.5).cast("int").alias(n) for a, o, s, n in zip(axes, origin, step, index, strict=True)]
    return points.withColumns({n: c for n, c in zip(index, ix, strict=True)}).join(grid.select(*index, value), list(index), "left").drop(*index)


def erode(df: DataFrame, group: Sequence[str], i: str, j: str, valid: Column, buffer: int, out: str = "eroded") -> DataFrame:
    """Whether a cell and all cells within ``buffer`` in both directions are there and valid.

    Valid cells are counted along each row, and those counts along each column: a cell that is not there leaves its
    column's sum short. A row or a column of a level is a window, and no cell is sent to its neighbours.
    """
    along = lambda line, at: Window.partitionBy(*group, line).orderBy(at).rangeBetween(-buffer, buffer)
    rows = df.withColumn("_n", F.count_if(valid).over(along(i, j)))
    return rows.withColumn("_n", F.sum("_n").over(along(j, i))).withColumn(out, F.col("_n") == (2 * buffer + 1) ** 2).drop("_n")


def neighbours(df: DataFrame, group: Sequence[str], index: tuple[str, str, str], value: str, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Sum of weight x value over a voxel's six neighbours, as ``field``; a line of voxels along each axis is a window."""
    out, total = df, F.lit(0.0)
    for k, (axis, weight) in enumerate(zip(index, weights, strict=True)):
        line = Window.partitionBy(*group, *[n for n in index if n != axis]).orderBy(axis)
        side = lambda at: F.coalesce(F.sum(clean(value)).over(line.rangeBetween(at, at)), F.lit(0.0))  # noqa: E731, B023
        out = out.withColumn(f"_s{k}", side(-1) + side(1))
        total = total + F.col(f"_s{k}") * weight
    return out.withColumn("field", total).drop(*[f"_s{k}" for k in range(3)])


def resolution_class(df: DataFrame, i: str, j: str, valid: Column) -> DataFrame:
    """``fine`` for valid cells with a valid neighbour one step away in either direction, ``coarse`` for the other valid ones, null for invalid."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    good = df.filter(valid)
    seen = good.select(F.explode(steps).alias("_o"), i, j).select((F.col(i) + F.col("_o.a")).alias(i), (F.col(j) + F.col("_o.b")).alias(j)).distinct().withColumn("_near", F.lit(True))
    return df.join(seen, [i, j], "left").withColumn("resolution", F.when(valid, F.when(F.col("_near"), "fine").otherwise("coarse"))).drop("_near")


def fill_all_nearest(df: DataFrame, group: Sequence[str], i: str, j: str, value: str) -> DataFrame:
    """Missing values from the nearest valid cell, however far (ties: the smaller indices); groups without any stay as they are.

    A distance transform in two passes. Along each row (``i``) a cell gets the nearest valid column on either side, by
    windows; along each column (``j``) the rows' squared distances are parabolas, whose lower envelope gives the nearest
    row. A row of the grid, and a column of it, is what must fit a task. Cells of the grid without a row are holes on the way.
    """
    return _transformed(df, group, i, j, value).drop("_distance")


def fill_nearest(df: DataFrame, group: Sequence[str], i: str, j: str, value: str, reach: float) -> DataFrame:
    """Missing values from the nearest valid cell within a distance of ``reach`` cells (ties: the smaller indices)."""
    found = _transformed(df, group, i, j, value)
    return found.withColumn(value, F.when(F.col("_distance") <= float(reach) ** 2, F.col(value))).drop("_distance")


def _transformed(df: DataFrame, group: Sequence[str], i: str, j: str, value: str) -> DataFrame:
    """``df`` with holes filled, and the squared distance that each value came from as ``_distance`` (0 for its own)."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    line = [*group, i]
    have = F.when(clean(value).isNotNull(), F.struct(F.col(j).alias("at"), F.col(value).cast("double").alias("v")))
    before = Window.partitionBy(*line).orderBy(j).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*line).orderBy(j).rowsBetween(0, Window.unboundedFollowing)
    cells = df.select(*group, i).distinct().join(df.select(*group, j).distinct(), list(group)) if group else df.select(i).distinct().crossJoin(df.select(j).distinct())
    whole = cells.join(df.select(*group, i, j, value), [*group, i, j], "left")  # the grid, with cells that have no row
    sides = whole.withColumn("_l", F.last(have, ignorenulls=True).over(before)).withColumn("_r", F.first(have, ignorenulls=True).over(after))
    nearer = F.when(F.col("_l").isNull() | ((F.col("_r.at") - F.col(j)) < (F.col(j) - F.col("_l.at"))), F.col("_r")).otherwise(F.col("_l"))
    rows = sides.select(*group, i, j, nearer.alias("_n")).select(*group, i, j, F.col("_n.at").alias("_at"), F.col("_n.v").alias("_v"))

    column = F.array_sort(F.collect_list(F.struct(F.col(i).alias("x"), F.col("_at").alias("at"), F.col("_v").alias("v"))))
    columns = rows.groupBy(*group, j).agg(column.alias("_c")).withColumn("_ok", F.filter("_c", lambda c: c["at"].isNotNull()))
    gap = F.transform("_ok", lambda c: (c["at"] - F.col(j)).cast("double") * (c["at"] - F.col(j)))
    sent = columns.select(*group, j, F.col("_c.x").alias("_i"), F.transform("_ok", lambda c: c["x"].cast("double")).alias("_x"), gap.alias("_gap"), F.col("_ok.v").alias("_v"))
    keys = len(group) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # many columns of the grid at once
            at, x, height, v = (batch.column(keys + k).flatten().to_numpy(zero_copy_only=False) for k in range(4))
            n, ok = (batch.column(keys + k).value_lengths().to_numpy(zero_copy_only=False) for k in range(2))
            fill, square = np.full(len(at), np.nan), np.full(len(at), np.nan)
            a = b = 0
            for size, valid in zip(n.tolist(), ok.tolist(), strict=True):
                if valid:
                    best, square[a : a + size] = lower_envelope(x[b : b + valid], height[b : b + valid], at[a : a + size].astype(float))
                    fill[a : a + size] = v[b : b + valid][best]
                a, b = a + size, b + valid
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[: keys + 1], *[pa.ListArray.from_arrays(offsets, pa.array(c, from_pandas=True)) for c in (fill, square)]], names=[*batch.schema.names[: keys + 1], "_fill", "_distance"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*group, j]) + f", _i array<{kinds[i]}>, _fill array<double>, _distance array<double>"
    filled = sent.mapInArrow(run, schema).select(*group, j, F.explode(F.arrays_zip("_i", "_fill", "_distance")).alias("_c"))
    filled = filled.select(*group, F.col("_c._i").alias(i), j, "_c._fill", "_c._distance")
    return df.join(filled, [*group, i, j], "left").withColumn(value, F.coalesce(clean(value), F.col("_fill"))).drop("_fill")


#: Columns up to this length are compared cell by cell at once.
SHORT = 64


def lower_envelope(x: np.ndarray, height: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At each place of ``at`` which of the parabolas ``(. - x)^2 + height`` is lowest (ties: the first), and how low it is. ``x`` ascends."""
    if len(x) <= SHORT >= len(at):
        low = (at[:, None] - x) ** 2 + height
        best = low.argmin(axis=1)
        return best, low[np.arange(len(at)), best]
    kept, start = [0], [-np.inf]
    for k in range(1, len(x)):
        while kept:
            q = kept[-1]
            cross = ((height[k] + x[k] ** 2) - (height[q] + x[q] ** 2)) / (2 * (x[k] - x[q]))
            if cross > start[-1]:
                break
            kept.pop()
            start.pop()
        start.append(cross if kept else -np.inf)
        kept.append(k)
    best = np.array(kept)[np.maximum(np.searchsorted(start, at, side="left") - 1, 0)]
    return best, (at - x[best]) ** 2 + height[best]


def kernel(sigma: float) -> np.ndarray:
    """Weights of a Gaussian mean, to four deviations."""
    radius = max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return k / k.sum()


def convolved(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """A 2-D array with a kernel run along both axes; what is smaller than the kernel is cut away."""
    for axis in (0, 1):
        x = np.lib.stride_tricks.sliding_window_view(x, len(k), axis=axis) @ k[::-1]
    return x


#: Cells along a side of a tile, beside its halo.
TILE = 256


def tiles(df: DataFrame, group: Sequence[str], i: str, j: str, radius: int, tile: int | None = None) -> DataFrame:
    """Cells sent to every tile whose halo of ``radius`` holds them: columns ``_ti``, ``_tj``, and the level's bounds ``_i0``, ``_i1``, ``_j0``, ``_j1``.

    A tile holds ``tile`` + 2 ``radius`` cells a side at most, so that no task has a level. Bounds are a row for each level.
    """
    tile = tile or TILE
    span = df.groupBy(*group).agg(F.min(i).alias("_i0"), F.max(i).alias("_i1"), F.min(j).alias("_j0"), F.max(j).alias("_j1"))
    both = df.join(span, list(group)) if group else df.crossJoin(F.broadcast(span))  # without groups: one row

    def reach(c: str, low: str, high: str) -> Column:
        at = lambda x: F.floor(x / tile)
        first, last = F.greatest(F.col(c) - radius, F.col(low)), F.least(F.col(c) + radius, F.col(high))
        return F.sequence(at(first), at(last))

    sent = both.withColumn("_ti", F.explode(reach(i, "_i0", "_i1")))
    return sent.withColumn("_tj", F.explode(reach(j, "_j0", "_j1")))


class Tile:
    """A tile's cells as arrays, its halo filled up to the level's edge and repeated beyond it."""

    def __init__(self, pdf: pd.DataFrame, i: str, j: str, radius: int, tile: int | None = None) -> None:
        tile = tile or TILE
        one = pdf.iloc[0]
        low = (max(int(one["_ti"]) * tile, int(one["_i0"])), max(int(one["_tj"]) * tile, int(one["_j0"])))
        high = (min(int(one["_ti"]) * tile + tile - 1, int(one["_i1"])), min(int(one["_tj"]) * tile + tile - 1, int(one["_j1"])))
        self.low, self.radius = low, radius
        self.edges = tuple(np.clip(np.arange(a - radius, z + radius + 1), int(one[e0]), int(one[e1])) for a, z, e0, e1 in zip(low, high, ("_i0", "_j0"), ("_i1", "_j1"), strict=True))
        self.at = (pdf[i].to_numpy() - (low[0] - radius), pdf[j].to_numpy() - (low[1] - radius))
        self.own = (pdf[i].between(low[0], high[0]) & pdf[j].between(low[1], high[1])).to_numpy()

    def dense(self, values: np.ndarray) -> np.ndarray:
        """The values with the halo; NaN where there is no cell."""
        shape = tuple(len(e) for e in self.edges)
        out = np.full(shape, np.nan)
        out[self.at] = values
        r, c = (e - (low - self.radius) for e, low in zip(self.edges, self.low, strict=True))
        return out[np.ix_(r, c)]

    def inner(self, values: np.ndarray) -> np.ndarray:
        """Of an array without the halo, the values of the tile's own rows of the frame."""
        return values[self.at[0][self.own] - self.radius, self.at[1][self.own] - self.radius]


def smooth(df: DataFrame, group: Sequence[str], i: str, j: str, value: str, sigma: float, tile: int | None = None) -> DataFrame:
    """Gaussian mean of each level, by tiles with halos, edges repeated; missing cells count as the level's mean and stay missing."""
    k = kernel(sigma)
    radius, names = len(k) // 2, df.columns
    mean = df.groupBy(*group).agg(F.avg(clean(value)).alias("_mean"))
    with_mean = df.join(mean, list(group)) if group else df.crossJoin(F.broadcast(mean))  # without groups: one row

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = Tile(pdf, i, j, radius, tile)
        x = own.dense(pdf[value].to_numpy(float))
        y = own.inner(convolved(np.where(np.isnan(x), pdf["_mean"].iloc[0], x), k))
        out = pdf[own.own][names]
        return out.assign(**{value: np.where(out[value].isna(), np.nan, y)})

    return tiles(with_mean, group, i, j, radius, tile).groupBy(*group, "_ti", "_tj").applyInPandas(run, df.schema)


def dense(pdf: pd.DataFrame, i: str, j: str, value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A level's voxels as an array, with their row and column in it."""
    r, c = pdf[i].to_numpy() - pdf[i].min(), pdf[j].to_numpy() - pdf[j].min()
    out = np.full((r.max() + 1, c.max() + 1), np.nan)
    out[r, c] = pdf[value].to_numpy(float)
    return out, r, c


def patches(df: DataFrame, group: Sequence[str], i: str, j: str, value: str, size: int, stride: int) -> DataFrame:
    """Square windows of a level as arrays in row order; windows with a missing cell are left out. Cells report to the windows they are in."""
    offset = F.array(*[F.lit(k) for k in range(size)])
    reach = lambda c: F.filter(F.transform(offset, lambda o: F.col(c) - o), lambda s: (s % stride == 0) & (s >= 0))
    sent = df.filter(clean(value).isNotNull()).select(*group, i, j, value, F.explode(reach(i)).alias("patch_i")).select("*", F.explode(reach(j)).alias("patch_j"))
    cell = F.struct(((F.col(i) - F.col("patch_i")) * size + (F.col(j) - F.col("patch_j"))).alias("k"), F.col(value).cast("double").alias("v"))
    got = sent.groupBy(*group, "patch_i", "patch_j").agg(F.array_sort(F.collect_list(cell)).alias("_c"))  # at most size x size cells
    return got.filter(F.size("_c") == size * size).select(*group, "patch_i", "patch_j", F.transform("_c", lambda c: c["v"]).alias("patch"))


def patch_weight(size: int, kind: str = "gaussian") -> list[float]:
    """Weights of a patch's cells in row order: gaussian, or feathered to its edges."""
    x = np.arange(size) - (size - 1) / 2
    w = np.exp(-0.5 * (x / (size / 4)) ** 2) if kind == "gaussian" else np.minimum(np.arange(size) + 1, size - np.arange(size)) / ((size + 1) // 2)
    return np.outer(w, w).reshape(-1).tolist()


def stitch(pieces: DataFrame, group: Sequence[str], size: int, weights: Sequence[float], i: str = "i", j: str = "j", value: str = "value") -> DataFrame:
    """Cells as the weighted mean of the overlapping patches."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    cells = pieces.select(*group, "patch_i", "patch_j", F.posexplode("patch").alias("_k", "_v"), w.alias("_w"))
    at = cells.select(*group, (F.col("patch_i") + F.floor(F.col("_k") / size)).cast("int").alias(i), (F.col("patch_j") + F.col("_k") % size).cast("int").alias(j), "_v", F.get("_w", F.col("_k")).alias("_w"))
    return at.groupBy(*group, i, j).agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias(value))


def dissent(df: DataFrame, cell: Sequence[str], model: str, label: str, models: tuple[str, str, str]) -> DataFrame:
    """Where three models' classes differ: -1 all agree, 0/1/2 the one against the two, 3 all differ; null where one is missing."""
    a, b, c = (F.col(m) for m in models)
    wide = df.groupBy(*cell).pivot(model, list(models)).agg(F.first(label, ignorenulls=True))
    out = F.when((a == b) & (b == c), -1).when(b == c, 0).when(a == c, 1).when(a == b, 2).when(a.isNotNull() & b.isNotNull() & c.isNotNull(), 3)
    return wide.select(*cell, out.cast("int").alias("dissent"))


def slab_mask(df: DataFrame, top: Num = "slab_top", thickness: Num = "slab_thickness", depth: Num = "depth") -> Column:
    """Whether a depth is inside a slab of a top and thickness; false without one."""
    return F.coalesce(col(depth).between(col(top), col(top) + col(thickness)), F.lit(False))


def sample_levels(df: DataFrame, depth: str, key: Sequence[str], fraction: float, least: int, most: int, seed: int = 42) -> DataFrame:
    """A sample of each level: the share ``fraction`` of its rows, between ``least`` and ``most``, by the hash of the key.

    Rows are thinned by their hash before they are ranked, with room for chance, so that a level is not sorted whole.
    """
    from quakeframe.functions.numeric import unit_hash

    sizes = df.groupBy(depth).agg(F.count("*").alias("_n")).withColumn("_want", F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.col("_n") * fraction))))
    u = unit_hash(*key, seed=seed)
    near = df.join(sizes, depth).withColumn("_u", u).filter(F.col("_u") <= (F.col("_want") + 6 * F.sqrt(F.col("_want")) + 20) / F.col("_n"))
    rank = F.row_number().over(Window.partitionBy(depth).orderBy("_u", *key))
    return near.withColumn("_r", rank).filter(F.col("_r") <= F.col("_want")).drop("_u", "_r", "_n", "_want")


def blend(df: DataFrame, weight: Num, model: Num, base: Num, out: str = "blended") -> DataFrame:
    """weight x model + (1 - weight) x base; the base alone where the model is missing."""
    return df.withColumn(out, F.when(clean(model).isNull() | (col(weight) <= 0), col(base)).otherwise(col(weight) * col(model) + (F.lit(1.0) - col(weight)) * col(base)))


def blend_checks(df: DataFrame, weight: str, model: str, base: str, out: str = "blended") -> DataFrame:
    """Counts of rows that break the blend: outside its two values, changed at weight 0, not the model at weight 1, missing."""
    eps = 1e-9
    lo, hi = F.least(model, base), F.greatest(F.col(model), F.col(base))
    return df.agg(F.count_if(~F.col(out).between(lo - eps, hi + eps)).alias("n_outside"), F.count_if((F.col(weight) <= 0) & (F.abs(F.col(out) - F.col(base)) > eps)).alias("n_changed"), F.count_if((F.col(weight) >= 1) & (F.abs(F.col(out) - F.col(model)) > eps)).alias("n_not_model"), F.count_if(clean(out).isNull()).alias("n_missing"))


def principal_axis(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Angle (degrees) of the first principal axis of a 2-D cloud, and the standard deviations along and across it."""
    a, b, c = F.var_pop(x), F.covar_pop(x, y), F.var_pop(y)
    m = df.groupBy(*group).agg(a.alias("a"), b.alias("b"), c.alias("c"), F.corr(x, y).alias("corr"))
    root = F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, F.lit(2)) + F.col("b") * F.col("b"))
    mid = (F.col("a") + F.col("c")) / 2
    return m.select(*group, (F.degrees(F.atan2(F.col("b") * 2, F.col("a") - F.col("c"))) / 2).alias("angle"), F.sqrt(mid + root).alias("along"), F.sqrt(F.greatest(F.lit(0.0), mid - root)).alias("across"), "corr")

