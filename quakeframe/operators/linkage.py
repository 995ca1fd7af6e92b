"""Clusters of points by linkage: density clusters with a stability for each, and Ward's agglomeration.

Both go by boxes of space. For densities, a task takes what a box and its surroundings settle, and what hangs on the rest goes
on to a level of larger regions; for Ward's merges, it makes all that nothing outside its box can prevent, and other boxes
follow for what is left. Only what lies farther off than boxes look is searched by cells, at a scale that doubles: cells are
dealt to blocks of a bounded number of points, and a task compares two blocks, of which only each point's nearest goes on.
Rows of equal features are one point that counts several times.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakeframe.functions.numeric import clean
from quakeframe.operators.common import checked_broadcast, stored

#: Points of a block; a task holds the arrays of a batch of pairs of blocks.
BLOCK = 256
#: Clusters or points of a group that a task takes whole; larger groups are dealt to boxes of about so many.
LEFT = 32768
#: Boxes of a round at most; where there would be more, they are larger.
BOXES = 4096
#: Boxes whose rests go on as one at the next level of a hierarchy by density, and boxes whose points are looked up in it together.
FAN, PART = 16, 8
#: Clusters for each box that the driver takes to choose where boxes end.
SEEN = 128
#: Distances below this count as this, so that a density is finite.
LEAST = 1e-9
#: Features that cells are made of; a distance over some features is never above that over all.
CELL_FEATURES = 3


def _points(df: DataFrame, key: str, features: Sequence[str], group: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Stored tables: key, _g, x, id of every row with all features; and the points id, _g, x, n, a row for each different one, id its least key."""
    ok = F.lit(True)
    for f in features:
        ok = ok & clean(f).isNotNull()
    x = F.array(*[F.col(f).cast("double") + 0.0 for f in features])
    rows = df.filter(ok & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_key"), F.struct(*[F.col(c) for c in group], F.lit(0).alias("_")).alias("_g"), x.alias("x"))
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_g", "x")
    points = stored(rows.groupBy("_g", "x").agg(F.min("_key").alias("id"), F.count("*").alias("n")), "points")
    return stored(rows.join(points.select("_g", "x", "id"), ["_g", "x"]), "rows"), points


def _cell(scale: float, d: int) -> Column:
    return F.array(*[F.floor(F.get("x", F.lit(i)) / scale).cast("long") for i in range(min(d, CELL_FEATURES))]).alias("cell")


def _around(d: int) -> Column:
    """The cells that touch a cell, and the cell itself."""
    steps = itertools.product((-1, 0, 1), repeat=min(d, CELL_FEATURES))
    return F.expr("array(" + ", ".join("array(" + ", ".join(f"cell[{i}] + {o}L" for i, o in enumerate(step)) + ")" for step in steps) + ")")


def _blocks(df: DataFrame, scale: float, d: int, block: int) -> DataFrame:
    """_g, cell, heavy, part, low, high, ids, comps, xs, ws: a row of arrays for each block of a cell. Stored.

    Points of a component that fills over a block of a cell are dealt to blocks of their own, all others by component, so
    a block holds about ``block`` points whatever a cell holds.
    """
    at = df.withColumn("cell", _cell(scale, d))
    own = at.groupBy("_g", "cell", "comp").agg(F.count("*").alias("_n"))
    total = own.groupBy("_g", "cell").agg(F.sum(F.expr(f"if(_n <= {block}, _n, 0)")).alias("_light"))
    at = at.join(own, ["_g", "cell", "comp"]).join(total, ["_g", "cell"])
    part = F.expr(f"if(_n > {block}, pmod(xxhash64(id), cast(ceil(_n / {block}) as long)), pmod(xxhash64(comp), cast(ceil(_light / {block}) as long)))")
    rows = at.select("_g", "cell", F.expr(f"if(_n > {block}, comp, null)").alias("heavy"), part.alias("part"), "comp", F.struct("id", "comp", "w", "x").alias("p"))
    filed = rows.groupBy("_g", "cell", "heavy", "part").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.collect_list("p").alias("p"))
    return stored(filed.select("_g", "cell", "heavy", "part", "low", "high", F.col("p.id").alias("ids"), F.col("p.comp").alias("comps"), F.flatten("p.x").alias("xs"), F.col("p.w").alias("ws")), "blocks")


def _searched(queries: DataFrame, targets: DataFrame | None, scale: float, d: int, block: int, kernel: Callable, schema: str) -> DataFrame:
    """``kernel`` on every two blocks (queries, targets) whose cells touch; without targets the queries search among themselves.

    Both tables have id, comp, _g, x, w. Blocks of one and the same component are compared only where there are targets.
    """
    q = _blocks(queries, scale, d, block)
    t = q if targets is None else _blocks(targets, scale, d, block)
    name = ["_g", "cell", "heavy", "part"]
    probes = q.select("_g", F.struct(*name).alias("q"), F.col("low").alias("ql"), F.col("high").alias("qh"), F.explode(_around(d)).alias("cell"))
    pairs = probes.join(t.select(*name, "low", "high"), ["_g", "cell"])
    if targets is None:
        pairs = pairs.filter("not (ql = qh and low = high and ql = low)")
    of = lambda z, k: z.select(F.struct(*name).alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("ids", "comps", "xs", "ws")])
    both = pairs.select("q", F.struct(*name).alias("t")).join(of(q, "q"), "q").join(of(t, "t"), "t").drop("q", "t")
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                left, right = ((np.asarray(ids), np.asarray(comps), np.asarray(xs, dtype=float).reshape(len(ids), d), np.asarray(ws)) for ids, comps, xs, ws in (row[:4], row[4:]))
                yield kernel(left, right)

    return both.repartition(tasks, F.xxhash64("q_ids", "t_ids")).mapInPandas(run, schema)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        total += (a[:, i, None] - b[None, :, i]) ** 2
    return np.sqrt(total)


def core_distances(points: DataFrame, samples: int, scale: float, d: int, block: int = BLOCK, asked: DataFrame | None = None) -> DataFrame:
    """id, core: the distance to the ``samples``-th other row; the largest distance to any where there are fewer. Stored. Of those ``asked`` (id) only."""
    need = samples + 1
    everything = points.select("id", F.col("id").alias("comp"), "_g", "x", F.col("n").cast("double").alias("w"))
    groups = everything.groupBy("_g").agg(F.sum("w").alias("rows"))
    open_ = everything if asked is None else everything.join(asked, "id", "left_semi")
    open_ = stored(open_.join(checked_broadcast(groups), "_g").withColumn("need", F.least(F.lit(float(need)), "rows")), "open")
    done = None
    while not open_.isEmpty():
        core = stored(_reached(open_.withColumn("w", F.col("need")), everything, scale, d, block, need), "core")
        done = core if done is None else done.unionByName(core)
        open_ = stored(open_.join(core, "id", "left_anti"), "open")
        scale *= 2
    return stored(done, "core") if done is not None else points.select("id", F.lit(0.0).alias("core"))


def _reached(queries: DataFrame, targets: DataFrame, scale: float, d: int, block: int, most: int) -> DataFrame:
    """id, core: how far out the targets' weights add up to a query's ``w`` (``most`` at most), for queries that get there within the scale.

    The blocks that a block of queries meets follow it into its task one by one; the nearest ``most`` of each query are
    all that is kept of those before, and nothing but its core leaves the task.
    """
    q, t = _blocks(queries, scale, d, block), _blocks(targets, scale, d, block)
    probes = q.select("_g", F.get("ids", F.lit(0)).alias("q"), F.explode(_around(d)).alias("cell"))
    met = probes.join(t.select("_g", "cell", "xs", "ws"), ["_g", "cell"]).select("q", F.lit(None).cast("array<long>").alias("ids"), "xs", "ws")
    both = q.select(F.get("ids", F.lit(0)).alias("q"), "ids", "xs", "ws").unionByName(met)
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        ids = x = need = near = weight = None
        waiting: list[tuple] = []
        done: list[tuple] = []

        def settle() -> None:
            nonlocal near, weight
            if waiting:
                points, w = np.concatenate([p for p, _ in waiting]), np.concatenate([w for _, w in waiting])
                waiting.clear()
                near = np.concatenate([near, _distances(x, points)], axis=1)
                weight = np.concatenate([weight, np.broadcast_to(w, (len(x), len(w)))], axis=1)
                kept = np.argpartition(near, most - 1, axis=1)[:, :most]
                near, weight = np.take_along_axis(near, kept, 1), np.take_along_axis(weight, kept, 1)

        def finish() -> None:
            settle()
            order = np.argsort(near, axis=1, kind="stable")
            far, upto = np.take_along_axis(near, order, 1), np.cumsum(np.take_along_axis(weight, order, 1), axis=1)
            enough = (upto >= need[:, None]) & (far <= scale)
            k = enough.any(axis=1)
            done.append((ids[k], far[k, enough.argmax(axis=1)[k]]))

        def found() -> pd.DataFrame:
            out = pd.DataFrame({"id": np.concatenate([i for i, _ in done]), "core": np.concatenate([c for _, c in done])})
            done.clear()
            return out

        for batch in batches:
            for row in batch.itertuples(index=False):
                points, w = np.asarray(row.xs, dtype=float).reshape(-1, d), np.asarray(row.ws)
                if row.ids is not None:
                    if ids is not None:
                        finish()
                    ids, x, need = np.asarray(row.ids), points, w
                    near, weight = np.full((len(ids), most), np.inf), np.zeros((len(ids), most))
                    continue
                waiting.append((points, w))
                if sum(len(w) for _, w in waiting) >= 4 * block:
                    settle()
            if done:
                yield found()
        if ids is not None:
            finish()
            yield found()

    return both.repartition(tasks, "q").sortWithinPartitions("q", F.col("ids").isNull()).mapInPandas(run, "id long, core double")


def _roots(parents: DataFrame) -> DataFrame:
    """comp, root of comp, parent without cycles, by doubling; a parent that is no comp is a root. Stored."""
    now = stored(parents.select("comp", F.col("parent").alias("root")), "roots")
    while True:
        up = now.select(F.col("comp").alias("root"), F.col("root").alias("above"))
        after = stored(now.join(up, "root", "left").select("comp", F.coalesce("above", "root").alias("root"), (F.col("above").isNotNull() & (F.col("above") != F.col("root"))).alias("moved")), "roots")
        now = after.select("comp", "root")
        if after.filter("moved").isEmpty():
            return now


def neighbour_distance(df: DataFrame, key: str, features: Sequence[str], samples: int, group: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """``key``, ``group``, core: how far the ``samples``-th other row of the group is (the last one where there are fewer).

    Rows with a null in a feature or key are left out.
    """
    rows, points = _points(df, key, features, group)
    names = [F.col(f"_g.{c}").alias(c) for c in group]
    if points.isEmpty():
        return rows.select(F.col("_key").alias(key), *names, F.lit(0.0).alias("core"))
    now = _grouped(points)[1]
    core = _cores(now, samples, len(features), block, _cut(now, len(features))).select("id", "core")
    return rows.join(core, "id").select(F.col("_key").alias(key), *names, "core")


def spanning_tree(points: DataFrame, scale: float, d: int, block: int, comps: DataFrame) -> DataFrame:
    """d, a, b (a < b): what the least spanning tree of each group under max(distance, core of a, core of b), ties by (a, b), has between ``comps`` (id, comp). Stored.

    Boruvka's rounds: every component takes its least edge out, among those not above the scale; where none has one, the
    scale doubles, until each group is one component. ``points`` has id, _g, x and core.
    """
    labels = stored(points.select("id").join(comps, "id"), "labels")
    groups = points.select("_g").distinct().count()
    tree = points.select(F.lit(0.0).alias("d"), F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    while labels.select("comp").distinct().count() > groups:

        def least(left: tuple, right: tuple) -> pd.DataFrame:
            order = np.argsort(right[0])
            ids, comps, core = right[0][order], right[1][order], right[3][order]
            dist = np.maximum(np.maximum(_distances(left[2], right[2][order]), left[3][:, None]), core[None, :])
            dist[left[1][:, None] == comps[None, :]] = np.inf
            # of equal ones the partner of the smallest id makes the smallest pair, on either side of a point's own
            j = dist.argmin(axis=1)
            low = dist[np.arange(len(dist)), j]
            k = low <= scale
            out = pd.DataFrame({"comp": left[1][k], "d": low[k], "a": np.minimum(left[0], ids[j])[k], "b": np.maximum(left[0], ids[j])[k], "to": comps[j][k]})
            return out.sort_values(["comp", "d", "a", "b"]).drop_duplicates("comp")

        live = points.filter(F.col("core") <= scale).join(labels, "id").select("id", "comp", "_g", "x", F.col("core").alias("w"))
        best = _searched(live, None, scale, d, block, least, "comp long, d double, a long, b long, to long").groupBy("comp").agg(F.min(F.struct("d", "a", "b", "to")).alias("e")).select("comp", "e.*")
        best = stored(best, "edges-out")
        if best.isEmpty():
            scale *= 2
            continue
        tree = stored(tree.unionByName(best.select("d", "a", "b")).distinct(), "tree")
        back = best.select(F.col("comp").alias("to"), F.col("to").alias("back"))
        parents = best.join(back, "to", "left").filter(F.col("back").isNull() | (F.col("back") != F.col("comp")) | (F.col("comp") > F.col("to"))).select("comp", F.col("to").alias("parent"))
        roots = _roots(parents)
        labels = stored(labels.join(roots, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")), "labels")
    return tree


def _grouped(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored tables: _g, gid (its least id), rows of each group; and id, gid, x, n, rows of each point."""
    groups = stored(points.groupBy("_g").agg(F.min("id").alias("gid"), F.sum("n").alias("rows")), "groups")
    return groups, stored(points.join(checked_broadcast(groups), "_g").select("id", "gid", "x", "n", "rows"), "filed")


def _cut(now: DataFrame, d: int) -> tuple[dict[int, int], dict[int, tuple], dict[tuple[int, int], tuple]]:
    """Points of each group of over ``LEFT``, and the boxes (of ``LEFT`` at least, ``BOXES`` at most) that these are cut into."""
    counts = {r["gid"]: r["count"] for r in now.groupBy("gid").count().filter(F.col("count") > LEFT).collect()}
    left = max(LEFT, sum(counts.values()) // BOXES)
    large = {g: n for g, n in counts.items() if n > left}
    trees, walls = _boxes(now, large, left, d) if large else ({}, {})
    return {g: large[g] for g in trees}, trees, walls


def _near_boxes(tree: tuple | int, x: np.ndarray, reach: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Positions, box: which of the points ``at`` are in a box or within their reach of it along each axis."""
    if isinstance(tree, int):
        return [(at, tree)]
    axis, where, below, above = tree
    v, r = x[at, axis], reach[at]
    return _near_boxes(below, x, reach, at[v - r < where]) + _near_boxes(above, x, reach, at[v + r >= where])


def _spread(df: DataFrame, trees: dict[int, tuple], d: int, reach: dict[int, float] | str | None = None) -> DataFrame:
    """``df`` (gid, x, ...) with box and home: a row for the box that a point is in, its home, and one for each within ``reach`` (by group, or a column)."""
    if not trees:
        return df.withColumns({"box": F.lit(0), "home": F.lit(0)})

    def dealt(batches):
        for batch in batches:
            gid, x = batch["gid"].to_numpy(), batch["x"].flatten().to_numpy().reshape(-1, d)
            home, at, box = np.zeros(len(gid), dtype=np.int32), [np.flatnonzero(~np.isin(gid, list(trees)))], [0]
            for g in set(np.unique(gid).tolist()) & trees.keys():
                k = np.flatnonzero(gid == g)
                home[k] = _box_of(trees[g], x[k])
                far = batch[reach].to_numpy()[k] if isinstance(reach, str) else np.full(len(k), reach[g] if reach else 0.0)
                for i, b in _near_boxes(trees[g], x[k], far * (1 + 1e-9), np.arange(len(k))):
                    at.append(k[i])
                    box.append(b)
            take = np.concatenate(at)
            boxes = np.repeat(np.array(box, dtype=np.int32), [len(k) for k in at])
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(take)).columns, pa.array(boxes), pa.array(home[take])], names=[*batch.schema.names, "box", "home"])

    return df.mapInArrow(dealt, T.StructType([*df.schema.fields, T.StructField("box", T.IntegerType()), T.StructField("home", T.IntegerType())]))


def _tasks(df: DataFrame, boxes: int, to: str = "box") -> DataFrame:
    """``df`` dealt by group and box to as many tasks as there are boxes: to Spark they look too small for a task each."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), boxes), "gid", to)


def _room(x: np.ndarray, walls: tuple | None) -> np.ndarray:
    """How far the nearest wall of a point's box is."""
    return np.minimum(x - walls[0], walls[1] - x).min(axis=1) if walls else np.full(len(x), np.inf)


def _fine(x: np.ndarray, scale: float, most: int) -> float:
    """``scale``, halved until no cell holds over ``most`` points."""
    while scale > LEAST and np.unique(np.floor(x[:, :CELL_FEATURES] / scale), axis=0, return_counts=True)[1].max() > most:
        scale /= 2
    return max(scale, LEAST)


def _width(walls: dict[tuple[int, int], tuple], g: int) -> float:
    """A width that few boxes of a group are thinner than."""
    wide = [float(w) for at, (low, high) in walls.items() if at[0] == g for w in high - low if np.isfinite(w)]
    return float(np.quantile(wide, 0.1)) if wide else np.inf


def _near(x: np.ndarray, of: np.ndarray, scale: float, comp: np.ndarray | None = None):
    """Arrays i, j, distance of pairs up to ``scale`` apart, a batch at a time: i of ``of``, j any. With ``comp`` each pair of different ones once."""
    f = x[:, :CELL_FEATURES]
    wide = np.maximum(scale * (1 + 1e-9), np.ptp(f, axis=0) / 2**20)
    cell = np.floor((f - f.min(axis=0)) / wide).astype(np.int64) + 1
    radix = np.concatenate([[1], np.cumprod(cell.max(axis=0)[:-1] + 2)])
    key = cell @ radix
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    cells, count = key[order[first]], np.diff(first, append=len(x))
    if comp is not None:
        low, high = np.minimum.reduceat(comp[order], first), np.maximum.reduceat(comp[order], first)
    for step in itertools.product((-1, 0, 1), repeat=f.shape[1]):
        by = int(np.dot(step, radix))
        if comp is not None and (by < 0 or by == 0 and any(step)):
            continue
        at = np.minimum(np.searchsorted(cells, key[of] + by), len(cells) - 1)
        k = cells[at] == key[of] + by
        if comp is not None:
            k &= (low[at] != high[at]) | (low[at] != comp[of])
        i, start, many = of[k], first[at[k]], count[at[k]]
        upto = np.cumsum(many)
        for part in np.split(np.arange(len(i)), np.searchsorted(upto, np.arange(2**19, upto[-1], 2**19)) if len(i) else []):
            if not len(part):
                continue
            m = many[part]
            left = np.repeat(i[part], m)
            right = order[np.repeat(start[part] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
            if comp is not None:
                apart = (comp[left] != comp[right]) & ((left < right) if by == 0 else True)
                left, right = left[apart], right[apart]
            total = np.zeros(len(left))
            for axis in range(x.shape[1]):
                total += (x[left, axis] - x[right, axis]) ** 2
            dist = np.sqrt(total)
            close = dist <= scale
            yield left[close], right[close], dist[close]


def _kth(x: np.ndarray, w: np.ndarray, of: np.ndarray, need: float, room: np.ndarray) -> np.ndarray:
    """How far out of each point ``of`` the weights add up to ``need``; NaN where that is farther than its ``room``."""
    core = np.full(len(of), np.nan)
    wide = np.ptp(x[:, :CELL_FEATURES], axis=0)
    wide = wide[wide > 0]
    scale = float((np.prod(wide) / len(x) * need / 2) ** (1 / len(wide))) if len(wide) else 1.0
    scale = _fine(x, scale, 64 + 8 * int(need))
    open_ = np.arange(len(of))
    while len(open_):
        back = np.full(len(x), -1)
        back[of[open_]] = open_
        found = list(_near(x, of[open_], scale))
        i, j, dist = (np.concatenate(c) for c in zip(*found, strict=True))
        i = back[i]
        order = np.lexsort((dist, i))
        i, dist, sums = i[order], dist[order], np.cumsum(w[j[order]])
        first = np.flatnonzero(np.diff(i, prepend=-1))
        before = np.repeat(np.where(first > 0, sums[first - 1], 0.0), np.diff(first, append=len(i)))
        enough = np.flatnonzero(sums - before >= need)
        enough = enough[np.flatnonzero(np.diff(i[enough], prepend=-1))]
        core[i[enough]] = dist[enough]
        open_ = open_[np.isnan(core[open_]) & (room[open_] > scale)]
        scale *= 1.5
    core[core > room] = np.nan
    return core


def _cores(now: DataFrame, samples: int, d: int, block: int, cut: tuple) -> DataFrame:
    """id, gid, x, n, box, core: the distance to the ``samples``-th other row; the largest to any where there are fewer. Stored.

    A task searches a box and what lies around it. Points that need to look farther are searched among all, by cells.
    """
    large, trees, walls = cut
    need = samples + 1
    ranges = {r["gid"]: r for r in now.filter(F.col("gid").isin(list(large))).groupBy("gid").agg(*[(F.max(F.get("x", F.lit(i))) - F.min(F.get("x", F.lit(i)))).alias(f"r{i}") for i in range(d)]).collect()} if large else {}
    around = {}
    for g, n in large.items():
        wide = [w for w in (ranges[g][f"r{i}"] for i in range(min(d, CELL_FEATURES))) if w > 0]
        around[g] = min(2 * float((np.prod(wide) / n * need / 2) ** (1 / len(wide))), _width(walls, g) / 2)

    def searched(key, table):
        gid, box = (k.as_py() for k in key)
        table = table.take(pa.array(np.argsort(table["id"].to_numpy())))
        x = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, d)
        own = np.flatnonzero(table["home"].to_numpy() == box)
        room = (_room(x[own], walls.get((gid, box))) + around.get(gid, np.inf)) * (1 - 1e-9)
        core = _kth(x, table["n"].to_numpy().astype(float), own, min(need, table["rows"][0].as_py()), room) if len(own) else np.empty(0)
        out = table.take(pa.array(own)).select(["id", "gid", "x", "n", "rows", "box"])
        return out.append_column("core", pa.array(core, mask=np.isnan(core)))

    filed = _tasks(_spread(now, trees, d, around), len(walls))
    found = stored(filed.groupBy("gid", "box").applyInArrow(searched, "id long, gid long, x array<double>, n long, rows long, box int, core double"), "cores")
    far = found.filter("core is null")
    if not large or far.isEmpty():
        return found
    rest = core_distances(found.withColumnRenamed("gid", "_g"), samples, max(LEAST, min(around.values())), d, block, far.select("id"))
    return stored(found.withColumnRenamed("core", "_near").join(rest, "id", "left").select("id", "gid", "x", "n", "rows", "box", F.coalesce("_near", "core").alias("core")), "cores")


def _forest(x: np.ndarray, core: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j (i < j), weight in ascending order (ties by i, j): the least spanning forest under max(distance, cores), of edges up to ``reach``.

    At a scale that grows, all pairs of different components that it allows are the edges that can come next.
    """
    n = len(x)
    comp, out = np.arange(n), []
    scale = min(reach, float(np.quantile(core, 0.1)) or float(np.max(core)) or float(np.ptp(x, axis=0).max()) or 1.0)
    scale = _fine(x, scale, 64)
    while True:
        live = np.flatnonzero(core <= scale)
        parts = []
        for i, j, dist in _near(x[live], np.arange(len(live)), scale, comp[live]) if len(live) else ():
            i, j = live[i], live[j]
            w = np.maximum(np.maximum(dist, core[i]), core[j])
            parts.append((np.minimum(i, j), np.maximum(i, j), w))
        if parts:
            i, j, w = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((j, i, w))
            i, j, w = i[order], j[order], w[order]
            kept, comp = _taken(comp, i, j)
            out.append((i[kept], j[kept], w[kept]))
        if scale >= reach or (comp == comp[0]).all():
            break
        scale = min(reach, scale * 1.4142)
    if not out:
        return np.empty(0, dtype=int), np.empty(0, dtype=int), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _taken(comp: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which edges, given in ascending order, a least spanning forest over components takes, and the components then."""
    m, e, kept = len(i), np.arange(len(i)), []
    while True:
        a, b = comp[i[e]], comp[j[e]]
        k = a != b
        e, a, b = e[k], a[k], b[k]
        if not len(e):
            return np.sort(np.concatenate(kept)) if kept else e, comp
        first, other = np.full(len(comp), m), np.full(len(comp), m)
        first[a[::-1]], other[b[::-1]] = e[::-1], e[::-1]  # of several the last one written stays: the least
        first = np.minimum(first, other)
        ends = np.flatnonzero(first < m)
        edge = first[ends]
        kept.append(np.unique(edge))
        top = np.arange(len(comp))
        top[ends] = np.where(comp[i[edge]] == ends, comp[j[edge]], comp[i[edge]])
        back = ends[(top[top[ends]] == ends) & (ends < top[ends])]
        top[back] = back
        while (top[top] != top).any():
            top = top[top]
        comp = top[comp]


#: Rows of a level of a hierarchy. 0: vertex u went into v, and with the edge (d, a, b) into the cluster ``leaf`` or that of v; 1: the
#: edge joins the clusters ``leaf`` and ``other``, or those of u and v; 2: vertex u of n rows is left; 3: so is the edge, between u and v,
#: of which those outside are null, in boxes p and q; 4: a cluster ``leaf`` is born.
_LEVEL = {"kind": pa.int32(), "gid": pa.int64(), "box": pa.int32(), "d": pa.float64(), "a": pa.int64(), "b": pa.int64(), "u": pa.int64(), "v": pa.int64(), "p": pa.int32(), "q": pa.int32(), "n": pa.int64(), "leaf": pa.int64(), "other": pa.int64(), "x": pa.list_(pa.float64())}
_LEVEL_SQL = "kind int, gid long, box int, d double, a long, b long, u long, v long, p int, q int, n long, leaf long, other long, x array<double>"


def _contracted(ids: list[int], size: list[int], leaf: list[int | None], u: list[int], v: list[int], least: int) -> tuple:
    """What is certain of single linkage in a region, given vertices and, in ascending order, edges between their positions (-1: outside).

    A component is open once an edge has left it. Others are whole: a vertex each, whose merges are final. A whole one goes
    into an open one by an edge that is its own least; if the open one has ``least_size`` rows here, it has them whatever is
    outside. Between open components, and where the size of an open one is not known, the edge and both vertices are kept.
    Returns into, born and cluster by vertex (born: the edge's position, -1 none), the joins of clusters, edges kept, clusters born.
    """
    n = len(ids)
    had = np.array([k is not None for k in leaf], dtype=bool)
    whole, into, up = list(range(n)), list(range(n)), list(range(n))
    count, opened, born, cluster = size.copy(), [False] * n, [-1] * n, [None] * n
    joins, kept, fresh = [], [], []

    def find(top: list[int], k: int) -> int:
        while top[k] != k:
            top[k] = k = top[top[k]]
        return k

    for e, (p, q) in enumerate(zip(u, v, strict=True)):
        if p < 0 or q < 0:
            opened[find(whole, max(p, q))] = True
            kept.append(e)
            continue
        a, b = find(whole, p), find(whole, q)
        if a == b:
            continue
        if opened[a]:
            p, q, a, b = q, p, b, a
        if opened[a] or (opened[b] and count[b] < least):
            kept.append(e)
        else:  # a is whole
            x, y = find(into, p), find(into, q)
            if leaf[x] is not None and (opened[b] or leaf[y] is not None):
                joins.append((e, leaf[x], x, leaf[y], y))
            elif leaf[x] is not None:
                x, y = y, x
                born[x], cluster[x] = e, leaf[y]
            elif opened[b] or leaf[y] is not None:
                born[x], cluster[x] = e, leaf[y]
            else:
                size[y] += size[x]
                if size[y] >= least:
                    born[x] = born[y] = e
                    leaf[y] = cluster[x] = cluster[y] = ids[y]
                    fresh.append(ids[y])
            into[x] = up[x] = y
        whole[a] = b
        count[b] += count[a]
        opened[b] = opened[a] or opened[b]
    at = np.arange(n)
    up, settled = np.array(up, dtype=int), had | (np.array(born, dtype=int) >= 0)
    while (move := ~settled[at] & (up[at] != at)).any():
        at[move] = up[at[move]]
    return [find(into, k) for k in range(n)], [born[k] for k in at], [cluster[k] for k in at], joins, kept, fresh


def _level(gid: int, box: int, ids: np.ndarray, size: np.ndarray, leaf: list, edges: tuple, least: int, x: np.ndarray | None = None) -> pa.Table:
    """Rows of a region's level. Edges are d, a, b, u, v, p, q in ascending order; ``x`` for points, that have no clusters yet."""
    d, a, b, u, v, p, q = edges
    names, rows, before = ids.tolist(), size.tolist(), leaf.copy()
    heavy = [] if x is None else np.flatnonzero(size >= least).tolist()
    for k in heavy:
        leaf[k] = names[k]
    start = leaf.copy()
    into, born, cluster, joins, kept, fresh = _contracted(names, rows, leaf, u.tolist(), v.tolist(), least)
    born = np.array(born, dtype=int)
    when = born >= 0
    first = np.array([s is not None and o is None for s, o in zip(start, before, strict=True)], dtype=bool)
    key = lambda c, none: pa.array(np.where(when, c[born] if len(c) else none, none), mask=~(when | first))
    into, roots = np.array(into, dtype=int), np.unique(np.array(into, dtype=int))
    of = [s if s is not None else c for s, c in zip(start, cluster, strict=True)]
    j = np.array([t[0] for t in joins], dtype=int)
    kept = np.array(kept, dtype=int)
    ends = [(c[kept], np.where(c[kept] >= 0, into[c[kept]], 0)) for c in (u, v)]
    parts = [
        (0, len(ids), {"d": key(d, 0.0), "a": key(a, -1), "b": key(b, -1), "u": ids, "v": ids[into], "n": size, "leaf": of} | ({} if x is None else {"x": pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())})),
        (1, len(j), {"d": d[j], "a": a[j], "b": b[j], "leaf": [t[1] for t in joins], "u": ids[[t[2] for t in joins]] if joins else [], "other": [t[3] for t in joins], "v": ids[[t[4] for t in joins]] if joins else []}),
        (2, len(roots), {"u": ids[roots], "n": [rows[k] for k in roots], "leaf": [leaf[k] for k in roots]}),
        (3, len(kept), {"d": d[kept], "a": a[kept], "b": b[kept], "p": p[kept], "q": q[kept], **{c: pa.array(ids[to] if len(ids) else to, mask=at < 0) for c, (at, to) in zip("uv", ends, strict=True)}}),
        (4, len(fresh) + len(heavy), {"leaf": fresh + [names[k] for k in heavy]}),
    ]
    tables = []
    for kind, n, columns in parts:
        columns |= {"kind": np.full(n, kind), "gid": np.full(n, gid), "box": np.full(n, box)}
        tables.append(pa.table({c: (columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], type=t)).cast(t) if c in columns else pa.nulls(n, t) for c, t in _LEVEL.items()}))
    return pa.concat_tables(tables).combine_chunks()


def _first_level(filed: DataFrame, cut: tuple, reach: dict[int, float], d: int, least: int) -> DataFrame:
    """Stored rows of the first level: a task takes the least spanning forest of a box and of what is within ``reach``, and contracts the box.

    An edge of the whole tree is one of every such forest that sees both its ends, so one from a box to another that only
    one of both finds is none; until the next level it counts as leaving.
    """
    _, trees, walls = cut

    def contracted(key, table):
        gid, box = (k.as_py() for k in key)
        table = table.take(pa.array(np.argsort(table["id"].to_numpy())))
        ids, home, size = (table[c].to_numpy() for c in ("id", "home", "n"))
        x = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, d)
        i, j, w = _forest(x, table["core"].to_numpy(), reach.get(gid, np.inf))
        k = (home[i] == box) | (home[j] == box)
        i, j, w = i[k], j[k], w[k]
        own = np.flatnonzero(home == box)
        if not len(own):
            return pa.table({c: pa.nulls(0, t) for c, t in _LEVEL.items()})
        at = np.full(len(ids), -1)
        at[own] = np.arange(len(own))
        order = np.lexsort((j, i, w))
        i, j, w = i[order], j[order], w[order]
        return _level(gid, box, ids[own], size[own], [None] * len(own), (w, ids[i], ids[j], at[i], at[j], home[i], home[j]), least, x[own])

    near = _tasks(_spread(filed.select("id", "gid", "x", "n", "core"), trees, d, reach), len(walls))
    return stored(near.groupBy("gid", "box").applyInArrow(contracted, _LEVEL_SQL), "level")


def _next_level(rows: DataFrame, width: int, boxes: int, least: int) -> DataFrame:
    """Stored rows of the next level, of what ``FAN`` boxes of the level before have left; of the first one ``width`` are one of it, in all ``boxes``."""

    def contracted(key, table):
        gid, box = (k.as_py() for k in key)
        kind = table["kind"].to_numpy()
        left = table.filter(pa.array(kind == 2))
        left = left.take(pa.array(np.argsort(left["u"].to_numpy())))
        edges = table.filter(pa.array(kind == 3))
        ids = left["u"].to_numpy()
        d, a, b, p, q = (edges[c].to_numpy() for c in ("d", "a", "b", "p", "q"))
        ends = [np.where(edges[c].is_null().to_numpy(), -1, np.searchsorted(ids, edges[c].fill_null(0).to_numpy())) for c in ("u", "v")]
        order = np.lexsort((b, a, d))
        d, a, b, p, q = (c[order] for c in (d, a, b, p, q))
        first = np.flatnonzero(np.diff(a, prepend=a[:1] - 1) | np.diff(b, prepend=b[:1] - 1))
        u, v = (np.maximum.reduceat(c[order], first) if len(first) else c for c in ends)
        d, a, b, p, q = (c[first] for c in (d, a, b, p, q))
        # a lone side whose other box is here too: that box found a shorter way
        k = ((u >= 0) | (p // width != box)) & ((v >= 0) | (q // width != box))
        return _level(gid, box, ids, left["n"].to_numpy(), left["leaf"].to_pylist(), tuple(c[k] for c in (d, a, b, u, v, p, q)), least)

    some = rows.filter("kind in (2, 3)").withColumn("box", F.expr(f"box div {FAN}").cast("int")).drop("x", "other")
    return stored(_tasks(some, boxes).groupBy("gid", "box").applyInArrow(contracted, _LEVEL_SQL), "level")


def _hierarchy(filed: DataFrame, cut: tuple, d: int, least: int, block: int) -> list[DataFrame]:
    """Rows of all levels of single linkage under max(distance, cores); after the last one every group is one component."""
    large, _, walls = cut
    reach = {}
    if large:
        of = filed.filter(F.col("gid").isin(list(large))).groupBy("gid").agg(F.max("core").alias("most"), F.percentile_approx("core", 0.99).alias("many"))
        for r in of.collect():
            reach[r["gid"]] = max(LEAST, min(1.5 * min(r["most"], 4 * r["many"]), _width(walls, r["gid"]) / 2))
    levels = [_first_level(filed, cut, reach, d, least)]
    boxes, width = max([b + 1 for _, b in walls], default=1), 1
    while boxes > 1:
        boxes, width = -(-boxes // FAN), width * FAN
        levels.append(_next_level(levels[-1], width, boxes * len(large), least))
    apart = levels[-1].filter("kind = 2").groupBy("gid").count().filter("count > 1")
    if apart.isEmpty():
        return levels
    # what is farther apart than the reach: longer edges come after all those above, in one more level
    comps = levels[0].filter("kind = 0").select(F.col("u").alias("id"), "v")
    for level in levels[1:]:
        comps = comps.join(level.filter("kind = 0").select(F.col("u").alias("v"), F.col("v").alias("_v")), "v").select("id", F.col("_v").alias("v"))
    comps = stored(comps.withColumnRenamed("v", "comp"), "components")
    points = filed.join(apart.select("gid"), "gid", "left_semi").withColumnRenamed("gid", "_g")
    longer = spanning_tree(points, max(reach.values()), d, block, comps)
    ends = [comps.select(F.col("id").alias(of), F.col("comp").alias(to)) for of, to in ("au", "bv")]
    longer = longer.join(ends[0], "a").join(ends[1], "b").join(filed.select(F.col("id").alias("a"), "gid"), "a")
    named = {"kind": F.lit(3), "box": F.lit(0), "p": F.lit(0), "q": F.lit(0)}
    empty = {c: F.lit(None) for c in ("n", "leaf", "other", "x")}
    more = levels[-1].filter("kind = 2").unionByName(longer.withColumns(named | empty).select(*_LEVEL))
    return [*levels, _next_level(more, width, 1, least)]


def _resolved(levels: list[DataFrame]) -> list[DataFrame]:
    """For each level but the first u, and after all levels: the cluster it came into (leaf), with the edge (d, a, b) if that was not known below. Stored."""
    out: list[DataFrame] = []
    for level in reversed(levels[1:]):
        now = level.filter("kind = 0").select("u", "v", "leaf", "d", "a", "b")
        now = _came_into(now, "v", out[0], "leaf", key=True) if out else now
        out.insert(0, stored(now.drop("v"), "resolved"))
    return out


def _came_into(df: DataFrame, to: str, above: DataFrame, leaf: str, key: bool = False) -> DataFrame:
    """``df`` with ``leaf``, where it was null, that of the vertex ``to`` in ``above``; with ``key`` also the edge (d, a, b) if that was null."""
    above = above.select(F.col("u").alias(to), F.col("leaf").alias("_leaf"), *[F.col(c).alias(f"_{c}") for c in "dab"])
    known, open_ = df.filter(F.col(leaf).isNotNull()), df.filter(F.col(leaf).isNull()).join(above, to, "left")
    new = {leaf: F.col("_leaf")} | ({c: F.when(F.col("d").isNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in "dab"} if key else {})
    return known.unionByName(open_.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns]))


def _skeleton(key: tuple, table: pa.Table) -> pa.Table:
    """A row of a group: its clusters of least size (leaf), and by node (a leaf, then in order the edges that join clusters) the parent."""
    joins = table.filter(table["other"].is_valid())
    d, a, b = (joins[c].to_numpy() for c in "dab")
    order = np.lexsort((b, a, d))
    leaf = np.sort(table.filter(table["other"].is_null())["leaf"].to_numpy())
    ends = [np.searchsorted(leaf, joins[c].to_numpy())[order].tolist() for c in ("leaf", "other")]
    n = len(leaf)
    top, node, parent = list(range(n)), list(range(n)), [-1] * (n + len(order))

    def find(k: int) -> int:
        while top[k] != k:
            top[k] = k = top[top[k]]
        return k

    for m, (u, v) in enumerate(zip(*ends, strict=True), n):
        u, v = find(u), find(v)
        parent[node[u]] = parent[node[v]] = m
        top[u], node[v] = v, m
    return pa.table({"gid": [key[0].as_py()], "leaves": [leaf], "parent": pa.array([parent], type=pa.list_(pa.int32())), "js": [d[order]], "as": [a[order]], "bs": [b[order]]})


def _nodes(table: pa.Table, leaf: np.ndarray, key: tuple) -> np.ndarray:
    """The node of each row: the last one above its leaf whose edge comes before the row's (d, a, b)."""
    leaves, parent, *edges = (table[c].combine_chunks().flatten().to_numpy() for c in ("leaves", "parent", "js", "as", "bs"))
    n = len(edges[0])
    order = np.lexsort([np.concatenate(c) for c in zip(edges, key, strict=True)][::-1])
    before = np.empty(len(order), dtype=int)
    before[order] = np.cumsum(order < n)
    last = len(leaves) + before[n:]  # nodes from here on come after the row
    none = len(parent)
    lift = [np.append(np.where(parent < 0, none, parent), none)]
    while (lift[-1] < none).any():
        lift.append(lift[-1][lift[-1]])
    at = np.searchsorted(leaves, leaf)
    for up in reversed(lift):
        at = np.where(up[at] < last, up[at], at)
    return at


def _chosen(key: tuple, table: pa.Table, own: pa.Table) -> pa.Table:
    """node, label (within the group), most, clusters: of the nodes in clusters, by excess of mass."""
    gid = key[0].as_py()
    if not len(table):
        return pa.table({"gid": pa.nulls(0, pa.int64()), "node": pa.nulls(0, pa.int32()), "label": pa.nulls(0, pa.int32()), "most": pa.nulls(0, pa.float64()), "clusters": pa.nulls(0, pa.int32())})
    leaves, parent, edge = (table[c].combine_chunks().flatten().to_numpy() for c in ("leaves", "parent", "js"))
    n = len(parent)
    node = own["node"].to_numpy()
    mine = {c: np.zeros(n) for c in ("n", "s", "most")} | {"least": np.full(n, np.iinfo(np.int64).max)}
    for c, of in mine.items():
        of[node] = own[c].to_numpy()
    split = np.concatenate([np.zeros(len(leaves)), 1 / np.maximum(edge, LEAST)])
    birth = np.where(parent >= 0, split[parent], 0.0).tolist()
    most = np.maximum(split, mine["most"])
    size, s, least, split, parent = mine["n"].tolist(), mine["s"].tolist(), mine["least"].tolist(), split.tolist(), parent.tolist()
    count, under, chosen = [0.0] * n, [0.0] * n, [False] * n
    for k in range(n):  # children come before parents
        stability = s[k] - size[k] * birth[k] + count[k] * (split[k] - birth[k])
        chosen[k] = parent[k] >= 0 and not (k >= len(leaves) and under[k] > stability)
        if parent[k] >= 0:
            up = parent[k]
            count[up] += count[k] + size[k]
            under[up] += stability if chosen[k] else under[k]
            least[up] = min(least[up], least[k])
    cluster = [-1] * n
    for k in reversed(range(n)):  # parents first: the highest chosen one holds all below it
        above = cluster[parent[k]] if parent[k] >= 0 else -1
        cluster[k] = above if above >= 0 else k if chosen[k] else -1
    cluster = np.array(cluster)
    taken = np.unique(cluster[cluster >= 0])
    number = np.empty(len(taken), dtype=np.int32)
    number[np.argsort(np.array(least)[taken])] = np.arange(len(taken))
    k = np.flatnonzero(cluster >= 0)
    label = number[np.searchsorted(taken, cluster[k])]
    return pa.table({"gid": np.full(len(k), gid), "node": k.astype(np.int32), "label": label, "most": most[cluster[k]], "clusters": np.full(len(k), len(taken), dtype=np.int32)})


def _nearest(queries: DataFrame, centres: DataFrame, cut: tuple, d: int) -> DataFrame:
    """id, nearest: the label of the nearest centre (gid, label, c) of each query's (id, gid, x) group, ties the least; none where the group has none.

    A task takes the queries of a box with the centres in and around it; queries for which that is not enough go to all boxes
    within the distance found.
    """
    large, trees, walls = cut
    around = {g: _width(walls, g) for g in large}
    around = {g: w if np.isfinite(w) else 0.0 for g, w in around.items()}
    queries = queries.join(centres.select("gid").distinct(), "gid", "left_semi")
    schema = "id long, gid long, x array<double>, gap double, label int, far boolean"

    def compared(key, asked, known):
        gid, box = (k.as_py() for k in key)
        asked, known = (t.take(pa.array(np.argsort(t[c].to_numpy()))) for t, c in ((asked, "id"), (known, "label")))
        n = len(asked)
        x, c = (t["x"].combine_chunks().flatten().to_numpy().reshape(-1, d) if len(t) else np.empty((0, d)) for t in (asked, known))
        gap, label = np.full(n, np.inf), np.full(n, -1)
        for k in range(0, n if len(c) else 0, max(1, 2**20 // max(1, len(c)))):
            part = slice(k, k + max(1, 2**20 // len(c)))
            total = np.zeros((len(x[part]), len(c)))
            for axis in range(d):
                total += (x[part, axis, None] - c[None, :, axis]) ** 2
            at = total.argmin(axis=1)
            gap[part], label[part] = total[np.arange(len(at)), at], known["label"].to_numpy()[at]
        far = np.sqrt(gap) >= (_room(x, walls.get((gid, box))) + around.get(gid, np.inf)) * (1 - 1e-9) if (gid, box) in walls else np.zeros(n, dtype=bool)
        return pa.table({"id": asked["id"], "gid": asked["gid"], "x": asked["x"], "gap": gap, "label": pa.array(label, type=pa.int32()), "far": far}).select(["id", "gid", "x", "gap", "label", "far"])

    def search(asked: DataFrame, known: DataFrame) -> DataFrame:
        return asked.groupBy("gid", "box").cogroup(known.groupBy("gid", "box")).applyInArrow(compared, schema)

    at = centres.select("gid", "label", F.col("c").alias("x"))
    found = search(queries.select("id", "gid", "x", "box"), _spread(at, trees, d, around).drop("home"))
    if not trees:
        return found.select("id", F.col("label").alias("nearest"))
    found = stored(found, "nearest")
    far = found.filter("far").withColumn("reach", F.col("gap"))
    if far.isEmpty():
        return found.select("id", F.col("label").alias("nearest"))
    far = far.withColumn("reach", F.sqrt("gap")).select("id", "gid", "x", "reach")
    again = search(_spread(far, trees, d, "reach").select("id", "gid", "x", "box"), _spread(at, trees, d).drop("home"))
    again = again.filter("label >= 0").groupBy("id").agg(F.min(F.struct("gap", "label"))["label"].alias("nearest"))
    return found.filter("not far").select("id", F.col("label").alias("nearest")).unionByName(again)


def density_clusters(df: DataFrame, key: str, features: Sequence[str], group: Sequence[str] = (), least_size: int | None = None, samples: int | None = None, block: int = BLOCK) -> DataFrame:
    """``key``, ``group``, label, probability, nearest: density clusters of each group's rows by excess of mass.

    A row's core is the distance to its ``samples``-th other row; two rows are as far apart as the largest of their cores
    and their distance. Clusters are what the spanning tree under it falls into when edges go, largest first, parts of
    under ``least_size`` rows aside; those of the largest stability are taken, never a whole group. Labels are numbered by
    group and smallest key; -1 is noise, and ``nearest`` names the cluster with the nearest mean then (-1 where the group
    has none). Rows with a null in a feature or key are left out; keys must be whole numbers and differ.
    By default ``least_size`` is 50 or 0.05 % of all rows. A group's tree of clusters, one for each join of two parts that
    have the size, is settled in a task; its points are not.
    """
    rows, points = _points(df, key, features, group)
    total = rows.count()
    least_size = least_size or max(50, round(total * 0.0005))
    samples = samples or max(10, least_size // 5)
    names = [F.col(f"_g.{c}").alias(c) for c in group]
    if not total:
        return rows.select(F.col("_key").alias(key), *names, F.lit(-1).alias("label"), F.lit(0.0).alias("probability"), F.lit(-1).alias("nearest"))
    d, spark = len(features), df.sparkSession
    groups, now = _grouped(points)
    cut = _cut(now, d)
    filed = _cores(now, samples, d, block, cut)
    levels = _hierarchy(filed, cut, d, least_size, block)
    resolved, joins = _resolved(levels), None
    for k, level in enumerate(levels):
        one = stored(level.filter("kind in (1, 4)").select("kind", "gid", "d", "a", "b", "leaf", "other", "u", "v"), "joins")
        fresh = one.filter("kind = 4")
        if k < len(resolved):
            one = _came_into(_came_into(one.filter("kind = 1"), "u", resolved[k], "leaf"), "v", resolved[k], "other").unionByName(fresh)
        one = one.drop("kind", "u", "v")
        joins = one if joins is None else joins.unionByName(one)
    skeleton = stored(joins.groupBy("gid").applyInArrow(_skeleton, "gid long, leaves array<long>, parent array<int>, js array<double>, `as` array<long>, bs array<long>"), "skeleton")
    state = levels[0].filter("kind = 0").select("gid", "box", F.col("u").alias("id"), "x", "n", "d", "a", "b", "leaf", "v")
    state = _came_into(state, "v", resolved[0], "leaf", key=True) if resolved else state
    state = state.drop("v").withColumn("part", F.expr(f"box div {PART}").cast("int"))
    boxes: dict[int, int] = {}
    for g, b in cut[2]:
        boxes[g] = max(boxes.get(g, 0), b // PART)
    parts = spark.createDataFrame([(g, k) for g, most in boxes.items() for k in range(most + 1)], "gid long, part int")
    shared = skeleton.join(checked_broadcast(parts), "gid", "left").withColumn("part", F.coalesce("part", F.lit(0)))

    def placed(key, table, tree):
        leaf = table["leaf"]
        k = np.flatnonzero(leaf.is_valid().to_numpy())
        node, density = np.full(len(table), -1, dtype=np.int32), np.zeros(len(table))
        if len(k):
            d, a, b = (table[c].take(pa.array(k)).to_numpy() for c in "dab")
            node[k], density[k] = _nodes(tree, leaf.take(pa.array(k)).to_numpy(), (d, a, b)), 1 / np.maximum(d, LEAST)
        return table.select(["gid", "box", "id", "x", "n"]).append_column("node", pa.array(node)).append_column("density", pa.array(density))

    state, shared = (_tasks(of, sum(boxes.values()) + len(boxes), "part") for of in (state, shared))
    state = state.groupBy("gid", "part").cogroup(shared.groupBy("gid", "part")).applyInArrow(placed, "gid long, box int, id long, x array<double>, n long, node int, density double")
    state = stored(state, "placed")
    own = state.filter("node >= 0").groupBy("gid", "node").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("density")).alias("s"), F.max("density").alias("most"), F.min("id").alias("least"))
    labels = stored(skeleton.groupBy("gid").cogroup(own.groupBy("gid")).applyInArrow(_chosen, "gid long, node int, label int, most double, clusters int"), "labels")
    several = groups.join(labels.select("gid", "clusters").distinct(), "gid")
    offset = several.select("gid", F.coalesce(F.sum("clusters").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("offset"))
    labels = labels.join(checked_broadcast(offset), "gid").select("gid", "node", (F.col("label") + F.col("offset")).alias("label"), "most")
    probability = F.when(F.col("label").isNotNull(), F.least(F.lit(1.0), F.col("density") / F.col("most")))
    found = state.join(checked_broadcast(labels), ["gid", "node"], "left").select("gid", "box", "id", "x", "n", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce(probability, F.lit(0.0)).alias("probability"))
    found = stored(found, "clusters")
    mean = [F.sum(F.get("x", F.lit(i)) * F.col("n")) / F.sum("n") for i in range(d)]
    means = stored(found.filter("label >= 0").groupBy("gid", "label").agg(F.array(*mean).alias("c")), "means")
    nearest = _nearest(found.filter("label < 0"), means, cut, d)
    out = rows.select("_key", "_g", "id").join(found.select("id", "label", "probability").join(nearest, "id", "left"), "id")
    return out.select(F.col("_key").alias(key), *names, "label", "probability", F.when(F.col("label") >= 0, F.col("label")).otherwise(F.coalesce("nearest", F.lit(-1))).alias("nearest"))


def ward_merges(df: DataFrame, key: str, features: Sequence[str], group: Sequence[str] = (), block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Ward's agglomeration: merges (_g, height, size, a, b, a < b, ids of clusters; the merged one goes on as a), and rows key, _g, x, id.

    Heights are sqrt(2 n m / (n + m)) times the distance of the means, so two clusters are never closer than their means
    are. Clusters that are each other's nearest (ties: the smallest pair) merge; whatever the order of such merges, they are
    those of the greedy order. In rounds, every group is dealt to boxes of about ``LEFT`` clusters, and a task merges what is
    nearer to each other than to the walls of its box; the next round has other walls. A group of ``LEFT`` clusters is one
    box without walls. Copies of a row merge first, at height 0, and have no row of their own. Further columns: round, gid
    (least id of the group) and box of a merge, and top, the cluster of that round and box that b ends up in.
    """
    rows, points = _points(df, key, features, group)
    d = len(features)
    spark = df.sparkSession
    schema = "gid long, box int, height double, size long, a long, b long, top long, x array<double>"
    groups = stored(points.groupBy("_g").agg(F.min("id").alias("gid")), "groups")
    now = stored(points.join(checked_broadcast(groups), "_g").select("id", "gid", "x", F.col("n").cast("double").alias("w")), "ward")
    done, left, before = spark.createDataFrame([], schema).withColumn("round", F.lit(0)), LEFT, None
    for step in itertools.count():
        large = {r["gid"]: r["count"] for r in now.groupBy("gid").count().filter(F.col("count") > left).collect()}
        total = sum(large.values())
        if before is not None and total > 0.75 * before:  # walls are in the way
            left *= 2
        before, left = total, max(left, total // BOXES)
        large = {g: n for g, n in large.items() if n > left}
        trees, walls = _boxes(now, large, left, d) if large else ({}, {})

        def dealt(batches):
            for batch in batches:
                gid, x = batch["gid"].to_numpy(), batch["x"].flatten().to_numpy().reshape(-1, d)
                box = np.zeros(len(gid), dtype=np.int32)
                for g in set(np.unique(gid).tolist()) & trees.keys():
                    at = np.flatnonzero(gid == g)
                    box[at] = _box_of(trees[g], x[at])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(box)], names=[*batch.schema.names, "box"])

        def merged(key, table):
            gid, box = (k.as_py() for k in key)
            low, high = walls.get((gid, box), (np.full(d, -np.inf), np.full(d, np.inf)))
            return _merged(gid, box, table, d, low, high, block)

        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * len(walls))
        filed = now.mapInArrow(dealt, "id long, gid long, x array<double>, w double, box int").repartition(tasks, "gid", "box")
        out = stored(filed.groupBy("gid", "box").applyInArrow(merged, schema).withColumn("round", F.lit(step)), "merges")
        done = done.unionByName(out.filter("b is not null"))
        if not large:
            return done.join(checked_broadcast(groups), "gid").select("_g", "height", "size", "a", "b", "round", "gid", "box", "top"), rows
        now = out.filter("b is null").select(F.col("a").alias("id"), "gid", "x", F.col("size").cast("double").alias("w"))


def _boxes(now: DataFrame, large: dict[int, int], left: int, d: int) -> tuple[dict[int, tuple], dict[tuple[int, int], tuple]]:
    """A tree of cuts (axis, where, below, above; a leaf is a box's number) by group, and each box's low and high walls.

    Cuts are chosen by a sample (they decide what a task holds, not what merges): in the middle third of the widest axis
    where clusters are thinnest, so that walls of the round before, along which many are left, lie inside.
    """
    share = min(1.0, 2 * SEEN / left)
    some = now.filter(F.col("gid").isin(list(large))).sample(share, seed=1).select("gid", "x").toPandas()
    trees, walls = {}, {}

    def cut(g: int, x: np.ndarray, n: float, low: np.ndarray, high: np.ndarray):
        for axis in np.argsort(-x.std(axis=0)) if n > left and len(x) > 1 else ():
            v = np.sort(x[:, axis])
            if v[0] == v[-1]:
                continue
            k, first = max(1, len(v) // 16), len(v) // 3
            wide = v[first + k :][: max(1, len(v) - 2 * first - k)] - v[first:][: max(1, len(v) - 2 * first - k)]
            i = first + int(wide.argmax())
            where = (v[i] + v[i + k]) / 2
            if not v[0] < where <= v[-1]:
                where = v[v > v[0]][0]
            below = x[:, axis] < where
            up, down = high.copy(), low.copy()
            up[axis] = down[axis] = where
            part = n * below.mean()
            return int(axis), float(where), cut(g, x[below], part, low, up), cut(g, x[~below], n - part, down, high)
        number = sum(1 for at in walls if at[0] == g)
        walls[g, number] = (low, high)
        return number

    for g, of in some.groupby("gid"):
        trees[g] = cut(g, np.stack(of["x"].to_numpy()), large[g], np.full(d, -np.inf), np.full(d, np.inf))
    return trees, walls


def _box_of(tree: tuple | int, x: np.ndarray) -> np.ndarray:
    """The box of each point."""
    if isinstance(tree, int):
        return np.full(len(x), tree, dtype=np.int32)
    axis, where, below, above = tree
    side = x[:, axis] < where
    out = np.empty(len(x), dtype=np.int32)
    out[side], out[~side] = _box_of(below, x[side]), _box_of(above, x[~side])
    return out


def _merged(gid: int, box: int, table: pa.Table, d: int, low: np.ndarray, high: np.ndarray, block: int) -> pa.Table:
    """A box's merges, and as rows without b the clusters left where the box has walls."""
    order = np.argsort(table["id"].to_numpy())
    ids, w = table["id"].to_numpy()[order], table["w"].to_numpy()[order]
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, d)[order]
    height, size, a, b = _ward(x, w, low, high, block)
    top = np.arange(len(ids))
    top[b] = a
    while (top[top] != top).any():
        top = top[top]
    rest = np.delete(np.arange(len(ids)), b) if np.isfinite(low).any() or np.isfinite(high).any() else np.arange(0)
    n, m = len(a), len(rest)
    none = pa.nulls(m, pa.int64())
    columns = {
        "gid": pa.array(np.full(n + m, gid)),
        "box": pa.array(np.full(n + m, box, dtype=np.int32)),
        "height": pa.chunked_array([pa.array(height), pa.nulls(m, pa.float64())]),
        "size": pa.array(np.concatenate([size, w[rest]]).astype(np.int64)),
        "a": pa.array(np.concatenate([ids[a], ids[rest]])),
        "b": pa.chunked_array([pa.array(ids[b]), none]),
        "top": pa.chunked_array([pa.array(ids[top[b]]), none]),
        "x": pa.chunked_array([pa.nulls(n, pa.list_(pa.float64())), pa.ListArray.from_arrays(np.arange(0, (m + 1) * d, d, dtype=np.int32), x[rest].ravel())]),
    }
    return pa.table(columns).combine_chunks()


def _ward(x: np.ndarray, w: np.ndarray, low: np.ndarray, high: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """height, size, a, b (positions, a < b) of all merges that are certain whatever lies outside low <= x < high. Changes x and w.

    A cluster outside weighs one at least, so its height over one inside is at least that at the wall. Halves merge on their
    own first, down to ``block`` clusters; what is left of both then goes on without the wall between them. ``near`` is a
    nearest cluster that no other can undercut; without one, ``least`` is what its height is at least, since heights over
    others never fall as clusters merge.
    """
    n = len(x)
    near, least, edge, touched, dead = np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    hint, into = np.arange(n), np.arange(n)  # another cluster that is near (none: itself), and the one that a merged one went into
    out: list[tuple] = []

    def room(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        gap = np.minimum(x[at] - low, high - x[at]).min(axis=1)
        return gap * np.sqrt(2 * w[at] / (w[at] + 1)) * (1 - 1e-9)

    def height(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(len(a))
        for i in range(x.shape[1]):
            total += (x[a, i] - x[b, i]) ** 2
        return np.sqrt(total) * np.sqrt(2 * w[a] * w[b] / (w[a] + w[b]))

    def search(of: np.ndarray, live: np.ndarray) -> None:
        parts = [(of, live)]
        if len(live) > 2 * block:  # only those as near along the widest axis as the wall, or as a cluster known to be near
            axis = int(np.ptp(x[live], axis=0).argmax())
            while (into[hint[of]] != hint[of]).any():
                hint[of] = into[hint[of]]
            most = np.where(hint[of] != of, height(of, hint[of]), np.inf)
            m = w[live].min()
            reach = np.minimum(most, edge[of]) * np.sqrt((w[of] + m) / (2 * w[of] * m)) * (1 + 1e-9)
            order, along = np.argsort(x[of, axis]), live[np.argsort(x[live, axis])]
            v, parts = x[along, axis], []
            for k in (order[s : s + 64] for s in range(0, len(of), 64)):
                at = x[of[k], axis]
                wide = reach[k] + 1e-12 * np.abs(at)
                first, end = np.searchsorted(v, (at - wide).min()), np.searchsorted(v, (at + wide).max(), side="right")
                parts.append((of[k], np.sort(along[first:end])))
        for q, near_by in parts:
            step = max(1, 2**17 // len(near_by))
            for k in range(0, len(q), step):
                compare(q[k : k + step], near_by)
        far = of[least[of] >= edge[of]]
        near[far], least[far] = -1, edge[far]

    def compare(q: np.ndarray, live: np.ndarray) -> None:
        total, other = np.zeros((len(q), len(live))), np.empty((len(q), len(live)))
        for i in range(x.shape[1]):
            np.subtract(x[q, i][:, None], x[live, i], out=other)
            total += np.multiply(other, other, out=other)
        np.divide(w[live], np.add(w[q][:, None], w[live], out=other), out=other)
        other *= total
        every, me = np.arange(len(q)), np.searchsorted(live, q)
        other[every, me] = np.inf
        j = other.argmin(axis=1)
        # rounding: what comes this close is compared by its height; of equal ones the smallest makes the smallest pair
        low = other[every, j]
        row, col = np.nonzero(other <= (low * (1 + 1e-12))[:, None])
        h = height(q[row], live[col])
        best = np.lexsort((col, h, row))
        best = best[np.flatnonzero(np.diff(row[best], prepend=-1))]
        near[q], least[q] = live[col[best]], np.where(np.isinf(low), np.inf, h[best])  # none but itself: beyond the wall
        other[every, col[best]] = np.inf
        hint[q] = live[other.argmin(axis=1)]

    def settle(live: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        wide = np.ptp(x[live], axis=0)
        if len(live) > block and wide.max() > 0:
            axis = int(wide.argmax())
            v = x[live, axis]
            where = np.median(v)
            if where == v.min():
                where = v[v > where].min()
            up, down = high.copy(), low.copy()
            up[axis] = down[axis] = where
            live = np.sort(np.concatenate([settle(live[v < where], low, up), settle(live[v >= where], down, high)]))
        edge[live] = room(live, low, high)
        fresh = False
        while len(live) > 1:
            ask = live[(near[live] < 0) & (least[live] < edge[live])]
            if len(ask):
                search(ask, live)
            sure = live[near[live] >= 0]
            a = sure[(near[near[sure]] == sure) & (sure < near[sure])]
            if not len(a):
                if fresh or not np.isinf(edge[live]).all():
                    return live
                near[live], least[live], fresh = -1, 0.0, True  # rounding has made a circle of nearest ones
                continue
            b, fresh = near[a], False
            size = w[a] + w[b]
            out.append((least[a], size, a, b))
            x[a], w[a] = (x[a] * w[a][:, None] + x[b] * w[b][:, None]) / size[:, None], size
            into[b] = a
            hint[a] = np.where(hint[a] != b, hint[a], hint[b])
            touched[a] = touched[b] = True
            near[a] = near[b] = -1
            edge[a] = room(a, low, high)
            dead[b] = True
            live = live[~dead[live]]
            lost = live[near[live] >= 0]
            near[lost[touched[near[lost]]]] = -1
            touched[a] = touched[b] = False
        return live

    settle(np.arange(n), low, high)
    if not out:
        return np.empty(0), np.empty(0), np.empty(0, dtype=int), np.empty(0, dtype=int)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def ward_clusters(df: DataFrame, key: str, features: Sequence[str], k: int, group: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """``key``, ``group``, label: the ``k`` clusters of each group that Ward's merges leave (fewer where fewer rows differ), numbered by smallest key.

    Rows with a null in a feature or key are left out. The last k - 1 merges of a group, the highest, are not done.
    """
    merges, rows = ward_merges(df, key, features, group, block)
    names = [F.col(f"_g.{c}").alias(c) for c in group]
    # a merge is never lower than those below it: ties by ids, later rounds last
    order = Window.partitionBy("_g").orderBy(F.desc("height"), F.desc("size"), F.desc("a"), F.desc("b"))
    top = stored(merges.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") < k).select("round", "gid", "box", "b"), "top")
    # boxes in which a merge is not done follow their own merges anew, all others have the cluster that each ends up in
    at = ["round", "gid", "box"]
    cut = checked_broadcast(top.select(*at).distinct())
    undone = merges.join(cut, at, "left_semi").join(checked_broadcast(top.withColumn("undone", F.lit(True))), [*at, "b"], "left")

    def follow(key, table):
        ids, place = np.unique(np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()]), return_inverse=True)
        a, b = place[: len(table)], place[len(table) :]
        root = np.arange(len(ids))
        root[b] = np.where(table["undone"].is_null().to_numpy(), a, b)
        while (root[root] != root).any():
            root = root[root]
        moved = root != np.arange(len(ids))
        return pa.table({"id": ids[moved], "root": ids[root[moved]], "round": np.full(moved.sum(), key[0].as_py(), dtype=np.int32)})

    anew = undone.select(*at, "a", "b", "undone").groupBy(*at).applyInArrow(follow, "id long, root long, round int")
    up = stored(merges.join(cut, at, "left_anti").select(F.col("b").alias("id"), F.col("top").alias("root"), "round").unionByName(anew), "up")
    last = up.agg(F.max("round")).first()[0]
    roots = up.filter(F.col("round") == last).select("id", "root")
    for step in reversed(range(last or 0)):
        above = roots.select(F.col("id").alias("root"), F.col("root").alias("above"))
        own = up.filter(F.col("round") == step).join(above, "root", "left").select("id", F.coalesce("above", "root").alias("root"))
        roots = stored(roots.unionByName(own), "roots")
    found = stored(rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "found")
    # a root is the smallest id of its cluster, and an id the smallest key of its copies
    several = found.select("_g", "root").distinct().withColumn("label", F.row_number().over(Window.partitionBy("_g").orderBy("root")) - 1)
    return found.join(several, ["_g", "root"]).select(F.col("_key").alias(key), *names, "label")
