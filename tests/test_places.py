"""Joins by place and stand-in tables against brute force, with many rows of one place."""

from __future__ import annotations

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeframe.functions.numeric import nearest_second
from quakeframe.operators import aggregates, grid, joins, selection
from quakeframe.plans import registry
from tests.compare import DATA, connection
from tests.test_windows import plan

#: Few places of many rows, near a pole and at the antimeridian too; a row without a place.
SPOTS = [(0.0, 179.5), (0.5, -179.5), (0.0, 180.5), (88.0, 10.0), (88.5, 170.0), (10.0, 20.0), (12.0, 21.0), (11.0, 20.5)]


def rows(n, shift, step):
    out = [(k + shift, *SPOTS[k * step % len(SPOTS)], float(k * 7919 % 13)) for k in range(n)]
    return [*out, (n + shift, None, 1.0, 1.0), (n + shift + 1, float("nan"), 1.0, 99.0)]


def distance(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return math.degrees(2 * math.asin(min(1.0, math.sqrt(h))))


def placed(table):
    return [x for x in table if x[1] is not None and x[1] == x[1]]


@pytest.fixture(scope="module")
def both(spark):
    a, b = rows(60, 0, 3), rows(90, 1000, 5)
    left = spark.createDataFrame(a, "id long, lat1 double, lon1 double, p double")
    right = spark.createDataFrame(b, "sta long, lat2 double, lon2 double, v double")
    near = {(x[0], y[0]): distance(x, y) for x in placed(a) for y in placed(b) if distance(x, y) <= 3}
    return a, b, left, right, near


def test_pairs_of_copies(both):
    a, b, left, right, near = both
    got = {(r["id"], r["sta"]): r["distance"] for r in joins.spatial_pairs(left, right, 3.0).collect()}
    assert got.keys() == near.keys() and all(abs(got[k] - d) < 1e-9 for k, d in near.items()) and len(near) > 500


def test_places_are_compared_once(spark, both):
    _, _, left, right, _ = both
    met = joins.place_pairs(joins.places(left, ("lat1", "lon1")), joins.places(right, ("lat2", "lon2"), "c"), 3.0)
    assert met.count() <= len(SPOTS) ** 2 and {r["c"] for r in met.collect()} <= {11, 12}


def test_nearest_of_copies(both):
    a, b, left, right, near = both
    got = {}
    for r in joins.knn(left, right, "id", "sta", 15, 3.0).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["sta"]))
    want = {}
    for x in placed(a):
        order = sorted((round(d, 9), s) for (i, s), d in near.items() if i == x[0])
        want[x[0]] = [(n, s) for n, (_, s) in enumerate(order[:15], 1)]
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    means = {r["id"]: (r["v"], r["n_near"]) for r in joins.idw(left, right, "id", "sta", "v", 15, 3.0).collect()}
    assert means.keys() == {x[0] for x in a} and means[60] == (None, None)
    value = {y[0]: y[3] for y in b}
    for k, found in want.items():
        hit = [value[s] for _, s in found if near[k, s] <= 1e-9]
        far = [(near[k, s] ** -2, value[s]) for _, s in found if near[k, s] > 1e-9]
        mean = max(hit) if hit else sum(w * v for w, v in far) / sum(w for w, _ in far)
        assert means[k][1] == len(found) and abs(means[k][0] - mean) < 1e-9


def test_spread_of_copies(both):
    a, b, left, right, near = both
    met = joins.place_pairs(joins.places(left, ("lat1", "lon1")), joins.places(right, ("lat2", "lon2"), "c"), 3.0)
    got = {(r["lat1"], r["lon1"]): r for r in aggregates.weighted_spread(met, ["lat1", "lon1"], "distance", "c").collect()}
    for x in placed(a):
        d = [v for (i, _), v in near.items() if i == x[0]]
        mean = sum(d) / len(d)
        r = got[x[1], x[2]]
        assert r["n"] == len(d) and abs(r["mean"] - mean) < 1e-9 and abs(r["sd"] - math.sqrt(sum((v - mean) ** 2 for v in d) / len(d))) < 1e-9


def test_thinning_and_exclusion_of_copies(spark, both):
    a, b, left, right, near = both
    points = left.select("id", "p", "lat1", "lon1")
    taken = []
    for x in sorted(placed(a), key=lambda x: (-x[3], x[0])):
        if all(distance(x, y) > 3 for y in taken):
            taken.append(x)
    got = {r["id"] for r in selection.spaced(points, "id", "p", 3.0, "lat1", "lon1").collect()}
    assert got == {x[0] for x in taken} | {60, 61}  # rows without a place have no neighbour
    spots = spark.createDataFrame([(10.5, 20.2), (None, 0.0)], "y double, x double")
    kept = joins.exclude_near(left, spots, "id", ("lat1", "lon1"), ("y", "x"), 1.0)
    assert {r["id"] for r in kept.collect()} == {x[0] for x in a if x not in placed(a) or distance(x, (0, 10.5, 20.2)) > 1} and kept.columns == left.columns


def test_density_of_copies(spark):
    table = [(f"g{k % 2}", k % 70, *SPOTS[k * 3 % len(SPOTS)]) for k in range(80)] + [("g0", None, 0.0, 1.0), ("g2", 5, None, 1.0)]
    df = spark.createDataFrame(table, "g string, k int, lat double, lon double")
    got = {r["g"]: (r["n"], r["density"]) for r in selection.dense_groups(df, "g", "k", "lat", "lon", 12.0).collect()}
    for g in ("g0", "g1", "g2"):
        own = [t for t in table if t[0] == g]
        ok = [t for t in own if t[1] is not None and t[2] is not None]
        near = sum(s[1] != t[1] and math.hypot(s[2] - t[2], s[3] - t[3]) <= 12 for s in ok for t in ok)
        assert got[g] == (len(own), near / (len(own) * (len(own) - 1)) if len(own) > 1 else 0.0)


def test_match_by_minute(spark):
    a = [(k, k % 3, k * 7 % 20) for k in range(200)]
    b = [(k + 500, k % 3, k * 11 % 31) for k in range(300)]
    left, right = spark.createDataFrame(a, "lid int, h int, mi int"), spark.createDataFrame(b, "rid int, h int, mj int")
    got = joins.match_in_hour(left, right, ["h"], "mi", "mj", "rid", 2, "lid")
    want = {}
    for lid, h, mi in a:
        near = [(abs(mi - mj), rid, mj) for rid, g, mj in b if g == h and abs(mi - mj) <= 2]
        if near:
            want[lid] = min(near)[1:]
    assert {r["lid"]: (r["rid"], r["mj"]) for r in got.collect()} == want and got.columns == ["h", "lid", "mi", "rid", "mj"]


def test_seconds_are_rounded(spark):
    base = datetime.datetime(2024, 1, 1)
    at = [base + datetime.timedelta(microseconds=m) for m in (0, 499_999, 500_000, 500_001, 1_500_000, 2_500_000)]
    df = spark.createDataFrame([(t,) for t in at], "t timestamp_ntz")
    assert [r["s"] - 1704067200 for r in df.select(nearest_second("t").alias("s")).collect()] == [0, 0, 0, 1, 2, 2]


@pytest.mark.parametrize("name, columns", [("vox", "m, ilat, ilon, depth, v"), ("station", "sta, lat, lon"), ("evt", "event_id, lat, lon, mag")])
def test_stand_ins_are_equal_to_the_last_bit(spark, name, columns):
    sql = registry.STANDINS[name].replace("{", "").replace("}", "")
    want = sorted(connection("sf0.1").execute(f"select {columns} from ({sql}) t where v is not null" if name == "vox" else f"select {columns} from ({sql}) t").fetchall())
    got = registry.table(spark, f"{DATA}/sf0.1", name).selectExpr(*columns.split(", "))
    assert sorted(map(tuple, (got.filter("v is not null") if name == "vox" else got).collect())) == want


def test_long_columns_by_their_envelope(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(grid, "SHORT", 0)
    for _ in range(100):
        x = np.sort(rng.choice(90, rng.integers(1, 80), replace=False)).astype(float)
        h, at = rng.integers(0, 60, len(x)).astype(float), np.arange(-3.0, 95)
        best, low = grid.lower_envelope(x, h, at)
        all_ = (at[:, None] - x) ** 2 + h
        assert (low == all_.min(axis=1)).all() and (best == all_.argmin(axis=1)).all()


def test_columns_are_filled_in_batches(spark):
    cells = [(g, i, j, float(i * 7 + j) if (i * 3 + j * 5 + g) % 11 < 2 + g else None) for g in range(3) for i in range(70) for j in range(6) if (i + j) % 9]
    df = spark.createDataFrame([*cells, (3, 0, 0, None), (3, 1, 0, None)], "g int, i int, j int, v double")
    out = grid.fill_all_nearest(df, ["g"], "i", "j", "v")
    have = {}
    for g, i, j, v in cells:
        have.setdefault(g, []).append((i, j, v)) if v is not None else None
    want = {(g, i, j): v if v is not None else min(((i - a) ** 2 + (j - b) ** 2, a, b, w) for a, b, w in have[g])[3] for g, i, j, v in cells}
    assert {(r["g"], r["i"], r["j"]): r["v"] for r in out.collect()} == want | {(3, 0, 0): None, (3, 1, 0): None}
    assert "FlatMapGroupsInPandas" not in plan(out)


def test_neighbourhoods_send_no_cells(spark):
    cells = [(i, j, k, None if (i + 2 * j + k) % 7 == 0 else float(i * j + k)) for i in range(6) for j in range(5) for k in range(4) if (i, j, k) != (2, 2, 1)]
    df = spark.createDataFrame(cells, "i int, j int, k int, v double")
    v = {c[:3]: c[3] for c in cells}
    eroded, field = grid.erode(df, ["k"], "i", "j", F.col("v").isNotNull(), 1), grid.neighbours(df, [], ("i", "j", "k"), "v", (1.0, 0.5, 2.0))
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    assert {(r["i"], r["j"], r["k"]): r["eroded"] for r in eroded.collect()} == {(i, j, k): all(v.get((i + a, j + b, k)) is not None for a, b in around) for i, j, k in v}
    at = lambda i, j, k: v.get((i, j, k)) or 0.0
    want = {(i, j, k): at(i - 1, j, k) + at(i + 1, j, k) + 0.5 * (at(i, j - 1, k) + at(i, j + 1, k)) + 2 * (at(i, j, k - 1) + at(i, j, k + 1)) for i, j, k in v}
    assert {(r["i"], r["j"], r["k"]): r["field"] for r in field.collect()} == want
    assert "Generate" not in plan(eroded) and "Generate" not in plan(field) and "HashAggregate" not in plan(field)
