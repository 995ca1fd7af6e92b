"""Reference columns: readers by hand-made files, values on both sides of an interface."""

from __future__ import annotations

import math

from quakeframe.operators import reference
from quakeframe.sources import reference as readers


def test_column_of_a_file(spark, tmp_path):
    rows = [(0, 13000, 11000, 3500), (3480000, 9900, 8000, 0), (3480000, 5500, 13700, 7200), (6346600, 3380, 8100, 4490), (6346600, 2900, 6800, 3900), (6368000, 2600, 5800, 3200), (6368000, 1020, 1450, 0), (6371000, 1020, 1450, 0)]
    text = ["a name", "1 1. 1 1", "8 1 2 5 7", *[f"{r} {rho} {vp} {vs} 57823 600 {vp} {vs} 1" for r, rho, vp, vs in rows]]
    (tmp_path / "column.txt").write_text("\n".join(text) + "\n")
    got = readers.reference_column(spark, str(tmp_path / "column.txt")).orderBy("depth", "side").collect()
    assert [(round(r["depth"], 3), r["side"], r["vsv"], r["rho"], r["qmu"]) for r in got] == [(3.0, 0, 3.2, 2.6, 600.0), (24.4, 0, 3.9, 2.9, 600.0), (24.4, 1, 4.49, 3.38, 600.0), (2891.0, 0, 7.2, 5.5, 600.0)]


def test_boundaries_of_a_file(spark, tmp_path):
    (tmp_path / "bnds").write_text("".join(f"0 0 {k % 7} 0 0 0 0 0 {-(k % 50)}\n" for k in range(180 * 360)))
    got = readers.boundary_layers(spark, str(tmp_path / "bnds"))
    assert got.count() == 64800 and got.select("lat", "lon").distinct().count() == 64800
    at = {(r["lat"], r["lon"]): r["moho"] for r in got.collect()}
    assert at[89.5, 180.5] == 0 and at[88.5, 0.5] == (360 + 180) % 7 + (360 + 180) % 50 and at[-89.5, 179.5] == 64799 % 7 + 64799 % 50


def test_both_sides_of_an_interface(spark):
    knots = [("a", 10.0, 0, 1.0), ("a", 30.0, 0, 3.0), ("a", 30.0, 1, 7.0), ("a", 230.0, 0, 9.0), ("b", 5.0, 0, 4.0)]
    column = spark.createDataFrame(knots, "g string, z double, side int, v double")
    points = [(1, "a", 30.0), (2, "a", -50.0), (3, "a", 20.0), (4, "a", 130.0), (5, "a", 9000.0), (6, "b", 5.0), (7, "b", 6000.0), (8, "c", 1.0), (9, "a", None), (10, "a", float("nan")), (11, "a", 10.0), (12, "a", 230.0), (1, "a", 30.0)]
    df = spark.createDataFrame(points, "id int, g string, z double")
    rest = [(2, 1.0), (3, 2.0), (4, 8.0), (5, 9.0), (6, 4.0), (7, 4.0), (8, None), (9, None), (10, None), (11, 1.0), (12, 9.0)]
    for below, value in ((True, 7.0), (False, 3.0)):
        got = sorted(((r["id"], r["v"]) for r in reference.at_depth(df, column, ["g"], "z", ["v"], below).collect()), key=lambda r: r[0])
        want = [(1, value), (1, value), *rest]
        assert all(a == b and (v is None and w is None or v is not None and math.isclose(v, w)) for (a, v), (b, w) in zip(got, want, strict=True))
    assert reference.at_depth(df, column.limit(0), ["g"], "z", ["v"]).filter("v is not null").count() == 0
