"""Ordered operators against brute force, and how their plans deal out rows."""

from __future__ import annotations

from quakeframe.operators import windows


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scaling_needs_no_window(spark):
    rows = [(1, "a", 2.0), (2, "a", 4.0), (3, None, 5.0), (4, None, 10.0), (5, "b", 3.0)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    top = windows.max_scaled(df, ["g"], "v", "s")
    both = windows.min_max_scaled(top, ["g"], "v", "u")
    assert {r["id"]: (r["s"], r["u"]) for r in both.collect()} == {1: (0.5, 0.0), 2: (1.0, 1.0), 3: (0.5, 0.0), 4: (1.0, 1.0), 5: (1.0, 1.0)}
    assert {r["id"]: r["u"] for r in windows.min_max_scaled(df, [], "v", "u").collect()} == {1: 0.0, 2: 0.25, 3: 0.375, 4: 1.0, 5: 0.125}
    assert "Window" not in plan(both) and both.columns == ["id", "g", "v", "s", "u"]


def test_look_back_crosses_buckets_in_many_tasks(spark):
    values = [(k * 7919 % 997) % 60 for k in range(400)]
    df = spark.createDataFrame(list(enumerate(map(float, values))), "id int, v double").repartition(7)
    want = {k for k, v in enumerate(values) if all(abs(v - b) > 0.5 for b in values[max(0, k - 30) : k])}
    for bucket in (1, 30, 37, 1000):
        got = windows.tolerance_dedup(df, ["id"], [("v", 0.5)], back=30, bucket=bucket)
        assert {r["id"] for r in got.collect()} == want and got.columns == ["id", "v"]
        assert "SinglePartition" not in plan(got)
    assert windows.tolerance_dedup(df.limit(0), ["id"], [("v", 0.5)]).count() == 0
