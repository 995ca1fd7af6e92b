"""The distance to a row's n-th other row, with copies and several blocks to a cell, against all pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quakeframe.operators import linkage
from tests.test_windows import plan


def test_core_distances_leave_their_task_alone(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 2)) * [1.0, 6.0], 1)
    x[:20] = x[0]
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "id long, a double, b double")
    dist = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), axis=1)
    for samples in (1, 12, 25, 400):
        got = {r["id"]: r["core"] for r in linkage.neighbour_distance(df, "id", ["a", "b"], samples, block=7).collect()}
        assert len(got) == 300 and all(abs(got[k] - dist[k, min(samples, 299)]) < 1e-9 for k in range(300))
    points = df.select("id", F.lit(0).alias("_g"), F.array("a", "b").alias("x"), F.col("id").alias("comp"), F.lit(1.0).alias("w"))
    assert "Window" not in plan(linkage._reached(points.withColumn("w", F.lit(3.0)), points, 1.0, 2, 7, 3))
