"""Column functions against values computed by hand, and regions and names in plain Python."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeframe.functions import geo, seismic, text
from quakeframe.operators import aggregates as agg
from quakeframe.operators import fusion, similarity, waveform, windows


def one(spark, **cols):
    """The values of columns over one row."""
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_scalars(spark):
    r = one(
        spark, a=geo.haversine_deg(0.0, 100.0, 0.0, 101.0), b=geo.haversine_deg(35.0, 100.0, 36.0, 102.0), mw=seismic.moment_magnitude(F.lit(1e25)),
        h6=seismic.half_duration(6.0), h75=seismic.half_duration(7.5), vs=seismic.voigt_vs(4.0, 4.2), vp=seismic.voigt_vp(7.0, 7.2), gap=seismic.gap_score(90.0, 8.0), few=seismic.gap_score(90.0, 3.0),
    )
    want = {"a": 1.0, "b": 1.910726, "mw": 5.933333, "h6": 4.869022, "h75": 15.397201, "vs": 4.067759, "vp": 7.160447, "gap": 0.5, "few": 0.3}
    assert {k: round(r[k], 6) for k in want} == want
    nothing = one(spark, a=geo.haversine_deg(F.lit(None).cast("double"), 1.0, 2.0, 3.0), b=seismic.perturbation(4.0, 0.0), c=seismic.voigt_vs(F.lit(None).cast("double"), 1.0), d=text.short_label(F.lit(None).cast("string")))
    assert list(nothing) == [None] * 4


def test_mechanisms(spark):
    zero = F.lit(0.0)
    for diagonal, want in (((1, -1, 0), "thrust"), ((-1, 1, 0), "normal"), ((0, 1, -1), "strike-slip"), ((0, 0, 0), None)):
        values = [*[F.lit(float(v)) for v in diagonal], zero, zero, zero]
        row = spark.range(1).select(*[v.alias(f"m{k}") for k, v in enumerate(values)]).select(seismic.mechanism(tuple(f"m{k}" for k in range(6))).alias("m")).first()
        assert row["m"] == want


def test_longitudes_wrap(spark):
    r = one(spark, a=geo.normalize_lon(-10.0), b=geo.lon_in_bounds(-179.0, 170.0, -170.0), c=geo.lon_in_bounds(0.0, 170.0, -170.0), d=geo.haversine_deg(0.0, 179.5, 0.0, -179.5))
    assert (r["a"], r["b"], r["c"], round(r["d"], 9)) == (350.0, True, False, 1.0)


def test_regions_and_names():
    a, b = geo.Box(0, 40, 70, 120, 0, 100), geo.Box(10, 50, 60, 110, 20, 400)
    assert geo.intersect_boxes([a, b]) == geo.Box(10, 40, 70, 110, 20, 100)
    assert geo.intersect_boxes([a]) == a and geo.intersect_boxes([a, geo.Box(40, 60, 120, 130)]) == geo.Box(40, 40, 120, 120)
    with pytest.raises(ValueError):
        geo.intersect_boxes([a, geo.Box(41, 50, 70, 120)])
    with pytest.raises(ValueError):
        geo.intersect_boxes([a, geo.Box(0, 40, 70, 120, 200, 300)])
    names = ["2019_ALPHA", "2020_BETA", "2021_BETA2"]
    assert text.resolve_name("ALPHA", names) == "2019_ALPHA" and text.resolve_name("2020_BETA", names) == "2020_BETA"
    for wrong in ("GAMMA", "BET"):
        with pytest.raises(KeyError):
            text.resolve_name(wrong, names)


def test_mesh_parameters():
    p = seismic.mesh_parameters(50.0, 60.0, 144)
    assert p["nproc_xi"] == p["nproc_eta"] == 12 and p["nex"] % (8 * 12) == 0 and p["nex"] >= 60 * 111.195 / 50
    q = seismic.mesh_parameters(50.0, 60.0, 6)
    assert (q["nproc_xi"], q["nproc_eta"]) == (2, 3) and q["nex"] % 16 == q["nex"] % 24 == 0


def test_aggregates_of_few_rows(spark):
    rows = [("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 3.0, 1.0), ("a", 10.0, 5.0), ("b", 1.0, 1.0), ("b", 2.0, 1.0), ("b", 3.0, 2.0), ("c", None, 1.0), ("c", float("nan"), 1.0), ("d", 4.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    assert {r["g"]: r["wmedian"] for r in agg.weighted_median(df, ["g"], "v", "w").collect()} == {"a": 10.0, "b": 2.0}
    levels = spark.createDataFrame([("a", 0.0, 1.0), ("a", 10.0, 2.0), ("a", 30.0, 4.0), ("b", 5.0, 7.0), ("c", 1.0, None)], "g string, z double, v double")
    assert {r["g"]: r["mean"] for r in agg.trapezoid_mean(levels, ["g"], "z", "v").collect()} == {"a": 2.5, "b": 7.0}
    az = spark.createDataFrame([(1, 10.0), (1, 100.0), (1, 200.0), (1, 350.0), (2, 5.0)], "e int, az double")
    assert {r["e"]: r["gap"] for r in windows.azimuthal_gap(az, ["e"], "az").collect()} == {1: 150.0, 2: 360.0}
    sse = spark.createDataFrame([(1, k, s) for k, s in ((2, 100.0), (3, 50.0), (4, 30.0), (5, 25.0), (6, 23.0))], "g int, k int, sse double")
    assert windows.elbow(sse, ["g"], "k", "sse").first()["k_elbow"] == 4
    weights = spark.createDataFrame([(1, "x", 15, 13), (1, "y", 10, 13), (1, "z", 5, 13)], "g int, name string, w int, total int")
    assert {r["name"]: r["quota"] for r in windows.quotas(weights, ["g"], "name", "w", "total").collect()} == {"x": 7, "y": 4, "z": 2}
    labels = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 2), (2, 2), (2, 2)], "a int, b int")
    assert round(similarity.label_agreement(labels, [], "a", "b").first()["ari"], 6) == 0.444444


def test_averaged_models_of_one_cell(spark):
    cell = spark.createDataFrame([(0, "a", 3.5), (0, "b", 3.6), (0, "c", 4.1)], "cell int, m string, v double")
    loglik = fusion.log_likelihood(cell, ["cell"], "m", "v")
    post = fusion.posterior(loglik, "m")
    assert {r["m"]: (round(r["loglik"], 6), round(r["posterior"], 6)) for r in post.collect()} == {"a": (-0.072581, 0.444353), "b": (0.0, 0.477804), "c": (-1.814516, 0.077842)}
    r = fusion.bma(cell, ["cell"], "m", "v", post).first()
    assert [round(r[k], 6) for k in ("bma_mean", "between_var", "entropy")] == [3.594486, 0.023874, 0.912052] and r["dominant"] == "b"
    assert round(fusion.vote(cell, ["cell"], "v").first()["cv_pct"], 6) == 7.030364


def test_bootstrap_intervals(spark):
    values = {c: [c + k * k / 10 for k in range(5)] for c in range(20)}
    df = spark.createDataFrame([(c, f"m{k}", v) for c, vs in values.items() for k, v in enumerate(vs)] + [(99, "m0", 1.5)], "cell int, m string, v double")
    got = {r["cell"]: r for r in fusion.bootstrap_median(df, ["cell"], "m", "v", replicates=400).collect()}
    rng = np.random.default_rng(0)
    for c, vs in values.items():
        lo, hi = np.percentile(np.median(rng.choice(vs, (4000, 5)), axis=1), [2.5, 97.5])
        assert abs(got[c]["ci_low"] - lo) < 0.11 and abs(got[c]["ci_high"] - hi) < 0.71 and vs[0] <= got[c]["ci_low"] <= got[c]["ci_high"] <= vs[-1]
    assert (got[99]["ci_low"], got[99]["ci_high"]) == (1.5, 1.5)
    assert got == {r["cell"]: r for r in fusion.bootstrap_median(df.repartition(7), ["cell"], "m", "v", replicates=400).collect()}


def test_traces(spark):
    t = np.arange(400) * 0.5
    ref = np.exp(-((t - 80) / 8) ** 2) * np.sin(t / 4)
    m = waveform.measure(ref, np.roll(ref, 5) * 2.0, 0.5, 20.0)
    assert round(m["dt_shift"], 3) == 2.5 and round(m["ccmax"], 6) == 1.0 and round(m["dln_a"], 6) == round(math.log(2), 6)
    assert waveform.measure(ref, np.zeros(400), 0.5, 20.0) is None and waveform.measure(ref[:1], ref[:1], 0.5, 20.0) is None
    assert abs(waveform.measure(ref, ref * 1.5, 0.5, 20.0)["rel_l2"] - 0.25) < 1e-12
    line = waveform.detrend_taper(3 + 2 * t)
    assert np.abs(line).max() < 1e-9 and np.allclose(waveform.differentiate(t * t, 0.5)[1:-1], 2 * t[1:-1])
    long = np.arange(4000) * 0.5
    kept, cut = np.sin(2 * np.pi * long / 40), np.sin(2 * np.pi * long / 4)
    out = waveform.bandpass(kept + cut, 0.5, 20.0, 80.0)
    assert np.abs(out[500:-500] - kept[500:-500]).max() < 0.05
    rows = spark.createDataFrame([(1, 0.0, 1.0, [0.0, 1.0, 2.0, 3.0, 4.0], 1.5, 0.5, [3.0, 4.0, 5.0, 6.0, 7.0, 8.0]), (2, 0.0, 1.0, [0.0, 1.0], 9.0, 1.0, [0.0, 1.0])], "k int, t1 double, d1 double, a array<double>, t2 double, d2 double, b array<double>")
    got = waveform.common_axis(rows, ["k"], ("t1", "d1", "a"), ("t2", "d2", "b"), least=1.0).collect()
    assert [(r["k"], r["t0"], r["dt"], list(r["ref"]), list(r["test"])) for r in got] == [(1, 1.5, 1.0, [1.5, 2.5, 3.5], [3.0, 5.0, 7.0])]
    doubled = waveform.map_traces(rows, "a", lambda x: 2 * x).orderBy("k").first()["a"]
    assert list(doubled) == [0.0, 2.0, 4.0, 6.0, 8.0]
