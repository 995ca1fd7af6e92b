"""Operators on gridded models, clusters, dictionaries and selections against NumPy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeframe.operators import clustering, dictionary, fusion, grid, selection, similarity


def level(x: np.ndarray, y: np.ndarray | None = None) -> list[tuple]:
    return [(0, i, j, None if np.isnan(x[i, j]) else float(x[i, j]), *([None if np.isnan(y[i, j]) else float(y[i, j])] if y is not None else [])) for i, j in np.ndindex(*x.shape)]


@pytest.fixture(scope="module")
def maps():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(14, 17))
    y = 0.7 * x + 0.3 * rng.normal(size=x.shape)
    x[4, 5] = y[9, 2] = np.nan
    return x, y


def _blur(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian mean by sums over all offsets, edges repeated."""
    n = max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    k /= k.sum()
    at = lambda a, size: min(max(a, 0), size - 1)
    return np.array([[sum(k[a + n] * k[b + n] * x[at(i + a, x.shape[0]), at(j + b, x.shape[1])] for a in range(-n, n + 1) for b in range(-n, n + 1)) for j in range(x.shape[1])] for i in range(x.shape[0])])


def test_smoothing(spark, maps):
    x, _ = maps
    got = grid.smooth(spark.createDataFrame(level(x), "g int, i int, j int, v double"), ["g"], "i", "j", "v", 1.2).collect()
    want = _blur(np.where(np.isnan(x), np.nanmean(x), x), 1.2)
    assert all((r["v"] is None or math.isnan(r["v"])) if np.isnan(x[r["i"], r["j"]]) else math.isclose(r["v"], want[r["i"], r["j"]], rel_tol=1e-9) for r in got)


def test_structural_similarity(spark, maps):
    x, y = maps
    pairs = spark.createDataFrame(level(x, y), "g int, i int, j int, x double, y double").filter("x is not null and y is not null")
    r = similarity.ssim(pairs, ["g"], "i", "j").first()
    hole = np.isnan(x) | np.isnan(y)
    w = _blur((~hole).astype(float), 1.5)
    mean = lambda z: _blur(np.where(hole, 0, z), 1.5) / w
    mx, my = mean(x), mean(y)
    span = max(np.nanmax(x[~hole]), np.nanmax(y[~hole])) - min(np.nanmin(x[~hole]), np.nanmin(y[~hole]))
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    s = (2 * mx * my + c1) * (2 * (mean(x * y) - mx * my) + c2) / ((mx**2 + my**2 + c1) * (np.maximum(mean(x * x) - mx**2, 0) + np.maximum(mean(y * y) - my**2, 0) + c2))
    assert math.isclose(r["ssim"], s[~hole].mean(), rel_tol=1e-9) and r["n"] == (~hole).sum()
    own = similarity.ssim(pairs.withColumn("y", F.col("x")), ["g"], "i", "j").first()
    assert math.isclose(own["ssim"], 1.0)


def test_tiles_equal_whole_levels(spark):
    """Tiles of 5 cells with their halos give what one tile of the whole level gives, and no group of them holds a level."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(23, 31)), rng.normal(size=(23, 31))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:4, :9] = np.nan
    rows = [(g, i - 7, j + 40, float(v) + g, float(y[i, j])) for g in (0, 1) for (i, j), v in np.ndenumerate(x) if not (i > 18 and j > 25)]
    df = spark.createDataFrame(rows, "g int, i int, j int, x double, y double")
    key = lambda r: tuple(r[c] for c in ("g", "i", "j"))
    small, whole = ({key(r): math.nan if r["x"] is None else r["x"] for r in grid.smooth(df, ["g"], "i", "j", "x", 0.8, tile=t).collect()} for t in (5, 1000))
    assert small.keys() == whole.keys() and len(whole) == len(rows)
    assert all(math.isnan(whole[k]) if math.isnan(a) else math.isclose(a, whole[k], rel_tol=1e-9, abs_tol=1e-12) for k, a in small.items())
    small, whole = ({r["g"]: (r["ssim"], r["n"]) for r in similarity.ssim(df, ["g"], "i", "j", 0.8, tile=t).collect()} for t in (5, 1000))
    assert all(math.isclose(small[g][0], whole[g][0], rel_tol=1e-9) and small[g][1] == whole[g][1] == sum(not math.isnan(r[3]) for r in rows if r[0] == g) for g in (0, 1))
    sent = grid.tiles(df, ["g"], "i", "j", 3, 5)
    assert sent.groupBy("g", "_ti", "_tj").count().agg({"count": "max"}).first()[0] <= 11 * 11
    assert sent.filter("floor(i / 5) = _ti and floor(j / 5) = _tj").count() == len(rows)


def test_lower_envelopes():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x = np.sort(rng.choice(40, rng.integers(1, 12), replace=False)).astype(float)
        h, at = rng.integers(0, 60, len(x)).astype(float), np.arange(-3.0, 45)
        best, low = grid.lower_envelope(x, h, at)
        all_ = (at[:, None] - x) ** 2 + h
        assert (low == all_.min(axis=1)).all() and (best == all_.argmin(axis=1)).all()


def test_similarity_of_profiles(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=12), rng.normal(size=12)
    rows = [("p", k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))] + [("short", 1, 1.0, 2.0)]
    got = {r["g"]: r for r in similarity.ssim_1d(spark.createDataFrame(rows, "g string, z int, x double, y double"), ["g"], "z").collect()}
    span = max(x.max(), y.max()) - min(x.min(), y.min())
    c1, c2, parts = (0.01 * span) ** 2, (0.03 * span) ** 2, []
    for k in range(6):
        a, b = x[k : k + 7], y[k : k + 7]
        cov = ((a - a.mean()) * (b - b.mean())).mean()
        parts.append((2 * a.mean() * b.mean() + c1) * (2 * cov + c2) / ((a.mean() ** 2 + b.mean() ** 2 + c1) * (a.var() + b.var() + c2)))
    assert math.isclose(got["p"]["ssim"], np.mean(parts), rel_tol=1e-9) and got["short"]["ssim"] is None


def test_wavelet_similarity_forgives_shifts(spark):
    rng = np.random.default_rng(5)
    base = _blur(rng.normal(size=(24, 25)), 1.0)
    x, near, other = base[:, :24], base[:, 1:], _blur(rng.normal(size=(24, 24)), 1.0)
    g = similarity.gabor(9, 1.8, 0.25, 0.0)
    assert abs(g.sum()) < 1e-12 and math.isclose(np.abs(g).sum(), 1.0)
    rows = [("same", i, j, float(x[i, j]), float(x[i, j])) for i, j in np.ndindex(24, 24)] + [("near", i, j, float(x[i, j]), float(near[i, j])) for i, j in np.ndindex(24, 24)] + [("other", i, j, float(x[i, j]), float(other[i, j])) for i, j in np.ndindex(24, 24)]
    got = {r["g"]: r for r in similarity.cw_ssim(spark.createDataFrame(rows, "g string, i int, j int, x double, y double"), ["g"], "i", "j", surrogates=20).collect()}
    assert math.isclose(got["same"]["cw_ssim"], 1.0, rel_tol=1e-9) and got["near"]["cw_ssim"] > got["near"]["null_p95"] and got["other"]["cw_ssim"] < got["near"]["cw_ssim"]
    surrogate = similarity.phase_randomized(x, np.random.default_rng(1))
    assert np.allclose(np.abs(np.fft.rfft2(surrogate))[1:5, 1:5], np.abs(np.fft.rfft2(x))[1:5, 1:5])


def test_unified_grid_and_samples(spark):
    g = grid.unified_grid(spark.range(1), (0.0, 2.0, 0.5), (10.0, 11.0, 0.25), [0.0, 50.0])
    assert g.count() == 5 * 5 * 2 and {(r["ilat"], r["lat"]) for r in g.collect()} == {(k, k / 2) for k in range(5)}
    rows = spark.createDataFrame([(d, k) for d in (0, 1) for k in range(100 if d else 7)], "d int, k int")
    took = {r["d"]: r["n"] for r in grid.sample_levels(rows, "d", ["k"], 0.2, 10, 15).groupBy("d").agg(F.count("*").alias("n")).collect()}
    assert took == {0: 7, 1: 15}


def test_weighted_kmeans_settles_where_lloyd_does(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.2, (60, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    x = np.column_stack([x, rng.normal(0, 3, len(x))])  # the third feature says nothing
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id int, a double, b double, c double")
    model = clustering.fit_weighted_kmeans(df, ["a", "b", "c"], ["id"], 3)
    d = ((x[:, None, :] - model.centres) ** 2 * model.weights**model.beta).sum(axis=2)
    label = d.argmin(axis=1)
    assert np.allclose(model.centres, [x[label == k].mean(axis=0) for k in range(3)], atol=1e-6)
    spread = np.array([sum(((x[label == k, f] - model.centres[k, f]) ** 2).sum() for k in range(3)) for f in range(3)])
    assert np.allclose(model.weights, spread**-1 / (spread**-1).sum(), rtol=1e-6) and model.weights.argmin() == 2
    assert all(a >= b - 1e-9 for a, b in zip(model.history, model.history[1:], strict=False))
    assert {r["id"]: r["label"] for r in model.predict(df).collect()} == dict(enumerate(label.tolist()))
    scan = {r["beta"]: r for r in clustering.scan_beta(df, ["a", "b", "c"], ["id"], 3, [1.5, 2.0, 8.0]).collect()}
    assert np.ptp(scan[1.5]["weights"]) > np.ptp(scan[8.0]["weights"]) and all(math.isclose(sum(r["weights"]), 1.0) for r in scan.values())
    with pytest.raises(ValueError):
        clustering.fit_weighted_kmeans(df, ["a"], ["id"], 2, beta=0.5)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(6)
    rows = [(k, i, j, float(v + rng.normal(0, 0.3))) for k, (i, j) in enumerate(np.ndindex(12, 12)) for v in [6.0 if i >= 6 else 0.0]]
    return spark.createDataFrame(rows, "id int, i int, j int, v double").withColumn("z", F.lit(0))


def test_mixtures(spark, blobs):
    scan = {r["k"]: r for r in clustering.scan_mixtures(blobs, ["v"], [2, 4]).collect()}
    assert scan[2]["bic"] < scan[4]["bic"] and scan[2]["silhouette"] > 0.9 and scan[2]["n_points"] == 144
    p = clustering.mixture_parameters(2, 1)
    assert p == 5 and math.isclose(scan[2]["bic"], p * math.log(144) - 2 * scan[2]["loglik"]) and math.isclose(scan[2]["aic"], 2 * p - 2 * scan[2]["loglik"])
    stable = clustering.subsample_stability(blobs, ["v"], ["id"], 2, repeats=1).collect()
    assert len(stable) == 1 and all(r["ari"] == 1.0 and 80 < r["n"] < 144 for r in stable)
    sturdy = clustering.k_robustness(blobs, ["v"], ["id"], [2], repeats=1).first()
    assert sturdy["mean_ari"] == sturdy["least_ari"] == 1.0
    banded = clustering.by_band(blobs.withColumn("band", F.when(F.col("j") < 6, "a").when(F.col("j") < 11, "b").otherwise("c")), "band", ["v"], 2, 20)
    assert {(r["band"], r["label"]) for r in banded.collect()} == {("a", 0), ("a", 1), ("b", 2), ("b", 3), ("c", -1)}


def test_random_field_mends_lone_voxels(spark, blobs):
    odd = blobs.withColumn("v", F.when((F.col("i") == 2) & (F.col("j") == 5), 3.4).otherwise(F.col("v")))
    rows = clustering.random_field(odd, ["v"], ("i", "j", "z"), 2, strength=3.0).collect()
    low = {r["label"] for r in rows if r["i"] < 6}
    assert len(low) == 1 and low.isdisjoint({r["label"] for r in rows if r["i"] >= 6})


def test_standardised_features(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0), (None, 5.0)], "a double, b double")
    got = clustering.standardised(clustering.valid_points(df, ["a", "b"]), ["a", "b"]).collect()
    x = np.array([1.0, 2.0, 6.0])
    assert np.allclose(sorted(r["a"] for r in got), sorted((x - x.mean()) / x.std())) and {r["b"] for r in got} == {0.0}


def test_dictionaries(spark):
    rng = np.random.default_rng(7)
    atoms = np.linalg.qr(rng.normal(size=(9, 9)))[0][:, :4]
    other = rng.normal(size=(16, 4))
    codes = np.zeros((300, 4))
    for c in codes:
        c[rng.choice(4, 2, replace=False)] = rng.normal(size=2)
    assert np.allclose(dictionary.omp(atoms, atoms @ codes[0], 2), codes[0])
    df = spark.createDataFrame([(k, (atoms @ c).tolist(), (other @ c).tolist()) for k, c in enumerate(codes)], "id int, low array<double>, high array<double>")
    coupled = dictionary.couple(df, "low", "high", atoms, 2)
    assert np.allclose(coupled, other, atol=1e-4)
    e = dictionary.errors(dictionary.transform(df, "low", atoms, coupled, 2, "found"), "high", "found").first()
    assert e["n"] == 300 and e["p95"] < 1e-3
    learned, errors = dictionary.train(df, "low", "id", 6, 2, rounds=6)
    assert np.allclose(np.linalg.norm(learned, axis=0), 1.0) and errors[-1] < errors[0]
    search = dictionary.grid_search(df, "low", "high", "id", [4, 6], [2], rounds=2)
    assert {(r["atoms"], r["sparsity"]) for r in search.collect()} == {(4, 2), (6, 2)}


def _degrees(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return math.degrees(2 * math.asin(math.sqrt(h)))


def test_selections(spark):
    rng = np.random.default_rng(10)
    at = {k: (float(rng.uniform(-30, 30)), float(rng.uniform(-180, 180))) for k in range(120)}
    df = spark.createDataFrame([(k, *p, float(k * 37 % 50)) for k, p in at.items()], "id int, lat double, lon double, score double")
    picks, pool = [], set(at)
    while len(picks) < 6:
        best = max(pool, key=lambda k: (round(min((_degrees(at[k], at[p]) for p in picks), default=0.0), 9), -k))
        picks.append(best)
        pool.remove(best)
    got = selection.farthest_points(df, "id", 6).orderBy("pick").collect()
    assert [r["id"] for r in got] == picks
    taken, kept = [(0.0, 0.0)], []
    for k in sorted(at, key=lambda k: (-(k * 37 % 50), k)):
        if all(_degrees(at[k], at[p]) > 12 for p in kept) and all(_degrees(at[k], p) > 12 for p in taken):
            kept.append(k)
    some = selection.spaced(df, "id", "score", 12.0, most=9, taken=spark.createDataFrame(taken, "lat double, lon double"))
    assert [r["id"] for r in some.collect()] == kept[:9]
    line = spark.createDataFrame([(k, 0.0, k * 0.5, float(-k)) for k in range(30)], "id int, lat double, lon double, score double")
    assert sorted(r["id"] for r in selection.spaced(line, "id", "score", 0.6).collect()) == list(range(0, 30, 2))
    drawn = selection.weighted_sample(df, ["id"], F.col("score"), 10)
    assert drawn.count() == 10 and drawn.filter("score = 0").count() == 0
    assert {r["id"] for r in drawn.collect()} == {r["id"] for r in selection.weighted_sample(df.repartition(5), ["id"], F.col("score"), 10).collect()}
    heavy = df.withColumn("w", F.when(F.col("id") < 20, 1000.0).otherwise(1.0))
    assert selection.weighted_sample(heavy, ["id"], F.col("w"), 20).filter("id < 20").count() >= 18
    keyed = df.withColumn("k", fusion.weighted_sample_key(F.col("score") + 1, "id"))
    assert keyed.filter("k is null or k > 0").count() == 0


def test_picks_keep_away_from_all_seeds(spark):
    """More seeds than picks: all of them count."""
    df = spark.createDataFrame([(k, 0.0, 10.0 * k) for k in range(10)], "id long, lat double, lon double")
    seeds = spark.createDataFrame([(0.0, 0.0), (0.0, 90.0), (0.0, 90.0)], "lat double, lon double")
    assert [r["id"] for r in selection.farthest_points(df, "id", 1, seeds=seeds).collect()] == [4]
    assert [r["id"] for r in selection.farthest_points(df, "id", 1, seeds=seeds.limit(0)).collect()] == [0]
