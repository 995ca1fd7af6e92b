"""Likeness of models and of labellings: correlations, sign agreement, SSIM, complex-wavelet SSIM, ARI, NMI."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.functions.numeric import clean, col
from quakeframe.operators.grid import Tile, convolved, dense, kernel, tiles


def model_pairs(df: DataFrame, cell: Sequence[str], model: str, value: str) -> DataFrame:
    """Values of every two models (a < b) in their common cells: an equi-join on the cell, which holds a row for each model."""
    v = df.filter(clean(value).isNotNull())
    a = v.select(*cell, F.col(model).alias("model_a"), F.col(value).alias("x"))
    b = v.select(*cell, F.col(model).alias("model_b"), F.col(value).alias("y"))
    return a.join(b, list(cell)).filter(F.col("model_a") < F.col("model_b"))


def weighted_pearson(df: DataFrame, group: Sequence[str], x: str, y: str, weight: Column, least: int = 10, out: str = "pearson") -> DataFrame:
    """Weighted correlation; null for fewer than ``least`` pairs or without spread.

    Means come first, so that the sums of products are taken about them.
    """
    ok = clean(x).isNotNull() & clean(y).isNotNull()
    rows = df.filter(ok).withColumn("_w", weight)
    means = rows.groupBy(*group).agg((F.sum(F.col("_w") * col(x)) / F.sum("_w")).alias("_mx"), (F.sum(F.col("_w") * col(y)) / F.sum("_w")).alias("_my"))
    j = rows.join(means, list(group)) if group else rows.crossJoin(F.broadcast(means))  # one row
    dx, dy, w = col(x) - F.col("_mx"), col(y) - F.col("_my"), F.col("_w")
    cov, vx, vy = F.sum(w * dx * dy), F.sum(w * dx * dx), F.sum(w * dy * dy)
    return j.groupBy(*group).agg(F.count("*").alias("n"), F.when((F.count("*") >= least) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias(out))


def sign_agreement(df: DataFrame, group: Sequence[str], x: str, y: str, weight: Column, percentile: float = 0.5, out: str = "agreement") -> DataFrame:
    """Weighted share of equal signs where both amplitudes reach their percentile."""
    rows = df.filter(clean(x).isNotNull() & clean(y).isNotNull()).withColumn("_w", weight)
    cut = rows.groupBy(*group).agg(F.percentile(F.abs(col(x)), F.lit(percentile)).alias("_cx"), F.percentile(F.abs(col(y)), F.lit(percentile)).alias("_cy"))
    j = (rows.join(cut, list(group)) if group else rows.crossJoin(F.broadcast(cut))).filter((F.abs(col(x)) >= F.col("_cx")) & (F.abs(col(y)) >= F.col("_cy")))  # one row
    return j.groupBy(*group).agg((F.sum(F.when(F.signum(col(x)) == F.signum(col(y)), F.col("_w")).otherwise(0.0)) / F.sum("_w")).alias(out), F.count("*").alias("n"))


def pooled_rms(df: DataFrame, group: Sequence[str], x: str, y: str, weight: Column, out: str = "rms") -> DataFrame:
    """Root of the weighted mean of both squares."""
    ok = df.filter(clean(x).isNotNull() & clean(y).isNotNull()).withColumn("_w", weight)
    return ok.groupBy(*group).agg(F.sqrt(F.sum(F.col("_w") * (col(x) * col(x) + col(y) * col(y))) / (F.sum("_w") * 2.0)).alias(out))


def correlation_matrix(pairs: DataFrame) -> DataFrame:
    """Pearson correlation of every two models."""
    return pairs.groupBy("model_a", "model_b").agg(F.corr("x", "y").alias("corr"), F.count("*").alias("n"))


def rank_correlation(pairs: DataFrame) -> DataFrame:
    """Spearman correlation: of average ranks, which come from counts of the different values."""
    def ranks(side: str) -> DataFrame:
        w = Window.partitionBy("model_a", "model_b").orderBy(side).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        n = pairs.groupBy("model_a", "model_b", side).agg(F.count("*").alias("_n"))
        return n.select("model_a", "model_b", side, (F.sum("_n").over(w) - (F.col("_n") - 1) / 2.0).alias(f"_r{side}"))

    j = pairs.join(ranks("x"), ["model_a", "model_b", "x"]).join(ranks("y"), ["model_a", "model_b", "y"])
    return j.groupBy("model_a", "model_b").agg(F.corr("_rx", "_ry").alias("spearman"), F.count("*").alias("n"))


def label_agreement(df: DataFrame, group: Sequence[str], a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean) of two labellings, from their contingency table."""
    t = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*group, a, b).agg(F.count("*").cast("double").alias("n"))
    pairs = lambda x: x * (x - 1) / 2
    rows = t.groupBy(*group, a).agg(F.sum("n").alias("m"))
    cols = t.groupBy(*group, b).agg(F.sum("n").alias("m"))
    entropy = lambda side, name: side.groupBy(*group).agg(F.sum(pairs(F.col("m"))).alias(f"_p{name}"), F.sum(F.col("m") * F.log("m")).alias(f"_h{name}"))
    cells = t.groupBy(*group).agg(F.sum("n").alias("_n"), F.sum(pairs(F.col("n"))).alias("_pc"), F.sum(F.col("n") * F.log("n")).alias("_hc"))
    if group:
        j = cells.join(entropy(rows, "a"), list(group)).join(entropy(cols, "b"), list(group))
    else:
        j = cells.crossJoin(entropy(rows, "a")).crossJoin(entropy(cols, "b"))  # one row each
    n = F.col("_n")
    expect = F.col("_pa") * F.col("_pb") / F.nullif(pairs(n), F.lit(0.0))
    most = (F.col("_pa") + F.col("_pb")) / 2
    ari = F.when(most == F.coalesce(expect, most), 1.0).otherwise((F.col("_pc") - expect) / (most - expect))
    ha, hb = F.log(n) - F.col("_ha") / n, F.log(n) - F.col("_hb") / n
    mutual = ha + hb - (F.log(n) - F.col("_hc") / n)
    nmi = F.when(ha + hb <= 1e-12, 1.0).otherwise(F.greatest(F.lit(0.0), mutual) * 2.0 / (ha + hb))
    return j.select(*group, n.cast("long").alias("n"), ari.alias("ari"), nmi.alias("nmi"))


def ssim_map(x: np.ndarray, y: np.ndarray, k: np.ndarray, span: float) -> np.ndarray:
    """Structural similarity of two arrays with windows of weights ``k``; cells missing in either are left out of all means. What the kernel reaches over is cut away."""
    radius = len(k) // 2
    hole = np.isnan(x) | np.isnan(y)
    w = convolved((~hole).astype(float), k)
    mean = lambda z: convolved(np.where(hole, 0.0, z), k) / np.maximum(w, 1e-12)
    mx, my = mean(x), mean(y)
    vx, vy, cov = mean(x * x) - mx * mx, mean(y * y) - my * my, mean(x * y) - mx * my
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    out = (2 * mx * my + c1) * (2 * cov + c2) / ((mx * mx + my * my + c1) * (np.maximum(vx, 0) + np.maximum(vy, 0) + c2))
    out[hole[radius : len(hole) - radius, radius : hole.shape[1] - radius]] = np.nan
    return out


def ssim(pairs: DataFrame, group: Sequence[str], i: str, j: str, sigma: float = 1.5, tile: int | None = None) -> DataFrame:
    """Mean SSIM of x and y for each group (a pair of models and a level), by tiles with halos whose sums are added up.

    The range of values, of the cells that both have, is the whole level's. Groups without such a cell have a null.
    """
    k, radius = kernel(sigma), len(kernel(sigma)) // 2
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    cells = pairs.select(*group, i, j, clean("x").alias("x"), clean("y").alias("y"))
    common = F.col("x").isNotNull() & F.col("y").isNotNull()
    high, low = (f(F.when(common, g("x", "y"))) for f, g in ((F.max, F.greatest), (F.min, F.least)))
    span = cells.groupBy(*group).agg(F.coalesce(high - low, F.lit(0.0)).alias("_span"))
    span = span.withColumn("_span", F.when(F.col("_span") > 0, F.col("_span")).otherwise(1.0))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = Tile(pdf, i, j, radius, tile)
        m = ssim_map(own.dense(pdf["x"].to_numpy(float)), own.dense(pdf["y"].to_numpy(float)), k, float(pdf["_span"].iloc[0]))
        return pd.DataFrame([[*key[: len(group)], float(np.nansum(m)), int(np.isfinite(m).sum())]], columns=[*group, "_sum", "_n"])

    parts = tiles(cells.join(span, list(group)), group, i, j, radius, tile).groupBy(*group, "_ti", "_tj").applyInPandas(run, ", ".join(f"{g} {kinds[g]}" for g in group) + ", _sum double, _n long")
    n = F.sum("_n")
    return parts.groupBy(*group).agg(F.when(n > 0, F.sum("_sum") / n).alias("ssim"), n.alias("n"))


def ssim_1d(pairs: DataFrame, group: Sequence[str], level: str, size: int = 7) -> DataFrame:
    """SSIM of two profiles: the mean over sliding windows of ``size`` levels (all of them where there are fewer)."""
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["x", "y"]).sort_values(level)
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        value = None
        if len(x) >= 2:
            n = min(size, len(x))
            a, b = (np.lib.stride_tricks.sliding_window_view(v, n) for v in (x, y))
            span = float(np.ptp(np.concatenate([x, y]))) or 1.0
            c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
            ma, mb = a.mean(axis=1), b.mean(axis=1)
            cov = (a * b).mean(axis=1) - ma * mb
            value = float(np.mean((2 * ma * mb + c1) * (2 * cov + c2) / ((ma**2 + mb**2 + c1) * (a.var(axis=1) + b.var(axis=1) + c2))))
        return pd.DataFrame([[*key, value, len(x)]], columns=[*group, "ssim", "n"])

    return pairs.select(*group, level, "x", "y").groupBy(*group).applyInPandas(run, ", ".join(f"{g} {kinds[g]}" for g in group) + ", ssim double, n long")


def gabor(size: int, sigma: float, frequency: float, angle: float) -> np.ndarray:
    """Complex Gabor kernel without a mean."""
    r = np.arange(size) - size // 2
    y, x = np.meshgrid(r, r, indexing="ij")
    along = x * np.cos(angle) + y * np.sin(angle)
    g = np.exp(-(x * x + y * y) / (2 * sigma**2))
    k = g * np.exp(2j * np.pi * frequency * along)
    k -= g * (k.sum() / g.sum())
    return k / np.abs(k).sum()


def _convolve(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    shape = [a + b - 1 for a, b in zip(x.shape, k.shape, strict=True)]
    full = np.fft.ifft2(np.fft.fft2(x, shape) * np.fft.fft2(k, shape))
    top, left = k.shape[0] // 2, k.shape[1] // 2
    return full[top : top + x.shape[0], left : left + x.shape[1]]


def cw_ssim_value(x: np.ndarray, y: np.ndarray, size: int = 9, angles: int = 4, frequency: float = 0.25) -> float:
    """Complex-wavelet SSIM over a bank of Gabor kernels: insensitive to small shifts. Missing cells count as the mean."""
    hole = np.isnan(x) | np.isnan(y)
    if hole.all():
        return float("nan")
    scale = lambda z: (np.where(hole, np.nanmean(z), z) - np.nanmean(z)) / (np.nanstd(z) or 1.0)
    a, b = scale(x), scale(y)
    out = []
    for k in range(angles):
        g = gabor(size, size / 5, frequency, np.pi * k / angles)
        ca, cb = _convolve(a, g)[~hole], _convolve(b, g)[~hole]
        power = float((np.abs(ca) ** 2 + np.abs(cb) ** 2).sum())
        stab = 1e-3 * len(ca)
        out.append((2 * abs((ca * np.conj(cb)).sum()) + stab) / (power + stab))
    return float(np.mean(out))


def phase_randomized(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A surrogate with the same spectrum and random phases."""
    hole = np.isnan(x)
    f = np.fft.rfft2(np.where(hole, np.nanmean(x), x))
    phase = np.exp(1j * np.angle(np.fft.rfft2(rng.standard_normal(x.shape))))
    phase[0, 0] = 1
    y = np.fft.irfft2(np.abs(f) * phase * np.where(f[0, 0].real < 0, -1, 1), s=x.shape)
    y[hole] = np.nan
    return y


def cw_ssim(pairs: DataFrame, group: Sequence[str], i: str, j: str, surrogates: int = 0, seed: int = 42) -> DataFrame:
    """Complex-wavelet SSIM for each group, with the mean and 95th percentile over phase-randomised surrogates of the second model if asked."""
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, _, _ = dense(pdf, i, j, "x")
        y, _, _ = dense(pdf, i, j, "y")
        rng = np.random.default_rng([seed, *"|".join(map(str, key)).encode()])
        null = [cw_ssim_value(x, phase_randomized(y, rng)) for _ in range(surrogates)]
        row = [*key, cw_ssim_value(x, y), float(np.mean(null)) if null else None, float(np.percentile(null, 95)) if null else None]
        return pd.DataFrame([row], columns=[*group, "cw_ssim", "null_mean", "null_p95"])

    return pairs.select(*group, i, j, "x", "y").groupBy(*group).applyInPandas(run, ", ".join(f"{g} {kinds[g]}" for g in group) + ", cw_ssim double, null_mean double, null_p95 double")


def pair_matrix(pairs: DataFrame, metric: str, models: Sequence[str]) -> DataFrame:
    """Square matrix of a metric, symmetric, 1 on the diagonal."""
    both = pairs.select("model_a", "model_b", metric).unionByName(pairs.select(F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"), metric))
    own = pairs.sparkSession.createDataFrame([(m, m, 1.0) for m in models], f"model_a string, model_b string, {metric} double")
    return both.unionByName(own).groupBy("model_a").pivot("model_b", list(models)).agg(F.first(metric))
