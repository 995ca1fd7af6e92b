"""Waveform pairs and traces in array columns, measured in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.functions.numeric import Num, col
from quakeframe.operators.common import checked_broadcast


def measure(ref: np.ndarray, test: np.ndarray, dt: float, max_lag: float) -> dict[str, float] | None:
    """Time shift (late test is positive), largest and zero-lag correlation, log amplitude ratio, relative misfit of two equally long traces; None without energy."""
    e_ref, e_test = float(ref @ ref), float(test @ test)
    n = len(ref)
    if n < 2 or e_ref <= 0 or e_test <= 0:
        return None
    size = 1 << (2 * n - 1).bit_length()
    cross = np.fft.irfft(np.fft.rfft(test, size) * np.conj(np.fft.rfft(ref, size)), size) / np.sqrt(e_ref * e_test)
    most = min(int(round(max_lag / dt)), n - 1)
    lags = np.arange(-most, most + 1)
    window = cross[lags]
    k = int(np.argmax(window))
    shift = float(lags[k])
    if 0 < k < len(window) - 1:
        a, b, c = window[k - 1 : k + 2]
        bend = a - 2 * b + c
        shift += 0.5 * (a - c) / bend if abs(bend) > 1e-30 else 0.0
    return {"dt_shift": shift * dt, "ccmax": float(window[k]), "nzcc": float(cross[0]), "dln_a": 0.5 * float(np.log(e_test / e_ref)), "rel_l2": float(((test - ref) ** 2).sum() / e_ref)}


METRICS = ("dt_shift", "ccmax", "nzcc", "dln_a", "rel_l2")


def measure_pairs(pairs: DataFrame, keep: Sequence[str], ref: str, test: str, dt: float, max_lag: float) -> DataFrame:
    """The five measures of every row's two traces, cut to the shorter; null without energy."""
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for a, b in zip(pdf[ref], pdf[test], strict=True):
                n = 0 if a is None or b is None else min(len(a), len(b))
                m = measure(np.asarray(a[:n], float), np.asarray(b[:n], float), dt, max_lag) if n else None
                rows.append([None] * 5 if m is None else [m[x] for x in METRICS])
            yield pd.concat([pdf[list(keep)].reset_index(drop=True), pd.DataFrame(rows, columns=METRICS, dtype=float)], axis=1)

    return pairs.select(*keep, ref, test).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", " + ", ".join(f"{m} double" for m in METRICS))


def map_traces(df: DataFrame, samples: str, fn, out: str | None = None) -> DataFrame:
    """A NumPy function of one trace over an array column; null stays null."""
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fn(np.asarray(x, float)))

    return df.withColumn(out or samples, run(F.col(samples)))


def detrend_taper(x: np.ndarray, taper: float = 0.05) -> np.ndarray:
    """A trace less its line, with cosine ends."""
    n = len(x)
    if n < 3:
        return x - x.mean() if n else x
    t = np.arange(n)
    x = x - np.polyval(np.polyfit(t, x, 1), t)
    m = max(1, int(taper * n))
    edge = 0.5 * (1 - np.cos(np.pi * np.arange(m) / m))
    w = np.ones(n)
    w[:m], w[-m:] = edge, edge[::-1]
    return x * w


def bandpass(x: np.ndarray, dt: float, period_min: float, period_max: float, order: int = 4) -> np.ndarray:
    """Zero-phase Butterworth response between two periods, applied in the frequency domain."""
    n = len(x)
    if n < 2:
        return x
    f = np.fft.rfftfreq(2 * n, dt)
    with np.errstate(divide="ignore", over="ignore"):
        high = 1 / (1 + np.where(f > 0, (1 / (period_max * np.maximum(f, 1e-300))), np.inf) ** (2 * order))
    low = 1 / (1 + (f * period_min) ** (2 * order))
    return np.fft.irfft(np.fft.rfft(x, 2 * n) * high * low, 2 * n)[:n]


def differentiate(x: np.ndarray, dt: float) -> np.ndarray:
    """Centred differences."""
    return np.gradient(x, dt) if len(x) > 1 else np.zeros_like(x)


def rotate_horizontal(north: Num, east: Num, back_azimuth: Num) -> list[Column]:
    """Radial and transverse arrays of north and east arrays."""
    a = F.radians(col(back_azimuth))
    pair = F.arrays_zip(col(north).alias("n"), col(east).alias("e"))
    radial = F.transform(pair, lambda p: -(p["n"] * F.cos(a) + p["e"] * F.sin(a)))
    transverse = F.transform(pair, lambda p: p["n"] * F.sin(a) - p["e"] * F.cos(a))
    return [radial, transverse]


def common_axis(df: DataFrame, keep: Sequence[str], a: tuple[str, str, str], b: tuple[str, str, str], least: float = 50.0) -> DataFrame:
    """Two traces (start, step, samples columns each) on one axis of the coarser step over their overlap; rows with less than ``least`` seconds of it are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                r = r._asdict()
                (t1, d1, x1), (t2, d2, x2) = ([r[c] for c in side] for side in (a, b))
                lo, hi, dt = max(t1, t2), min(t1 + d1 * (len(x1) - 1), t2 + d2 * (len(x2) - 1)), max(d1, d2)
                if hi - lo < least:
                    continue
                t = lo + dt * np.arange(int((hi - lo) / dt + 1e-9) + 1)
                rows.append([*(r[k] for k in keep), lo, dt, np.interp(t, t1 + d1 * np.arange(len(x1)), x1), np.interp(t, t2 + d2 * np.arange(len(x2)), x2)])
            yield pd.DataFrame(rows, columns=[*keep, "t0", "dt", "ref", "test"])

    return df.select(*keep, *a, *b).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", t0 double, dt double, ref array<double>, test array<double>")


def window_snr(samples: Num, first: Num, last: Num, noise_last: Num) -> Column:
    """Peak of the samples in [first, last) over twice the rms of those before ``noise_last``; null without noise."""
    x = F.transform(col(samples), lambda v: F.abs(v.cast("double")))
    part = lambda lo, hi: F.slice(x, lo + 1, F.greatest(F.lit(0), hi - lo))
    noise = part(F.lit(0), col(noise_last).cast("int"))
    rms = F.sqrt(F.aggregate(noise, F.lit(0.0), lambda a, v: a + v * v) / F.size(noise))
    peak = F.array_max(part(col(first).cast("int"), col(last).cast("int")))
    return F.when((F.size(noise) > 0) & (rms > 0), peak / (rms * 2.0))


def travel_times(queries: DataFrame, table: DataFrame, phase: str = "phase", distance: str = "dist_deg", out: str = "t_pred") -> DataFrame:
    """Arrival times by linear interpolation in a table of phase, dist_deg, t (pre-computed for a depth); null outside it. The table is a curve for each phase."""
    from pyspark.sql import Window

    w = Window.partitionBy("phase").orderBy("dist_deg")
    seg = table.select(F.col("phase").alias("_ph"), F.col("dist_deg").alias("_d1"), F.col("t").alias("_t1"), F.lead("dist_deg").over(w).alias("_d2"), F.lead("t").over(w).alias("_t2"))
    inside = (F.col(phase) == F.col("_ph")) & (F.col(distance) >= F.col("_d1")) & (F.col(distance) < F.coalesce("_d2", F.col("_d1") + 1e-9))
    t = F.col("_t1") + F.coalesce((F.col(distance) - F.col("_d1")) / (F.col("_d2") - F.col("_d1")) * (F.col("_t2") - F.col("_t1")), F.lit(0.0))
    return queries.join(checked_broadcast(seg), inside, "left").withColumn(out, t).drop("_ph", "_d1", "_t1", "_d2", "_t2")
