"""Sources, velocities and phases, as columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quakeframe.functions.numeric import Num, col, safe_log

MOMENT = ("mrr", "mtt", "mpp", "mrt", "mrp", "mtp")


def magnitude(policy: str, mb: Num = "mb", ms: Num = "ms", mw: Num | None = None) -> Column:
    """One magnitude of several: ``mb_first``, ``ms_first``, ``max`` or ``mw_first``. Zero, negative and null are missing."""
    have = lambda x: F.when(col(x) > 0, col(x))
    if policy == "mb_first":
        return F.coalesce(have(mb), have(ms))
    if policy == "ms_first":
        return F.coalesce(have(ms), have(mb))
    if policy == "max":
        return F.greatest(have(mb), have(ms))
    if policy == "mw_first":
        return F.coalesce(have(mw), have(mb), have(ms), F.lit(0.0))
    raise ValueError(f"unknown magnitude policy {policy}")


def magnitude_kind(policy: str, mb: Num = "mb", ms: Num = "ms") -> Column:
    """Which magnitude ``magnitude`` took."""
    first, second = ("mb", "ms") if policy == "mb_first" else ("ms", "mb")
    of = {"mb": mb, "ms": ms}
    return F.when(col(of[first]) > 0, first).when(col(of[second]) > 0, second).otherwise("default")


def either_in_range(lo: float, hi: float, mb: Num = "mb", ms: Num = "ms") -> Column:
    """mb or Ms in an inclusive range; nulls are outside."""
    inside = lambda x: F.coalesce(col(x).between(lo, hi), F.lit(False))
    return inside(mb) | inside(ms)


def scalar_moment(names: tuple[str, ...] = MOMENT) -> Column:
    """Scalar moment of a tensor: square root of half its squared norm."""
    rr, tt, pp, rt, rp, tp = (col(n) for n in names)
    return F.sqrt((rr * rr + tt * tt + pp * pp + (rt * rt + rp * rp + tp * tp) * 2.0) / 2.0)


def moment_magnitude(m0: Num) -> Column:
    """Mw of a scalar moment in dyn cm, 0 where there is none."""
    return F.when(col(m0) > 0, (F.log10(col(m0)) - 16.1) * (2.0 / 3.0)).otherwise(0.0)


def half_duration(mag: Num) -> Column:
    """Exponential rule, within 1 and 300 s."""
    return F.when(col(mag).isNotNull(), F.least(F.lit(300.0), F.greatest(F.lit(1.0), F.pow(F.lit(10.0), (col(mag) - 5.0) / 3.0) * 2.26)))


def half_duration_piecewise(mag: Num) -> Column:
    """Piecewise linear rule."""
    m = col(mag)
    return F.when(m <= 5.5, 1.0).when(m <= 6.0, (m - 5.5) * 2.0 + 2.0).when(m <= 7.0, (m - 6.0) * 5.0 + 3.0).otherwise((m - 7.0) * 10.0 + 8.0)


def depth_category(depth: Num) -> Column:
    return F.when(col(depth) <= 70, "shallow").when(col(depth) <= 300, "intermediate").when(col(depth).isNotNull(), "deep")


def source_depth_km(depth: Num, most: float = 1000.0) -> Column:
    """Depths too large for kilometres are metres."""
    return F.when(col(depth) > most, col(depth) / 1000.0).otherwise(col(depth))


def voigt_vp(vpv: Num, vph: Num) -> Column:
    return F.sqrt((col(vpv) * col(vpv) + col(vph) * col(vph) * 4.0) / 5.0)


def voigt_vs(vsv: Num, vsh: Num) -> Column:
    return F.sqrt((col(vsv) * col(vsv) * 2.0 + col(vsh) * col(vsh)) / 3.0)


def perturbation(v: Num, reference: Num) -> Column:
    """Natural log of v over its reference; null where there is none."""
    return safe_log(col(v) / F.when(col(reference) > 0, col(reference)))


@F.pandas_udf(StringType())
def _mechanism(m: pd.DataFrame) -> pd.Series:
    rr, tt, pp, rt, rp, tp = (m.iloc[:, k].to_numpy(float) for k in range(6))
    bad = ~np.isfinite(m.to_numpy(float)).all(axis=1)
    tensors = np.nan_to_num(np.stack([rr, rt, rp, rt, tt, tp, rp, tp, pp], axis=1).reshape(-1, 3, 3))
    values, vectors = np.linalg.eigh(tensors)
    plunge = np.degrees(np.arcsin(np.clip(np.abs(vectors[:, 0, :]), 0, 1)))  # the first axis is up
    steep = plunge.argmax(axis=1)  # columns by value: 0 is P, 1 is B, 2 is T
    names = np.array(["normal", "strike-slip", "thrust"], dtype=object)[steep]
    names[bad | (np.abs(values).max(axis=1) == 0)] = None
    return pd.Series(names.tolist())


def mechanism(names: tuple[str, ...] = MOMENT) -> Column:
    """thrust, normal or strike-slip by the steepest axis (T, P, B) of a moment tensor; null without one."""
    return _mechanism(F.struct(*[col(n).cast("double") for n in names]))


def rotate_to_cartesian(lat: Num, lon: Num, names: tuple[str, ...] = MOMENT, factor: float = 1e-7) -> dict[str, Column]:
    """Tensor in up, south, east axes (dyn cm) to Earth-centred x, y, z axes (N m)."""
    return _rotate(lat, lon, names, factor, inverse=False)


def rotate_to_local(lat: Num, lon: Num, names: tuple[str, ...] = ("mxx", "myy", "mzz", "mxy", "mxz", "myz"), factor: float = 1e7) -> dict[str, Column]:
    """The inverse of ``rotate_to_cartesian``."""
    return _rotate(lat, lon, names, factor, inverse=True)


def _rotate(lat: Num, lon: Num, names: tuple[str, ...], factor: float, inverse: bool) -> dict[str, Column]:
    t, p = F.radians(F.lit(90.0) - col(lat)), F.radians(col(lon))
    zero = F.lit(0.0)
    up = [F.sin(t) * F.cos(p), F.sin(t) * F.sin(p), F.cos(t)]
    south = [F.cos(t) * F.cos(p), F.cos(t) * F.sin(p), -F.sin(t)]
    east = [-F.sin(p), F.cos(p), zero]
    a = [[up[i], south[i], east[i]] for i in range(3)]  # columns are the local axes
    if inverse:
        a = [[a[j][i] for j in range(3)] for i in range(3)]
    d = [col(n) for n in names]
    m = [[d[0], d[3], d[4]], [d[3], d[1], d[5]], [d[4], d[5], d[2]]]
    entry = lambda i, j: sum((a[i][k] * m[k][q] * a[j][q] for k in range(3) for q in range(3)), zero) * factor
    out = MOMENT if inverse else ("mxx", "myy", "mzz", "mxy", "mxz", "myz")
    return dict(zip(out, (entry(i, j) for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))), strict=True))


def phase_class(phase: Num = "phase", component: Num = "component") -> Column:
    """body, surf or full, with the component."""
    kind = F.when(col(phase).isin("P", "SV", "SH"), "body").when(col(phase).isin("Rayleigh", "Love"), "surf").otherwise("full")
    return F.concat(kind, F.lit("-"), col(component))


def phase_window(phase: Num, arrival: Num, period_min: Num, period_max: Num, pre: Num = 10.0, post: Num = 60.0) -> list[Column]:
    """Start and end of a body wave's window about its arrival; null for other phases."""
    body = col(phase).isin("P", "SV", "SH")
    return [F.when(body, col(arrival) - F.greatest(col(pre), col(period_min) * 0.5)), F.when(body, col(arrival) + F.greatest(col(post), col(period_max)))]


def surface_window(distance_deg: Num, velocity: Num, period_max: Num, half_width: float = 2.0) -> list[Column]:
    """Start, end and time of a surface wave at a group velocity (km/s); null without distance or velocity."""
    t = F.when(col(velocity) > 0, col(distance_deg) * (math.pi / 180 * 6371.0) / col(velocity))
    return [t - col(period_max) * half_width, t + col(period_max) * half_width, t]


def reliable_shift(cc: Num = "ccmax", shift: Num = "dt_shift", snr: Num = "snr", max_lag: float = 30.0, least_cc: float = 0.7, least_snr: float = 4.0) -> Column:
    """Whether a measured time shift can be trusted: good correlation, not at the search's edge, enough signal."""
    return F.coalesce((col(cc) >= least_cc) & (F.abs(col(shift)) < 0.95 * max_lag) & (col(snr) >= least_snr), F.lit(False))


def keep_measurement(in_region: Column, distance_deg: Num, phase: Num, least: float = 3.0, least_shear: float = 10.0) -> Column:
    """Measurements of the common region, far enough for their phase; an unknown distance is too near."""
    far = F.coalesce(col(distance_deg) >= F.when(col(phase).isin("SV", "SH"), least_shear).otherwise(least), F.lit(False))
    return in_region & far


#: Weak and strong shear perturbation by depth band, and the reading of an anomaly from fast to slow.
FACIES_THRESHOLDS = {"crust": (0.010, 0.030), "lithosphere": (0.010, 0.030), "transition_zone": (0.010, 0.030), "lower_mantle": (0.010, 0.030)}
FACIES = {
    "crust": ("Very fast crust (cratonic / mafic)", "Fast crust (crystalline basement)", "Average crust", "Slow crust (sedimentary / warm)", "Very slow crust (thick sediments / basin)"),
    "lithosphere": ("Fast anomaly (cratonic root / slab)", "Moderately fast mantle (cold)", "Ambient upper mantle", "Moderately slow mantle (warm)", "Slow anomaly (asthenospheric / back-arc)"),
    "transition_zone": ("Fast TZ anomaly (stagnant slab)", "Fast TZ anomaly (stagnant slab)", "Ambient transition zone", "Slow TZ anomaly (warm / hydrated)", "Slow TZ anomaly (warm / hydrated)"),
    "lower_mantle": ("Fast anomaly (slab remnant)", "Fast anomaly (slab remnant)", "Ambient lower mantle", "Slow anomaly (thermal upwelling)", "Slow anomaly (thermal upwelling)"),
}


def facies(band: Num, dlnvp: Num, dlnvs: Num, thresholds: dict[str, tuple[float, float]] | None = None) -> Column:
    """Label of an anomaly by its band and shear perturbation; a compressional one of the other sign is noted."""
    b, v, out = F.lower(col(band)), F.coalesce(col(dlnvs), F.lit(0.0)), F.lit("Unclassified")
    weak_of = F.lit(0.010)
    for name, labels in FACIES.items():
        weak, strong = (thresholds or FACIES_THRESHOLDS)[name]
        label = F.when(v >= strong, labels[0]).when(v >= weak, labels[1]).when(v <= -strong, labels[4]).when(v <= -weak, labels[3]).otherwise(labels[2])
        here = b.isin("lithosphere", "shallow", "all") if name == "lithosphere" else b == name
        out, weak_of = F.when(here, label).otherwise(out), F.when(here, weak).otherwise(weak_of)
    odd = (F.abs(v) >= weak_of) & (F.abs(col(dlnvp)) >= weak_of * 0.5) & (F.signum(col(dlnvp)) != F.signum(v))
    return F.when(F.coalesce(odd, F.lit(False)), F.concat(out, F.lit(" [Vp-Vs decoupled]"))).otherwise(out)


def gap_score(gap: Num, count: Num, few: int = 4, floor: float = 0.3) -> Column:
    """Azimuthal coverage from the largest gap; with few azimuths a fixed low score."""
    return F.when(col(count) < few, floor).when(col(gap).isNotNull(), F.greatest(F.lit(0.0), F.lit(1.0) - col(gap) / 180.0))


def spread_score(std: Num, mean: Num, count: Num, best: float = 0.3) -> Column:
    """Score of a distance distribution, 1 where the coefficient of variation is ``best``; a half for fewer than three."""
    cv = F.when(col(mean) > 0, col(std) / col(mean)).otherwise(0.0)
    return F.when(col(count) < 3, 0.5).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(cv - best) / best))


def level_wavelength(resolution: Num, level: Num) -> Column:
    """Wavelength of a dyadic wavelet level."""
    return col(resolution) * F.pow(F.lit(2.0), col(level))


def mesh_parameters(resolution_km: float, width_deg: float, processes: int, multiple: int = 16) -> dict[str, int]:
    """Elements a side for a resolution, in multiples for the mesher, and the squarest layout of processes that divides them."""
    elements = max(multiple, math.ceil(width_deg * 111.195 / resolution_km / multiple) * multiple)
    for side in range(math.isqrt(processes), 0, -1):
        step = 8 * side
        if processes % side == 0 and side == processes // side:
            return {"nex": math.ceil(elements / step) * step, "nproc_xi": side, "nproc_eta": side}
    side = max(s for s in range(1, math.isqrt(processes) + 1) if processes % s == 0)
    other = processes // side
    return {"nex": math.ceil(elements / math.lcm(8 * side, 8 * other)) * math.lcm(8 * side, 8 * other), "nproc_xi": side, "nproc_eta": other}
