"""Geography on the sphere and the ellipsoid, as columns. Angles are degrees unless a name says otherwise."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quakeframe.functions.numeric import Num, between, col

EARTH_KM = 6371.0
#: WGS84.
SEMI_MAJOR_M = 6378137.0
FLATTENING = 1 / 298.257223563


def _haversine(lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    dlat, dlon = b - a, F.radians(col(lon2)) - F.radians(col(lon1))
    h = F.pow(F.sin(dlat / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin(dlon / 2), F.lit(2))
    return F.when(h.isNotNull(), F.lit(2.0) * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def haversine_deg(lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    return F.degrees(_haversine(lat1, lon1, lat2, lon2))


def haversine_km(lat1: Num, lon1: Num, lat2: Num, lon2: Num, radius: float = EARTH_KM) -> Column:
    return _haversine(lat1, lon1, lat2, lon2) * radius


def cosine_distance_deg(lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    """Great-circle distance by the law of cosines."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    c = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(col(lon2) - col(lon1)))
    return F.when(c.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))))


def azimuth_deg(lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    """Forward azimuth in [0, 360)."""
    a, b, d = F.radians(col(lat1)), F.radians(col(lat2)), F.radians(col(lon2) - col(lon1))
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360.0, F.lit(360.0))


def planar_degrees(lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    """Euclidean distance in degrees, as the density test of networks takes it."""
    return F.sqrt(F.pow(col(lat2) - col(lat1), F.lit(2)) + F.pow(col(lon2) - col(lon1), F.lit(2)))


def normalize_lon(lon: Num) -> Column:
    """Longitude in [0, 360)."""
    return F.pmod(col(lon), F.lit(360.0))


def lon_in_bounds(lon: Num, lo: Num, hi: Num) -> Column:
    """Longitude in an interval that may wrap (lo > hi)."""
    x, a, b = normalize_lon(lon), normalize_lon(lo), normalize_lon(hi)
    return F.when(a <= b, x.between(a, b)).otherwise((x >= a) | (x <= b))


@dataclass(frozen=True)
class Box:
    """A region: inclusive bounds; depths are optional."""

    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float
    depth_min: float | None = None
    depth_max: float | None = None

    def contains(self, lat: Num = "latitude", lon: Num = "longitude", depth: Num | None = None, pad: float = 0.0) -> Column:
        inside = between(lat, self.lat_min - pad, self.lat_max + pad) & between(lon, self.lon_min - pad, self.lon_max + pad)
        if depth is not None and self.depth_min is not None and self.depth_max is not None:
            inside = inside & between(depth, self.depth_min - pad, self.depth_max + pad)
        return inside

    def margin(self, lat: Num = "latitude", lon: Num = "longitude") -> Column:
        """Distance in degrees to the nearest edge, negative outside."""
        return F.when(col(lat).isNotNull() & col(lon).isNotNull(), F.least(col(lat) - self.lat_min, F.lit(self.lat_max) - col(lat), col(lon) - self.lon_min, F.lit(self.lon_max) - col(lon)))

    def outside_by(self, lat: Num = "latitude", lon: Num = "longitude") -> Column:
        """Planar distance in degrees to the box, 0 inside."""
        d = lambda x, lo, hi: F.when(col(x).isNotNull(), F.greatest(F.lit(0.0), F.lit(lo) - col(x), col(x) - hi))
        return F.sqrt(F.pow(d(lat, self.lat_min, self.lat_max), F.lit(2)) + F.pow(d(lon, self.lon_min, self.lon_max), F.lit(2)))


def intersect_boxes(boxes: list[Box]) -> Box:
    """The common region; raises if there is none."""
    lo = lambda name: max(getattr(b, name) for b in boxes)
    hi = lambda name: min(getattr(b, name) for b in boxes)
    deep = all(b.depth_min is not None for b in boxes)
    out = Box(lo("lat_min"), hi("lat_max"), lo("lon_min"), hi("lon_max"), lo("depth_min") if deep else None, hi("depth_max") if deep else None)
    if out.lat_min > out.lat_max or out.lon_min > out.lon_max or (deep and out.depth_min > out.depth_max):
        raise ValueError("the regions have nothing in common")
    return out


def interior_score(box: Box, lat: Num = "latitude", lon: Num = "longitude", reach: float = 20.0) -> Column:
    """1 inside a box, falling to 0 at ``reach`` degrees from it."""
    far = box.outside_by(lat, lon)
    return F.when(far.isNotNull(), F.greatest(F.lit(0.0), F.lit(1.0) - far / reach))


def unit_vector(lat: Num, lon: Num, geocentric: bool = True) -> list[Column]:
    """x, y, z on the unit sphere; geographic latitudes are made geocentric first."""
    a = F.radians(col(lat))
    if geocentric:
        a = F.atan(F.tan(a) * (1 - FLATTENING) ** 2)
    b = F.radians(col(lon))
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def xyz_to_spherical(x: Num, y: Num, z: Num) -> list[Column]:
    """Latitude, longitude and radius of a Cartesian point."""
    r = F.sqrt(col(x) * col(x) + col(y) * col(y) + col(z) * col(z))
    return [F.when(r > 0, F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), col(z) / r))))), F.degrees(F.atan2(col(y), col(x))), r]


def xyz_to_depth(x: Num, y: Num, z: Num, scale_km: float = EARTH_KM) -> list[Column]:
    """Latitude, longitude and depth (km) of a point in units of the Earth's radius."""
    lat, lon, r = xyz_to_spherical(x, y, z)
    return [lat, lon, F.lit(EARTH_KM) - r * scale_km]


def geodetic_to_ecef(lat: Num, lon: Num, height_m: Num) -> list[Column]:
    """WGS84 latitude, longitude, height to Earth-centred x, y, z in metres."""
    e2 = FLATTENING * (2 - FLATTENING)
    a, b = F.radians(col(lat)), F.radians(col(lon))
    n = F.lit(SEMI_MAJOR_M) / F.sqrt(F.lit(1.0) - F.pow(F.sin(a), F.lit(2)) * e2)
    h = col(height_m)
    return [(n + h) * F.cos(a) * F.cos(b), (n + h) * F.cos(a) * F.sin(b), (n * (1 - e2) + h) * F.sin(a)]


def ecef_to_geodetic(x: Num, y: Num, z: Num) -> list[Column]:
    """Earth-centred metres to WGS84 latitude, longitude, height, by Bowring's closed form."""
    e2 = FLATTENING * (2 - FLATTENING)
    semi_minor = SEMI_MAJOR_M * (1 - FLATTENING)
    second = e2 / (1 - e2)
    p = F.sqrt(col(x) * col(x) + col(y) * col(y))
    t = F.atan2(col(z) * SEMI_MAJOR_M, p * semi_minor)
    lat = F.atan2(col(z) + F.pow(F.sin(t), F.lit(3)) * (second * semi_minor), p - F.pow(F.cos(t), F.lit(3)) * (e2 * SEMI_MAJOR_M))
    n = F.lit(SEMI_MAJOR_M) / F.sqrt(F.lit(1.0) - F.pow(F.sin(lat), F.lit(2)) * e2)
    polar = F.abs(F.cos(lat)) < 1e-9
    height = F.when(polar, F.abs(col(z)) - semi_minor).otherwise(p / F.cos(lat) - n)
    return [F.degrees(lat), F.degrees(F.atan2(col(y), col(x))), height]


@dataclass(frozen=True)
class Chunk:
    """A square piece of the cubed sphere: centre, rotation and widths in degrees."""

    lat: float
    lon: float
    rotation: float
    width_xi: float
    width_eta: float

    def axes(self) -> list[list[float]]:
        """Rows: the chunk's eta-, xi- and outward axes in Earth-centred coordinates."""
        theta, phi, g = math.radians(90 - self.lat), math.radians(self.lon), math.radians(self.rotation)
        south = [math.cos(theta) * math.cos(phi), math.cos(theta) * math.sin(phi), -math.sin(theta)]
        east = [-math.sin(phi), math.cos(phi), 0.0]
        out = [math.sin(theta) * math.cos(phi), math.sin(theta) * math.sin(phi), math.cos(theta)]
        xi = [math.cos(g) * e + math.sin(g) * -s for e, s in zip(east, south, strict=True)]
        eta = [-math.sin(g) * e + math.cos(g) * -s for e, s in zip(east, south, strict=True)]
        return [xi, eta, out]

    def xi_eta(self, lat: Num, lon: Num) -> list[Column]:
        """Chunk-local angles; null on the far side of the Earth."""
        v = unit_vector(lat, lon)
        dot = lambda axis: v[0] * axis[0] + v[1] * axis[1] + v[2] * axis[2]
        xi, eta, out = (dot(a) for a in self.axes())
        return [F.when(out > 0, F.degrees(F.atan(xi / out))), F.when(out > 0, F.degrees(F.atan(eta / out)))]

    def margin(self, lat: Num, lon: Num) -> Column:
        """Degrees to the nearest edge of the chunk, negative outside, -180 on the far side."""
        xi, eta = self.xi_eta(lat, lon)
        return F.coalesce(F.least(F.lit(self.width_xi / 2) - F.abs(xi), F.lit(self.width_eta / 2) - F.abs(eta)), F.lit(-180.0))


def scaled(lon: Num, lat: Num, depth: Num, reference_lat: float, km_per_degree: float = 111.195) -> list[Column]:
    """Longitude, latitude and depth in kilometres about a reference latitude, for distances between near points."""
    return [col(lon) * (km_per_degree * math.cos(math.radians(reference_lat))), col(lat) * km_per_degree, col(depth)]


def replace_weight(box: Box, lat: Num, lon: Num, depth: Num, taper: float, taper_top: float, taper_bottom: float, top: Num | None = None) -> Column:
    """Weight of a regional model at a point: 1 well inside, ramps to 0 at the edges. ``top`` (such as a Moho depth) replaces the box's depth_min."""
    from quakeframe.functions.numeric import ramp

    x = normalize_lon(lon)
    flat = F.least(ramp(lat, box.lat_min, box.lat_min + taper), ramp(-col(lat), -box.lat_max, -box.lat_max + taper)) * F.least(ramp(x, box.lon_min, box.lon_min + taper), ramp(-x, -box.lon_max, -box.lon_max + taper))
    first = col(top) if top is not None else F.lit(float(box.depth_min or 0.0))
    deep = F.least(ramp(col(depth) - first, 0.0, taper_top), ramp(-col(depth), -(box.depth_max or 0.0), -(box.depth_max or 0.0) + taper_bottom))
    return flat * deep
