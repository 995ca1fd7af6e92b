"""Queries of column functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakeframe.functions import geo, numeric, seismic, text
from quakeframe.functions.geo import Box
from quakeframe.operators import filters
from quakeframe.plans.registry import n, query, r

HAVERSINE = "degrees(2 * asin(least(1.0, sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)))))"
SELECT_BOX = "lat between 0 and 40 and lon between 70 and 120 and depth between 0 and 400"


def haversine_sql(a: str, b: str, c: str, d: str) -> str:
    return HAVERSINE.format(a=a, b=b, c=c, d=d)


@query(f"""select event_id, round({haversine_sql('lat', 'lon', '35.0', '105.0')}, 6) + 0.0 as deg, round({haversine_sql('lat', 'lon', '35.0', '105.0')} * pi() / 180 * 6371, 4) + 0.0 as km,
  round(degrees(acos(greatest(-1.0, least(1.0, sin(radians(lat)) * sin(radians(35.0)) + cos(radians(lat)) * cos(radians(35.0)) * cos(radians(105.0 - lon)))))), 5) + 0.0 as deg_cos,
  round(((degrees(atan2(sin(radians(105.0 - lon)) * cos(radians(35.0)), cos(radians(lat)) * sin(radians(35.0)) - sin(radians(lat)) * cos(radians(35.0)) * cos(radians(105.0 - lon)))) + 360.0) % 360.0), 6) + 0.0 as azimuth,
  round(sqrt(pow(35.0 - lat, 2) + pow(105.0 - lon, 2)), 6) + 0.0 as planar from evt where not (lat = 35.0 and lon = 105.0)""")
def geo_distances(t):
    """Distances and azimuth to a point."""
    e = t("evt").filter("not (lat = 35.0 and lon = 105.0)")
    return e.select("event_id", r(geo.haversine_deg("lat", "lon", 35.0, 105.0)).alias("deg"), r(geo.haversine_km("lat", "lon", 35.0, 105.0), 4).alias("km"), r(geo.cosine_distance_deg("lat", "lon", 35.0, 105.0), 5).alias("deg_cos"), r(geo.azimuth_deg("lat", "lon", 35.0, 105.0)).alias("azimuth"), r(geo.planar_degrees("lat", "lon", 35.0, 105.0)).alias("planar"))


@query("""select event_id, round((lon - 200 + 720) % 360, 6) + 0.0 as lon360, ((lon - 200 + 720) % 360 >= 350 or (lon - 200 + 720) % 360 <= 10) as wrapped,
  round(least(lat - 0, 40 - lat, lon - 70, 120 - lon), 6) + 0.0 as margin, round(greatest(0.0, 1.0 - sqrt(pow(greatest(0.0, 0 - lat, lat - 40), 2) + pow(greatest(0.0, 70 - lon, lon - 120), 2)) / 20.0), 6) + 0.0 as interior from evt""")
def geo_regions(t):
    """Longitudes that wrap, margins to a box, interior score."""
    box = Box(0, 40, 70, 120)
    shifted = F.col("lon") - 200
    return t("evt").select("event_id", r(geo.normalize_lon(shifted)).alias("lon360"), geo.lon_in_bounds(shifted, -10.0, 10.0).alias("wrapped"), r(box.margin("lat", "lon")).alias("margin"), r(geo.interior_score(box, "lat", "lon")).alias("interior"))


@query("""select event_id, round(least(300.0, greatest(1.0, 2.26 * pow(10.0, (mag - 5) / 3))), 6) as half_exp, round(case when mag <= 5.5 then 1.0 when mag <= 6 then 2 * (mag - 5.5) + 2 when mag <= 7 then 3 + 5 * (mag - 6) else 8 + 10 * (mag - 7) end, 6) as half_lin,
  case when depth <= 70 then 'shallow' when depth <= 300 then 'intermediate' else 'deep' end as category,
  round(case when event_id % 3 = 0 then null else mag end, 6) as mb, round(coalesce(case when event_id % 4 = 0 then mag + 0.3 end, case when event_id % 3 = 0 then null else mag end), 6) as ms_first, round(coalesce(case when event_id % 3 = 0 then null else mag end, case when event_id % 4 = 0 then mag + 0.3 end), 6) as mb_first,
  round(greatest(case when event_id % 3 = 0 then null else mag end, case when event_id % 4 = 0 then mag + 0.3 end), 6) as largest from evt""")
def source_scalars(t):
    """Half durations, depth class, magnitudes by policy."""
    mb, ms = F.when(F.col("event_id") % 3 != 0, F.col("mag")), F.when(F.col("event_id") % 4 == 0, F.col("mag") + 0.3)
    e = t("evt").withColumns({"mb": mb, "ms": ms})
    return e.select("event_id", r(seismic.half_duration("mag")).alias("half_exp"), r(seismic.half_duration_piecewise("mag")).alias("half_lin"), seismic.depth_category("depth").alias("category"), r("mb").alias("mb"), r(seismic.magnitude("ms_first")).alias("ms_first"), r(seismic.magnitude("mb_first")).alias("mb_first"), r(seismic.magnitude("max")).alias("largest"))


@query("""select event_id, round(sqrt((mag * mag + depth * depth + lat * lat + 2 * (lon * lon + mag * mag + 1)) / 2), 5) as m0, round((log10(sqrt((mag * mag + depth * depth + lat * lat + 2 * (lon * lon + mag * mag + 1)) / 2) * 1e24) - 16.1) * 2 / 3, 6) as mw from evt""")
def source_moment(t):
    """Scalar moment and moment magnitude of a tensor."""
    m0 = seismic.scalar_moment(("mag", "depth", "lat", "lon", "mag", "one"))
    return t("evt").withColumn("one", F.lit(1.0)).select("event_id", r(m0, 5).alias("m0"), r(seismic.moment_magnitude(m0 * 1e24)).alias("mw"))


@query()
def source_mechanism(t):
    """Mechanism by the steepest axis, and the tensor rotated to Cartesian axes and back."""
    names = seismic.MOMENT
    e = t("evt").select("event_id", "lat", "lon", *[F.sin(F.col("event_id") * (k + 1)).alias(m) for k, m in enumerate(names)])
    turned = e.withColumns(seismic.rotate_to_cartesian("lat", "lon"))
    back = seismic.rotate_to_local("lat", "lon")
    worst = F.greatest(*[F.abs(back[m] - F.col(m)) for m in names])
    return turned.select("event_id", seismic.mechanism().alias("mechanism"), (worst < 1e-9).alias("turns_back"))


@query("""select m, ilat, ilon, depth, round(sqrt((2 * v * v + (v + 0.2) * (v + 0.2)) / 3), 6) as vs, round(sqrt(((1.7 * v) * (1.7 * v) + 4 * (1.75 * v) * (1.75 * v)) / 5), 6) as vp, round(ln(v / 4.0) * 100, 6) + 0.0 as dln from vox""")
def voigt_means(t):
    """Voigt means and log perturbation of voxels."""
    v = F.col("v")
    return t("vox").select("m", "ilat", "ilon", "depth", r(seismic.voigt_vs(v, v + 0.2)).alias("vs"), r(seismic.voigt_vp(v * 1.7, v * 1.75)).alias("vp"), r(seismic.perturbation(v, 4.0) * 100).alias("dln"))


@query("""with x as (select m, ilat, ilon, depth, ln(v / 4.0) as d, case when ilon % 2 = 0 then 'crust' when ilon % 3 = 0 then 'lithosphere' when ilon % 5 = 0 then 'transition_zone' else 'lower_mantle' end as band from vox)
select m, ilat, ilon, depth, case band when 'crust' then case when coalesce(d, 0) >= 0.03 then 'Very fast crust (cratonic / mafic)' when coalesce(d, 0) >= 0.01 then 'Fast crust (crystalline basement)' when coalesce(d, 0) <= -0.03 then 'Very slow crust (thick sediments / basin)' when coalesce(d, 0) <= -0.01 then 'Slow crust (sedimentary / warm)' else 'Average crust' end
 when 'lithosphere' then case when coalesce(d, 0) >= 0.03 then 'Fast anomaly (cratonic root / slab)' when coalesce(d, 0) >= 0.01 then 'Moderately fast mantle (cold)' when coalesce(d, 0) <= -0.03 then 'Slow anomaly (asthenospheric / back-arc)' when coalesce(d, 0) <= -0.01 then 'Moderately slow mantle (warm)' else 'Ambient upper mantle' end
 when 'transition_zone' then case when coalesce(d, 0) >= 0.01 then 'Fast TZ anomaly (stagnant slab)' when coalesce(d, 0) <= -0.01 then 'Slow TZ anomaly (warm / hydrated)' else 'Ambient transition zone' end
 else case when coalesce(d, 0) >= 0.01 then 'Fast anomaly (slab remnant)' when coalesce(d, 0) <= -0.01 then 'Slow anomaly (thermal upwelling)' else 'Ambient lower mantle' end end as facies from x""")
def facies_labels(t):
    """Reading of anomalies by band."""
    band = F.when(F.col("ilon") % 2 == 0, "crust").when(F.col("ilon") % 3 == 0, "lithosphere").when(F.col("ilon") % 5 == 0, "transition_zone").otherwise("lower_mantle")
    x = t("vox").withColumns({"d": seismic.perturbation("v", 4.0), "band": band})
    return x.select("m", "ilat", "ilon", "depth", seismic.facies("band", "d", "d").alias("facies"))


@query("""with i as (select event_id, case event_id % 5 when 0 then concat('C', cast(year as varchar(9)), '04300043A') when 1 then concat(cast(year as varchar(9)), '04300043B') when 2 then 'C043006A' when 3 then concat('B', cast(year as varchar(9)), '12010101C') else 'odd' end as id, year from evt)
select event_id, case event_id % 5 when 0 then 'gcmt_c_full' when 1 then 'specfem_datetime' when 2 then 'gcmt_c_short' when 3 then 'gcmt_b_full' else 'unknown' end as form, case when event_id % 5 in (0, 1, 3) then year end as id_year, case event_id % 5 when 0 then 4 when 3 then 12 end as id_month from i""")
def event_identifiers(t):
    """Forms and dates of event identifiers."""
    y, k = F.col("year").cast("string"), F.col("event_id") % 5
    ident = F.when(k == 0, F.concat(F.lit("C"), y, F.lit("04300043A"))).when(k == 1, F.concat(y, F.lit("04300043B"))).when(k == 2, "C043006A").when(k == 3, F.concat(F.lit("B"), y, F.lit("12010101C"))).otherwise("odd")
    return t("evt").withColumn("id", ident).select("event_id", text.classify_event_id("id").alias("form"), text.event_id_year("id").alias("id_year"), text.event_id_time("id")[1].alias("id_month"))


@query("""select sta, concat(net, '.', cast(sta as varchar(20))) as station_id, regexp_replace(concat('2019_', net, '_model'), '^[0-9]{4}_', '') as model, concat('N', substr(net, 2)) as plain_net,
  case when net in ('N1', 'N2') then 'CNSN' when net = 'N0' then 'Hinet' when net in ('N3', 'N4') then 'IRIS' else 'Other' end as provider from station""")
def station_names(t):
    """Names and source families of stations."""
    return t("station").select("sta", text.station_id("net", F.col("sta").cast("string")).alias("station_id"), text.strip_year(F.concat(F.lit("2019_"), "net", F.lit("_model"))).alias("model"), text.strip_net_suffix(F.concat("net", F.lit("_02"))).alias("plain_net"), text.provider_of("net", ["N1", "N2"], ["N3", "N4"], dense="N0").alias("provider"))


@query("""select event_id, case when event_id % 3 = 0 then cast(cast(t as date) as varchar(10)) || ' 10:20:59' when event_id % 3 = 1 then cast(cast(t as date) as varchar(10)) || ' 10:20:30' else '1970-01-01 00:00:00' end as origin from evt""")
def origin_times(t):
    """Origin times from text: seconds of 60, and what cannot be read."""
    k = F.col("event_id") % 3
    e = t("evt").withColumns({"d": F.when(k == 2, "none").otherwise(F.date_format("t", "yyyy/MM/dd")), "c": F.when(k == 0, "10:20:60").otherwise("10:20:30")})
    return e.select("event_id", F.date_format(text.sort_time("d", "c"), "yyyy-MM-dd HH:mm:ss").alias("origin"))


RAMP = "0.5 * (1 - cos(pi() * least(1.0, greatest(0.0, ({x} - ({a})) / ({b} - ({a}))))))"
_ramp = lambda x, a, b: RAMP.format(x=x, a=a, b=b)


@query(f"""select event_id, round(least({_ramp('lat', 0.0, 5.0)}, {_ramp('(-lat)', -40.0, -35.0)}) * least({_ramp('lon', 70.0, 75.0)}, {_ramp('(-lon)', -120.0, -115.0)}) * least({_ramp('(depth - 50.0)', 0.0, 30.0)}, {_ramp('(-depth)', -600.0, -500.0)}), 6) + 0.0 as weight from evt""")
def taper_weight(t):
    """Weight of a regional model with ramps at its edges."""
    return t("evt").select("event_id", r(geo.replace_weight(Box(0.0, 40.0, 70.0, 120.0, 50.0, 600.0), "lat", "lon", "depth", 5.0, 30.0, 100.0)).alias("weight"))


@query("""select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double))) / len(embedding)), 6) as rms,
  round(len(list_filter(embedding, lambda x: abs(cast(x as double) - med) > 2.0 * 1.4826 * mad)) / len(embedding), 6) as glitch
from (select *, list_aggregate(list_transform(embedding, lambda x: abs(cast(x as double) - med)), 'median') as mad from (select *, cast(list_aggregate(list_transform(embedding, lambda x: cast(x as double)), 'median') as double) as med from emb) a) b""")
def trace_quality(t):
    """Root mean square and glitch ratio of traces."""
    return t("emb").select("vec_id", r(numeric.array_rms("embedding")).alias("rms"), r(numeric.glitch_ratio("embedding", 2.0)).alias("glitch"))


def _rules():
    return [("region", geo.Box(0, 40, 70, 120).contains("lat", "lon")), ("depth", F.col("depth").between(0, 400)), ("magnitude", seismic.either_in_range(5.5, 7.0, "mag", F.lit(None).cast("double"))), ("year", F.col("year").between(1993, 1996))]


@query("""select reason, count(*) as n from (select case when not (lat between 0 and 40 and lon between 70 and 120) then 'region' when not depth between 0 and 400 then 'depth' when not mag between 5.5 and 7 then 'magnitude' when not year between 1993 and 1996 then 'year' else 'accepted' end as reason from evt) x group by reason""")
def reject_reasons(t):
    """Rows by the first filter that they fail."""
    return filters.reject_counts(t("evt"), _rules())


@query("""select count(*) as n_all, count(*) filter (lat between 0 and 40 and lon between 70 and 120) as n_region, count(*) filter (lat between 0 and 40 and lon between 70 and 120 and depth between 0 and 400) as n_depth,
 count(*) filter (lat between 0 and 40 and lon between 70 and 120 and depth between 0 and 400 and mag between 5.5 and 7) as n_magnitude, count(*) filter (lat between 0 and 40 and lon between 70 and 120 and depth between 0 and 400 and mag between 5.5 and 7 and year between 1993 and 1996) as n_year from evt""")
def filter_cascade(t):
    """Rows after each filter, in one pass."""
    return filters.cascade_counts(t("evt"), _rules())


@query("""select event_id, lat, lon, mag from evt where lat between 0 and 40 and lon between 70 and 120 and depth between 0 and 400 and mag between 5.5 and 7 and year between 1993 and 1996""")
def filter_accept(t):
    """Rows that pass the cascade."""
    return filters.accept(t("evt"), _rules()).select("event_id", "lat", "lon", "mag")


@query("""select grp, count(*) as n from validity where s <= date '1995-06-15' and (e is null or e >= date '1995-06-15') group by grp""")
def active_intervals(t):
    """Intervals that hold a date, by group; open ends count."""
    return t("validity").filter(filters.active_at("s", "e", F.lit("1995-06-15").cast("date"))).groupBy("grp").agg(F.count("*").alias("n"))


@query("""select m, case when depth >= 0 and depth < 200 then 'crust' when depth >= 200 and depth < 300 then 'mantle' when depth >= 300 and depth <= 400 then 'deep' end as band, count(*) as n, count(v) as n_valid from vox group by 1, 2""")
def depth_bands(t):
    """Voxels by depth band, the last one closed."""
    band = filters.depth_band("depth", [("crust", 0, 200), ("mantle", 200, 300), ("deep", 300, 400)])
    return t("vox").withColumn("band", band).groupBy("m", "band").agg(F.count("*").alias("n"), F.count("v").alias("n_valid"))


@query("""select event_id from evt where lat between 10 and 30 and lon between 70 and 120 and not (lat < 20 and lon < 90)""")
def region_minus_corner(t):
    """A region without one of its corners."""
    return t("evt").filter(geo.Box(10, 30, 70, 120).contains("lat", "lon") & ~((F.col("lat") < 20) & (F.col("lon") < 90))).select("event_id")


@query("""select k, sta, nz from meas where nz >= 0.04 and w < 0.95 * 0.08 and q >= 4""")
def reliable_rows(t):
    """Measurements whose time shift can be trusted."""
    return t("meas").filter(seismic.reliable_shift("nz", "w", "q", max_lag=0.08, least_cc=0.04)).select("k", "sta", "nz")


@query("""select m, count(*) filter (v not between 3.5 and 3.6) as n_outside, count(v) as n_valid from vox where ilat between 3 and 10 and ilon between 2 and 12 group by m""")
def crop_and_report(t):
    """Crop to a box, then count values outside a range; the data stay."""
    inside = filters.crop(t("vox").withColumnsRenamed({"ilat": "latitude", "ilon": "longitude"}), Box(3, 10, 2, 12), "v", ["v"])
    out = None
    for m in range(3):
        one = filters.range_report(inside.filter(F.col("m") == m), {"v": (3.5, 3.6)}).select(F.lit(m).alias("m"), n("n_outside").alias("n_outside"), n("n_valid").alias("n_valid"))
        out = one if out is None else out.unionByName(one)
    return out
