"""Queries of further column functions, filters, grids and similarity measures, each compared with plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakeframe.functions import geo, seismic, text
from quakeframe.operators import aggregates as agg
from quakeframe.operators import filters, fusion, grid, selection, similarity, waveform
from quakeframe.plans.registry import n, query, r

CELL = ["ilat", "ilon", "depth"]
E2 = "0.0066943799901413165"
SPHERE = "atan(tan(radians(lat)) * pow(1 - 1 / 298.257223563, 2))"


@query(f"""with u as (select event_id, cos({SPHERE}) * cos(radians(lon)) as x, cos({SPHERE}) * sin(radians(lon)) as y, sin({SPHERE}) as z, cos(radians(lat)) * cos(radians(lon)) as sx, sin(radians(lat)) as sz, depth from evt)
select event_id, round(x, 9) + 0.0 as x, round(y, 9) + 0.0 as y, round(z, 9) + 0.0 as z, round(sz, 9) + 0.0 as spherical_z, round(degrees(asin(z / sqrt(x * x + y * y + z * z))), 6) + 0.0 as lat_back, round(degrees(atan2(y, x)), 6) + 0.0 as lon_back, round(6371.0 - sqrt(x * x + y * y + z * z) * 6000.0, 6) + 0.0 as depth_back from u""")
def geo_vectors(t):
    """Unit vectors from geographic coordinates, and spherical coordinates and depth from vectors."""
    x, y, z = geo.unit_vector("lat", "lon")
    e = t("evt").withColumns({"x": x, "y": y, "z": z, "sz": geo.unit_vector("lat", "lon", geocentric=False)[2]})
    lat, lon, depth = geo.xyz_to_depth("x", "y", "z", 6000.0)
    return e.select("event_id", *[r(c, 9).alias(c) for c in "xyz"], r("sz", 9).alias("spherical_z"), r(lat).alias("lat_back"), r(lon).alias("lon_back"), r(depth).alias("depth_back"))


@query(f"""with g as (select event_id, lat, lon, depth, 6378137.0 / sqrt(1 - {E2} * pow(sin(radians(lat)), 2)) as n from evt)
select event_id, round((n + depth) * cos(radians(lat)) * cos(radians(lon)), 3) + 0.0 as x, round((n + depth) * cos(radians(lat)) * sin(radians(lon)), 3) + 0.0 as y, round((n * (1 - {E2}) + depth) * sin(radians(lat)), 3) + 0.0 as z,
  round(lat, 6) + 0.0 as lat_back, round(lon, 6) + 0.0 as lon_back, round(depth, 3) + 0.0 as height_back from g""")
def geo_ellipsoid(t):
    """Points on the ellipsoid to Earth-centred metres and back: the way back gives what it started from."""
    x, y, z = geo.geodetic_to_ecef("lat", "lon", "depth")
    e = t("evt").withColumns({"x": x, "y": y, "z": z})
    lat, lon, height = geo.ecef_to_geodetic("x", "y", "z")
    return e.select("event_id", *[r(c, 3).alias(c) for c in "xyz"], r(lat).alias("lat_back"), r(lon).alias("lon_back"), r(height, 3).alias("height_back"))


CHUNK = geo.Chunk(20.0, 95.0, 0.0, 60.0, 50.0)


@query(f"""with u as (select event_id, {SPHERE} as a, radians(lon - 95.0) as b, radians(20.0) as c from evt), v as (select event_id, cos(a) * sin(b) as xi, cos(c) * sin(a) - sin(c) * cos(a) * cos(b) as eta, sin(c) * sin(a) + cos(c) * cos(a) * cos(b) as up from u),
w as (select event_id, case when up > 0 then degrees(atan(xi / up)) end as xi, case when up > 0 then degrees(atan(eta / up)) end as eta from v)
select event_id, round(xi, 6) + 0.0 as xi, round(eta, 6) + 0.0 as eta, round(coalesce(least(30.0 - abs(xi), 25.0 - abs(eta)), -180.0), 6) + 0.0 as margin from w""")
def geo_chunk(t):
    """Local angles in a piece of the cubed sphere, and the margin to its edges."""
    xi, eta = CHUNK.xi_eta("lat", "lon")
    return t("evt").select("event_id", r(xi).alias("xi"), r(eta).alias("eta"), r(CHUNK.margin("lat", "lon")).alias("margin"))


@query("""select event_id, round(lon * 111.195 * cos(radians(30.0)), 6) + 0.0 as x, round(lat * 111.195, 6) + 0.0 as y, round(case when depth * 10 > 1000 then depth * 10 / 1000 else depth * 10 end, 6) as depth_km, round(4.0 * pow(2.0, event_id % 5), 6) as wavelength from evt""")
def scaled_points(t):
    """Coordinates in kilometres, depths in metres made kilometres, wavelengths of wavelet levels."""
    x, y, _ = geo.scaled("lon", "lat", "depth", 30.0)
    return t("evt").select("event_id", r(x).alias("x"), r(y).alias("y"), r(seismic.source_depth_km(F.col("depth") * 10)).alias("depth_km"), r(seismic.level_wavelength(4.0, F.col("event_id") % 5)).alias("wavelength"))


PHASES = "case event_id % 6 when 0 then 'P' when 1 then 'SV' when 2 then 'SH' when 3 then 'Rayleigh' when 4 then 'Love' else 'other' end"


@query(f"""with p as (select event_id, {PHASES} as phase, mag * 100 as arrival, depth / 10.0 as dist, case when event_id % 4 = 0 then 0.0 else 3.5 end as u, lat between 0 and 40 and lon between 70 and 120 as inside from evt)
select event_id, case when phase in ('P', 'SV', 'SH') then 'body' when phase in ('Rayleigh', 'Love') then 'surf' else 'full' end || '-Z' as class,
  round(case when phase in ('P', 'SV', 'SH') then arrival - greatest(10.0, 30.0 * 0.5) end, 6) as win_start, round(case when phase in ('P', 'SV', 'SH') then arrival + greatest(60.0, 80.0) end, 6) as win_end,
  round(case when u > 0 then dist * pi() / 180 * 6371.0 / u - 160.0 end, 5) + 0.0 as surf_start, round(case when u > 0 then dist * pi() / 180 * 6371.0 / u + 160.0 end, 5) + 0.0 as surf_end,
  inside and dist >= case when phase in ('SV', 'SH') then 10.0 else 3.0 end as kept from p""")
def phase_windows(t):
    """Classes and windows of phases, and which measurements are far enough."""
    names = F.array(*[F.lit(p) for p in ("P", "SV", "SH", "Rayleigh", "Love", "other")])
    e = t("evt").withColumns({"phase": F.get(names, (F.col("event_id") % 6).cast("int")), "arrival": F.col("mag") * 100, "dist": F.col("depth") / 10.0, "u": F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(3.5)})
    start, end = seismic.phase_window("phase", "arrival", 30.0, 80.0)
    s_start, s_end, _ = seismic.surface_window("dist", "u", 80.0)
    kept = seismic.keep_measurement(geo.Box(0, 40, 70, 120).contains("lat", "lon"), "dist", "phase")
    return e.select("event_id", seismic.phase_class("phase", F.lit("Z")).alias("class"), r(start).alias("win_start"), r(end).alias("win_end"), r(s_start, 5).alias("surf_start"), r(s_end, 5).alias("surf_end"), kept.alias("kept"))


@query("""with a as (select event, sta * 37 % 360 as az, sta % 100 as d from (select distinct event, sta from meas) x), s as (select event, count(*) as n, stddev_pop(d) as sd, avg(d) as m from a group by event)
select event, round(case when n < 4 then 0.3 else greatest(0.0, 1 - (event * 9 % 360) / 180.0) end, 6) + 0.0 as gap_score, round(case when n < 3 then 0.5 else greatest(0.0, 1 - abs(sd / m - 0.3) / 0.3) end, 6) + 0.0 as spread_score from s""")
def coverage_scores(t):
    """Scores of azimuthal gaps and of distance distributions."""
    s = t("meas").select("event", "sta").distinct().groupBy("event").agg(F.count("*").alias("n"), F.stddev_pop(F.col("sta") % 100).alias("sd"), F.avg(F.col("sta") % 100).alias("m"))
    gap = (F.col("event") * 9 % 360).cast("double")
    return s.select("event", r(seismic.gap_score(gap, "n")).alias("gap_score"), r(seismic.spread_score("sd", "m", "n")).alias("spread_score"))


@query("""with p as (select sta, case sta % 3 when 0 then '/d/ev/' || net || '.S' || cast(sta as varchar(9)) || '.00.BHZ.sac' when 1 then '/d/' || net || '.S' || cast(sta as varchar(9)) || '__x.y.mseed' else '/d/plain' end as path, net from station)
select sta, case when sta % 3 < 2 then net || '.S' || cast(sta as varchar(9)) end as key, case when sta % 3 = 0 then net end as network, case when sta % 3 = 0 then '00' end as location, case when sta % 3 = 0 then 'BHZ' end as channel,
  case when sta % 2 = 0 then '5_2' else '0_0' end as module, 'Fast mantle' as label, net || '_short' as short, '1.50e+03' as number from p""")
def file_names(t):
    """Keys and fields from waveform file names, module prefixes and short labels."""
    code = F.concat(F.lit("S"), F.col("sta").cast("string"))
    name = F.concat(F.col("net"), F.lit("."), code)
    s = t("station").withColumn("name", F.when(F.col("sta") % 3 == 0, F.concat(name, F.lit(".00.BHZ.sac"))).when(F.col("sta") % 3 == 1, F.concat(name, F.lit("__x.y.mseed"))).otherwise("plain"))
    fields = text.waveform_fields("name")
    dotted = F.col("sta") % 3 == 0
    module = text.module_prefix(F.when(F.col("sta") % 2 == 0, "/a/5_2_GCMT.py").otherwise("/a/plot.py"))
    short = F.concat(F.col("net"), F.lit("_short (long, and much longer) text"))
    return s.select("sta", text.waveform_key(F.concat(F.lit("/d/ev/"), "name")).alias("key"), *[F.when(dotted, c).alias(a) for c, a in zip((fields[0], fields[2], fields[3]), ("network", "location", "channel"), strict=True)], module.alias("module"), text.short_label(F.lit("Fast mantle [cold]")).alias("label"), text.short_label(short).alias("short"), text.scientific(1500.0).alias("number"))


@query("""select event_id, strftime(t, '%Y%m%d.%H.%M') as folder, case when event_id % 5 = 0 then null when event_id % 5 = 1 then 'bad' else cast(elev as varchar(20)) end is not null as had, case when event_id % 5 in (0, 1) then 0.0 else elev end as elevation, coalesce(case when event_id % 2 = 0 then 'x' end, '') as site from (select *, cast(event_id as double) as elev from evt) x where case when event_id % 7 = 0 then 95.0 else lat end between -90 and 90""")
def cleaned_stations(t):
    """Rows with valid coordinates; elevations that are no number are 0, missing text is empty."""
    k = F.col("event_id") % 5
    e = t("evt").withColumns({"elevation": F.when(k == 1, "bad").when(k != 0, F.col("event_id").cast("double").cast("string")), "site": F.when(F.col("event_id") % 2 == 0, "x"), "lat": F.when(F.col("event_id") % 7 == 0, 95.0).otherwise(F.col("lat"))})
    e = e.withColumn("had", F.col("elevation").isNotNull())
    return filters.clean_stations(e, "lat", "lon", "elevation", ["site"]).select("event_id", text.event_directory("t").alias("folder"), "had", F.col("elevation").cast("double").alias("elevation"), "site")


@query("""select id, e is null and (date '2000-01-01' - s) / 365.25 > 4.5 as lasting from validity""")
def permanent_stations(t):
    """Intervals that are open and have lasted for years."""
    return t("validity").select("id", filters.permanent("s", "e", F.lit("2000-01-01").cast("date"), 4.5).alias("lasting"))


@query("""select vec_id, list_max(list_transform(embedding, lambda x: abs(x))) between 0.2 and 0.4 as loud, len(embedding) >= 64 and len(list_filter(embedding, lambda x: abs(cast(x as double) - med) > 2.5 * 1.4826 * mad)) / len(embedding) <= 0.02 as clean
from (select *, list_aggregate(list_transform(embedding, lambda x: abs(cast(x as double) - med)), 'median') as mad from (select *, cast(list_aggregate(list_transform(embedding, lambda x: cast(x as double)), 'median') as double) as med from emb) a) b""")
def trace_filters(t):
    """Traces of an amplitude in a range, and those with few glitches."""
    return t("emb").select("vec_id", filters.amplitude_quality("embedding", 0.2, 0.4).alias("loud"), filters.trace_quality("embedding", 64, 0.02, 2.5).alias("clean"))


@query("""select m, ilat, ilon, depth, round(sqrt((2 * vsv * vsv + vsh * vsh) / 3), 6) as vs, round(sqrt((5 * vp * vp) / 5), 6) as vp, rho, 1.0 as eta, qmu from (select m, ilat, ilon, depth, coalesce(case when ilat % 2 = 0 then v * 0.99 end, v) as vsv, v as vsh, v * 1.75 as vp, coalesce(case when ilon % 3 = 0 then 2900.0 end, 3300.0) as rho, 600.0 as qmu from vox) x""")
def canonical_model(t):
    """Standard parameters of a model with missing ones filled."""
    v = t("vox").select("m", *CELL, F.col("v").alias("vs"), (F.col("v") * 1.75).alias("vp"), F.when(F.col("ilat") % 2 == 0, F.col("v") * 0.99).otherwise(F.lit(float("nan"))).alias("vsv"), F.when(F.col("ilon") % 3 == 0, 2900.0).alias("rho"))
    return grid.canonical(v).select("m", *CELL, r("vs").alias("vs"), r("vp").alias("vp"), "rho", "eta", "qmu")


@query("""with a as (select m, depth, avg(v) as mean from vox group by m, depth) select m, ilat, ilon, depth, round(ln(v / coalesce(case when ilat % 4 = 0 then 3.6 end, mean)) * 100, 6) + 0.0 as dlnv from vox join a using (m, depth)""")
def grid_log_perturbation(t):
    """Log of a value over its reference, or its level's mean where that is missing."""
    v = t("vox").withColumn("ref", F.when(F.col("ilat") % 4 == 0, 3.6))
    return grid.log_perturbation(v, ["m"], "depth", "v", "ref", 100.0).select("m", *CELL, r("dlnv").alias("dlnv"))


@query("""with p as (select event_id, (lat + 10) / 3.5 as a, (lon - 60) / 4.5 as b, depth / 100.0 as c from evt where event_id % 3 = 0), q as (select event_id, a, b, c, cast(floor(round(a, 9)) as int) as i, cast(floor(round(b, 9)) as int) as j, cast(floor(round(c, 9)) as int) as k from p),
w as (select event_id, i + x.d as ilat, j + y.d as ilon, (k + z.d) * 100.0 as depth, (case when x.d = 1 then round(a, 9) - i else 1 - round(a, 9) + i end) * (case when y.d = 1 then round(b, 9) - j else 1 - round(b, 9) + j end) * (case when z.d = 1 then round(c, 9) - k else 1 - round(c, 9) + k end) as w
  from q, (values (0), (1)) x(d), (values (0), (1)) y(d), (values (0), (1)) z(d)),
h as (select w.event_id, w.w, v.v from w left join (select * from vox where m = 1) v on w.ilat = v.ilat and w.ilon = v.ilon and w.depth = v.depth where w.w > 0)
select event_id, round(case when count(v) = count(*) then sum(w * v) end, 5) as v from h group by event_id""")
def grid_trilinear(t):
    """A model between its nodes; null where a corner of weight is missing."""
    g = t("vox").filter("m = 1").withColumn("idepth", F.round(F.col("depth") / 100).cast("int"))
    return grid.trilinear(t("evt").filter("event_id % 3 = 0").select("event_id", "lat", "lon", "depth"), g, "event_id", "v", (-10.0, 60.0, 0.0), (3.5, 4.5, 100.0)).select("event_id", r("v", 5).alias("v"))


@query("""select e.event_id, round(v.v, 6) as v from evt e left join (select * from vox where m = 0 and depth = 100) v on cast(floor((lat + 10) / 3.5 + 0.5) as int) = v.ilat and cast(floor((lon - 60) / 4.5 + 0.5) as int) = v.ilon""")
def grid_nearest(t):
    """Value of the nearest node."""
    return grid.nearest_sample(t("evt").select("event_id", "lat", "lon"), t("vox").filter("m = 0 and depth = 100"), "v", (-10.0, 60.0), (3.5, 4.5)).select("event_id", r("v").alias("v"))


@query("""with x as (select m, ilat, ilon, cast(depth / 100 as int) as idepth, v from vox) select a.m, a.ilat, a.ilon, a.idepth, round(coalesce(sum(b.v * case when a.idepth <> b.idepth then 2.0 when a.ilon <> b.ilon then 0.5 else 1.0 end), 0), 5) as field from x a left join x b on a.m = b.m and abs(a.ilat - b.ilat) + abs(a.ilon - b.ilon) + abs(a.idepth - b.idepth) = 1 and b.v is not null group by 1, 2, 3, 4""")
def grid_neighbours(t):
    """Weighted sum of a voxel's six neighbours."""
    x = t("vox").withColumn("idepth", F.round(F.col("depth") / 100).cast("int"))
    return grid.neighbours(x, ["m"], ("ilat", "ilon", "idepth"), "v", (1.0, 0.5, 2.0)).select("m", "ilat", "ilon", "idepth", r("field", 5).alias("field"))


@query("""with x as (select ilat, ilon, v is not null and ilat % 3 <> 1 as ok from vox where m = 0 and depth = 100) select a.ilat, a.ilon, case when a.ok then case when exists (select 1 from x b where b.ok and abs(a.ilat - b.ilat) + abs(a.ilon - b.ilon) = 1) then 'fine' else 'coarse' end end as resolution from x a""")
def grid_resolution(t):
    """Cells with and without a valid neighbour."""
    x = t("vox").filter("m = 0 and depth = 100")
    return grid.resolution_class(x, "ilat", "ilon", F.col("v").isNotNull() & (F.col("ilat") % 3 != 1)).select("ilat", "ilon", "resolution")


@query("""with x as (select m, depth, ilat, ilon, case when ilat between 4 and 15 and ilon between 3 and 16 then null else v end as v from vox),
d as (select a.m, a.depth, a.ilat, a.ilon, b.v, row_number() over (partition by a.m, a.depth, a.ilat, a.ilon order by pow(a.ilat - b.ilat, 2) + pow(a.ilon - b.ilon, 2), b.ilat, b.ilon) as k from x a join x b on a.m = b.m and a.depth = b.depth and b.v is not null where a.v is null)
select x.m, x.depth, x.ilat, x.ilon, round(coalesce(x.v, d.v), 6) as v from x left join d on x.m = d.m and x.depth = d.depth and x.ilat = d.ilat and x.ilon = d.ilon and d.k = 1""")
def grid_filled(t):
    """Missing cells of every model from the nearest valid one, however far."""
    x = t("vox").withColumn("v", F.when(~(F.col("ilat").between(4, 15) & F.col("ilon").between(3, 16)), F.col("v")))
    return grid.fill_all_nearest(x, ["m", "depth"], "ilat", "ilon", "v").select("m", "depth", "ilat", "ilon", r("v").alias("v"))


@query("""with c as (select cast(o_orderkey % 3 as int) as g, cast(floor(o_orderkey / 3) as int) % 260 as i, cast(floor(o_orderkey / 780) as int) % 230 as j, avg(cast(o_totalprice as double)) as p from ord group by 1, 2, 3),
x as (select g, i, j, case when i between 30 and 229 and j between 3 and 202 then null else p end as v from c),
d as (select a.g, a.i, a.j, min((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j)) as near, arg_min(b.v, (a.i - b.i) * (a.i - b.i) * 100000.0 * 100000 + (a.j - b.j) * (a.j - b.j) * 100000.0 * 100000 + b.i * 1000.0 + b.j) as v from x a join x b on a.g = b.g where a.v is null and b.v is not null group by a.g, a.i, a.j)
select x.g, x.i, x.j, round(coalesce(x.v, d.v), 4) as v from x left join d on x.g = d.g and x.i = d.i and x.j = d.j""")
def grid_filled_wide(t):
    """Holes 200 cells wide, in grids that lack cells too, from the nearest valid cell."""
    c = t("ord").select((F.col("o_orderkey") % 3).cast("int").alias("g"), (F.floor(F.col("o_orderkey") / 3).cast("int") % 260).alias("i"), (F.floor(F.col("o_orderkey") / 780).cast("int") % 230).alias("j"), F.col("o_totalprice").cast("double").alias("p"))
    x = c.groupBy("g", "i", "j").agg(F.avg("p").alias("p")).select("g", "i", "j", F.when(~(F.col("i").between(30, 229) & F.col("j").between(3, 202)), F.col("p")).alias("v"))
    return grid.fill_all_nearest(x, ["g"], "i", "j", "v").select("g", "i", "j", r("v", 4).alias("v"))


@query("""with p as (select a.m, a.depth, a.ilat as i, a.ilon as j, count(b.v) as c, string_agg(cast(round(b.v * 1000) as bigint), ',' order by b.ilat, b.ilon) as patch from vox a join vox b on a.m = b.m and a.depth = b.depth and b.ilat - a.ilat between 0 and 2 and b.ilon - a.ilon between 0 and 2 where a.ilat % 2 = 0 and a.ilon % 2 = 0 group by 1, 2, 3, 4)
select m, depth, i as patch_i, j as patch_j, patch from p where c = 9""")
def grid_patches(t):
    """Whole square windows of the levels."""
    p = grid.patches(t("vox"), ["m", "depth"], "ilat", "ilon", "v", 3, 2)
    return p.select("m", "depth", "patch_i", "patch_j", F.array_join(F.transform("patch", lambda v: F.round(v * 1000).cast("long").cast("string")), ",").alias("patch"))


@query("""with p as (select a.m, a.depth, a.ilat as i, a.ilon as j from vox a join vox b on a.m = b.m and a.depth = b.depth and b.ilat - a.ilat between 0 and 2 and b.ilon - a.ilon between 0 and 2 where a.ilat % 2 = 0 and a.ilon % 2 = 0 group by 1, 2, 3, 4 having count(b.v) = 9)
select distinct v.m, v.depth, v.ilat as i, v.ilon as j, round(v.v, 6) as v from p join vox v on v.m = p.m and v.depth = p.depth and v.ilat - p.i between 0 and 2 and v.ilon - p.j between 0 and 2""")
def grid_stitched(t):
    """Patches put together again: every cell that one covers has its value back."""
    p = grid.patches(t("vox"), ["m", "depth"], "ilat", "ilon", "v", 3, 2)
    return grid.stitch(p, ["m", "depth"], 3, grid.patch_weight(3), value="v").select("m", "depth", "i", "j", r("v").alias("v"))


_LABEL = "case when v is null then null when v >= 3.62 + 0.0004 * depth - 0.05 then 1 when v <= 3.52 + 0.0004 * depth then -1 else 0 end"


def _labelled(t):
    hi, lo = F.lit(3.62) + F.col("depth") * 0.0004 - 0.05, F.lit(3.52) + F.col("depth") * 0.0004
    return t("vox").withColumn("label", F.when(F.col("v").isNull(), None).when(F.col("v") >= hi, 1).when(F.col("v") <= lo, -1).otherwise(0))


@query(f"""with l as (select ilat, ilon, depth, max(case when m = 0 then label end) as a, max(case when m = 1 then label end) as b, max(case when m = 2 then label end) as c from (select *, {_LABEL} as label from vox) x group by 1, 2, 3)
select ilat, ilon, depth, cast(case when a = b and b = c then -1 when b = c then 0 when a = c then 1 when a = b then 2 when a is not null and b is not null and c is not null then 3 end as int) as dissent from l""")
def grid_dissent(t):
    """Which of three models differs in its class."""
    x = _labelled(t).withColumn("m", F.concat(F.lit("m"), F.col("m").cast("string")))
    return grid.dissent(x, CELL, "m", "label", ("m0", "m1", "m2"))


@query(f"""select ilat, ilon, depth, cast(case when count(label) = 3 then sum(label) end as bigint) as vote_sum, count(*) filter (label = 1) as n_fast, count(*) filter (label = -1) as n_slow, count(label) as n_valid from (select *, {_LABEL} as label from vox) x group by 1, 2, 3""")
def class_votes(t):
    """Sum of the models' classes in each cell."""
    return fusion.class_vote(_labelled(t), CELL, "label", 3)


@query(f"""with c as (select ilat, ilon, depth, count(*) filter (label = 1) as f, count(*) filter (label = -1) as s, count(label) as n from (select *, {_LABEL} as label from vox) x group by 1, 2, 3)
select depth, round(count(*) filter (n = 3 and f = 3) * 1.0 / nullif(count(*) filter (n = 3), 0), 6) as fast_frac, round(count(*) filter (n = 3 and s = 3) * 1.0 / nullif(count(*) filter (n = 3), 0), 6) as slow_frac, count(*) filter (n = 3) as n_cells from c group by depth""")
def class_agreement(t):
    """Shares of cells in which all models agree, by depth."""
    return fusion.agreement_profile(fusion.class_vote(_labelled(t), CELL, "label", 3), "depth", 3).withColumns({c: r(c) for c in ("fast_frac", "slow_frac")})


@query("""select ilat, ilon, depth, case when depth <= 100 then case when v >= 3.6 then 1 when v <= 3.55 then -1 when v is not null then 0 end else case when v >= 3.7 then 1 when v <= 3.6 then -1 when v is not null then 0 end end as class from vox where m = 2""")
def cluster_classes(t):
    """Fast, slow or neutral by the thresholds of a band."""
    x = t("vox").filter("m = 2").withColumn("band", F.when(F.col("depth") <= 100, "top").otherwise("low"))
    return x.select(*CELL, agg.class_of_cluster(x, "v", "band", {"top": (3.55, 3.6), "low": (3.6, 3.7)}).alias("class"))


@query("""with b as (select m, ilat, ilon, depth, v, least(1.0, greatest(0.0, (ilat - 5) / 10.0)) as w, 3.6 as base from vox) select m, ilat, ilon, depth, round(case when v is null or w <= 0 then base else w * v + (1 - w) * base end, 6) as blended from b""")
def grid_blend(t):
    """A model blended into a base by weight."""
    return grid.blend(_weighted(t), "w", "v", "base").select("m", *CELL, r("blended").alias("blended"))


def _weighted(t):
    return t("vox").withColumns({"w": F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("ilat") - 5) / 10.0)), "base": F.lit(3.6)})


@query("select 0 as n_outside, 0 as n_changed, 0 as n_not_model, 0 as n_missing from (select count(*) from vox) x")
def grid_blend_checks(t):
    """A blend breaks none of its rules."""
    return grid.blend_checks(grid.blend(_weighted(t), "w", "v", "base").filter("v is not null"), "w", "v", "base")


@query("""select event_id, depth between lat * 10 and lat * 10 + 150 as inside from evt""")
def slab_membership(t):
    """Points inside a slab."""
    return t("evt").select("event_id", grid.slab_mask(t("evt"), F.col("lat") * 10, F.lit(150.0), "depth").alias("inside"))


@query("""with s as (select m, var_pop(v) as a, covar_pop(v, ilat / 10.0) as b, var_pop(case when v is not null then ilat / 10.0 end) as c, corr(v, ilat / 10.0) as corr from vox group by m)
select m, round(degrees(atan2(2 * b, a - c)) / 2, 4) + 0.0 as angle, round(sqrt((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b)), 6) as along, round(sqrt((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b)), 6) as across, round(corr, 6) + 0.0 as corr from s""")
def principal_axes(t):
    """First principal axis of two values."""
    x = t("vox").filter("v is not null").withColumn("y", F.col("ilat") / 10.0)
    return grid.principal_axis(x, ["m"], "v", "y").select("m", r("angle", 4).alias("angle"), r("along").alias("along"), r("across").alias("across"), r("corr").alias("corr"))


_PAIRS = "select a.m as model_a, b.m as model_b, a.ilat, a.ilon, a.depth, a.v as x, b.v as y, cos(radians(a.ilat)) as w from vox a join vox b on a.ilat = b.ilat and a.ilon = b.ilon and a.depth = b.depth and a.m < b.m where a.v is not null and b.v is not null"


def _pairs(t):
    return similarity.model_pairs(t("vox"), CELL, "m", "v")


@query(f"""with p as ({_PAIRS}), c as (select model_a, model_b, sum(w * x) / sum(w) as mx, sum(w * y) / sum(w) as my from p group by 1, 2)
select model_a, model_b, count(*) as n, round(sum(w * (x - mx) * (y - my)) / sqrt(sum(w * (x - mx) * (x - mx)) * sum(w * (y - my) * (y - my))), 6) as pearson from p join c using (model_a, model_b) group by 1, 2""")
def model_pearson(t):
    """Area-weighted correlation of every two models."""
    p = similarity.weighted_pearson(_pairs(t), ["model_a", "model_b"], "x", "y", F.cos(F.radians("ilat")))
    return p.withColumn("pearson", r("pearson"))


@query(f"""with p as (select model_a, model_b, x - 3.65 as x, y - 3.65 as y, w from ({_PAIRS}) z), c as (select model_a, model_b, quantile_cont(abs(x), 0.5) as cx, quantile_cont(abs(y), 0.5) as cy from p group by 1, 2)
select model_a, model_b, round(sum(case when sign(x) = sign(y) then w else 0 end) / sum(w), 6) as agreement, count(*) as n from p join c using (model_a, model_b) where abs(x) >= cx and abs(y) >= cy group by 1, 2""")
def model_signs(t):
    """Share of equal signs among large anomalies of two models."""
    p = _pairs(t).withColumns({"x": F.col("x") - 3.65, "y": F.col("y") - 3.65})
    return similarity.sign_agreement(p, ["model_a", "model_b"], "x", "y", F.cos(F.radians("ilat"))).withColumn("agreement", r("agreement"))


@query(f"""select model_a, model_b, depth, round(sqrt(sum(w * (x * x + y * y)) / (2 * sum(w))), 6) as rms from ({_PAIRS}) p group by 1, 2, 3""")
def model_rms(t):
    """Pooled root mean square of two models by depth."""
    return similarity.pooled_rms(_pairs(t), ["model_a", "model_b", "depth"], "x", "y", F.cos(F.radians("ilat"))).withColumn("rms", r("rms"))


@query(f"""with p as ({_PAIRS}), k as (select model_a, model_b, rank() over (partition by model_a, model_b order by x) + (count(*) over (partition by model_a, model_b, x) - 1) / 2.0 as rx, rank() over (partition by model_a, model_b order by y) + (count(*) over (partition by model_a, model_b, y) - 1) / 2.0 as ry from p)
select model_a, model_b, round(corr(rx, ry), 6) as spearman, count(*) as n from k group by 1, 2""")
def model_spearman(t):
    """Rank correlation of every two models."""
    return similarity.rank_correlation(_pairs(t)).withColumn("spearman", r("spearman"))


@query(f"""with p as ({_PAIRS}), c as (select model_a, model_b, corr(x, y) as c from p group by 1, 2), s as (select model_a, model_b, c from c union all select model_b, model_a, c from c union all select distinct m, m, 1.0 from vox)
select model_a, round(max(case when model_b = 0 then c end), 6) as m0, round(max(case when model_b = 1 then c end), 6) as m1, round(max(case when model_b = 2 then c end), 6) as m2 from s group by model_a""")
def model_matrix(t):
    """Correlations of all models as a square table."""
    named = t("vox").withColumn("m", F.col("m").cast("string"))
    m = similarity.pair_matrix(similarity.correlation_matrix(similarity.model_pairs(named, CELL, "m", "v")), "corr", ["0", "1", "2"])
    return m.select(F.col("model_a").cast("int").alias("model_a"), *[r(f"`{k}`").alias(f"m{k}") for k in range(3)])


_LABELS = "select cast(ilat % 4 as int) as a, cast(floor(v * 20) as int) % 5 as b from vox where m = 0 and v is not null"


@query(f"""with t as (select a, b, count(*) * 1.0 as n from ({_LABELS}) x group by 1, 2), s as (select sum(n) as n, sum(n * (n - 1) / 2) as pc, sum(n * ln(n)) as hc from t), ra as (select sum(m * (m - 1) / 2) as p, sum(m * ln(m)) as h from (select sum(n) as m from t group by a) x), rb as (select sum(m * (m - 1) / 2) as p, sum(m * ln(m)) as h from (select sum(n) as m from t group by b) x)
select cast(s.n as bigint) as n, round((pc - ra.p * rb.p / (s.n * (s.n - 1) / 2)) / ((ra.p + rb.p) / 2 - ra.p * rb.p / (s.n * (s.n - 1) / 2)), 6) + 0.0 as ari, round(2 * ((ln(s.n) - ra.h / s.n) + (ln(s.n) - rb.h / s.n) - (ln(s.n) - hc / s.n)) / ((ln(s.n) - ra.h / s.n) + (ln(s.n) - rb.h / s.n)), 6) as nmi from s, ra, rb""")
def label_likeness(t):
    """Adjusted Rand index and mutual information of two labellings."""
    x = t("vox").filter("m = 0 and v is not null").select((F.col("ilat") % 4).alias("a"), (F.floor(F.col("v") * 20).cast("int") % 5).alias("b"))
    return similarity.label_agreement(x, [], "a", "b").withColumns({c: r(c) for c in ("ari", "nmi")})


@query("""with a as (select event_id, depth / 10.0 as d, case event_id % 2 when 0 then 'P' else 'S' end as phase from evt), c as (select p as phase, i * 5.0 as dist_deg, i * i * f + 10.0 as t from (values ('P', 1.0), ('S', 1.8)) v(p, f), (select unnest(range(0, 13)) as i) g), s as (select *, lead(dist_deg) over (partition by phase order by dist_deg) as d2, lead(t) over (partition by phase order by dist_deg) as t2 from c)
select event_id, round(s.t + coalesce((d - dist_deg) / (d2 - dist_deg) * (t2 - s.t), 0), 6) as t_pred from a left join s on a.phase = s.phase and d >= dist_deg and (d < d2 or d2 is null and d = dist_deg)""")
def travel_time_table(t):
    """Arrival times between the points of a table; none outside it."""
    curve = t.spark.range(13).select(F.explode(F.array(F.struct(F.lit("P").alias("phase"), F.lit(1.0).alias("f")), F.struct(F.lit("S").alias("phase"), F.lit(1.8).alias("f")))).alias("p"), (F.col("id") * 5.0).alias("dist_deg"), "id")
    curve = curve.select("p.phase", "dist_deg", (F.col("id") * F.col("id") * F.col("p.f") + 10.0).alias("t"))
    asked = t("evt").select("event_id", (F.col("depth") / 10.0).alias("dist_deg"), F.when(F.col("event_id") % 2 == 0, "P").otherwise("S").alias("phase"))
    return waveform.travel_times(asked, curve).select("event_id", r("t_pred").alias("t_pred"))


@query("""select vec_id, round(list_max(list_transform(embedding[21:40], lambda v: abs(cast(v as double)))) / (2 * sqrt(list_sum(list_transform(embedding[1:20], lambda v: cast(v as double) * cast(v as double))) / 20)), 6) as snr,
  round(list_sum(list_transform(range(1, 33), lambda k: pow(-(cast(embedding[k] as double) * cos(radians(30.0)) + cast(embedding[k + 32] as double) * sin(radians(30.0))), 2))), 6) as radial_power, round(list_sum(list_transform(range(1, 33), lambda k: pow(cast(embedding[k] as double) * sin(radians(30.0)) - cast(embedding[k + 32] as double) * cos(radians(30.0)), 2))), 6) as transverse_power from emb""")
def trace_components(t):
    """Signal over noise of a window, and horizontal components turned to the source."""
    e = t("emb").withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    radial, transverse = waveform.rotate_horizontal(F.slice("x", 1, 32), F.slice("x", 33, 32), 30.0)
    power = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    return e.select("vec_id", r(waveform.window_snr("x", 20, 40, 20)).alias("snr"), r(power(radial)).alias("radial_power"), r(power(transverse)).alias("transverse_power"))


@query("""with w as (select sta, net, greatest(max(lat) over (partition by net) - min(lat) over (partition by net), 0.02) * greatest(max(lon) over (partition by net) - min(lon) over (partition by net), 0.02) as area from station) select sta from w where net not in ('N1', 'N2') or net = (select net from w where net in ('N1', 'N2') order by area desc, net limit 1)""")
def exclusive_networks(t):
    """Stations without the smaller of two networks."""
    s = t("station")
    return selection.smaller_of_two(s, "net", "N1", "N2", agg.bbox_area(s, ["net"], "lat", "lon")).select("sta")


@query("""with k as (select event_id, year, lat, lon, mag, row_number() over (partition by year order by mag desc, event_id) as k from evt) select cast(year as int) as year, count(*) as n, round(avg(mag), 6) as mean_mag from k where k <= 20 group by year""")
def yearly_largest(t):
    """The twenty largest events of each year."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("year").orderBy(F.desc("mag"), "event_id"))
    return t("evt").withColumn("k", k).filter("k <= 20").groupBy("year").agg(n(F.count("*")).alias("n"), r(F.avg("mag")).alias("mean_mag"))


@query("""with p as (select vec_id, list_transform(embedding, lambda v: cast(v as double)) as a, list_transform(embedding, lambda v: cast(v as double) * (1.0 + (vec_id % 7) / 10.0)) as b, vec_id % 5 as event, case vec_id % 2 when 0 then 'near' else 'far' end as band from emb),
m as (select event, band, list_sum(list_transform(range(1, 65), lambda k: a[k] * b[k])) / sqrt(list_sum(list_transform(a, lambda v: v * v)) * list_sum(list_transform(b, lambda v: v * v))) as nz, 0.5 * ln(list_sum(list_transform(b, lambda v: v * v)) / list_sum(list_transform(a, lambda v: v * v))) as amp, vec_id from p),
k as (select *, 1.0 + vec_id % 3 as w from m where amp <= 0.4), s as (select event, band, round(amp, 9) as amp, sum(w) as w from k group by 1, 2, 3), c as (select *, sum(w) over (partition by event, band order by amp rows unbounded preceding) as cw, sum(w) over (partition by event, band) as tw from s), d as (select event, band, min(amp) as med from c where cw >= tw * 0.5 - 1e-9 group by 1, 2), f as (select event, round(min(nz), 6) as least_nz, count(*) as n from k group by event)
select event, round(avg(med), 6) + 0.0 as score, count(*) as n_classes, least_nz, n from d join f using (event) group by event, least_nz, n""")
def assessed_traces(t):
    """From pairs of traces to the score table: measured, filtered by quality, weighed by class, joined with counts."""
    pairs = t("emb").withColumns({"x": F.transform("embedding", lambda v: v.cast("double")), "f": F.lit(1.0) + (F.col("vec_id") % 7) / 10.0})
    pairs = pairs.withColumns({"test": F.transform("x", lambda v: v * F.col("f")), "event": F.col("vec_id") % 5, "band": F.when(F.col("vec_id") % 2 == 0, "near").otherwise("far"), "w": (F.col("vec_id") % 3 + 1).cast("double")})
    measured = waveform.measure_pairs(pairs, ["vec_id", "event", "band", "w"], "x", "test", 1.0, 10.0)
    kept = filters.accept(measured, [("amplitude", F.col("dln_a") <= 0.4)]).withColumn("amp", F.round("dln_a", 9))
    score = agg.two_level(kept, ["event"], "band", "amp", "w")
    counts = kept.groupBy("event").agg(r(F.min("nzcc")).alias("least_nz"), n(F.count("*")).alias("n"))
    return score.join(counts, "event").withColumn("score", r("score"))
