"""Queries of joins, aggregates, windows and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakeframe.functions.numeric import nearest_second
from quakeframe.operators import aggregates as agg
from quakeframe.operators import joins, selection, windows
from quakeframe.plans.registry import n, query, r
from quakeframe.plans.scalars import haversine_sql

EV = "cast(extract(epoch from ts) as bigint)"


@query(f"""with l as (select event_id as lid, user_id, {EV} as lt from ev where event_id % 7 = 0), g as (select event_id as rid, user_id, {EV} as rt, value from ev where event_id % 7 <> 0),
p as (select lid, rid, value, row_number() over (partition by lid order by abs(rt - lt), rt, rid) as k from l join g using (user_id) where abs(rt - lt) <= 36000)
select l.lid, p.rid, round(p.value, 6) + 0.0 as value from l left join (select * from p where k = 1) p on l.lid = p.lid""")
def join_as_of(t):
    """Nearest row in time by key, ten hours away at most."""
    e = t("ev").withColumn("s", nearest_second("ts"))
    left = e.filter("event_id % 7 = 0").select(F.col("event_id").alias("lid"), "user_id", F.col("s").alias("lt"))
    right = e.filter("event_id % 7 <> 0").select("user_id", F.col("event_id").alias("rid"), F.col("s").alias("rt"), "value")
    return joins.as_of(left, right, ["user_id"], "lt", "rt", "rid", 36000).select("lid", "rid", r("value").alias("value"))


@query("""with a as (select event_id as lid, year, cast(event_id % 23 as int) as h, cast(event_id * 7 % 60 as int) as mi from evt where event_id % 3 = 0), b as (select event_id as rid, year, cast(event_id % 23 as int) as h, cast(event_id * 11 % 60 as int) as mj from evt where event_id % 3 <> 0)
select lid, rid from (select lid, rid, row_number() over (partition by lid order by abs(mi - mj), rid) as k from a join b on a.year = b.year and a.h = b.h where abs(mi - mj) <= 2) x where k = 1""")
def join_in_hour(t):
    """Match within the hour, the nearest minute taken."""
    e = t("evt").withColumn("h", (F.col("event_id") % 23).cast("int"))
    a = e.filter("event_id % 3 = 0").select(F.col("event_id").alias("lid"), "year", "h", (F.col("event_id") * 7 % 60).cast("int").alias("mi"))
    b = e.filter("event_id % 3 <> 0").select(F.col("event_id").alias("rid"), "year", "h", (F.col("event_id") * 11 % 60).cast("int").alias("mj"))
    return joins.match_in_hour(a, b, ["year", "h"], "mi", "mj", "rid", 2, "lid").select("lid", "rid")


@query("""with x as (select event_id as k, event_id * 7919 % 10000000 as s from evt) select k, s from x a where not exists (select 1 from x b where b.k <> a.k and b.s >= a.s - 60 and b.s < a.s + 60)""")
def join_interval_anti(t):
    """Rows without another one in a time window."""
    return joins.without_interference(t("evt").select(F.col("event_id").alias("k"), (F.col("event_id") * 7919 % 10000000).alias("s")), "k", "s", 60)


@query("""with l as (select sta as left_id, net, sta % 50 as s, sta % 3 as c from station where sta % 4 <> 0), g as (select sta + 1000000 as right_id, case when sta % 5 = 0 then 'N9' else net end as net, sta % 50 as s, sta % 3 as c from station where sta % 3 <> 0),
f as (select left_id, right_id from l join g using (net, s, c)), rl as (select * from l where left_id not in (select left_id from f)), rr as (select * from g where right_id not in (select right_id from f)),
u as (select min(left_id) as left_id, s, c from rl group by s, c having count(*) = 1), w as (select min(right_id) as right_id, s, c from rr group by s, c having count(*) = 1), l2 as (select left_id, right_id from u join w using (s, c))
select left_id, right_id, 'strict' as phase from f union all select left_id, right_id, 'loose' from l2 union all select left_id, null, null from rl where left_id not in (select left_id from l2) union all select null, right_id, null from rr where right_id not in (select right_id from l2)""")
def join_two_phase(t):
    """Strict match, then loose where unique on both sides."""
    s = t("station").withColumns({"s": F.col("sta") % 50, "c": F.col("sta") % 3})
    left = s.filter("sta % 4 <> 0").select(F.col("sta").alias("left_id"), "net", "s", "c")
    right = s.filter("sta % 3 <> 0").select((F.col("sta") + 1000000).alias("right_id"), F.when(F.col("sta") % 5 == 0, "N9").otherwise(F.col("net")).alias("net"), "s", "c")
    return joins.two_phase(left, right, ["net", "s", "c"], ["s", "c"])


@query("""select event, sta, phase from meas group by event, sta, phase having count(distinct model) = (select count(distinct m2.model) from meas m2 where m2.event = meas.event)""")
def join_division(t):
    """Windows that every model of an event has."""
    return joins.division(t("meas"), ["event"], ["sta", "phase"], "model")


@query("""with a as (select distinct depth as d1 from vox), b as (select distinct depth * 1.02 + 3 as d2 from vox) select d1, round(d2, 6) as d2 from (select d1, d2, row_number() over (partition by d1 order by abs(d1 - d2), d2) as k from a join b on abs(d1 - d2) <= 12) x where k = 1""")
def join_nearest_level(t):
    """Nearest depth level within a tolerance."""
    a = t("vox").select(F.col("depth").alias("d1")).distinct()
    b = t("vox").select((F.col("depth") * 1.02 + 3).alias("d2")).distinct()
    return joins.nearest_level(a, b, "d1", "d2", 12).select("d1", r("d2").alias("d2"))


_SP = haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")


@query(f"""select a.sta as k1, b.sta as k2, round({_SP}, 6) as distance from station a join station b on a.sta < b.sta where {_SP} <= 6""")
def join_spatial(t):
    """Pairs of stations within six degrees."""
    s = t("station")
    a, b = (s.select(F.col("sta").alias(f"k{i}"), F.col("lat").alias(f"lat{i}"), F.col("lon").alias(f"lon{i}")) for i in (1, 2))
    return joins.spatial_pairs(a, b, 6.0).filter("k1 < k2").select("k1", "k2", r("distance").alias("distance"))


@query(f"""select event_id, sta, rank, round(d, 6) as distance from (select event_id, sta, d, row_number() over (partition by event_id order by d, sta) as rank from (select a.event_id, b.sta, {_SP} as d from evt a join station b on abs(a.lat - b.lat) <= 4) x where d <= 4) y where rank <= 3""")
def join_knn(t):
    """The three nearest stations of each event within four degrees."""
    e = t("evt").select("event_id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    s = t("station").select("sta", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return joins.knn(e, s, "event_id", "sta", 3, 4.0).select("event_id", "sta", "rank", r("distance").alias("distance"))


@query(f"""with p as (select event_id, elev, d from (select a.event_id, b.elev, {_SP} as d, row_number() over (partition by a.event_id order by {_SP}, b.sta) as k from evt a join station b on abs(a.lat - b.lat) <= 4 where {_SP} <= 4) x where k <= 8)
select event_id, round(value, 4) + 0.0 as value, n from (select event_id, coalesce(max(case when d <= 1e-9 then elev end), sum(case when d > 1e-9 then elev * pow(d, -2) end) / sum(case when d > 1e-9 then pow(d, -2) end)) as value, count(*) as n from p group by event_id) y""")
def join_idw(t):
    """Inverse-distance mean of the nearest stations' values."""
    e = t("evt").select("event_id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    s = t("station").select("sta", "elev", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return joins.idw(e, s, "event_id", "sta", "elev", 8, 4.0).filter("n_near is not null").select("event_id", r("elev", 4).alias("value"), n("n_near").alias("n"))


@query(f"""select event_id from evt a where event_id % 5 <> 2 and not exists (select 1 from station b where b.sta % 9 = 0 and {_SP} <= 1.5)""")
def join_exclude_near(t):
    """Events not in a list and not near its points."""
    s = t("station").filter("sta % 9 = 0").select(F.col("lat").alias("xlat"), F.col("lon").alias("xlon"), F.lit(2).cast("long").alias("gone"))
    e = t("evt").withColumn("mod5", F.col("event_id") % 5)
    return joins.exclude_near(e, s, "event_id", ("lat", "lon"), ("xlat", "xlon"), 1.5, [("mod5", "gone")]).select("event_id")


@query("""select coalesce(a.sta, b.sta) as sta, case when b.sta is null then 'ours_only' when a.sta is null then 'theirs_only' else 'common' end as membership from (select distinct sta from station where sta % 3 <> 0) a full outer join (select distinct sta from station where sta % 4 <> 0) b on a.sta = b.sta""")
def catalog_diff(t):
    """Stations by the catalogs that have them."""
    s = t("station")
    return joins.catalog_diff(s.filter("sta % 3 <> 0"), s.filter("sta % 4 <> 0"), ["sta"])


@query("""select sta, round(case when sta % 3 = 0 then elev + 2 when sta % 2 = 0 then elev + 1 else elev end, 4) as elev from station""")
def coordinate_priority(t):
    """One row a station; later tables win."""
    s = t("station").select("sta", "elev")
    parts = [s, s.filter("sta % 2 = 0").withColumn("elev", F.col("elev") + 1), s.filter("sta % 3 = 0").withColumn("elev", F.col("elev") + 2)]
    return joins.by_priority(parts, ["sta"]).select("sta", r("elev", 4).alias("elev"))


@query("""select a.p as model_a, a.q as model_b, count(*) as n, count(*) filter (x is null) as n_missing_left, count(*) filter (y is null) as n_missing_right, count(*) filter (abs(x - y) > 0.0505) as n_over, round(max(abs(x - y)), 6) as max_abs_diff
from (select p, q, ilat, ilon, depth, v as x from vox join (values (0, 1), (0, 2), (1, 2)) k(p, q) on m = p) a full outer join (select p, q, ilat, ilon, depth, v as y from vox join (values (0, 1), (0, 2), (1, 2)) k(p, q) on m = q) b on a.p = b.p and a.q = b.q and a.ilat = b.ilat and a.ilon = b.ilon and a.depth = b.depth group by 1, 2""")
def mesh_diff(t):
    """Differences of every two models' values on one mesh."""
    v, out = t("vox"), None
    for a, b in ((0, 1), (0, 2), (1, 2)):
        one = joins.values_diff(v.filter(F.col("m") == a), v.filter(F.col("m") == b), ["ilat", "ilon", "depth"], "v", 0.0505).withColumn("max_abs_diff", r("max_abs_diff"))
        one = one.select(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), "*")
        out = one if out is None else out.unionByName(one)
    return out


_WM = """with s as (select event, model, band, nz, sum(w) as w from meas where w > 0 group by event, model, band, nz), c as (select *, sum(w) over (partition by event, model, band order by nz rows unbounded preceding) as cw, sum(w) over (partition by event, model, band) as tw from s), d as (select event, model, band, min(nz) as med from c where cw >= tw * 0.5 - 1e-9 group by event, model, band)"""


@query(_WM + " select event, model, band, round(med, 6) as wmedian from d")
def agg_weighted_median(t):
    """Lower weighted median."""
    return agg.weighted_median(t("meas"), ["event", "model", "band"], "nz", "w").withColumn("wmedian", r("wmedian"))


@query(_WM + " select event, model, round(avg(med), 6) as score, count(*) as n_classes from d group by event, model")
def score_table(t):
    """Weighted median in each class, then the mean of the classes."""
    return agg.two_level(t("meas"), ["event", "model"], "band", "nz", "w").withColumn("score", r("score"))


@query("""select model, round(avg(m), 6) as value, count(*) as n_events from (select model, event, avg(nz) as m from meas group by model, event) x group by model""")
def agg_event_equal(t):
    """Mean of events' means."""
    return agg.event_equal(t("meas"), ["model"], "event", F.col("nz")).withColumn("value", r("value"))


@query("""select model, band, round(count(*) filter (nz >= 0.05) * 1.0 / count(*), 6) as fraction, count(*) as n from meas group by model, band""")
def agg_pooled_fraction(t):
    """Share of rows over a threshold."""
    return agg.pooled_fraction(t("meas"), ["model", "band"], F.col("nz") >= 0.05).withColumn("fraction", r("fraction"))


@query("""with s as (select distinct event, sta % 8 as az, sta % 3 as di, sta from meas) select event, az, di, sta, count(*) over (partition by event, az, di) as n_stations, round(1.0 / count(*) over (partition by event, az, di), 6) as weight from s""")
def agg_station_weights(t):
    """One over the stations of a cell."""
    m = t("meas").withColumns({"az": F.col("sta") % 8, "di": F.col("sta") % 3})
    return agg.station_weights(m, ["event"], "sta", ["az", "di"]).withColumn("weight", r("weight"))


@query("""select m, depth, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(median(v), 6) as median, count(v) as n from vox group by m, depth""")
def profile_plain(t):
    """Unweighted depth profile."""
    return agg.depth_profile(t("vox"), ["m"], "depth", "v").withColumns({c: r(c) for c in ("mean", "std", "median")})


@query("""select m, depth, round(sum(v * cos(radians(ilat))) / sum(case when v is not null then cos(radians(ilat)) end), 6) as mean, count(v) as n from vox group by m, depth""")
def profile_weighted(t):
    """Depth profile by the cosine of latitude."""
    return agg.weighted_profile(t("vox"), ["m"], "depth", "v", "ilat").withColumn("mean", r("mean"))


@query("""with p as (select m, depth, avg(v) as v from vox group by m, depth), s as (select m, v, lead(depth) over (partition by m order by depth) - depth as dz, (lead(v) over (partition by m order by depth) + v) / 2 as mv from p)
select m, round(coalesce(sum(mv * dz) / sum(dz), avg(v)), 6) as mean from s group by m""")
def profile_trapezoid(t):
    """Depth mean by the trapezoid rule."""
    p = t("vox").groupBy("m", "depth").agg(F.avg("v").alias("v"))
    return agg.trapezoid_mean(p, ["m"], "depth", "v").withColumn("mean", r("mean"))


@query("""with p as (select m, depth, avg(v) as v from vox group by m, depth), s as (select *, lead(depth) over (partition by m order by depth) as d2, lead(v) over (partition by m order by depth) as v2, count(*) over (partition by m) as c from p), g as (select unnest(range(0, 20)) * 37.0 as z)
select m, cast(z as double) as z, round(case when d2 is null then v else v + (z - depth) / (d2 - depth) * (v2 - v) end, 6) as v from s join g on (d2 is null and z = depth) or (z >= depth and z < d2) where c >= 3""")
def profile_interpolated(t):
    """A profile on other levels, linear between."""
    p = t("vox").groupBy("m", "depth").agg(F.avg("v").alias("v"))
    levels = t.spark.range(20).select((F.col("id") * 37.0).alias("z"))
    return agg.interpolate_profile(p, ["m"], "depth", "v", levels, "z").withColumn("v", r("v"))


@query("""select depth, round(sqrt(sum(cos(radians(ilat)) * x * x) / sum(case when x is not null then cos(radians(ilat)) end)), 6) as rms from (select depth, ilat, v - 3.6 as x from vox) y group by depth""")
def profile_rms(t):
    """Area-weighted root mean square by depth."""
    return t("vox").groupBy("depth").agg(r(agg.area_rms(F.col("v") - 3.6, "ilat")).alias("rms"))


@query("""select 'elev' as param, round_even(min(elev), 4) as min, round_even(max(elev), 4) as max, round(avg(elev), 3) as mean, round(stddev_pop(elev), 3) as std, cast(100 as double) as valid_pct from station union all
select 'lat', round_even(min(lat), 4), round_even(max(lat), 4), round(avg(lat), 3), round(stddev_pop(lat), 3), cast(100 as double) from station""")
def param_ranges(t):
    """Ranges, means and validity of parameters in one pass."""
    return agg.param_ranges(t("station"), ["elev", "lat"]).select("param", "min", "max", r("mean", 3).alias("mean"), r("std", 3).alias("std"), F.col("valid_pct").cast("double").alias("valid_pct"))


@query("""select count(*) as n, count(distinct net) as n_keys, count(elev) as n_value, round(min(elev), 4) as min_value, round(max(elev), 4) as max_value, round(avg(elev), 4) as mean_value, round(stddev_samp(elev), 4) as std_value from station""")
def summary_stats(t):
    """Summary of a column."""
    s = agg.summary(t("station"), "elev", "net")
    return s.select("n", "n_keys", "n_value", *[r(c, 4).alias(c) for c in ("min_value", "max_value", "mean_value", "std_value")])


@query("select net, count(*) as n from station group by net order by n desc, net limit 5")
def top_networks(t):
    """The five largest networks."""
    return agg.top_counts(t("station"), "net", 5)


@query("""with e as (select m, min(ilat) as a, max(ilat) as b, min(ilon) as c, max(ilon) as d, min(depth) as f, max(depth) as g from vox where v is not null and ilat >= m and ilon <= 19 - m group by m) select max(a) as ilat_min, min(b) as ilat_max, max(c) as ilon_min, min(d) as ilon_max, max(f) as depth_min, min(g) as depth_max, count(*) as n_groups, max(a) <= min(b) and max(c) <= min(d) and max(f) <= min(g) as has_common from e""")
def common_region(t):
    """The box that all models share."""
    return agg.common_region(t("vox"), "m", "ilat", "ilon", "depth", F.col("v").isNotNull() & (F.col("ilat") >= F.col("m")) & (F.col("ilon") <= 19 - F.col("m")))


@query("""select m, round(avg(s), 6) as mean_step, round(median(s), 6) as median_step, count(*) as n_values from (select m, depth - lag(depth) over (partition by m order by depth) as s from (select distinct m, depth from vox) d) x group by m""")
def grid_spacing(t):
    """Mean and median spacing of a grid's axis."""
    return agg.mean_spacing(t("vox"), ["m"], "depth").withColumns({c: r(c) for c in ("mean_step", "median_step")})


@query("""select model, count(x) as n, round(median(x), 6) + 0.0 as median, round(median(abs(x)), 6) as median_abs, round(avg(x), 6) + 0.0 as mean, round(quantile_cont(abs(x), 0.95), 6) as p95_abs from (select model, nz - 0.05 as x from meas) y group by model""")
def misfit_stats(t):
    """Medians, mean and 95th percentile of a misfit."""
    return t("meas").withColumn("x", F.col("nz") - 0.05).groupBy("model").agg(*agg.misfit_stats("x")).select("model", "n", *[r(c).alias(c) for c in ("median", "median_abs", "mean", "p95_abs")])


@query("""select ilat % 4 as label, count(*) as n_points, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(min(v), 6) as min, round(max(v), 6) as max, round(median(v), 6) as median, round(count(*) * 100.0 / (select count(*) from vox), 6) as percentage from vox group by ilat % 4""")
def cluster_statistics(t):
    """Statistics of a feature by cluster."""
    g = agg.group_stats(t("vox").withColumn("label", F.col("ilat") % 4), ["label"], "v")
    return g.select("label", "n_points", *[r(c).alias(c) for c in ("mean", "std", "min", "max", "median", "percentage")])


@query("""select ilat % 4 as label, round(quantile_cont(depth, 0.05), 6) as p05, round(avg(depth), 6) as mean, round(quantile_cont(depth, 0.95), 6) as p95, count(*) as n, round(count(*) * 1.0 / (select count(*) from vox), 6) as volume_frac from vox group by ilat % 4""")
def cluster_depths(t):
    """Depth spread of clusters."""
    g = agg.radial_stats(t("vox").withColumn("label", F.col("ilat") % 4), ["label"], "depth")
    return g.select("label", "n", *[r(c).alias(c) for c in ("p05", "mean", "p95", "volume_frac")])


@query("""select net, round(greatest(max(lat) - min(lat), 0.02) * greatest(max(lon) - min(lon), 0.02), 6) as area, count(*) as n from station group by net""")
def network_area(t):
    """Bounding box areas of networks."""
    return agg.bbox_area(t("station"), ["net"], "lat", "lon").withColumn("area", r("area"))


@query("""with x as (select cast(extract(year from s) as int) as a, cast(coalesce(extract(year from e), 1999) as int) as b from validity), y as (select unnest(range((select min(a) from x), (select max(b) from x) + 1)) as year) select cast(year as int) as year, (select count(*) from x where a = year) as n_new, (select count(*) from x where a <= year and b >= year) as n_active from y""")
def active_per_year(t):
    """Rows active and new in each year."""
    return agg.active_per_year(t("validity"), "s", "e", 1999)


@query("""with a as (select distinct event, sta from meas where sta % 2 = 0), h as (select event, sta, count(distinct phase) as p from meas where sta % 4 = 0 and phase <= 3 group by event, sta)
select a.event, count(*) as n_active, count(p) as n_present, count(*) filter (p >= 3) as n_complete, round(count(p) * 1.0 / count(*), 6) as present_frac, round(count(*) filter (p >= 3) * 1.0 / count(*), 6) as complete_frac, round(1 - count(p) * 1.0 / count(*), 6) + 0.0 as missing_frac from a left join h on a.event = h.event and a.sta = h.sta group by a.event""")
def event_coverage(t):
    """Shares of active stations with any and with all components."""
    m = t("meas")
    c = agg.coverage(m.filter("sta % 2 = 0"), m.filter("sta % 4 = 0 and phase <= 3").withColumn("part", F.col("phase")), "event", "sta", 3)
    return c.select("event", "n_active", "n_present", "n_complete", *[r(x).alias(x) for x in ("present_frac", "complete_frac", "missing_frac")])


@query("""select cast(floor(lat / 2.0) as bigint) as cell_lat, cast(floor(lon / 2.0) as bigint) as cell_lon, round(sum(elev * cos(radians(lat))) / sum(cos(radians(lat))), 4) + 0.0 as elev, count(elev) as n from station group by 1, 2""")
def block_means(t):
    """Area-weighted means in cells of two degrees."""
    return agg.block_mean(t("station"), [], "lat", "lon", "elev", 2.0).withColumn("elev", r("elev", 4))


@query("""select event_id, cast(lat as double) as lat, mag from (select *, row_number() over (partition by year, depth order by mag desc, event_id) as k from evt) x where k = 1""")
def dedup_first(t):
    """The first row of each key in a full order."""
    return windows.keep_one(t("evt"), ["year", "depth"], [-F.col("mag"), "event_id"]).select("event_id", "lat", "mag")


@query("""select o_custkey, o_orderkey, total from (select *, row_number() over (partition by o_custkey order by src desc, o_orderkey desc) as k from (select o_custkey, o_orderkey, round(o_totalprice, 2) as total, 0 as src from ord where o_orderkey % 2 = 0 union all select o_custkey, o_orderkey, round(o_totalprice + 1, 2), 1 from ord where o_orderkey % 3 = 0) u) x where k = 1""")
def upsert_keep_last(t):
    """Union of old and new in which the newest row of a key stays."""
    o = t("ord").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("total"))
    out = windows.upsert(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0").withColumn("total", F.col("total") + 1), ["o_custkey"], ["o_orderkey"])
    return out.withColumn("total", r("total", 2))


@query("""with o as (select event_id, lat, lon, mag, row_number() over (order by t, event_id) as k from evt) select event_id from o a where not exists (select 1 from o b join (select unnest(range(1, 51)) as d) x on true where b.k = a.k - x.d and abs(b.lat - a.lat) <= 1 and abs(b.lon - a.lon) <= 1 and abs(b.mag - a.mag) <= 0.5)""")
def dedup_tolerance(t):
    """Rows without a near one among the 50 before, over the whole catalogue."""
    return windows.tolerance_dedup(t("evt"), ["t", "event_id"], [("lat", 1.0), ("lon", 1.0), ("mag", 0.5)]).select("event_id")


@query("""with a as (select event, cast(sta * 37 % 360 as double) as az from (select distinct event, sta from meas) x), s as (select event, az, lead(az) over (partition by event order by az) - az as g from a)
select event, case when count(*) < 2 then 360.0 else greatest(coalesce(max(g), 0), 360 - max(az) + min(az)) end as gap, count(*) as n from s group by event""")
def azimuth_gap(t):
    """Largest azimuthal gap of an event's stations."""
    a = t("meas").select("event", "sta").distinct().withColumn("az", (F.col("sta") * 37 % 360).cast("double"))
    return windows.azimuthal_gap(a, ["event"], "az")


@query("""with y as (select year, avg(mag) as w, count(*) as c from evt group by year), z as (select year, avg(w) over k as m, sum(c) over k as n from y window k as (order by year range between current row and 2 following)) select year as start_year, year + 2 as end_year, round(m, 6) as mean_weight, cast(n as bigint) as n from z where n >= 100 and year + 2 <= (select max(year) from y) order by m desc, year limit 1""")
def best_years(t):
    """The three years of the highest mean weight."""
    y = t("evt").groupBy("year").agg(F.avg("mag").alias("w"), F.count("*").alias("c"))
    return windows.best_window(y, "year", "w", "c", 3, 100).withColumn("mean_weight", r("mean_weight"))


_CURVE = "select m, k, 100.0 / (k - 1 + m) + k * 0.5 as sse from (select distinct m from vox) a cross join (select unnest(range(2, 12)) as k) b"


@query(f"""with c as ({_CURVE}), d as (select m, k, (k - 2) / 9.0 as x, (sse - min(sse) over (partition by m)) / (max(sse) over (partition by m) - min(sse) over (partition by m)) as y from c), f as (select m, max(case when k = 2 then y end) as a, max(case when k = 11 then y end) as b from d group by m)
select m, cast(k as int) as k_elbow from (select d.m, k, row_number() over (partition by d.m order by round(a + (b - a) * x - y, 12) desc, k) as n from d join f on d.m = f.m) z where n = 1""")
def elbow_k(t):
    """K furthest below the chord of its curve."""
    return windows.elbow(_curve(t), ["m"], "k", "sse")


def _curve(t):
    ks = t.spark.range(2, 12).select(F.col("id").cast("int").alias("k"))
    return t("vox").select("m").distinct().crossJoin(ks).withColumn("sse", F.lit(100.0) / (F.col("k") - 1 + F.col("m")) + F.col("k") * 0.5)


@query(f"""with c as ({_CURVE}), g as (select m, k, (lag(sse) over (partition by m order by k) - sse) / lag(sse) over (partition by m order by k) as g from c) select m, cast(min(case when g < 0.1 then k end) as int) as k_gain from g group by m""")
def gain_k(t):
    """First K of a small gain."""
    return windows.first_small_gain(_curve(t), ["m"], "k", "sse", 0.1)


@query("""with p as (select m, depth, round(avg(case when ilat % 3 = 0 then v - 0.0004 * depth end), 6) as s from vox group by m, depth), q as (select *, lag(s) over (partition by m order by depth) as a, lead(s) over (partition by m order by depth) as b from p) select m, depth, s from q where s > a and s > b""")
def profile_maxima(t):
    """Interior maxima of a profile."""
    p = t("vox").groupBy("m", "depth").agg(r(F.avg(F.when(F.col("ilat") % 3 == 0, F.col("v") - F.col("depth") * 0.0004))).alias("s"))
    return windows.local_maxima(p, ["m"], "depth", "s")


@query("""with p as (select m, depth, round(avg(case when ilat % 3 = 0 then v end), 6) as s from vox group by m, depth) select m, depth, s, max(s) over (partition by m order by depth rows unbounded preceding) as repaired from p""")
def running_maximum(t):
    """A log-likelihood made monotone."""
    p = t("vox").groupBy("m", "depth").agg(r(F.avg(F.when(F.col("ilat") % 3 == 0, F.col("v")))).alias("s"))
    return windows.monotone(p, ["m"], "depth", "s")


@query("""with l as (select m, ilat % 5 - 1 as label, ilon, v from vox), a as (select m, label, row_number() over (partition by m order by avg(v), label) - 1 as k from l where label >= 0 group by m, label) select l.m, l.label, coalesce(cast(k as int), l.label) as new_label, count(*) as n from l left join a on l.m = a.m and l.label = a.label group by 1, 2, 3""")
def renumbered(t):
    """Labels by their mean value; negative ones stay."""
    x = t("vox").withColumn("label", F.col("ilat") % 5 - 1)
    return windows.renumber(x, ["m"], "label", "v").groupBy("m", "label", "new_label").agg(F.count("*").alias("n"))


@query("""select event_id, rank from (select event_id, row_number() over (order by b, mag desc, event_id) as rank from (select *, case when row_number() over (partition by year order by mag desc, event_id) <= 2 then 0 else 1 end as b from evt) x) y where rank <= 30""")
def top_then_fill(t):
    """Two of each year, then the largest of the rest."""
    return windows.top_then_fill(t("evt"), "year", "mag", "event_id", 2, 30).select("event_id", "rank")


@query("""with w as (select net, count(*) as c from station group by net), q as (select net, c, 13 * c / (select sum(c) from w) as raw from w), f as (select *, floor(round(raw, 9)) as fl from q)
select net, cast(fl + case when row_number() over (order by round(raw - fl, 9) desc, net) <= 13 - (select sum(fl) from f) then 1 else 0 end as bigint) as quota from f""")
def largest_remainder(t):
    """Quotas of 13 by weight."""
    w = t("station").groupBy("net").agg(F.count("*").alias("c")).withColumns({"total": F.lit(13), "g": F.lit(0)})
    return windows.quotas(w, ["g"], "net", "c", "total").select("net", "quota")


@query("""with b as (select m, ilat, ilon, min(case when cast(v * 10 as int) % 4 >= 2 then depth end) as boundary from vox group by m, ilat, ilon) select count(boundary) as n, round(median(boundary), 6) as median, round(quantile_cont(boundary, 0.95) - quantile_cont(boundary, 0.05), 6) as spread from b""")
def boundary_depths(t):
    """First depths at which a label is reached, and their spread."""
    x = t("vox").withColumn("label", F.round(F.col("v") * 10).cast("int") % 4)
    b = windows.boundary_depths(x, ["m", "ilat", "ilon"], "depth", "label", 2)
    return windows.boundary_table(b).select("n", r("median").alias("median"), r("spread").alias("spread"))


@query("""select sta from (select sta, row_number() over (partition by round(lat / 5), round(lon / 5) order by sta) as k from station) x where k = 1""")
def unique_points(t):
    """Shared points once, by rounded coordinates."""
    return windows.unique_points(t("station"), {"a": F.round(F.col("lat") / 5), "b": F.round(F.col("lon") / 5)}, ["sta"]).select("sta")


@query("""with c as (select event, sta, cast(floor((sta * 37 % 360) / 45.0) as int) as az_bin, least(cast(floor((sta % 100) / 25.0) as int), 3) as dist_bin, max(nz) as s from meas group by event, sta) select event, az_bin, dist_bin, sta from (select *, row_number() over (partition by event, az_bin, dist_bin order by s desc, sta) as k from c) x where k = 1""")
def spread_stations(t):
    """The best station of each azimuth and distance cell."""
    s = t("meas").groupBy("event", "sta").agg(F.max("nz").alias("s")).withColumns({"az": (F.col("sta") * 37 % 360).cast("double"), "di": (F.col("sta") % 100).cast("double")})
    return windows.pick_spread(s, ["event"], "az", "di", "s", "sta", 8, 4, 100.0).select("event", "az_bin", "dist_bin", "sta")


@query("""with a as (select event_id, lat, lon, mag from evt) select event_id, round(mag / (max(mag) over ()), 6) as s, round(case when max(lat) over () > min(lat) over () then (lat - min(lat) over ()) / (max(lat) over () - min(lat) over ()) else 1 end, 6) as u from a""")
def scaled_terms(t):
    """Terms of a score of every event, scaled by maximum and by range."""
    return windows.min_max_scaled(windows.max_scaled(t("evt"), [], "mag", "s"), [], "lat", "u").select("event_id", r("s").alias("s"), r("u").alias("u"))


@query(f"""with recursive s as (select sta, elev, lat, lon, row_number() over (order by elev desc, sta) as k from station), near as (select a.k as i, b.k as j from s a join s b on a.k > b.k where {_SP} <= 6),
walk(k, taken) as (select cast(0 as bigint), cast([] as bigint[]) union all select w.k + 1, case when exists (select 1 from near where i = w.k + 1 and list_contains(w.taken, j)) then w.taken else list_append(w.taken, w.k + 1) end from walk w where w.k < (select count(*) from s))
select sta from s where list_contains((select taken from walk order by k desc limit 1), k)""")
def greedy_spacing(t):
    """Greedy thinning by priority with a minimum distance."""
    return selection.spaced(t("station"), "sta", "elev", 6.0).select("sta")


@query()
def farthest_events(t):
    """Twelve events far from each other."""
    return selection.farthest_points(t("evt"), "event_id", 12).select("event_id", "pick")


@query()
def sampled_events(t):
    """Weighted sample of five events a year."""
    return selection.weighted_sample(t("evt"), ["event_id"], F.col("mag"), 5, ["year"]).select("event_id", "year")


@query("""with p as (select a.net, count(*) as c from station a join station b on a.net = b.net and a.sta <> b.sta where sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) <= 25 group by a.net) select s.net, s.n, round(coalesce(c, 0) * 1.0 / (n * (n - 1)), 6) as density, n >= 3 and coalesce(c, 0) * 1.0 / (n * (n - 1)) > 0.15 as is_dense from (select net, count(*) as n from station group by net) s left join p on s.net = p.net""")
def dense_networks(t):
    """Networks whose stations are close together."""
    return selection.dense_groups(t("station"), "net", "sta", "lat", "lon", 25.0, 3, 0.15).withColumn("density", r("density"))


@query("""select event, sta, cast(floor((row_number() over (partition by event order by lpad(cast(sta as varchar(20)), 6, '0')) - 1) / least(15, floor(60 / 7.0))) as int) as chunk from (select distinct event, sta from meas) x""")
def request_chunks(t):
    """Names in request chunks of bounded size."""
    s = t("meas").select("event", "sta").distinct().withColumn("name", F.lpad(F.col("sta").cast("string"), 6, "0"))
    return selection.pack_chunks(s, ["event"], "name", 15, 60).select("event", "sta", "chunk")


@query("""select l_returnflag, count(*) as n, round(avg(l_quantity), 6) as mean_quantity, round(sum(l_extendedprice), 2) as total from (select l.*, row_number() over (partition by l_partkey, l_suppkey order by o_orderdate desc, l_orderkey desc, l_linenumber desc) as k from li l join ord o on l_orderkey = o_orderkey where l_shipdate >= date '1994-01-01' and o_totalprice between 1000 and 300000) x where k = 1 group by l_returnflag""")
def catalog_slice(t):
    """Scan, range filter, keep the last of each key, grouped statistics."""
    o = t("ord").filter("o_totalprice between 1000 and 300000").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    li = t("li").filter("l_shipdate >= date '1994-01-01'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice")
    kept = windows.keep_one(li.join(o, "l_orderkey"), ["l_partkey", "l_suppkey"], ["o_orderdate", "l_orderkey", "l_linenumber"], last=True)
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), r(F.avg("l_quantity")).alias("mean_quantity"), r(F.sum("l_extendedprice"), 2).alias("total"))
