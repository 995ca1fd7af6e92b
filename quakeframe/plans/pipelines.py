"""Queries of whole workflows: selection of events, analysis of networks, models from voxels to votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakeframe.functions import geo, seismic
from quakeframe.operators import aggregates as agg
from quakeframe.operators import clustering, filters, fusion, joins, selection, windows
from quakeframe.plans.registry import n, query, r
from quakeframe.plans.scalars import haversine_sql

_SP = haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")
_NEAR = haversine_sql("e.lat", "e.lon", "s.lat", "s.lon")


@query(f"""with c as (select event_id, lat, lon, depth, mag, year, cast(event_id * 7919 % 100000000 as bigint) as sec from evt where lat between -5 and 50 and lon between 65 and 140 and depth between 0 and 600 and mag between 5.5 and 7.2),
q as (select * from c a where not exists (select 1 from c b where b.event_id <> a.event_id and b.sec >= a.sec - 600 and b.sec < a.sec + 600)),
x as (select * from q a where event_id % 5 <> 2 and not exists (select 1 from station b where b.sta % 9 = 0 and {_SP} <= 1.5)),
k as (select *, case when row_number() over (partition by year order by mag desc, event_id) <= 5 then 0 else 1 end as later from x)
select event_id, rank, case when depth <= 70 then 'shallow' when depth <= 300 then 'intermediate' else 'deep' end as category, round(least(300.0, greatest(1.0, 2.26 * pow(10.0, (mag - 5) / 3))), 6) as half_duration
from (select *, row_number() over (order by later, mag desc, event_id) as rank from k) y where rank <= 40""")
def event_selection(t):
    """Events through the filter cascade, without others at the same time, not near listed points; five a year, then the largest."""
    box = geo.Box(-5, 50, 65, 140)
    rules = [("region", box.contains("lat", "lon")), ("depth", F.col("depth").between(0, 600)), ("magnitude", F.col("mag").between(5.5, 7.2))]
    e = filters.accept(t("evt"), rules).withColumn("sec", F.col("event_id") * 7919 % 100000000)
    alone = joins.without_interference(e, "event_id", "sec", 600).withColumn("mod5", F.col("event_id") % 5)
    listed = t("station").filter("sta % 9 = 0").select(F.col("lat").alias("xlat"), F.col("lon").alias("xlon"), F.lit(2).cast("long").alias("gone"))
    free = joins.exclude_near(alone, listed, "event_id", ("lat", "lon"), ("xlat", "xlon"), 1.5, [("mod5", "gone")])
    picked = windows.top_then_fill(free, "year", "mag", "event_id", 5, 40)
    return picked.select("event_id", "rank", seismic.depth_category("depth").alias("category"), r(seismic.half_duration("mag")).alias("half_duration"))


@query(f"""with e as (select event_id, lat, lon from evt where mag >= 6.5), p as (select e.event_id, s.sta, {_NEAR} as d, ((degrees(atan2(sin(radians(s.lon - e.lon)) * cos(radians(s.lat)), cos(radians(e.lat)) * sin(radians(s.lat)) - sin(radians(e.lat)) * cos(radians(s.lat)) * cos(radians(s.lon - e.lon)))) + 360.0) % 360.0) as az from e join station s on abs(e.lat - s.lat) <= 8 where {_NEAR} <= 8),
g as (select event_id, sta, d, az, lead(az) over (partition by event_id order by az) - az as gap from p),
m as (select event_id, count(*) as n, case when count(*) < 2 then 360.0 else greatest(coalesce(max(gap), 0), 360 - max(az) + min(az)) end as gap, stddev_pop(d) as sd, avg(d) as mean from g group by event_id)
select event_id, n, round(gap, 5) as gap, round((case when n < 4 then 0.3 else greatest(0.0, 1 - gap / 180.0) end + case when n < 3 then 0.5 else greatest(0.0, 1 - abs(case when mean > 0 then sd / mean else 0 end - 0.3) / 0.3) end) / 2, 5) + 0.0 as score from m where n >= 3""")
def event_station_metrics(t):
    """Stations about each large event: their number, azimuthal gap and a score of both spreads."""
    e = t("evt").filter("mag >= 6.5").select("event_id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    s = t("station").select("sta", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    # all that is asked depends on the place of an event; stations of one place are as many rows of one distance
    at = ["lat1", "lon1"]
    near = joins.place_pairs(joins.places(e, ("lat1", "lon1")), joins.places(s, ("lat2", "lon2"), "c"), 8.0).withColumn("az", geo.azimuth_deg("lat1", "lon1", "lat2", "lon2"))
    gap = windows.azimuthal_gap(near, at, "az").select(*at, "gap")
    m = agg.weighted_spread(near, at, "distance", "c").join(gap, at).join(e, at)
    score = (seismic.gap_score("gap", "n") + seismic.spread_score("sd", "mean", "n")) / 2.0
    return m.filter("n >= 3").select("event_id", "n", r("gap", 5).alias("gap"), r(score, 5).alias("score"))


@query("""with p as (select a.net, count(*) as c from station a join station b on a.net = b.net and a.sta <> b.sta where sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) <= 25 group by a.net),
s as (select net, count(*) as n, greatest(max(lat) - min(lat), 0.02) * greatest(max(lon) - min(lon), 0.02) as area, avg(elev) as mean_elev from station group by net),
q as (select net, n, 20 * n / (select sum(n) from s) as raw from (select net, n * 1.0 as n from s) z), f as (select *, floor(round(raw, 9)) as fl from q)
select s.net, s.n, round(area, 6) as area, round(mean_elev, 4) + 0.0 as mean_elev, round(coalesce(c, 0) * 1.0 / (s.n * (s.n - 1)), 6) as density, s.n >= 3 and coalesce(c, 0) * 1.0 / (s.n * (s.n - 1)) > 0.15 as is_dense,
  cast(f.fl + case when row_number() over (order by round(f.raw - f.fl, 9) desc, s.net) <= 20 - (select sum(fl) from f) then 1 else 0 end as bigint) as quota from s join f on s.net = f.net left join p on s.net = p.net""")
def network_analysis(t):
    """Networks with their areas, densities, mean elevations and quotas of twenty stations."""
    s = t("station")
    area = agg.bbox_area(s, ["net"], "lat", "lon").drop("n")
    dense = selection.dense_groups(s, "net", "sta", "lat", "lon", 25.0, 3, 0.15)
    mean = s.groupBy("net").agg(F.avg("elev").alias("mean_elev"))
    quota = windows.quotas(s.groupBy("net").agg(F.count("*").alias("c")).withColumns({"total": F.lit(20), "g": F.lit(0)}), ["g"], "net", "c", "total").select("net", "quota")
    return dense.join(area, "net").join(mean, "net").join(quota, "net").select("net", n("n").alias("n"), r("area").alias("area"), r("mean_elev", 4).alias("mean_elev"), r("density").alias("density"), "is_dense", "quota")


@query()
def model_space(t):
    """Models from voxels to votes: bands of depth, a mixture in each band of each model, clusters numbered by speed, classes of clusters by their mean anomaly, the models' vote in each cell."""
    v = t("vox").withColumn("anomaly", F.col("v") - 3.5 - F.col("depth") * 0.0004 - 0.05)
    v = v.withColumn("band", filters.depth_band("depth", [("top", 0, 200), ("low", 200, 400)]))
    out = None
    for m in range(3):
        own = clustering.by_band(v.filter(F.col("m") == m), "band", ["anomaly"], 3, 50).withColumn("m", F.lit(m))
        own = windows.renumber(own, ["m", "band"], "label", "anomaly")
        mean = own.groupBy("band", "new_label").agg(F.avg("anomaly").alias("mean"))
        one = own.join(mean.withColumn("class", agg.class_of_cluster(mean, "mean", "band", {"top": (-0.02, 0.02), "low": (-0.02, 0.02)})), ["band", "new_label"])
        out = one if out is None else out.unionByName(one)
    return fusion.class_vote(out, ["ilat", "ilon", "depth"], "class", 3)
