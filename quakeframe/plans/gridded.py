"""Queries of gridded models: slices, perturbations, votes, averaging, similarity, clusters, traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakeframe.operators import clustering, fusion, grid, linkage, reference, similarity, waveform
from quakeframe.plans.registry import n, query, r

CELL = ["ilat", "ilon", "depth"]


@query("""with l as (select depth from (select distinct depth from vox) d order by abs(depth - 140), depth limit 1) select m, ilat, ilon, round(v, 6) as v from vox where depth = (select depth from l)""")
def grid_slice(t):
    """Voxels of the level nearest to a depth."""
    return grid.slice_at(t("vox"), "depth", 140.0).select("m", "ilat", "ilon", r("v").alias("v"))


@query("""select m, ilat, ilon, depth, round(v / avg(v) over (partition by m, depth) - 1, 6) + 0.0 as perturbation from vox""")
def grid_perturbation(t):
    """Relative perturbation about each level's mean."""
    return grid.lateral_perturbation(t("vox"), ["m"], "depth", "v").select("m", *CELL, r("perturbation").alias("perturbation"))


@query("""with o as (select a.m, a.ilat, a.ilon, a.depth, count(*) as c from vox a join vox b on a.m = b.m and a.depth = b.depth and abs(a.ilat - b.ilat) <= 1 and abs(a.ilon - b.ilon) <= 1 where b.v is not null group by a.m, a.ilat, a.ilon, a.depth)
select m, ilat, ilon, depth, c = 9 as eroded from o""")
def grid_erosion(t):
    """Cells whose neighbourhood is whole."""
    return grid.erode(t("vox"), ["m", "depth"], "ilat", "ilon", F.col("v").isNotNull(), 1).select("m", *CELL, "eroded")


@query("""select ilat, ilon, depth, round(median(v), 6) as median, round(avg(v), 6) as mean, count(v) as coverage, round(stddev_pop(v), 6) + 0.0 as std from vox group by ilat, ilon, depth""")
def model_vote(t):
    """Median, mean, count and deviation of the models in each cell."""
    return fusion.vote(t("vox"), CELL, "v").select(*CELL, r("median").alias("median"), r("mean").alias("mean"), n("coverage").alias("coverage"), r("std").alias("std"))


@query("""with c as (select ilat, ilon, depth, median(v) as med, greatest(stddev_pop(v), 0.001) as sd from vox group by ilat, ilon, depth), l as (select m, avg(-0.5 * ((v - med) / sd) * ((v - med) / sd)) as loglik from vox join c using (ilat, ilon, depth) group by m),
p as (select m, exp(loglik) / (select sum(exp(loglik)) from l) as p from l)
select ilat, ilon, depth, round(sum(p * v) / sum(p), 6) as bma_mean, count(*) as n_models from vox join p using (m) where v is not null group by ilat, ilon, depth""")
def model_average(t):
    """Posterior mean of the models in each cell."""
    v = t("vox")
    weights = fusion.posterior(fusion.log_likelihood(v, CELL, "m", "v"), "m")
    return fusion.bma(v, CELL, "m", "v", weights).select(*CELL, r("bma_mean").alias("bma_mean"), n("n_models").alias("n_models"))


@query("""select cast(a.m as varchar) as model_a, cast(b.m as varchar) as model_b, round(corr(a.v, b.v), 6) as corr, count(*) as n from vox a join vox b on a.ilat = b.ilat and a.ilon = b.ilon and a.depth = b.depth and a.m < b.m where a.v is not null and b.v is not null group by a.m, b.m""")
def model_correlation(t):
    """Correlation of every two models over their common cells."""
    pairs = similarity.model_pairs(t("vox").withColumn("m", F.col("m").cast("string")), CELL, "m", "v")
    return similarity.correlation_matrix(pairs).select("model_a", "model_b", r("corr").alias("corr"), n("n").alias("n"))


@query("""with p as (select a.m as model_a, b.m as model_b, a.depth, a.ilat as i, a.ilon as j, a.v as x, b.v as y from vox a join vox b on a.ilat = b.ilat and a.ilon = b.ilon and a.depth = b.depth and a.m < b.m where a.v is not null and b.v is not null),
s as (select model_a, model_b, depth, min(i) as i0, max(i) as i1, min(j) as j0, max(j) as j1, case when greatest(max(x), max(y)) > least(min(x), min(y)) then greatest(max(x), max(y)) - least(min(x), min(y)) else 1 end as span from p group by 1, 2, 3),
k as (select cast(range as int) - 6 as a, exp(-0.5 * ((range - 6) / 1.5) * ((range - 6) / 1.5)) as w from range(13)),
g as (select p.model_a, p.model_b, p.depth, p.i, p.j, any_value(s.span) as span, sum(ka.w * kb.w) as w, sum(ka.w * kb.w * q.x) as sx, sum(ka.w * kb.w * q.y) as sy, sum(ka.w * kb.w * q.x * q.x) as sxx, sum(ka.w * kb.w * q.y * q.y) as syy, sum(ka.w * kb.w * q.x * q.y) as sxy
  from p join s using (model_a, model_b, depth) cross join k ka cross join k kb join p q on q.model_a = p.model_a and q.model_b = p.model_b and q.depth = p.depth and q.i = greatest(s.i0, least(s.i1, p.i + ka.a)) and q.j = greatest(s.j0, least(s.j1, p.j + kb.a)) group by 1, 2, 3, 4, 5),
m as (select *, sx / w as mx, sy / w as my, greatest(sxx / w - sx / w * sx / w, 0) as vx, greatest(syy / w - sy / w * sy / w, 0) as vy, sxy / w - sx / w * sy / w as cov, 0.0001 * span * span as c1, 0.0009 * span * span as c2 from g)
select model_a, model_b, depth, round(avg((2 * mx * my + c1) * (2 * cov + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))), 6) as ssim, count(*) as n from m group by 1, 2, 3""")
def model_ssim(t):
    """Structural similarity of every two models by level."""
    found = similarity.ssim(similarity.model_pairs(t("vox"), CELL, "m", "v"), ["model_a", "model_b", "depth"], "ilat", "ilon")
    return found.select("model_a", "model_b", "depth", r("ssim").alias("ssim"), n("n").alias("n"))


@query()
def voxel_mixture(t):
    """Gaussian mixture labels of every model's voxels, a mixture for each model."""
    out = None
    for m in range(3):
        one = clustering.gaussian_mixture(t("vox").filter(F.col("m") == m), ["depth", "v"], 3, rounds=10)[0].select("m", *CELL, "label")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def trace_measures(t):
    """Time shift, correlations and misfit of each trace against a louder copy."""
    traces = t("emb").withColumn("test", F.transform("embedding", lambda x: x * 1.1))
    return waveform.measure_pairs(traces, ["vec_id"], "embedding", "test", 1.0, 10.0)


def points_of(t):
    """Voxels with a number of their own and their value on the scale of a cell."""
    number = F.col("depth").cast("long") * 12 + F.col("ilon") * 60 + F.col("ilat") * 3 + F.col("m")
    return t("vox").select("m", number.cast("long").alias("voxel"), "ilat", "ilon", (F.col("v") * 10).alias("level"))


@query("""with p as (select m, cast(depth * 12 + ilon * 60 + ilat * 3 + m as bigint) as voxel, ilat, ilon, v * 10 as level from vox where v is not null),
d as (select a.m, a.voxel, sqrt((a.ilat - b.ilat) * (a.ilat - b.ilat) + (a.ilon - b.ilon) * (a.ilon - b.ilon) + (a.level - b.level) * (a.level - b.level)) as d from p a join p b on a.m = b.m),
k as (select m, voxel, d, row_number() over (partition by m, voxel order by d) as k, count(*) over (partition by m, voxel) as n from d)
select m, voxel, round(d, 6) + 0.0 as core from k where k = least(11, n)""")
def voxel_cores(t):
    """How far each voxel's tenth other voxel of its model is, in cells and tenths of the value: the radius that its density is taken in."""
    return linkage.neighbour_distance(points_of(t), "voxel", ["ilat", "ilon", "level"], 10, ["m"]).select("m", "voxel", r("core").alias("core"))


@query()
def voxel_density(t):
    """Density clusters of each model's voxels."""
    return linkage.density_clusters(points_of(t), "voxel", ["ilat", "ilon", "level"], ["m"], least_size=20, samples=5)


@query()
def voxel_ward(t):
    """Six clusters of each model's voxels by Ward's merges."""
    return linkage.ward_clusters(points_of(t), "voxel", ["ilat", "ilon", "level"], 6, ["m"])


@query("""with k as (select m, depth as z, case when ilat < 10 then 0 else 1 end as s, avg(v) as x from vox where v is not null group by 1, 2, 3),
i as (select m, z as z0, x as v0, lead(z) over (partition by m order by z, s) as z1, lead(x) over (partition by m order by z, s) as v1 from k),
b as (select m, min(z) as zf, max(z) as zl, arg_min(x, z * 2 + s) as vf, arg_max(x, z * 2 + s) as vl from k group by m),
p as (select event_id, cast(event_id % 3 as int) as m, depth as z from evt)
select p.event_id, round(coalesce(u.v0 + (p.z - u.z0) / (u.z1 - u.z0) * (u.v1 - u.v0), case when p.z <= b.zf then b.vf else b.vl end), 6) as above, round(coalesce(l.v0 + (p.z - l.z0) / (l.z1 - l.z0) * (l.v1 - l.v0), case when p.z < b.zf then b.vf else b.vl end), 6) as below
from p join b using (m) left join i u on u.m = p.m and u.z1 > u.z0 and p.z > u.z0 and p.z <= u.z1 left join i l on l.m = p.m and l.z1 > l.z0 and p.z >= l.z0 and p.z < l.z1""")
def reference_sides(t):
    """Each event's value in the column of a model, on both sides of the interface that every level is."""
    side = F.when(F.col("ilat") < 10, 0).otherwise(1)
    column = t("vox").filter(F.col("v").isNotNull()).groupBy("m", "depth", side.alias("side")).agg(F.avg("v").alias("below")).withColumn("above", F.col("below"))
    events = t("evt").select("event_id", (F.col("event_id") % 3).cast("int").alias("m"), "depth")
    both = reference.at_depth(reference.at_depth(events, column, ["m"], "depth", ["above"], below=False), column, ["m"], "depth", ["below"])
    return both.select("event_id", r("above").alias("above"), r("below").alias("below"))
