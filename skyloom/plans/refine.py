"""Queries of rasters, frames, gaps, metrics, sets and jobs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions import encoding as E
from skyloom.functions import geometry as G
from skyloom.functions import text as T
from skyloom.operators import generators, nearness, rasters, robust, spatial, splats as S, stencils, views
from skyloom.operators.quantiles import quantiles
from skyloom.plans.tables import FRAMES_SQL, JOBS_SQL, MASKS_SQL, RASTER_SQL, SPLATS_SQL, WIDTH, frames, height, jobs, masks, query, raster, rounded, splats, sql_rounded, width
from skyloom.streaming import jobs as J

WRAP_SQL = RASTER_SQL + """,
wu AS (SELECT *, coalesce(lead(depth) OVER (PARTITION BY v ORDER BY u), first_value(depth) OVER (PARTITION BY v ORDER BY u)) AS nu,
 coalesce(lag(depth) OVER (PARTITION BY v ORDER BY u), last_value(depth) OVER (PARTITION BY v ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS pu,
 coalesce(lead(depth) OVER (PARTITION BY u ORDER BY v), first_value(depth) OVER (PARTITION BY u ORDER BY v)) AS nv,
 coalesce(lag(depth) OVER (PARTITION BY u ORDER BY v), last_value(depth) OVER (PARTITION BY u ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS pv FROM raster)"""
ONE_SIDED_SQL = RASTER_SQL + """,
ln AS (SELECT *, lead(depth) OVER (PARTITION BY v ORDER BY u) AS nu, lag(depth) OVER (PARTITION BY v ORDER BY u) AS pu, lead(depth) OVER (PARTITION BY u ORDER BY v) AS nv, lag(depth) OVER (PARTITION BY u ORDER BY v) AS pv FROM raster),
gr AS (SELECT *, CASE WHEN pu IS NULL AND nu IS NULL THEN 0 WHEN pu IS NULL THEN nu - depth WHEN nu IS NULL THEN depth - pu ELSE (nu-pu)/2 END AS gu,
 CASE WHEN pv IS NULL AND nv IS NULL THEN 0 WHEN pv IS NULL THEN nv - depth WHEN nv IS NULL THEN depth - pv ELSE (nv-pv)/2 END AS gv FROM ln)"""


@query("wn1_central_difference", sql_rounded((WRAP_SQL, "SELECT v, u, (nu-pu)/2 AS gu, (nv-pv)/2 AS gv FROM wu"), "v, u", ["gu", "gv"], 9))
def wn1(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("depth")
    return rounded(raster(spark, sf).select("v", "u", stencils.central_difference(d, "u").alias("gu"), stencils.central_difference(d, "v").alias("gv")), 9)


@query("wn1_one_sided", sql_rounded((ONE_SIDED_SQL, "SELECT v, u, gu, gv FROM gr"), "v, u", ["gu", "gv"], 9))
def wn1b(spark, sf):
    d = F.col("depth")
    return rounded(raster(spark, sf).select("v", "u", stencils.central_difference(d, "u", "one_sided").alias("gu"), stencils.central_difference(d, "v", "one_sided").alias("gv")), 9)


def box_sql(value: str, r: int, out: str, src: str) -> str:
    over = lambda p, o: f"OVER (PARTITION BY {p} ORDER BY {o} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
    return f"""{out}_l AS (SELECT *, SUM({value}) {over('v', 'u')} AS bs, COUNT(*) {over('v', 'u')} AS bn FROM {src}),
{out} AS (SELECT *, SUM(bs) {over('u', 'v')} / SUM(bn) {over('u', 'v')} AS m FROM {out}_l)"""


@query("wn2_box_mean", sql_rounded((RASTER_SQL + ", " + box_sql("depth", 3, "box", "raster"), "SELECT v, u, m FROM box"), "v, u", ["m"]))
def wn2(spark, sf):
    return rounded(stencils.box_sum_mean(raster(spark, sf), "depth", "m", 3).select("v", "u", "m"))


def _gauss_sql() -> str:
    w = stencils.gaussian_weights(2, 1.0)
    line = lambda c, p, o: "(" + " + ".join(f"coalesce(lag({c}, {-k}) OVER (PARTITION BY {p} ORDER BY {o})*{x!r}, 0)" if k < 0 else f"coalesce(lead({c}, {k}) OVER (PARTITION BY {p} ORDER BY {o})*{x!r}, 0)" for k, x in zip(range(-2, 3), w)) + ")/(" + " + ".join(f"CASE WHEN {'lag' if k < 0 else 'lead'}({c}, {abs(k)}) OVER (PARTITION BY {p} ORDER BY {o}) IS NULL THEN 0 ELSE {x!r} END" for k, x in zip(range(-2, 3), w)) + ")"
    return f"WITH {RASTER_SQL}, a AS (SELECT *, {line('depth', 'v', 'u')} AS l FROM raster) SELECT v, u, round({line('l', 'u', 'v')}, 6) + 0.0 AS m FROM a"


@query("wn3_gaussian_blur", _gauss_sql())
def wn3(spark, sf):
    return rounded(stencils.weighted(raster(spark, sf), "depth", "m", stencils.gaussian_weights(2, 1.0)).select("v", "u", "m"))


SQUARE = lambda c, f, src, out: f"""{out}_l AS (SELECT *, {f}({c}) OVER (PARTITION BY v ORDER BY u ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS ll FROM {src}), {out} AS (SELECT *, {f}(ll) OVER (PARTITION BY u ORDER BY v ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM {out}_l)"""


@query("wn4_morphology", f"WITH {RASTER_SQL}, b AS (SELECT v, u, (depth > 20)::INTEGER AS k FROM raster), {SQUARE('k', 'SUM', 'b', 'e')}, {SQUARE('k', 'MAX', 'b', 'd')} SELECT e.v, e.u, e.m = 9 AS eroded, d.m = 1 AS dilated FROM e JOIN d USING (v, u)")
def wn4(spark, sf):
    d = raster(spark, sf).withColumn("k", F.col("depth") > 20)
    return stencils.dilate(stencils.erode(d, "k", "eroded"), "k", "dilated").select("v", "u", "eroded", "dilated")


@query("wn5_pooling", f"WITH {RASTER_SQL} SELECT CAST(v // 4 AS INTEGER) AS v, CAST(u // 4 AS INTEGER) AS u, round(MIN(depth), 10) AS low, round(MAX(depth), 10) AS high, round(AVG(depth), 10) + 0.0 AS mean FROM raster GROUP BY 1, 2")
def wn5(spark, sf):
    return rounded(stencils.pool(raster(spark, sf), "depth", 4), 10)


@query("wn6_cyclic_jump", sql_rounded((WRAP_SQL, "SELECT v, u, abs(nu - depth) AS ju, CASE WHEN lead(depth) OVER (PARTITION BY u ORDER BY v) IS NULL THEN NULL ELSE abs(nv - depth) END AS jv FROM wu"), "v, u", ["ju", "jv"]))
def wn6(spark, sf):
    d = F.col("depth")
    return rounded(raster(spark, sf).select("v", "u", stencils.cyclic_jump(d, "u").alias("ju"), stencils.cyclic_jump(d, "v").alias("jv")))


@query("wn7_integral_image", sql_rounded((RASTER_SQL + ", l AS (SELECT *, SUM(depth) OVER (PARTITION BY v ORDER BY u) AS s FROM raster)", "SELECT v, u, SUM(s) OVER (PARTITION BY u ORDER BY v) AS total FROM l"), "v, u", ["total"], 6))
def wn7(spark, sf):
    return rounded(stencils.integral(raster(spark, sf), "depth", "total").select("v", "u", "total"), 6)


@query("fl21_edge_mask", "WITH " + RASTER_SQL + """, n AS (SELECT *, lead(depth) OVER (PARTITION BY v ORDER BY u) AS a, lag(depth) OVER (PARTITION BY v ORDER BY u) AS b, lead(depth) OVER (PARTITION BY u ORDER BY v) AS c, lag(depth) OVER (PARTITION BY u ORDER BY v) AS d FROM raster)
SELECT v, u, NOT (coalesce(abs(a-depth) > 6 AND abs(a-depth) > 0.5*least(a, depth), false) OR coalesce(abs(b-depth) > 6 AND abs(b-depth) > 0.5*least(b, depth), false)
 OR coalesce(abs(c-depth) > 6 AND abs(c-depth) > 0.5*least(c, depth), false) OR coalesce(abs(d-depth) > 6 AND abs(d-depth) > 0.5*least(d, depth), false)) AS keep FROM n""")
def fl21(spark, sf):
    return rasters.edge_mask(raster(spark, sf), 6.0, 0.5).select("v", "u", "keep")


@query("fl2_sky_gradient", f"""WITH {ONE_SIDED_SQL}, g AS (SELECT *, sqrt(gu*gu + gv*gv) AS gradient, depth*depth AS d2 FROM gr), {box_sql('depth', 2, 'b1', 'g')}, {box_sql('d2', 2, 'b2', 'g')},
x AS (SELECT b1.v, b1.u, b1.gradient, greatest(b2.m - b1.m*b1.m, 0) AS variance, b1.depth > 50*0.4 AS far FROM b1 JOIN b2 USING (v, u)),
c AS (SELECT quantile_cont(gradient, 0.3) AS g, quantile_cont(variance, 0.2) AS s FROM x WHERE far) SELECT v, u, far AND gradient < g AND variance < s AS sky FROM x, c""")
def fl2(spark, sf):
    return rasters.sky_by_gradient(raster(spark, sf), 50.0, 0.4, radius=2).select("v", "u", "sky")


@query("fl6_prune_grazing", f"""WITH {WRAP_SQL}, s AS (SELECT v, u, sqrt(((nu-pu)/2)**2 + ((nv-pv)/2)**2)/greatest(depth, 1e-6) AS slope FROM wu)
SELECT (v::BIGINT*{WIDTH} + u)::BIGINT AS splat_id FROM s, dims WHERE slope < tan(radians(87))*pi()/h""")
def fl6(spark, sf):
    r = raster(spark, sf)
    cloud = S.from_depth(r, height(r), width())
    return rasters.prune_grazing(cloud, r, width(), height(r), 87.0).select("splat_id")


@query("fl24_valid_depth", f"WITH {RASTER_SQL} SELECT v, u, depth > 0.01 AND depth < 'inf'::DOUBLE AS valid FROM raster")
def fl24(spark, sf):
    return raster(spark, sf).select("v", "u", ((F.col("depth") > 0.01) & G.finite(F.col("depth"))).alias("valid"))


@query("fl16_sky_hsv", f"WITH {SPLATS_SQL} SELECT splat_id, greatest(r,g,b) > 0.5 AND (greatest(r,g,b)-least(r,g,b))/greatest(r,g,b) < 0.25 AND z > 0 AS bright, greatest(r,g,b) > 0.75 AND (greatest(r,g,b)-least(r,g,b))/greatest(r,g,b) < 0.25 AND splat_id < 250.0/2 AS sky FROM splats")
def fl16(spark, sf):
    c = F.col
    high, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    return splats(spark, sf).select("splat_id", ((high > 0.5) & ((high - low) / high < 0.25) & (c("z") > 0)).alias("bright"), rasters.sky_hsv(c("r"), c("g"), c("b"), c("splat_id"), F.lit(250.0)).alias("sky"))


def _specular_sql() -> str:
    w = stencils.gaussian_weights(4, 0.3 * ((9 - 1) * 0.5 - 1) + 0.8)
    acc = lambda c, p, o: "(" + " + ".join(f"coalesce({'lag' if k < 0 else 'lead'}({c}, {abs(k)}) OVER (PARTITION BY {p} ORDER BY {o})*{x!r}, 0)" for k, x in zip(range(-4, 5), w)) + ")/(" + " + ".join(f"CASE WHEN {'lag' if k < 0 else 'lead'}({c}, {abs(k)}) OVER (PARTITION BY {p} ORDER BY {o}) IS NULL THEN 0 ELSE {x!r} END" for k, x in zip(range(-4, 5), w)) + ")"
    return f"WITH {RASTER_SQL}, g AS (SELECT v, u, least(depth/30, 1.0) AS gray FROM raster), a AS (SELECT *, {acc('gray', 'v', 'u')} AS l FROM g), b AS (SELECT v, u, gray, {acc('l', 'u', 'v')} AS blur FROM a) SELECT v, u, gray > 0.85 AND abs(gray - blur) < 0.02 AS specular FROM b"


@query("fl17_specular", _specular_sql())
def fl17(spark, sf):
    d = raster(spark, sf).select("v", "u", F.least(F.col("depth") / 30, F.lit(1.0)).alias("gray"))
    return rasters.specular(d, "gray").select("v", "u", "specular")


@query("fl18_validity", f"""WITH {ONE_SIDED_SQL}, b AS (SELECT v, u, (depth < 0.95*60 AND NOT depth > 48 AND NOT depth < 0.5 AND sqrt(gu*gu+gv*gv)/greatest(depth, 1e-6) < 0.15*4)::INTEGER AS k0, (depth < 0.95*60 AND NOT depth > 48 AND NOT depth < 0.5 AND sqrt(gu*gu+gv*gv)/greatest(depth, 1e-6) < 0.15)::INTEGER AS k FROM gr), {SQUARE('k', 'SUM', 'b', 'e')} SELECT v, u, m = 9 AS valid FROM e""")
def fl18(spark, sf):
    d = raster(spark, sf).withColumns({"alpha": F.lit(1.0), "sky": F.col("depth") > 48, "specular": F.col("depth") < 0.5})
    return rasters.validity(d, 60.0).select("v", "u", "valid")


HOLES_SQL = FRAMES_SQL + """, near AS (SELECT a.frame_idx, a.v, a.u, median(b.rendered) AS scale FROM frames a JOIN frames b ON a.frame_idx = b.frame_idx AND abs(a.v-b.v) <= 2 AND abs(a.u-b.u) <= 2 GROUP BY 1, 2, 3),
holes AS (SELECT f.*, CASE WHEN alpha < 0.3 THEN 'alpha' WHEN alpha < 0.9 AND raw < rendered - 0.02*scale THEN 'disoccl' END AS hole_mode FROM frames f JOIN near USING (frame_idx, v, u))"""


def hole_candidates(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    near = stencils.median(f, "rendered", "scale", 2, ("frame_idx",))
    return near.withColumn("hole_mode", rasters.hole_mode(F.col("alpha"), F.col("raw"), F.col("rendered"), F.col("scale")))


@query("fl13_hole_filter", f"WITH {HOLES_SQL} SELECT frame_idx, v, u, hole_mode FROM holes WHERE hole_mode IS NOT NULL")
def fl13(spark, sf):
    return hole_candidates(spark, sf).where("hole_mode is not null").select("frame_idx", "v", "u", "hole_mode")


@query("ag29_frame_diagnostics", f"WITH {HOLES_SQL} SELECT frame_idx, COUNT(*) AS n, COUNT(hole_mode) AS kept, round(1 - COUNT(hole_mode)/COUNT(*)::DOUBLE, 6) + 0.0 AS drop_rate, 1 - COUNT(hole_mode)/COUNT(*)::DOUBLE > 0.3 AS warning FROM holes GROUP BY 1")
def ag29(spark, sf):
    drop = 1 - F.count("hole_mode") / F.count("*")
    return rounded(hole_candidates(spark, sf).groupBy("frame_idx").agg(F.count("*").alias("n"), F.count("hole_mode").alias("kept"), drop.alias("drop_rate"), (drop > 0.3).alias("warning")))


@query("jn8_median_patch", sql_rounded((RASTER_SQL, "SELECT a.v, a.u, median(b.depth) AS m FROM raster a JOIN raster b ON b.v BETWEEN a.v-2 AND a.v+2 AND b.u BETWEEN a.u-2 AND a.u+2 GROUP BY 1, 2"), "v, u", ["m"], 9))
def jn8(spark, sf):
    return rounded(stencils.median(raster(spark, sf), "depth", "m", 2).select("v", "u", "m"), 9)


@query("jn3_radius_join", f"WITH {SPLATS_SQL} SELECT a.splat_id AS lid, b.splat_id AS rid, round(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2), 6) + 0.0 AS dist FROM splats a JOIN splats b ON sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) <= 0.06")
def jn3(spark, sf):
    s = splats(spark, sf)
    return rounded(spatial.radius_join(s, s, 0.06))


@query("jn4_isolated", f"WITH {SPLATS_SQL} SELECT a.splat_id, a.frame_idx FROM splats a WHERE NOT EXISTS (SELECT 1 FROM splats b WHERE b.frame_idx <> a.frame_idx AND sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) <= 0.08)")
def jn4(spark, sf):
    """Splats without one of another frame nearby."""
    s = splats(spark, sf).select("splat_id", "frame_idx", "x", "y", "z")
    near = nearness.near_groups(s, s.withColumnRenamed("frame_idx", "other"), 0.08, group="other")
    return s.select("splat_id", "frame_idx").join(near, (s["splat_id"] == near["splat_id"]) & (s["frame_idx"] != near["other"]), "left_anti")


@query("fl19_consistency_gate", f"WITH {SPLATS_SQL}, n AS (SELECT a.splat_id, COUNT(DISTINCT b.frame_idx) AS support FROM splats a JOIN splats b ON sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) <= 0.12 GROUP BY 1) SELECT splat_id, support FROM n WHERE support >= 3")
def fl19(spark, sf):
    s = splats(spark, sf)
    return nearness.near_groups(s, s, 0.12).groupBy("splat_id").agg(F.count("*").alias("support")).where("support >= 3")


@query("ag15_components", "WITH RECURSIVE " + SPLATS_SQL + """, e AS (SELECT a.splat_id AS a, b.splat_id AS b FROM splats a JOIN splats b ON a.splat_id <> b.splat_id AND sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) <= 0.045),
w AS (SELECT a AS node, a AS seen FROM e UNION SELECT w.node, e.b FROM w JOIN e ON w.seen = e.a) SELECT node, MIN(seen) AS component FROM w GROUP BY 1 HAVING MIN(seen) < node""")
def ag15(spark, sf):
    s = splats(spark, sf)
    return nearness.near_components(s, 0.045).where("component < node")


@query("ag19_voxel_size", f"WITH {SPLATS_SQL}, p AS (SELECT a.splat_id, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS d, row_number() OVER (PARTITION BY a.splat_id ORDER BY sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2), b.splat_id) AS k FROM splats a JOIN splats b ON a.splat_id <> b.splat_id) SELECT round(quantile_cont(d, 0.5), 6) + 0.0 AS voxel FROM p WHERE k <= 5")
def ag19(spark, sf):
    return rounded(quantiles(spatial.knn(splats(spark, sf), 5), "dist", [0.5]).select(F.col("p")[0].alias("voxel")))


VOXEL_SQL = SPLATS_SQL + ", vox AS (SELECT CAST(floor(x/0.1) AS BIGINT) AS vx, CAST(floor(y/0.1) AS BIGINT) AS vy, CAST(floor(z/0.1) AS BIGINT) AS vz, AVG(x) AS x, AVG(y) AS y, AVG(z) AS z, AVG(r) AS r, AVG(g) AS g, AVG(b) AS b, COUNT(*) AS n, MIN(splat_id) AS first_id FROM splats GROUP BY 1, 2, 3)"


@query("ag3_voxel_mean", sql_rounded((VOXEL_SQL, "SELECT * FROM vox"), "vx, vy, vz, n, first_id", ["x", "y", "z", "r", "g", "b"]))
def ag3(spark, sf):
    return rounded(spatial.voxel_mean(splats(spark, sf), 0.1, id="splat_id"))


@query("pr15_new_splats", sql_rounded((VOXEL_SQL + ", d AS (SELECT a.first_id, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS d, row_number() OVER (PARTITION BY a.first_id ORDER BY sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2), b.first_id) AS k FROM vox a JOIN vox b ON a.first_id <> b.first_id)", "SELECT first_id AS splat_id, 0.75*AVG(d) AS scale, ln(0.35/0.65) AS opacity FROM d WHERE k <= 5 GROUP BY 1"), "splat_id", ["scale", "opacity"]))
def pr15(spark, sf):
    v = spatial.voxel_mean(splats(spark, sf), 0.1, id="splat_id").withColumnRenamed("first_id", "splat_id")
    near = spatial.knn(v, 5).groupBy("splat_id").agg((F.avg("dist") * 0.75).alias("scale"))
    return rounded(near.withColumn("opacity", E.logit(F.lit(0.35))))


# --- fits and metrics -------------------------------------------------------------------------------------------------
_SUMS = "SUM(w) AS sw, SUM(w*raw) AS sx, SUM(w*rendered) AS sy, SUM(w*raw*raw) AS sxx, SUM(w*raw*rendered) AS sxy"
_PLAIN = "COUNT(*) AS sw, SUM(raw) AS sx, SUM(rendered) AS sy, SUM(raw*raw) AS sxx, SUM(raw*rendered) AS sxy"
_SOLVE = "CASE WHEN sxx*sw-sx*sx > 0 THEN (sw*sxy-sx*sy)/(sxx*sw-sx*sx) ELSE 0 END AS scale, CASE WHEN sxx*sw-sx*sx > 0 THEN (sxx*sy-sx*sxy)/(sxx*sw-sx*sx) ELSE 0 END AS shift"


@query("ag7_scale_shift", sql_rounded((FRAMES_SQL + f", s AS (SELECT frame_idx, {_PLAIN} FROM frames GROUP BY 1)", f"SELECT frame_idx, {_SOLVE} FROM s"), "frame_idx", ["scale", "shift"]))
def ag7(spark, sf):
    return rounded(robust.scale_and_shift(frames(spark, sf), "raw", "rendered", ["frame_idx"]))


@query("ag8_align_prediction", sql_rounded((FRAMES_SQL + f", s AS (SELECT frame_idx, {_PLAIN} FROM frames GROUP BY 1), f AS (SELECT frame_idx, {_SOLVE} FROM s)", "SELECT frame_idx, v, u, scale*raw + shift AS aligned FROM frames JOIN f USING (frame_idx)"), "frame_idx, v, u", ["aligned"], 4))
def ag8(spark, sf):
    f = frames(spark, sf)
    fit = robust.scale_and_shift(f, "raw", "rendered", ["frame_idx"])
    return rounded(f.join(fit, "frame_idx").select("frame_idx", "v", "u", (F.col("scale") * F.col("raw") + F.col("shift")).alias("aligned")), 4)


def _irls_sql(rounds: int) -> str:
    parts = [FRAMES_SQL, "m AS (SELECT frame_idx, greatest(0.05*quantile_cont(rendered, 0.5), 1e-12) AS delta, quantile_cont(rendered, 0.5) AS med, COUNT(*) AS n FROM frames GROUP BY 1)", f"f0 AS (SELECT frame_idx, {_SOLVE} FROM (SELECT frame_idx, {_PLAIN} FROM frames GROUP BY 1))"]
    for k in range(rounds):
        res = "abs(scale*raw + shift - rendered)"
        parts.append(f"f{k + 1} AS MATERIALIZED (SELECT frame_idx, {_SOLVE} FROM (SELECT frame_idx, {_SUMS} FROM (SELECT frame_idx, raw, rendered, CASE WHEN {res} <= delta THEN 1.0 ELSE delta/greatest({res}, 1e-12) END AS w FROM frames JOIN f{k} USING (frame_idx) JOIN m USING (frame_idx)) GROUP BY 1))")
    return "WITH " + ",\n".join(parts) + f""", r AS (SELECT frame_idx, scale, shift, delta, med, n, abs(scale*raw + shift - rendered) AS res FROM frames JOIN f{rounds} USING (frame_idx) JOIN m USING (frame_idx))
SELECT frame_idx, round(scale, 5) + 0.0 AS scale, round(shift, 5) + 0.0 AS shift, COUNT(*) FILTER (res <= delta) AS inlier_count, round(COUNT(*) FILTER (res <= delta)/COUNT(*)::DOUBLE, 5) AS inlier_fraction, round(quantile_cont(res, 0.5), 5) AS residual_median, round(quantile_cont(res, 0.95), 5) AS residual_p95,
 MAX(n) >= 10 AND COUNT(*) FILTER (res <= delta)/COUNT(*)::DOUBLE >= 0.2 AND quantile_cont(res, 0.95) < 0.25*MAX(med) AS converged FROM r GROUP BY frame_idx, scale, shift"""


@query("ag6_irls_alignment", _irls_sql(10))
def ag6(spark, sf):
    return rounded(robust.irls(frames(spark, sf), "raw", "rendered", ["frame_idx"]), 5)


@query("ag9_depth_metrics", sql_rounded((FRAMES_SQL, "SELECT frame_idx, AVG(abs(raw-rendered)/rendered) AS abs_rel, AVG((raw-rendered)**2/rendered) AS sq_rel, sqrt(AVG((raw-rendered)**2)) AS rmse, AVG((greatest(raw/rendered, rendered/raw) < 1.25)::INTEGER) AS delta1 FROM frames WHERE rendered > 0.5 GROUP BY 1"), "frame_idx", ["abs_rel", "sq_rel", "rmse", "delta1"]))
def ag9(spark, sf):
    return rounded(robust.depth_metrics(frames(spark, sf), "raw", "rendered", ["frame_idx"], F.col("rendered") > 0.5))


@query("ag10_normal_metrics", sql_rounded((SPLATS_SQL + ", a AS (SELECT frame_idx, degrees(acos(greatest(least((x*qx+y*qy+z*qz)/sqrt(x*x+y*y+z*z)/sqrt(qx*qx+qy*qy+qz*qz), 1), -1))) AS a FROM splats)", "SELECT frame_idx, AVG(a) AS mean, AVG(a*a) AS mse, AVG((a < 5)::INTEGER) AS delta_5, AVG((a < 22.5)::INTEGER) AS delta_22_5 FROM a GROUP BY 1"), "frame_idx", ["mean", "mse", "delta_5", "delta_22_5"], 5))
def ag10(spark, sf):
    c = F.col
    d = splats(spark, sf)
    p, q = G.unit((c("x"), c("y"), c("z"))), G.unit((c("qx"), c("qy"), c("qz")))
    d = d.withColumns(dict(zip(("ax", "ay", "az", "bx", "by", "bz"), (*p, *q))))
    return rounded(robust.normal_metrics(d, ("ax", "ay", "az"), ("bx", "by", "bz"), ["frame_idx"]), 5)


@query("ag12_edge_jumps", sql_rounded((WRAP_SQL + ", j AS (SELECT u, abs(nu - depth) AS j FROM wu)", "SELECT u, AVG(j) AS mean, MAX(j) AS largest, AVG((j > 10)::INTEGER) AS density FROM j GROUP BY 1"), "u", ["mean", "largest", "density"]))
def ag12(spark, sf):
    d = raster(spark, sf).select("u", stencils.cyclic_jump(F.col("depth"), "u").alias("j"), "v")
    return rounded(d.groupBy("u").agg(F.avg("j").alias("mean"), F.max("j").alias("largest"), F.avg((F.col("j") > 10).cast("int")).alias("density")))


@query("ag13_seam_metrics", sql_rounded((WRAP_SQL + ", j AS (SELECT u, abs(nu - depth) AS j FROM wu), e AS (SELECT u, AVG(j) AS m, AVG((j > 10)::INTEGER) AS d FROM j GROUP BY 1)", "SELECT AVG(d) AS density, AVG(m) AS severity, AVG((d > 0.5)::INTEGER) AS prevalence FROM e"), "", ["density", "severity", "prevalence"]))
def ag13(spark, sf):
    d = raster(spark, sf).select("u", stencils.cyclic_jump(F.col("depth"), "u").alias("j"))
    e = d.groupBy("u").agg(F.avg("j").alias("m"), F.avg((F.col("j") > 10).cast("int")).alias("d"))
    return rounded(e.agg(F.avg("d").alias("density"), F.avg("m").alias("severity"), F.avg((F.col("d") > 0.5).cast("int")).alias("prevalence")))


@query("ag14_minmax", sql_rounded((FRAMES_SQL + ", p AS (SELECT frame_idx, quantile_cont(raw, 0.02) AS a, quantile_cont(raw, 0.98) AS b FROM frames GROUP BY 1)", "SELECT frame_idx, v, u, greatest(least((raw-a)/(b-a), 1), 0) AS share FROM frames JOIN p USING (frame_idx)"), "frame_idx, v, u", ["share"]))
def ag14(spark, sf):
    return rounded(robust.minmax(frames(spark, sf), "raw", ["frame_idx"], "share", 0.02, 0.98).select("frame_idx", "v", "u", "share"))


@query("ag16_psnr", sql_rounded((FRAMES_SQL + ", m AS (SELECT frame_idx, AVG((raw/120 - rendered/120)**2) AS mse FROM frames GROUP BY 1)", "SELECT frame_idx, CASE WHEN mse < 1e-10 THEN 100 ELSE 10*log10(1/mse) END AS psnr FROM m"), "frame_idx", ["psnr"]))
def ag16(spark, sf):
    m = frames(spark, sf).groupBy("frame_idx").agg(F.avg((F.col("raw") / 120 - F.col("rendered") / 120) ** 2).alias("mse"))
    return rounded(m.select("frame_idx", robust.psnr(F.col("mse")).alias("psnr")))


@query("fl26_anchor_check", "WITH " + FRAMES_SQL + ", m AS (SELECT frame_idx, 10*log10(1/AVG((raw/120 - rendered/120)**2)) AS cur, 10*log10(1/AVG((raw/118 - rendered/120)**2)) AS base FROM frames GROUP BY 1) SELECT frame_idx, cur >= 8 AND greatest(base-cur, 0) <= 1 AS passes FROM m")
def fl26(spark, sf):
    at = lambda k: robust.psnr(F.avg((F.col("raw") / k - F.col("rendered") / 120) ** 2))
    m = frames(spark, sf).groupBy("frame_idx").agg(at(120).alias("cur"), at(118).alias("base"))
    return m.select("frame_idx", views.anchor_passes(F.col("base"), F.col("cur"), 8.0).alias("passes"))


@query("ag5_trimmed_median", sql_rounded((FRAMES_SQL + ", q AS (SELECT frame_idx, CAST(v // 8 AS INTEGER) AS cv, CAST(u // 25 AS INTEGER) AS cu, rendered/raw AS ratio FROM frames), p AS (SELECT frame_idx, cv, cu, quantile_cont(ratio, 0.1) AS a, quantile_cont(ratio, 0.9) AS b, COUNT(*) AS n FROM q GROUP BY 1, 2, 3 HAVING COUNT(*) >= 8)", "SELECT frame_idx, cv, cu, quantile_cont(ratio, 0.5) AS median, MAX(n) AS n FROM q JOIN p USING (frame_idx, cv, cu) WHERE ratio >= a AND ratio <= b GROUP BY 1, 2, 3"), "frame_idx, cv, cu, n", ["median"]))
def ag5(spark, sf):
    q = frames(spark, sf).select("frame_idx", F.floor(F.col("v") / 8).cast("int").alias("cv"), F.floor(F.col("u") / 25).cast("int").alias("cu"), (F.col("rendered") / F.col("raw")).alias("ratio"))
    return rounded(robust.trimmed_median(q, "ratio", ["frame_idx", "cv", "cu"], 0.1, 0.9, 8))


@query("ag20_median_radius", sql_rounded((SPLATS_SQL + ", f AS (SELECT frame_idx, quantile_disc(sqrt(x*x+y*y+z*z), 0.5) AS m FROM splats GROUP BY 1)", "SELECT quantile_cont(m, 0.5) AS radius FROM f"), "", ["radius"]))
def ag20(spark, sf):
    d = splats(spark, sf).select("frame_idx", G.norm(F.col("x"), F.col("y"), F.col("z")).alias("d"))
    f = quantiles(d, "d", [0.5], ["frame_idx"], discrete=True).select("frame_idx", F.col("p")[0].alias("m"))
    return rounded(quantiles(f, "m", [0.5]).select(F.col("p")[0].alias("radius")))


@query("ag22_disparity_quantiles", sql_rounded((SPLATS_SQL, "SELECT quantile_cont(1/z, 0.1) AS p10, quantile_cont(1/z, 0.9) AS p90 FROM splats WHERE z > 0"), "", ["p10", "p90"], 4))
def ag22(spark, sf):
    d = quantiles(splats(spark, sf).where("z > 0"), 1 / F.col("z"), [0.1, 0.9])
    return rounded(d.select(F.col("p")[0].alias("p10"), F.col("p")[1].alias("p90")), 4)


@query("ag23_depth_quantiles", sql_rounded((SPLATS_SQL, "SELECT quantile_cont(z, 0.001) AS a, quantile_cont(z, 0.1) AS b, quantile_cont(z, 0.999) AS c FROM splats WHERE z > 0"), "", ["a", "b", "c"]))
def ag23(spark, sf):
    d = quantiles(splats(spark, sf).where("z > 0"), "z", [0.001, 0.1, 0.999])
    return rounded(d.select(*[F.col("p")[i].alias(n) for i, n in enumerate("abc")]))


@query("ag24_scatter_blend", sql_rounded((FRAMES_SQL, "SELECT v, u, sqrt(SUM(alpha*raw)/nullif(SUM(alpha), 0)) AS value, COUNT(*) AS samples FROM frames GROUP BY 1, 2"), "v, u, samples", ["value"]))
def ag24(spark, sf):
    return rounded(rasters.weighted_scatter(frames(spark, sf), ["v", "u"], "raw", "alpha").withColumn("value", F.sqrt("value")))


@query("ag26_scale_search", sql_rounded((FRAMES_SQL + ", c AS (SELECT s, SUM(least(raw*s, 60)*rendered)/(sqrt(SUM(least(raw*s, 60)**2))*sqrt(SUM(rendered**2))) AS cosine FROM frames, (SELECT pow(10, -1 + 2*k/31.0) AS s FROM range(32) t(k)) GROUP BY 1)", "SELECT CASE WHEN MAX(cosine) >= 0.3 THEN arg_max(s, cosine) ELSE 1 END AS scale, MAX(cosine) AS cosine FROM c"), "", ["scale", "cosine"]))
def ag26(spark, sf):
    """The best of 32 scales, evenly spread over the logarithms of 0.1 to 10."""
    f = views.at_scales(frames(spark, sf).select("raw", "rendered"), 0.1, 10.0, 32)
    return rounded(views.best_scale(f.withColumn("a", F.least(F.col("raw") * F.col("s"), F.lit(60.0))), "s", "a", "rendered"))


@query("ag27_weighted_loss", sql_rounded((FRAMES_SQL, "SELECT 0.5*SUM(abs(raw-rendered)*(alpha >= 0.537)::INTEGER)/SUM((alpha >= 0.537)::INTEGER) AS loss FROM frames"), "", ["loss"]))
def ag27(spark, sf):
    return rounded(views.weighted_l1(frames(spark, sf).withColumn("m", F.col("alpha") >= 0.537), "raw", "rendered", "m", 0.5))


@query("ag34_sky_occupancy", f"WITH {RASTER_SQL} SELECT round(AVG((depth > 45)::INTEGER), 6) AS share, AVG((depth > 45)::INTEGER) > 0.01 AS blend FROM raster")
def ag34(spark, sf):
    share = F.avg((F.col("depth") > 45).cast("int"))
    return rounded(raster(spark, sf).agg(share.alias("share"), (share > 0.01).alias("blend")))


# --- gaps and views ---------------------------------------------------------------------------------------------------
GAPS_SQL = MASKS_SQL + """, per AS (SELECT cam_id, azimuth, AVG(hole::INTEGER) AS share FROM masks GROUP BY 1, 2),
dir AS (SELECT CASE WHEN azimuth >= 315 OR azimuth < 45 THEN 'forward' WHEN azimuth < 135 THEN 'right' WHEN azimuth < 225 THEN 'backward' ELSE 'left' END AS direction, AVG(share) AS fraction FROM per GROUP BY 1),
four(ordinal, direction) AS (VALUES (0, 'forward'), (1, 'right'), (2, 'backward'), (3, 'left')), gap AS (SELECT ordinal::INTEGER AS ordinal, direction, coalesce(fraction, 0) AS fraction FROM four LEFT JOIN dir USING (direction))"""


@query("ag2_gap_directions", sql_rounded((GAPS_SQL, "SELECT * FROM gap"), "ordinal, direction", ["fraction"]))
def ag2(spark, sf):
    return rounded(views.gap_directions(spark, masks(spark, sf)))


@query("ag2_gap_report", f"WITH {GAPS_SQL} SELECT round((SELECT AVG(share) FROM per), 6) + 0.0 AS average, arg_min(direction, ordinal) FILTER (fraction = (SELECT MAX(fraction) FROM gap)) AS worst, coalesce(array_to_string(list(direction ORDER BY fraction DESC, ordinal) FILTER (fraction >= 0.05), ','), '') AS recommended, (SELECT AVG(share) FROM per) < 0.05 AS converged FROM gap")
def ag2r(spark, sf):
    r = views.gap_report(spark, masks(spark, sf))
    return rounded(r.select("average", "worst", F.concat_ws(",", "recommended").alias("recommended"), "converged"))


@query("ag17_coverage", sql_rounded((MASKS_SQL + ", p AS (SELECT cam_id, 1 - AVG(hole::INTEGER) AS c FROM masks GROUP BY 1)", "SELECT coalesce(AVG(c), 1) AS coverage FROM p"), "", ["coverage"]))
def ag17(spark, sf):
    return rounded(views.coverage(masks(spark, sf)))


SHARES_SQL = MASKS_SQL + ", shares AS (SELECT cam_id, azimuth, AVG(hole::INTEGER) AS gap FROM masks GROUP BY 1, 2)"


def shares(spark: SparkSession, sf: str) -> DataFrame:
    return masks(spark, sf).groupBy("cam_id", "azimuth").agg(F.avg(F.col("hole").cast("double")).alias("gap"))


@query("tk1_top_views", f"WITH {SHARES_SQL} SELECT cam_id, round(gap, 6) AS gap FROM shares WHERE gap >= 0.02 ORDER BY gap DESC, cam_id LIMIT 20")
def tk1(spark, sf):
    return rounded(views.top_views(shares(spark, sf), "gap", "cam_id", 0.02, 20).select("cam_id", "gap"))


@query("tk2_repair_cameras", f"WITH {SHARES_SQL} SELECT cam_id FROM shares WHERE gap >= 0.03 ORDER BY gap DESC, cam_id LIMIT 20")
def tk2(spark, sf):
    return views.top_views(shares(spark, sf), "gap", "cam_id", 0.03, 20).select("cam_id")


@query("tk3_anchor_indices", f"WITH {SHARES_SQL}, r AS (SELECT cam_id, row_number() OVER (ORDER BY gap, cam_id) AS k, COUNT(*) OVER () AS n FROM shares) SELECT cam_id FROM r WHERE k <= greatest(1, least(n-1, round_even(0.34*n, 0)))")
def tk3(spark, sf):
    return views.anchor_indices(shares(spark, sf), "gap", "cam_id")


@query("tk5_worst_direction", f"WITH {GAPS_SQL} SELECT direction AS worst FROM gap ORDER BY fraction DESC, ordinal LIMIT 1")
def tk5(spark, sf):
    return views.gap_directions(spark, masks(spark, sf)).agg(F.min_by("direction", F.struct(-F.col("fraction"), "ordinal")).alias("worst"))


@query("tk9_hash_sample", f"WITH {SPLATS_SQL} SELECT splat_id FROM splats ORDER BY md5(splat_id::VARCHAR), splat_id LIMIT 100")
def tk9(spark, sf):
    return splats(spark, sf).select("splat_id").orderBy(F.md5(F.col("splat_id").cast("string")), "splat_id").limit(100)


@query("st9_gap_columns", f"""WITH {SHARES_SQL}, b AS (SELECT trunc((azimuth-45)/360*720)::BIGINT AS s, trunc((azimuth+45)/360*720)::BIGINT AS e FROM shares WHERE gap >= 0.05)
SELECT DISTINCT ((((x % 720) + 720) % 720))::INTEGER AS u FROM (SELECT unnest(range(s, e)) AS x FROM b)""")
def st9(spark, sf):
    return rasters.column_bands(shares(spark, sf), "gap", "azimuth", 720, 0.05)


@query("pr8_gap_seeds", sql_rounded((RASTER_SQL + ", g AS (SELECT v, u, depth, (1 - u/(w-1))*2*pi() AS a, v/(h-1)*pi() AS b FROM raster, dims WHERE v % 4 = 0 AND u % 4 = 0 AND depth > 25)", "SELECT v, u, depth*sin(b)*cos(a) AS x, depth*cos(b) AS y, -depth*sin(b)*sin(a) AS z, 0.01 AS opacity FROM g"), "v, u", ["x", "y", "z", "opacity"]))
def pr8(spark, sf):
    r = raster(spark, sf)
    one = F.lit(1.0)
    ray = G.turn_ray(*G.turn_angles(G.fraction(F.col("u"), width(), "span"), G.fraction(F.col("v"), height(r), "span"), one, one))
    seeds = r.where((F.col("v") % 4 == 0) & (F.col("u") % 4 == 0) & (F.col("depth") > 25))
    return rounded(seeds.select("v", "u", *[(F.col("depth") * c).alias(n) for c, n in zip(ray, "xyz")], F.lit(0.01).alias("opacity")))


@query("jn7_bilinear", sql_rounded((RASTER_SQL + """, p AS (SELECT splat_id, (atan2(x, z)/(2*pi()) + 0.5)*w - 0.5 AS pu, (0.5 - asin(y/sqrt(x*x+y*y+z*z))/pi())*h - 0.5 AS pv, h FROM splats, dims),
c AS (SELECT splat_id, (((floor(pu)+a)::INTEGER % 200) + 200) % 200 AS u, least(greatest(floor(pv)+b, 0), h-1)::INTEGER AS v, (CASE WHEN a = 1 THEN pu-floor(pu) ELSE 1-(pu-floor(pu)) END)*(CASE WHEN b = 1 THEN pv-floor(pv) ELSE 1-(pv-floor(pv)) END) AS k FROM p, (VALUES (0,0),(0,1),(1,0),(1,1)) o(a,b))""".replace("FROM splats, dims", "FROM splats, dims"), "SELECT splat_id, SUM(k*depth) AS depth FROM c JOIN raster USING (v, u) GROUP BY 1"), "splat_id", ["depth"]).replace("WITH ", f"WITH {SPLATS_SQL}, ", 1))
def jn7(spark, sf):
    r = raster(spark, sf)
    u, v = G.ray_pixel(F.col("x"), F.col("y"), F.col("z"), width(), height(r))
    p = splats(spark, sf).select("splat_id", u.alias("pu"), v.alias("pv"))
    return rounded(stencils.bilinear(p, r, "depth", "depth", width(), height(r), ["splat_id"]))


@query("jn9_perspective_view")  # its SQL stands in extra.py
def jn9(spark, sf):
    r = raster(spark, sf)
    v = spark.createDataFrame([(k, 90.0 * k, 0.0) for k in range(4)] + [(4, 0.0, 90.0), (5, 0.0, -90.0)], "view_id int, yaw_deg double, pitch_deg double")
    return rounded(rasters.perspective_view(v, r, "depth", 32, 90.0, width(), height(r)))


@query("jn14_z_buffer", sql_rounded((SPLATS_SQL + ", p AS (SELECT CAST(floor((atan2(x, z)/(2*pi()) + 0.5)*32) AS INTEGER) AS u, CAST(floor((0.5 - asin(y/sqrt(x*x+y*y+z*z))/pi())*16) AS INTEGER) AS v, sqrt(x*x+y*y+z*z) AS d, splat_id, r FROM splats)", "SELECT v, u, MIN(d) AS depth, COUNT(*) AS hits, arg_min(r, d) AS r FROM p GROUP BY 1, 2"), "v, u, hits", ["depth", "r"]))
def jn14(spark, sf):
    c = F.col
    pu, pv = G.ray_pixel(c("x"), c("y"), c("z"), F.lit(32.0), F.lit(16.0))
    p = splats(spark, sf).select(F.floor(pv + 0.5).cast("int").alias("v"), F.floor(pu + 0.5).cast("int").alias("u"), G.norm(c("x"), c("y"), c("z")).alias("d"), "splat_id", "r")
    return rounded(rasters.z_buffer(p, ["v", "u"], "d", ["r"], "splat_id"))


@query("jn15_view_product", f"WITH {SHARES_SQL}, t AS (SELECT k::INTEGER AS frame_idx FROM range(0, 81, 4) r(k)), y AS (SELECT unnest([0, 90, 180, 270])::INTEGER AS yaw) SELECT cam_id, frame_idx, yaw FROM shares, t, y WHERE gap >= 0.05")
def jn15(spark, sf):
    s = shares(spark, sf).where("gap >= 0.05").select("cam_id", F.explode(F.sequence(F.lit(0), F.lit(80), F.lit(4))).alias("frame_idx"))
    return s.select("cam_id", "frame_idx", F.explode(F.array(*map(F.lit, (0, 90, 180, 270)))).alias("yaw"))


# --- sets, text and jobs ----------------------------------------------------------------------------------------------
@query("st1_merge", f"WITH {SPLATS_SQL} SELECT splat_id, 0::INTEGER AS part FROM splats WHERE frame_idx < 5 UNION ALL SELECT splat_id, 1::INTEGER FROM splats WHERE frame_idx >= 3")
def st1(spark, sf):
    s = splats(spark, sf).select("splat_id", "frame_idx")
    return S.merged([s.where("frame_idx < 5"), s.where("frame_idx >= 3")]).select("splat_id", "part")


_SKY_SQL = SPLATS_SQL + ", " + RASTER_SQL + """, base AS (SELECT splat_id, frame_idx, x, y, z, sx, sy, sz, qw, qx, qy, qz, r, g, b, opacity FROM splats),
sky AS (SELECT -1 - (v::BIGINT*200 + u) AS splat_id, NULL::BIGINT AS frame_idx, {r}*sin(v/h*pi())*cos(u/w*2*pi()) AS x, {r}*cos(v/h*pi()) AS y, -{r}*sin(v/h*pi())*sin(u/w*2*pi()) AS z, 8.0 AS sx, 8.0 AS sy, 0.08 AS sz, 1.0 AS qw, 0.0 AS qx, 0.0 AS qy, 0.0 AS qz,
 (u % 7)/7.0 AS r, (v % 5)/5.0 AS g, 0.5 AS b, 0.15 AS opacity FROM raster, dims WHERE depth > 45), both_ AS (SELECT * FROM base UNION ALL SELECT * FROM sky)"""
_SKY_COLUMNS = ["x", "y", "z", "sx", "sy", "sz", "qw", "qx", "qy", "qz", "r", "g", "b", "opacity"]


def _sky(name: str, mode: str, radius: float) -> None:
    @query(name, sql_rounded((_SKY_SQL.format(r=radius), "SELECT * FROM both_"), "splat_id, frame_idx", _SKY_COLUMNS))
    def run(spark, sf):
        """All splats and one for each cell of sky, with every column; frames have no sky splats."""
        d = raster(spark, sf)
        sky = d.where("depth > 45").select("v", "u", (-1 - (F.col("v").cast("long") * WIDTH + F.col("u"))).alias("splat_id"), ((F.col("u") % 7) / 7.0).alias("r"), ((F.col("v") % 5) / 5.0).alias("g"), F.lit(0.5).alias("b"))
        return rounded(S.with_sky(splats(spark, sf).drop("opacity_logit"), sky, height(d), width(), mode).select("splat_id", "frame_idx", *_SKY_COLUMNS))


_sky("st2_sky_append", "background_sphere", 200.0)
_sky("st2_sky_low_opacity", "low_opacity", 150.0)


@query("st7_distinct_frames", f"WITH {VOXEL_SQL.split(', vox AS')[0]} SELECT CAST(floor(x/0.2) AS BIGINT) AS vx, COUNT(DISTINCT frame_idx) AS n FROM splats GROUP BY 1")
def st7(spark, sf):
    return splats(spark, sf).groupBy(spatial.cell(F.col("x"), 0.2).alias("vx")).agg(F.countDistinct("frame_idx").alias("n"))


@query("sf15_direction", f"WITH {MASKS_SQL} SELECT DISTINCT azimuth, CASE WHEN azimuth >= 315 OR azimuth < 45 THEN 'forward' WHEN azimuth < 135 THEN 'right' WHEN azimuth < 225 THEN 'backward' ELSE 'left' END AS direction FROM masks")
def sf15(spark, sf):
    return masks(spark, sf).select("azimuth", T.direction(F.col("azimuth")).alias("direction")).distinct()


@query("sf16_scale_settings", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN CAST(event_id AS DOUBLE)/4 ELSE 'nan'::DOUBLE END AS scale FROM events")
def sf16(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id")
    k = F.col("event_id") % 3
    s = F.when(k == 0, F.lit(" None ")).when(k == 1, F.concat(F.lit("manual:"), (F.col("event_id") / 4).cast("string"))).otherwise("Reprojection")
    return e.select("event_id", T.scale_setting(s).alias("scale"))


@query("sf18_comma_list", "SELECT event_id, array_to_string(list_transform([event_type, user_id::VARCHAR, 'x'], lambda x: trim(x)), '|') AS parts FROM events")
def sf18(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    s = F.concat(F.col("event_type"), F.lit(" , "), F.col("user_id").cast("string"), F.lit(",, x ,"))
    return e.select("event_id", F.concat_ws("|", T.comma_list(s)).alias("parts"))


@query("sf20_progress", "SELECT event_id, user_id AS done, event_id AS total FROM events")
def sf20(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    p = T.progress(F.concat(F.lit("step "), F.col("user_id"), F.lit("/"), F.col("event_id"), F.lit(" of 1/2")))
    return e.select("event_id", p["done"].alias("done"), p["total"].alias("total"))


@query("sf21_hashes", "SELECT event_id, substr(md5(event_type || user_id), 1, 8) AS run, sha256(event_type) AS digest FROM events")
def sf21(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", T.run_hash(F.concat("event_type", F.col("user_id").cast("string"))).alias("run"), F.sha2("event_type", 256).alias("digest"))


@query("sf19_unix_path", r"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '/mnt/c/run/' || user_id ELSE 'run/' || user_id END AS path FROM events")
def sf19(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    p = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("C:\\run\\"), F.col("user_id"))).otherwise(F.concat(F.lit("run\\"), F.col("user_id")))
    return e.select("event_id", T.to_unix_path(p).alias("path"))


@query("sf11_feathered_blend", sql_rounded((FRAMES_SQL, "SELECT frame_idx, v, u, sqrt(alpha*raw + (1-alpha)*rendered) AS blend, exp(alpha*ln(raw) + (1-alpha)*ln(rendered)) AS log_blend, alpha*alpha*(3-2*alpha) AS smooth FROM frames"), "frame_idx, v, u", ["blend", "log_blend", "smooth"], 8))
def sf11(spark, sf):
    a, x, y = F.col("alpha"), F.col("raw"), F.col("rendered")
    return rounded(frames(spark, sf).select("frame_idx", "v", "u", F.sqrt(a * x + (1 - a) * y).alias("blend"), E.log_blend(x, y, a).alias("log_blend"), E.smoothstep(a).alias("smooth")), 8)


@query("fl30_expired_jobs", f"WITH {JOBS_SQL}, n AS (SELECT MAX(last_updated) AS now FROM jobs) SELECT job_id FROM jobs, n WHERE status IN ('complete', 'error') AND epoch_us(now) - epoch_us(last_updated) > 7200000000")
def fl30(spark, sf):
    j = jobs(spark, sf)
    return J.expired(j, j.agg(F.max("last_updated")).scalar()).select("job_id")


@query("ag30_queue_counts", f"WITH {JOBS_SQL} SELECT status, COUNT(*) AS n FROM jobs GROUP BY 1")
def ag30(spark, sf):
    return J.queue_counts(jobs(spark, sf))


@query("wn9_queue_position", f"WITH {JOBS_SQL} SELECT job_id, row_number() OVER (ORDER BY created_at, job_id) AS position FROM jobs WHERE status = 'queued'")
def wn9(spark, sf):
    return J.queue_positions(jobs(spark, sf)).select("job_id", "position")


@query("wn12_log_tail", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20")
def wn12(spark, sf):
    return J.tail(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id"), 20, "user_id", "event_id")


@query("jn20_active_files", f"WITH {JOBS_SQL}, f AS (SELECT lpad(job_id::VARCHAR, 9, '0') AS id, status FROM jobs) SELECT 'out_' || id || '.ply' AS path FROM f WHERE NOT EXISTS (SELECT 1 FROM f a WHERE a.status = 'processing' AND contains('out_' || f.id || '.ply', a.id))")
def jn20(spark, sf):
    j = jobs(spark, sf).withColumn("job_id", F.lpad(F.col("job_id").cast("string"), 9, "0"))
    files = j.select(F.concat(F.lit("out_"), "job_id", F.lit(".ply")).alias("path"))
    return J.unprotected_files(files, j.where("status = 'processing'").select("job_id"))


_UUID_SQL = "substr(md5(job_id::VARCHAR), 1, 8) || '-' || substr(md5(job_id::VARCHAR), 9, 4) || '-' || substr(md5(job_id::VARCHAR), 13, 4) || '-' || substr(md5(job_id::VARCHAR), 17, 4) || '-' || substr(md5(job_id::VARCHAR), 21, 12)"


@query("jn20_uuid_files", f"""WITH {JOBS_SQL}, u AS (SELECT job_id AS n, status, CASE WHEN job_id % 97 = 0 THEN substr(md5(job_id::VARCHAR), 1, 5) ELSE {_UUID_SQL} END AS id, {_UUID_SQL} AS name FROM jobs),
f AS (SELECT 'results/' || CASE n % 3 WHEN 0 THEN name || '.ply' WHEN 1 THEN 'upload_' || name || '_out.ply' ELSE name || '-depth.npy' END AS path FROM u), a AS (SELECT id FROM u WHERE status = 'processing')
SELECT path, MIN(id) AS first_id, COUNT(id)::BIGINT AS n_ids FROM f LEFT JOIN a ON contains(path, id) GROUP BY path""")
def jn20_uuid(spark, sf):
    """Files named after UUIDs with the active jobs whose id they hold; some ids are short and lie in longer ones."""
    digest = F.md5(F.col("job_id").cast("string").cast("binary"))
    at = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    j = jobs(spark, sf).select(F.col("job_id").alias("n"), "status", digest.alias("digest"), F.concat_ws("-", *at).alias("name"))
    kind = F.col("n") % 3
    path = F.concat(F.lit("results/"), F.when(kind == 0, F.concat("name", F.lit(".ply"))).when(kind == 1, F.concat(F.lit("upload_"), "name", F.lit("_out.ply"))).otherwise(F.concat("name", F.lit("-depth.npy"))))
    files = j.select(path.alias("path")).distinct()
    active = j.where("status = 'processing'").select(F.when(F.col("n") % 97 == 0, F.substring("digest", 1, 5)).otherwise(F.col("name")).alias("job_id"))
    held = J.containing(files, active).groupBy("path").agg(F.min("job_id").alias("first_id"), F.count("*").alias("n_ids"))
    return files.join(held.hint("merge"), "path", "left").fillna(0, ["n_ids"])


@query("ag31_gallery", f"WITH {MASKS_SQL} SELECT cam_id::VARCHAR AS cam, array_to_string(list(DISTINCT k ORDER BY k), ',') AS kinds FROM (SELECT cam_id, CASE WHEN hole THEN 'mask' ELSE 'rgb' END AS k FROM masks) GROUP BY 1")
def ag31(spark, sf):
    name = F.concat(F.lit("cam_"), F.col("cam_id").cast("string"), F.lit("_"), F.when(F.col("hole"), "mask").otherwise("rgb"), F.lit(".png"))
    parts = masks(spark, sf).select(F.split(F.regexp_replace(name, r"\.png$", ""), "_").alias("p"))
    return parts.groupBy(F.col("p")[1].alias("cam")).agg(F.concat_ws(",", F.array_sort(F.collect_set(F.col("p")[2]))).alias("kinds"))


@query("ud2_mock_depth", sql_rounded((SPLATS_SQL, "SELECT splat_id, greatest(5 + 10*(r+g+b)/3, 0.1) AS depth, (r+g+b)/3 < 0.9 AS mask FROM splats"), "splat_id, mask", ["depth"]))
def ud2(spark, sf):
    light = (F.col("r") + F.col("g") + F.col("b")) / 3
    return rounded(splats(spark, sf).select("splat_id", F.greatest(5.0 + 10.0 * light, F.lit(0.1)).alias("depth"), (light < 0.9).alias("mask")))


def _guided_sql() -> str:
    return f"""WITH {RASTER_SQL}, i AS (SELECT v, u, depth AS p, least(depth/50, 1.0) AS g FROM raster), i2 AS (SELECT *, g*p AS gp, g*g AS gg FROM i), {box_sql('p', 4, 'bp', 'i2')}, {box_sql('g', 4, 'bg', 'i2')}, {box_sql('gp', 4, 'bgp', 'i2')}, {box_sql('gg', 4, 'bgg', 'i2')},
k AS (SELECT bp.v, bp.u, bp.g, bp.m AS mp, bg.m AS mg, (bgp.m - bg.m*bp.m)/(bgg.m - bg.m*bg.m + 1e-4) AS a FROM bp JOIN bg USING (v, u) JOIN bgp USING (v, u) JOIN bgg USING (v, u)), k2 AS (SELECT *, mp - a*mg AS b FROM k), {box_sql('a', 4, 'ba', 'k2')}, {box_sql('b', 4, 'bb', 'k2')}
SELECT ba.v, ba.u, round(ba.m*ba.g + bb.m, 5) + 0.0 AS depth FROM ba JOIN bb USING (v, u)"""


@query("ud10_guided_filter", _guided_sql())
def ud10(spark, sf):
    d = raster(spark, sf).select("v", "u", F.col("depth").alias("p"), F.least(F.col("depth") / 50, F.lit(1.0)).alias("g"))
    d = d.withColumns({"gp": F.col("g") * F.col("p"), "gg": F.col("g") ** 2})
    d = stencils.box_means(d, {c: f"m_{c}" for c in ("p", "g", "gp", "gg")}, 4)
    d = d.withColumn("a", (F.col("m_gp") - F.col("m_g") * F.col("m_p")) / (F.col("m_gg") - F.col("m_g") ** 2 + 1e-4))
    d = d.withColumn("b", F.col("m_p") - F.col("a") * F.col("m_g"))
    d = stencils.box_means(d, {c: f"n_{c}" for c in ("a", "b")}, 4)
    return rounded(d.select("v", "u", (F.col("n_a") * F.col("g") + F.col("n_b")).alias("depth")), 5)
