"""Queries of the remaining layouts, clusters, trackers and small functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import geometry as G
from skyloom.operators import generators, models, nearness, patches, robust, spatial, stencils, views
from skyloom.operators.quantiles import quantiles
from skyloom.plans.refine import GAPS_SQL, SHARES_SQL, SQUARE, shares
from skyloom.plans.tables import FRAMES_SQL, MASKS_SQL, RASTER_SQL, SPLATS_SQL, frames, masks, query, raster, rounded, splats, sql_rounded


@query("gn6_pole_views", "SELECT * FROM (VALUES ('zenith', 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE), ('nadir', 1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, -1.0, 0.0)) t(name, rx, ry, rz, dx, dy, dz, fx, fy, fz)")
def gn6(spark, sf):
    return generators.pole_views(spark)


@query("gn8_cap_layout", "WITH f AS (SELECT least(unnest([60.0, 90.0, 125.0, 179.0]), 170.0)::DOUBLE AS fov) SELECT fov, 512::INTEGER AS width, 512::INTEGER AS height, round(256/tan(radians(fov)/2), 6) + 0.0 AS focal FROM f")
def gn8(spark, sf):
    return rounded(generators.cap_layout(spark, 512, (60, 90, 125, 179)))


@query("gn12_icosahedral_faces", """WITH g AS (SELECT (1 + sqrt(5))/2 AS g), s AS (SELECT a, b*g AS b FROM g, (VALUES (-1), (1)) x(a), (VALUES (-1), (1)) y(b)),
v AS (SELECT row_number() OVER () AS i, x, y, z FROM (SELECT 0.0 AS x, a AS y, b AS z FROM s UNION ALL SELECT a, b, 0.0 FROM s UNION ALL SELECT b, 0.0, a FROM s)),
e AS (SELECT p.i AS i, q.i AS j FROM v p JOIN v q ON p.i < q.i AND (p.x-q.x)**2 + (p.y-q.y)**2 + (p.z-q.z)**2 < 4.1),
t AS (SELECT p.x+q.x+r.x AS x, p.y+q.y+r.y AS y, p.z+q.z+r.z AS z FROM e a JOIN e b ON a.i = b.i AND a.j < b.j JOIN e c ON c.i = a.j AND c.j = b.j JOIN v p ON p.i = a.i JOIN v q ON q.i = a.j JOIN v r ON r.i = b.j)
SELECT round(x/sqrt(x*x+y*y+z*z), 6) + 0.0 AS cx, round(y/sqrt(x*x+y*y+z*z), 6) + 0.0 AS cy, round(z/sqrt(x*x+y*y+z*z), 6) + 0.0 AS cz FROM t""")
def gn12(spark, sf):
    return rounded(generators.icosahedral_faces(spark))


@query("gn16_eye_paths", """WITH k AS (SELECT kind, s::INTEGER AS step, s/59.0 AS t, s/59.0*2*pi() AS a FROM (SELECT unnest(['swipe', 'shake', 'rotate', 'rotate_forward']) AS kind), range(60) r(s))
SELECT kind, step, round(CASE kind WHEN 'swipe' THEN 0.1*(2*t-1) WHEN 'shake' THEN CASE WHEN t < 0.5 THEN 0.1*sin(2*a) ELSE 0 END ELSE 0.1*sin(a) END, 6) + 0.0 AS ex,
 round(CASE kind WHEN 'shake' THEN CASE WHEN t < 0.5 THEN 0 ELSE 0.1*sin(2*a) END WHEN 'rotate' THEN 0.1*cos(a) ELSE 0 END, 6) + 0.0 AS ey, round(CASE WHEN kind = 'rotate_forward' THEN 0.1*(1-cos(a))/2 ELSE 0 END, 6) + 0.0 AS ez FROM k""")
def gn16(spark, sf):
    return rounded(generators.eye_paths(spark))


@query("wn10_tiles", "SELECT r::INTEGER AS row, c::INTEGER AS col, least(r*288, 1152)::INTEGER AS top, least(c*288, 1152)::INTEGER AS left FROM range(5) a(r), range(5) b(c)".replace("AS left", 'AS "left"'))
def wn10(spark, sf):
    return generators.tiles(spark, 1536, 384, 0.25)


_PATCHES_SQL = f"WITH {RASTER_SQL} SELECT v, u, round(depth, 6) AS depth, r::INTEGER AS row, c::INTEGER AS col, (v - r * 36)::INTEGER AS i, (u - c * 36)::INTEGER AS j FROM raster JOIN dims ON true JOIN range(1000) a(r) ON v >= r * 36 AND v < r * 36 + 48 AND r <= greatest(ceil((h - 48) / 36), 0) JOIN range(1000) b(c) ON u >= c * 36 AND u < c * 36 + 48 AND c <= greatest(ceil((w - 48) / 36), 0)"


@query("wn10_split_patches", _PATCHES_SQL)
def wn10_split(spark, sf):
    """Patches of 48 cells that share a quarter with the next."""
    return rounded(patches.split(raster(spark, sf).select("v", "u", "depth"), 48)).select("v", "u", "depth", "row", "col", "i", "j")


@query("wn10_merge_patches", f"WITH {RASTER_SQL} SELECT v, u, round(depth, 6) AS depth FROM raster")
def wn10_merge(spark, sf):
    """The patches less half of what they share, side by side: the raster again."""
    cut = patches.split(raster(spark, sf).select("v", "u", "depth"), 48).drop("v", "u")
    return rounded(patches.merge(cut, 48, 6).select("v", "u", "depth"))


@query("wn8_cumulative_steps", "SELECT l_orderkey, l_linenumber, round(SUM(s) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 6) + 0.0 AS travelled FROM (SELECT l_orderkey, l_linenumber, SUM(l_quantity) AS s FROM lineitem GROUP BY 1, 2)")
def wn8(spark, sf):
    from pyspark.sql import Window

    d = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("s"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(d.select("l_orderkey", "l_linenumber", F.sum("s").over(w).alias("travelled")))


@query("wn11_speck_fill", f"WITH {RASTER_SQL}, {SQUARE('depth', 'MIN', 'raster', 'e')} SELECT v, u, round(CASE WHEN depth > 40 THEN m ELSE depth END, 6) + 0.0 AS depth FROM e")
def wn11(spark, sf):
    d = stencils.separable(raster(spark, sf), "depth", "low", F.min, 1)
    return rounded(d.select("v", "u", F.when(F.col("depth") > 40, F.col("low")).otherwise(F.col("depth")).alias("depth")))


@query("fl20_isolated_clusters", "WITH RECURSIVE " + SPLATS_SQL + """, r AS (SELECT splat_id, x, y, z, sqrt(x*x+y*y+z*z) AS d FROM splats), c AS (SELECT quantile_cont(d, 0.9) AS far FROM r), f AS (SELECT r.* FROM r, c WHERE d > far), n AS (SELECT r.* FROM r, c WHERE d <= far),
e AS (SELECT a.splat_id AS a, b.splat_id AS b FROM f a JOIN f b ON a.splat_id <> b.splat_id JOIN c ON sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) <= 0.2*far), w AS (SELECT splat_id AS node, splat_id AS seen FROM f UNION SELECT w.node, e.b FROM w JOIN e ON w.seen = e.a),
k AS (SELECT node, MIN(seen) AS component FROM w GROUP BY 1), near AS (SELECT DISTINCT f.splat_id FROM f JOIN n ON true JOIN c ON sqrt((f.x-n.x)**2 + (f.y-n.y)**2 + (f.z-n.z)**2) <= 0.5*far),
bad AS (SELECT component FROM k LEFT JOIN near ON node = splat_id GROUP BY 1 HAVING COUNT(*) <= 500 AND COUNT(splat_id) = 0) SELECT splat_id FROM splats WHERE splat_id NOT IN (SELECT node FROM k JOIN bad USING (component))""")
def fl20(spark, sf):
    s = splats(spark, sf).select("splat_id", "x", "y", "z").withColumn("d", G.norm(F.col("x"), F.col("y"), F.col("z")))
    far = quantiles(s, "d", [0.9]).first()["p"][0]
    out, near = s.where(F.col("d") > far), s.where(F.col("d") <= far)
    named = nearness.near_components(out, 0.2 * far).withColumnRenamed("node", "splat_id")
    close = nearness.near_any(out, near, 0.5 * far).withColumn("close", F.lit(1))
    bad = named.join(close, "splat_id", "left").groupBy("component").agg(F.count("*").alias("n"), F.count("close").alias("c")).where("n <= 500 and c = 0")
    return s.join(named.join(bad, "component", "left_semi").select("splat_id"), "splat_id", "left_anti").select("splat_id")


@query("fl25_provenance", f"WITH {SPLATS_SQL} SELECT splat_id FROM splats WHERE (frame_idx % 5)::TINYINT = 3")
def fl25(spark, sf):
    return splats(spark, sf).withColumn("provenance", (F.col("frame_idx") % 5).cast("tinyint")).where("provenance = 3").select("splat_id")


@query("fl28_holes", f"WITH {SPLATS_SQL} SELECT splat_id, sqrt(r*r + g*g + b*b) < 0.8 AS hole FROM splats")
def fl28(spark, sf):
    return splats(spark, sf).select("splat_id", (G.norm(F.col("r"), F.col("g"), F.col("b")) < 0.8).alias("hole"))


@query("ag28_rig_holes", sql_rounded((SHARES_SQL, "SELECT AVG(gap) AS share FROM shares"), "", ["share"]))
def ag28(spark, sf):
    return rounded(shares(spark, sf).agg(F.avg("gap").alias("share")))


@query("ag18_refine_metrics", sql_rounded((FRAMES_SQL + ", m AS (SELECT frame_idx, 10*log10(1/AVG((raw/120 - rendered/120)**2)) AS p, 1 - AVG((alpha < 0.333)::INTEGER) AS before, 1 - AVG((alpha < 0.123)::INTEGER) AS after FROM frames GROUP BY 1)", "SELECT AVG(p) AS psnr, AVG(before) AS before, AVG(after) AS after FROM m"), "", ["psnr", "before", "after"]))
def ag18(spark, sf):
    m = frames(spark, sf).groupBy("frame_idx").agg(robust.psnr(F.avg((F.col("raw") / 120 - F.col("rendered") / 120) ** 2)).alias("p"), *[(1 - F.avg((F.col("alpha") < k).cast("int"))).alias(n) for n, k in (("before", 0.333), ("after", 0.123))])
    return rounded(m.agg(F.avg("p").alias("psnr"), F.avg("before").alias("before"), F.avg("after").alias("after")))


@query("ag11_tracker", sql_rounded((FRAMES_SQL + ", m AS (SELECT frame_idx, AVG(abs(raw-rendered)/rendered) AS a, sqrt(AVG((raw-rendered)**2)) AS r FROM frames WHERE rendered > 0.5 GROUP BY 1)", "SELECT AVG(a) AS abs_rel, AVG(r) AS rmse, COUNT(*) AS n FROM m"), "n", ["abs_rel", "rmse"]))
def ag11(spark, sf):
    per = robust.depth_metrics(frames(spark, sf), "raw", "rendered", ["frame_idx"], F.col("rendered") > 0.5)
    return rounded(per.agg(F.avg("abs_rel").alias("abs_rel"), F.avg("rmse").alias("rmse"), F.count("*").alias("n")))


@query("ag33_outdoor", sql_rounded((SPLATS_SQL, "SELECT frame_idx, AVG(r) AS p_outdoor, AVG(r) >= 0.5 AS outdoor FROM splats GROUP BY 1"), "frame_idx, outdoor", ["p_outdoor"]))
def ag33(spark, sf):
    return rounded(models.outdoor_share(splats(spark, sf), "frame_idx", "r"))


@query("tk4_recommended", f"WITH {GAPS_SQL} SELECT direction, (row_number() OVER (ORDER BY fraction DESC, ordinal))::INTEGER AS place FROM gap WHERE fraction >= 0.05")
def tk4(spark, sf):
    from pyspark.sql import Window

    g = views.gap_directions(spark, masks(spark, sf)).where("fraction >= 0.05")  # four rows at most
    return g.select("direction", F.row_number().over(Window.orderBy(F.desc("fraction"), "ordinal")).alias("place"))


@query("tk7_first_path", "SELECT MIN('run_' || event_type || '/gaussians.ply') AS path FROM events")
def tk7(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").agg(F.min(F.concat(F.lit("run_"), "event_type", F.lit("/gaussians.ply"))).alias("path"))


@query("tk10_stride_sample", f"WITH {RASTER_SQL} SELECT v, u, round(depth, 6) AS depth FROM raster WHERE v % 4 = 0 AND u % 4 = 0")
def tk10(spark, sf):
    return rounded(raster(spark, sf).where("v % 4 = 0 and u % 4 = 0"))


@query("st6_mask_algebra", f"WITH {RASTER_SQL} SELECT v, u, depth > 10 AND depth < 30 AS both, depth > 30 OR depth < 5 AS either, NOT depth > 20 AS neither FROM raster")
def st6(spark, sf):
    d = F.col("depth")
    return raster(spark, sf).select("v", "u", ((d > 10) & (d < 30)).alias("both"), ((d > 30) | (d < 5)).alias("either"), (~(d > 20)).alias("neither"))


@query("st8_scale_heads", "SELECT event_id, array_to_string(list_sort(list_filter(['base', 'scale', event_type], lambda x: x <> 'scale')), ',') AS heads FROM events")
def st8(spark, sf):
    heads = F.array_except(F.array(F.lit("base"), F.lit("scale"), F.col("event_type")), F.array(F.lit("scale")))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.concat_ws(",", F.array_sort(heads)).alias("heads"))


@query("sf17_select_trajectories", f"WITH {GAPS_SQL} SELECT direction AS preset FROM gap WHERE fraction >= 0.05 AND direction IN ('forward', 'backward', 'left', 'right')")
def sf17(spark, sf):
    r = views.gap_report(spark, masks(spark, sf))
    return r.select(F.explode("recommended").alias("preset")).where(F.col("preset").isin(*generators.PRESETS))


@query("sf22_json", f"WITH {SHARES_SQL} SELECT '{{\"cam_id\":' || cam_id || ',\"hole\":' || (gap > 0.1)::VARCHAR || '}}' AS line FROM shares")
def sf22(spark, sf):
    return shares(spark, sf).select(F.to_json(F.struct("cam_id", (F.col("gap") > 0.1).alias("hole"))).alias("line"))


@query("sf24_arrays", "SELECT event_id, array_to_string(list_reverse([event_type, 'b', 'c'])[1:2], ',') AS part FROM events")
def sf24(spark, sf):
    a = F.slice(F.reverse(F.array(F.col("event_type"), F.lit("b"), F.lit("c"))), 1, 2)
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.concat_ws(",", a).alias("part"))


@query("sf28_logging_stretch", f"WITH {RASTER_SQL}, m AS (SELECT a.v, a.u, median(b.depth) AS m FROM raster a JOIN raster b ON b.v BETWEEN a.v - 1 AND a.v + 1 AND b.u BETWEEN a.u - 1 AND a.u + 1 GROUP BY 1, 2), p AS (SELECT MIN(m) AS a, MAX(m) AS b FROM m) SELECT v, u, round((m - a) / (b - a + 1e-8), 6) + 0.0 AS share FROM m, p")
def sf28(spark, sf):
    """The preview's share of the range, after a 3 x 3 median that is clipped at the border."""
    d = stencils.median(raster(spark, sf), "depth", "m", 1)
    ends = d.agg(F.min("m").alias("a"), F.max("m").alias("b"))
    return rounded(d.join(F.broadcast(ends)).select("v", "u", ((F.col("m") - F.col("a")) / (F.col("b") - F.col("a") + 1e-8)).alias("share")))


@query("sf27_job_age", "SELECT event_id, epoch_us((SELECT MAX(ts) FROM events)) - epoch_us(ts) AS age_us FROM events")
def sf27(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.select("event_id", (F.unix_micros(e.agg(F.max("ts")).scalar()) - F.unix_micros("ts")).alias("age_us"))
