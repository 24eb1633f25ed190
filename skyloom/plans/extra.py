"""Cameras, cube maps, projections, checks and small lookups over the driver's tables, each beside its SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from skyloom.functions import geometry as G
from skyloom.functions import rotations
from skyloom.functions import text as T
from skyloom.operators import cameras, rasters, splats as S
from skyloom.operators.quantiles import quantiles
from skyloom.plans.refine import SHARES_SQL, shares
from skyloom.plans.scene import SPLAT_GRID_SQL, kept_cells
from skyloom.plans.tables import FRAMES_SQL, JOBS_SQL, MASKS_SQL, ORACLE_SQL, RASTER_SQL, SPLATS_SQL, frames, height, jobs, masks, query, raster, rounded, splats, sql_rounded, width
from skyloom.sources import ply

#: A view of 640 x 480 pixels, 500 pixels of focal length, turned by 30 degrees and moved.
_A = math.radians(30)
EXTRINSIC = np.array([[math.cos(_A), 0, math.sin(_A), 0.1], [0, 1, 0, -0.2], [-math.sin(_A), 0, math.cos(_A), 0.3], [0, 0, 0, 1]])
INTRINSIC = np.array([[500.0, 0, 320, 0], [0, 500, 240, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
_M = cameras.unprojection(EXTRINSIC, INTRINSIC, 640, 480)
_ROWS = ", ".join(" + ".join([f"({float(_M[i, j])!r})*{a}" for j, a in enumerate("xyz")] + [f"({float(_M[i, 3])!r})"]) + f" AS {n}" for i, n in enumerate(("x2", "y2", "z2")))


@query("pr13_unproject", f"WITH {SPLATS_SQL}, m AS (SELECT splat_id, {_ROWS} FROM splats) SELECT splat_id, round(x2, 6) + 0.0 AS x, round(y2, 6) + 0.0 AS y, round(z2, 6) + 0.0 AS z FROM m")
def pr13(spark, sf):
    return rounded(cameras.moved(splats(spark, sf), _M).select("splat_id", "x", "y", "z"))


@query("pr24_rigid_inverse", sql_rounded((SPLATS_SQL, "SELECT splat_id, x - 1.0 AS x2, y AS y2, z + 2.0 AS z2 FROM splats"), "splat_id", ["x2", "y2", "z2"]))
def pr24(spark, sf):
    """A point carried into a frame and on by that frame's inverse and a shift; the SQL knows the shift alone."""
    s = splats(spark, sf)
    r, t = [F.lit(float(x)) for x in EXTRINSIC[:3, :3].ravel()], tuple(F.lit(float(x)) for x in EXTRINSIC[:3, 3])
    there = tuple(a + b for a, b in zip(G.rotate(r, tuple(F.col(a) for a in "xyz")), t))
    back, move = cameras.rigid_inverse(r, t)
    here = tuple(a + b for a, b in zip(G.rotate(back, there), move))
    return rounded(s.select("splat_id", (here[0] - 1.0).alias("x2"), here[1].alias("y2"), (here[2] + 2.0).alias("z2")))


@query("pr24_unproject_depth", sql_rounded((RASTER_SQL, "SELECT v, u, (u - 100.0)/123.457*depth AS x, (v - 40.0)/111.713*depth AS y, depth AS z, degrees(2*atan(200.0/(2*(100 + u)))) AS fov FROM raster"), "v, u", ["x", "y", "z", "fov"]))
def pr24_depth(spark, sf):
    c = F.col
    ray = cameras.pixel_ray(c("u"), c("v"), F.lit(123.457), F.lit(111.713), F.lit(100.0), F.lit(40.0))
    d = raster(spark, sf).select("v", "u", *[(r * c("depth")).alias(a) for r, a in zip(ray, "xyz")], cameras.field_of_view(100.0 + c("u"), F.lit(200.0)).alias("fov"))
    return rounded(d)


@query("pr24_to_pixel", sql_rounded((SPLATS_SQL, "SELECT splat_id, 500*x/z + 320 AS px, 400*y/z + 240 AS py FROM splats WHERE z > 0.1"), "splat_id", ["px", "py"], 4))
def pr24_pixel(spark, sf):
    s = splats(spark, sf).where("z > 0.1")
    px, py = cameras.to_pixel(tuple(F.col(a) for a in "xyz"), *map(F.lit, (500.0, 400.0, 320.0, 240.0)))
    return rounded(s.select("splat_id", px.alias("px"), py.alias("py")), 4)


@query("pr24_dehomogenised", sql_rounded((SPLATS_SQL, "SELECT splat_id, x/(1 + opacity) AS hx, y/(1 + opacity) AS hy, z/(1 + opacity) AS hz FROM splats"), "splat_id", ["hx", "hy", "hz"]))
def pr24_homogeneous(spark, sf):
    h = cameras.dehomogenised(F.col("x"), F.col("y"), F.col("z"), 1 + F.col("opacity"))
    return rounded(splats(spark, sf).select("splat_id", *[c.alias(f"h{a}") for c, a in zip(h, "xyz")]))


@query("pr25_largest_offset", sql_rounded((SPLATS_SQL + ", q AS (SELECT quantile_cont(z, 0.001) AS near FROM splats WHERE z > 0)", "SELECT 0.08*sqrt((640/500.0)**2 + (480/500.0)**2)*near AS sideways, 0.15*near AS forward FROM q"), "", ["sideways", "forward"], 8))
def pr25(spark, sf):
    near = quantiles(splats(spark, sf).where("z > 0"), "z", [0.001]).select(F.col("p")[0].alias("near"))
    a, b = cameras.largest_offset(F.col("near"), 640, 480, 500.0, 0.08, 0.15)
    return rounded(near.select(a.alias("sideways"), b.alias("forward")), 8)


@query("pr25_screen_size", "WITH s AS (SELECT o_orderkey, (o_orderkey % 5000 + 101)::INTEGER AS w, (o_orderkey % 4001 + 77)::INTEGER AS h FROM orders), t AS (SELECT o_orderkey, CASE WHEN h > 3000 THEN w // 2 ELSE w END AS w, CASE WHEN h > 3000 THEN h // 2 ELSE h END AS h FROM s) SELECT o_orderkey, (w + w % 2)::INTEGER AS width, (h + h % 2)::INTEGER AS height FROM t")
def pr25_screen(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 5000 + 101).cast("int").alias("w"), (F.col("o_orderkey") % 4001 + 77).cast("int").alias("h"))
    w, h = cameras.screen_size(F.col("w"), F.col("h"))
    return o.select("o_orderkey", w.alias("width"), h.alias("height"))


def _jet_sql(channel: str) -> str:
    p = cameras.JET[channel]
    cases = " ".join(f"WHEN x <= {x1} THEN {y0} + (x - {x0})*{(y1 - y0) / (x1 - x0)!r}" for (x0, y0), (x1, y1) in zip(p, p[1:]))
    return f"floor(greatest(least(CASE {cases} ELSE {p[-1][1]} END, 1), 0)*255 + 1e-9)::INTEGER AS {channel}"


@query("pr28_colour_map", f"WITH {RASTER_SQL}, s AS (SELECT v, u, least(floor(greatest(least(depth/40, 1), 0)*256), 255)/255 AS x FROM raster) SELECT v, u, {', '.join(map(_jet_sql, 'rgb'))} FROM s")
def pr28(spark, sf):
    c = cameras.colourise(F.col("depth"), 0.0, 40.0)
    return raster(spark, sf).select("v", "u", *[x.alias(n) for n, x in c.items()])


@query("gn18_base_layers", sql_rounded((RASTER_SQL + ", c AS (SELECT (v // 4)::INTEGER AS v, (u // 4)::INTEGER AS u, MAX(1/depth) AS near FROM raster WHERE depth > 0 GROUP BY 1, 2), l AS (SELECT c.*, k::INTEGER AS layer, near*(1 - k/2.0) AS d FROM c, range(2) r(k))", "SELECT layer, v, u, 2*(u*4 + 2)/w - 1 AS x_ndc, 2*(v*4 + 2)/h - 1 AS y_ndc, d AS disparity, 2*4/w/d AS size, 0.5 AS opacity FROM l, dims"), "layer, v, u", ["x_ndc", "y_ndc", "disparity", "size", "opacity"]))
def gn18(spark, sf):
    r = raster(spark, sf)
    return rounded(cameras.base_layers(r, 4, width(), height(r), 2))


@query("gn17_normalised_grid", sql_rounded((RASTER_SQL, "SELECT v, u, 2*(u + 0.5)/w - 1 AS gx, 2*(v + 0.5)/h - 1 AS gy FROM raster, dims"), "v, u", ["gx", "gy"]))
def gn17(spark, sf):
    r = raster(spark, sf)
    place = lambda c, n: (2 * G.fraction(F.col(c), n) - 1)
    return rounded(r.select("v", "u", place("u", width()).alias("gx"), place("v", height(r)).alias("gy")))


@query("pr3_no_splats", f"SELECT 0::BIGINT AS splat_id, {', '.join(f'0.0::DOUBLE AS {c}' for c in S.COLUMNS[1:])} WHERE false")
def pr3(spark, sf):
    return S.none(spark)


@query("pr17_seed_rows", sql_rounded((RASTER_SQL, "SELECT v, u, 0.5 AS r, 0.5 AS g, 0.5 AS b, -5.0 AS log_scale, 1.0 AS qw, 0.0 AS qx, 0.0 AS qy, 0.0 AS qz, ln(0.01/0.99) AS opacity_logit FROM raster WHERE v % 4 = 0 AND u % 4 = 0 AND depth > 25"), "v, u", ["r", "g", "b", "log_scale", "qw", "qx", "qy", "qz", "opacity_logit"]))
def pr17(spark, sf):
    seeds = raster(spark, sf).where("v % 4 = 0 and u % 4 = 0 and depth > 25").select("v", "u", F.lit(0.01).alias("opacity"))
    return rounded(S.seeded(seeds))


@query("fl9_min_neighbours", "SELECT event_id, greatest(1, trunc(1 + 5*least(value/500, 1)))::INTEGER AS least FROM events")
def fl9(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", S.min_neighbours(F.least(F.col("value") / 500, F.lit(1.0))).alias("least"))


@query("fl15_z_depth", sql_rounded((FRAMES_SQL, "SELECT frame_idx, MAX(rendered)/(MAX(rendered) + 1e-8) AS ratio FROM frames GROUP BY 1"), "frame_idx", ["ratio"]))
def fl15(spark, sf):
    return rounded(S.assert_z_depth(frames(spark, sf), "rendered", "rendered", ["frame_idx"]))


@query("fl29_requests", "WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber*2 AS stride, l_discount*15 AS outlier_pruning, 25 + l_quantity AS grazing_angle, l_quantity AS depth_min, l_extendedprice/100 AS depth_max, CASE WHEN l_linenumber % 3 = 0 THEN 'dap' WHEN l_linenumber % 3 = 1 THEN 'da360' ELSE 'other' END AS depth_model FROM lineitem) SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN stride < 1 OR stride > 8 THEN 'stride' END, CASE WHEN outlier_pruning < 0 OR outlier_pruning > 1 THEN 'outlier_pruning' END, CASE WHEN grazing_angle < 30 OR grazing_angle > 90 THEN 'grazing_angle' END, CASE WHEN depth_min < 0.01 THEN 'depth_min' END, CASE WHEN depth_max > 1000 THEN 'depth_max' END, CASE WHEN depth_model NOT IN ('dap', 'da360') THEN 'depth_model' END, CASE WHEN depth_min >= depth_max THEN 'depth_min >= depth_max' END], lambda x: x IS NOT NULL), ', ') AS problems FROM r")
def fl29(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    n = F.col("l_linenumber")
    r = li.select("l_orderkey", n, (n * 2).alias("stride"), (F.col("l_discount") * 15).alias("outlier_pruning"), (25 + F.col("l_quantity")).alias("grazing_angle"), F.col("l_quantity").alias("depth_min"), (F.col("l_extendedprice") / 100).alias("depth_max"), F.when(n % 3 == 0, "dap").when(n % 3 == 1, "da360").otherwise("other").alias("depth_model"))
    return r.select("l_orderkey", "l_linenumber", F.concat_ws(", ", T.problems(r.columns)).alias("problems"))


@query("tk8_first_views", f"WITH {SHARES_SQL} SELECT cam_id FROM shares WHERE gap > 0 ORDER BY gap DESC, cam_id LIMIT 16")
def tk8(spark, sf):
    return shares(spark, sf).where("gap > 0").orderBy(F.desc("gap"), "cam_id").limit(16).select("cam_id")


@query("jn19_job_lookup", f"WITH {JOBS_SQL}, asked AS (SELECT event_id*3 AS job_id FROM events) SELECT job_id, status, status IS NULL AS missing FROM asked LEFT JOIN jobs USING (job_id)")
def jn19(spark, sf):
    asked = spark.read.parquet(f"{sf}/events.parquet").select((F.col("event_id") * 3).alias("job_id"))
    return asked.join(jobs(spark, sf).select("job_id", "status"), "job_id", "left").select("job_id", "status", F.col("status").isNull().alias("missing"))


@query("jn17_face_rotation", sql_rounded((SPLATS_SQL + ", t AS (SELECT *, radians(90.0*(frame_idx % 4)) AS a FROM splats)", "SELECT splat_id, x*cos(a) + z*sin(a) AS x2, y AS y2, z*cos(a) - x*sin(a) AS z2 FROM t"), "splat_id", ["x2", "y2", "z2"]))
def jn17(spark, sf):
    poses = spark.createDataFrame([(k, 90.0 * k) for k in range(4)], "face int, yaw_deg double")  # four faces
    s = splats(spark, sf).withColumn("face", (F.col("frame_idx") % 4).cast("int")).join(F.broadcast(poses), "face")
    a = F.radians("yaw_deg")
    return rounded(s.select("splat_id", (F.col("x") * F.cos(a) + F.col("z") * F.sin(a)).alias("x2"), F.col("y").alias("y2"), (F.col("z") * F.cos(a) - F.col("x") * F.sin(a)).alias("z2")))


_GRID = "q AS (SELECT frame_idx, v, u, CAST(v // 8 AS INTEGER) AS cy, CAST(u // 25 AS INTEGER) AS cx, rendered/raw AS ratio FROM frames), g AS (SELECT frame_idx, cy, cx, AVG(ratio) AS scale FROM q GROUP BY 1, 2, 3), n AS (SELECT (MAX(o_orderkey) // 200 // 8 + 1)::INTEGER AS rows FROM orders), p AS (SELECT frame_idx, v, u, u/25.0 - 0.5 AS gx, v/8.0 - 0.5 AS gy FROM frames), o AS (SELECT p.*, greatest(least(floor(gx), 7), 0) AS x0, greatest(least(floor(gy), rows - 1), 0) AS y0, rows FROM p, n), c AS (SELECT frame_idx, v, u, least(x0 + a, 7)::INTEGER AS cx, least(y0 + b, rows - 1)::INTEGER AS cy, (CASE WHEN a = 1 THEN greatest(least(gx - x0, 1), 0) ELSE 1 - greatest(least(gx - x0, 1), 0) END)*(CASE WHEN b = 1 THEN greatest(least(gy - y0, 1), 0) ELSE 1 - greatest(least(gy - y0, 1), 0) END) AS k FROM o, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) w(a, b))"


@query("jn18_grid_interpolation", sql_rounded((f"{FRAMES_SQL}, {_GRID}", "SELECT frame_idx, v, u, SUM(k*scale) AS scale FROM c JOIN g USING (frame_idx, cy, cx) GROUP BY 1, 2, 3"), "frame_idx, v, u", ["scale"], 5))
def jn18(spark, sf):
    f = frames(spark, sf)
    grid = f.groupBy("frame_idx", F.floor(F.col("v") / 8).cast("int").alias("cy"), F.floor(F.col("u") / 25).cast("int").alias("cx")).agg(F.avg(F.col("rendered") / F.col("raw")).alias("scale"))
    rows = int(spark.read.parquet(f"{sf}/orders.parquet").agg(F.max("o_orderkey")).first()[0] // 200 // 8 + 1)
    at = f.select("frame_idx", "v", "u", (F.col("u") / 25.0 - 0.5).alias("gx"), (F.col("v") / 8.0 - 0.5).alias("gy"))
    return rounded(cameras.interpolated(at, grid, "scale", 8, rows, ["frame_idx"], ["v", "u"]), 5)


def _sampled(points: str, keys: str) -> str:
    """SQL of a bilinear sample of the raster at p(keys, pu, pv): columns go round, rows stop."""
    return f"c AS (SELECT {keys}, (((floor(pu) + a)::INTEGER % 200) + 200) % 200 AS u, least(greatest(floor(pv) + b, 0), h - 1)::INTEGER AS v, (CASE WHEN a = 1 THEN pu - floor(pu) ELSE 1 - (pu - floor(pu)) END)*(CASE WHEN b = 1 THEN pv - floor(pv) ELSE 1 - (pv - floor(pv)) END) AS k FROM {points}, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b))"


VIEW_SQL = f"""{RASTER_SQL}, views AS (SELECT * FROM (VALUES (0, 0.0, 0.0), (1, 90.0, 0.0), (2, 180.0, 0.0), (3, 270.0, 0.0), (4, 0.0, 90.0), (5, 0.0, -90.0)) t(view_id, yaw, pitch)),
a AS (SELECT view_id, i::INTEGER AS "row", j::INTEGER AS col, radians(yaw) AS w, radians(pitch) AS p, (j + 0.5 - 16)/16 AS x, -(i + 0.5 - 16)/16 AS y FROM views, range(32) r(i), range(32) s(j)),
b AS (SELECT view_id, "row", col, w, x, y*cos(p) + sin(p) AS y, cos(p) - y*sin(p) AS z FROM a),
d AS (SELECT view_id, "row", col, x*cos(w) + z*sin(w) AS x, y, z*cos(w) - x*sin(w) AS z FROM b),
p AS (SELECT view_id, "row", col, (atan2(x, z)/(2*pi()) + 0.5)*w - 0.5 AS pu, (0.5 - asin(y/sqrt(x*x + y*y + z*z))/pi())*h - 0.5 AS pv, h FROM d, dims), {_sampled('p', 'view_id, "row", col')}"""


ORACLE_SQL["jn9_perspective_view"] = f'WITH {VIEW_SQL} SELECT view_id, "row", col, round(SUM(k*depth), 6) + 0.0 AS depth FROM c JOIN raster USING (v, u) GROUP BY 1, 2, 3'


@query("jn10_cube_faces", f'WITH {VIEW_SQL} SELECT view_id AS face, "row", col, round(SUM(k*depth), 3) + 0.0 AS depth FROM c JOIN raster USING (v, u) GROUP BY 1, 2, 3')
def jn10(spark, sf):
    r = raster(spark, sf)
    return rounded(cameras.to_cube(spark, r, "depth", 32, width(), height(r)), 3)


@query("jn13_cube_round_trip", sql_rounded((RASTER_SQL, "SELECT v, u, 7.5 AS depth FROM raster"), "v, u", ["depth"]))
def jn13(spark, sf):
    """Faces of a panorama of one depth, cut from 100 degrees down to 90, give that depth everywhere."""
    r = raster(spark, sf)
    flat = r.select("v", "u", F.lit(7.5).alias("depth"))
    views = spark.createDataFrame([(k, yaw, pitch) for k, (yaw, pitch) in enumerate(cameras.CUBE)], "face int, yaw_deg double, pitch_deg double")
    # cells that the table lacks are no part of a bilinear sample: weights are made whole again
    wide = rasters.perspective_view(views, flat.withColumn("one", F.lit(1.0)), "one", 24, 100.0, width(), height(r), "face").where("one > 0")
    faces, size = cameras.cropped(wide.select("face", "row", "col", F.lit(7.5).alias("depth"), "one"), 24, 100.0)
    every = spark.range(6).select(F.col("id").cast("int").alias("face"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("col"))
    full = every.join(faces, ["face", "row", "col"], "left").select("face", "row", "col", F.coalesce("depth", F.lit(7.5)).alias("depth"))
    return rounded(cameras.from_cube(full, r.select("v", "u"), "depth", size, width(), height(r)))


@query("jn12_tangent_planes", f"""WITH {RASTER_SQL}, planes AS (SELECT * FROM (VALUES (0, 1.0, 0.0, 0.0), (1, 0.0, 0.0, 1.0), (2, -1.0, 0.0, 0.0), (3, 0.0, 0.0, -1.0)) t(face, fx, fy, fz)),
g AS (SELECT *, tan(radians(30.0)) AS reach FROM planes), r AS (SELECT face, fx, fy, fz, fz AS rx, 0.0 AS ry, -fx AS rz, reach FROM g),
s AS (SELECT *, ry*fz - rz*fy AS ux, rz*fx - rx*fz AS uy, rx*fy - ry*fx AS uz FROM r),
t AS (SELECT face, i::INTEGER AS "row", j::INTEGER AS col, -reach + j*2*reach/15 AS a, -reach + i*2*reach/15 AS b, * EXCLUDE (face) FROM s, range(16) y(i), range(16) x(j)),
d AS (SELECT face, "row", col, fx + a*rx + b*ux AS x, fy + a*ry + b*uy AS y, fz + a*rz + b*uz AS z FROM t), n AS (SELECT face, "row", col, x/m AS x, y/m AS y, z/m AS z FROM (SELECT *, sqrt(x*x + y*y + z*z) AS m FROM d)),
q AS (SELECT face, "row", col, (1 - (CASE WHEN atan2(-z, x) < 0 THEN atan2(-z, x) + 2*pi() ELSE atan2(-z, x) END)/pi() + 1)/2*199 AS pu, acos(y)/pi()*(h - 1) AS pv, h FROM n, dims), p AS (SELECT face, "row", col, greatest(least(pu, 199), 0) AS pu, pv, h FROM q), {_sampled('p', 'face, "row", col')}
SELECT face, "row", col, round(SUM(k*depth), 3) + 0.0 AS depth FROM c JOIN raster USING (v, u) GROUP BY 1, 2, 3""")
def jn12(spark, sf):
    r = raster(spark, sf)
    planes = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (1, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0), (2, -1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (3, 0.0, 0.0, -1.0, 0.0, 1.0, 0.0)], "face int, fx double, fy double, fz double, ux double, uy double, uz double")
    return rounded(cameras.tangent_faces(planes, r, "depth", 16, 60.0, 200, height(r)), 3)


@query("jn6_colour_at_stride", sql_rounded((RASTER_SQL, "SELECT v, u, depth, (u % 7)/7.0 AS r, (v % 5)/5.0 AS g FROM raster WHERE v % 4 = 0 AND u % 4 = 0"), "v, u", ["depth", "r", "g"]))
def jn6(spark, sf):
    d = raster(spark, sf)
    image = d.select("v", "u", ((F.col("u") % 7) / 7.0).alias("r"), ((F.col("v") % 5) / 5.0).alias("g"))
    return rounded(d.where("v % 4 = 0 and u % 4 = 0").join(image, ["v", "u"]))


@query("tk11_anchor_shuffle", f"WITH {MASKS_SQL} SELECT cam_id, (row_number() OVER (ORDER BY md5(cam_id || ':7'), cam_id))::INTEGER AS place FROM (SELECT DISTINCT cam_id FROM masks)")
def tk11(spark, sf):
    cams = masks(spark, sf).select("cam_id").distinct()  # a row for each camera
    return cams.select("cam_id", F.row_number().over(Window.orderBy(F.md5(F.concat_ws(":", "cam_id", F.lit("7"))), "cam_id")).alias("place"))


@query("pr1_splat_frame", sql_rounded((SPLAT_GRID_SQL + """, y AS (SELECT (v::BIGINT*200 + u)::BIGINT AS splat_id, sin(phi)*cos(theta) AS rx, cos(phi) AS ry, -sin(phi)*sin(theta) AS rz FROM kang),
n AS (SELECT *, CASE WHEN abs(ry) > 0.99 THEN 0 ELSE 1 END AS ky, CASE WHEN abs(ry) > 0.99 THEN 1 ELSE 0 END AS kz FROM y), c AS (SELECT *, -ky*rz + kz*ry AS cx, -kz*rx AS cy, ky*rx AS cz FROM n),
a AS (SELECT *, cx/sqrt(cx*cx + cy*cy + cz*cz) AS ax, cy/sqrt(cx*cx + cy*cy + cz*cz) AS ay, cz/sqrt(cx*cx + cy*cy + cz*cz) AS az FROM c)""", "SELECT splat_id, ax AS m00, -ry*az + rz*ay AS m01, -rx AS m02, ay AS m10, -rz*ax + rx*az AS m11, -ry AS m12, az AS m20, -rx*ay + ry*ax AS m21, -rz AS m22 FROM a"), "splat_id", [f"m{i}{j}" for i in range(3) for j in range(3)]))
def pr1_frame(spark, sf):
    """The rotation that a splat's quaternion stands for: its tangent frame and the ray back to the origin."""
    r, cells = kept_cells(spark, sf)
    s = S.from_depth(cells, height(r), width())
    m = rotations.matrix(tuple(F.col(f"q{a}") for a in "wxyz"))
    return rounded(s.select("splat_id", *[c.alias(f"m{k // 3}{k % 3}") for k, c in enumerate(m)]))


_LOGIT = "ln(least(greatest(opacity, 1e-6), 1 - 1e-6)/(1 - least(greatest(opacity, 1e-6), 1 - 1e-6)))"


@query("sk1_all_columns", sql_rounded((SPLATS_SQL, f"SELECT splat_id, x AS c_x, y AS c_y, z AS c_z, (r - 0.5)/0.28209479177387814 AS f_dc_0, (g - 0.5)/0.28209479177387814 AS f_dc_1, (b - 0.5)/0.28209479177387814 AS f_dc_2, {_LOGIT} AS c_opacity, ln(greatest(sx, 1e-7)) AS scale_0, ln(greatest(sy, 1e-7)) AS scale_1, ln(greatest(sz, 1e-7)) AS scale_2, qw AS rot_0, qx AS rot_1, qy AS rot_2, qz AS rot_3 FROM splats"), "splat_id", ["c_x", "c_y", "c_z", "f_dc_0", "f_dc_1", "f_dc_2", "c_opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]))
def sk1_all(spark, sf):
    d = S.encoded(splats(spark, sf)).select("splat_id", *[F.col(c).alias(f"c_{stored}" if stored in ("x", "y", "z", "opacity") else stored) for c, stored in ply.FIELDS.items()])
    return rounded(d)


@query("ag25_face_weights", sql_rounded((RASTER_SQL + """, y AS (SELECT v, u, sin(v/(h - 1)*pi())*cos((1 - u/199.0)*2*pi()) AS x, cos(v/(h - 1)*pi()) AS y, -sin(v/(h - 1)*pi())*sin((1 - u/199.0)*2*pi()) AS z FROM raster, dims),
f AS (SELECT * FROM (VALUES (0, 1.0, 0.0), (1, 0.0, 1.0), (2, -1.0, 0.0), (3, 0.0, -1.0)) t(face, fx, fz)), p AS (SELECT face, v, u, x*fx + z*fz AS d, (x*fz - z*fx) AS a, -y AS b FROM y, f),
q AS (SELECT face, v, u, d, a/greatest(d, 0.1)/tan(radians(50.0)) AS a, b/greatest(d, 0.1)/tan(radians(50.0)) AS b FROM p)""",
"SELECT face, v, u, CASE WHEN d > 0.1 AND abs(a) <= 1 AND abs(b) <= 1 THEN exp(-(acos(greatest(least(d, 1), -1))**2)/(radians(100.0)**2/4))*cos(greatest(least((greatest(abs(a), abs(b)) - 0.8)/0.2, 1), 0)*pi()/2)**2 ELSE 0 END AS weight FROM q"), "face, v, u", ["weight"]))
def ag25(spark, sf):
    r = raster(spark, sf)
    faces = F.broadcast(spark.createDataFrame([(0, 1.0, 0.0), (1, 0.0, 1.0), (2, -1.0, 0.0), (3, 0.0, -1.0)], "face int, fx double, fz double"))
    one = F.lit(1.0)
    ray = G.turn_ray(*G.turn_angles(G.fraction(F.col("u"), width(), "span"), G.fraction(F.col("v"), height(r), "span"), one, one))
    d = r.select("v", "u", *[c.alias(a) for c, a in zip(ray, "xyz")]).join(faces)
    _, _, weight = cameras.face_weight(tuple(F.col(a) for a in "xyz"), (F.col("fx"), F.lit(0.0), F.col("fz")), (F.lit(0.0), F.lit(1.0), F.lit(0.0)), 100.0)
    return rounded(d.select("face", "v", "u", weight.alias("weight")))


_FACTORS = {"xy": 0.001, "z": 0.001, "scale": 1.0, "quaternion": 1.0, "color": 0.1, "opacity": 1.0}
_SLOPE, _OFFSET = S.scale_constants(0.0, 10.0)
_CHANGES = {"d_x": "y", "d_y": "z", "d_z": "x", "d_size": "qx", "d_qw": "x", "d_qx": "y", "d_qy": "z", "d_qz": "qy", "d_r": "x", "d_g": "y", "d_b": "z", "d_opacity": "qz"}


@query("pr29_composed", sql_rounded((SPLATS_SQL + """, b AS (SELECT *, sx AS disparity, greatest(least(r, 0.99), 0.01) AS cr FROM splats), z AS (SELECT *, sx + ln(1 - exp(-sx)) + 0.001*x AS t FROM b),
w AS (SELECT *, 1/(greatest(t, 0) + ln(1 + exp(-abs(t))) + 1e-3) AS pz FROM z)""", f"SELECT splat_id, pz*(x + 0.001*y) AS px, pz*(y + 0.001*z) AS py, pz, sy*10/(1 + exp(-({_SLOPE!r}*qx + ({_OFFSET!r})))) AS size, qw + x AS qw2, 1/(1 + exp(-(ln(cr/(1 - cr)) + 0.1*x))) AS r2, 1/(1 + exp(-(ln(opacity/(1 - opacity)) + qz))) AS opacity2 FROM w"), "splat_id", ["px", "py", "pz", "size", "qw2", "r2", "opacity2"], 5))
def pr29(spark, sf):
    s = splats(spark, sf)
    bases = s.select("splat_id", F.col("x").alias("x_ndc"), F.col("y").alias("y_ndc"), F.col("sx").alias("disparity"), F.col("sy").alias("size"), "qw", "qx", "qy", "qz", "r", "g", "b", "opacity", *[F.col(c).alias(n) for n, c in _CHANGES.items()])
    d = S.composed(bases, _FACTORS)
    return rounded(d.select("splat_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), "size", F.col("qw").alias("qw2"), F.col("r").alias("r2"), F.col("opacity").alias("opacity2")), 5)


@query("sf13_depth_output", sql_rounded((RASTER_SQL + ", s AS (SELECT v, u, exp(greatest(least(depth/10, ln(75)), ln(0.01)))*1.25*sqrt(((u - 100)/100.0)**2 + ((v - 40)/100.0)**2 + 1) AS d, (u % 11)/10.0 AS sky FROM raster)", "SELECT v, u, exp((1 - sky)*ln(greatest(d, 1e-6)) + sky*ln(75*1.25)) AS depth FROM s"), "v, u", ["depth"], 5))
def sf13(spark, sf):
    r = raster(spark, sf)
    factor = G.z_to_euclidean(F.lit(1.0), F.col("u"), F.col("v"), 100.0, 100.0, 100.0, 40.0)
    return rounded(r.select("v", "u", S.metric_depth(F.col("depth") / 10, True, 0.01, 75.0, F.lit(1.25), factor, (F.col("u") % 11) / 10.0).alias("depth")), 5)
