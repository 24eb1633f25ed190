"""Queries of grids, rays, splat generation and splat maps."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import encoding as E
from skyloom.functions import geometry as G
from skyloom.functions import rotations as R
from skyloom.operators import generators, randoms, splats as S
from skyloom.operators.quantiles import quantiles
from skyloom.plans.tables import FRAMES_SQL, RASTER_SQL, SPLATS_SQL, WIDTH, frames, height, query, raster, rounded, splats, sql_rounded, width
from skyloom.session import shared_folder
from skyloom.sources import ply, ply_table

PI = "pi()"
TURN_SQL = RASTER_SQL + """,
ang AS (SELECT v, u, depth, h, w, (1 - (u + 0.5) / w) * 2 * pi() AS theta, (v + 0.5) / h * pi() AS phi FROM raster, dims),
ray AS (SELECT *, sin(phi)*cos(theta) AS rx, cos(phi) AS ry, -sin(phi)*sin(theta) AS rz FROM ang),
c1 AS (SELECT *, CASE WHEN abs(ry) > 0.99 THEN 0.0 ELSE 1.0 END AS uy, CASE WHEN abs(ry) > 0.99 THEN 1.0 ELSE 0.0 END AS uz FROM ray),
c2 AS (SELECT *, uy*(-rz) - uz*(-ry) AS cx, uz*(-rx) AS cy, -uy*(-rx) AS cz FROM c1),
c3 AS (SELECT *, cx/sqrt(cx*cx+cy*cy+cz*cz) AS ax, cy/sqrt(cx*cx+cy*cy+cz*cz) AS ay, cz/sqrt(cx*cx+cy*cy+cz*cz) AS az FROM c2),
grid AS (SELECT *, (-ry)*az - (-rz)*ay AS bx, (-rz)*ax - (-rx)*az AS by_, (-rx)*ay - (-ry)*ax AS bz FROM c3)"""


@query("gn1_spherical_grid", sql_rounded((TURN_SQL, "SELECT v, u, theta, phi, rx, ry, rz, ax, ay, az, bx, by_ AS \"by\", bz FROM grid"), "v, u", ["theta", "phi", "rx", "ry", "rz", "ax", "ay", "az", "bx", '"by"', "bz"]))
def gn1(spark: SparkSession, sf: str) -> DataFrame:
    r = raster(spark, sf)
    return rounded(generators.with_grid(r.select("v", "u"), F.col("v") + 0.5, F.col("u") + 0.5, height(r), width()))


def _rays(name: str, u: str, v: str, lonlat: bool):
    at = f"({u} - 0.5) * 2 * pi() AS a, (0.5 - {v}) * pi() AS b" if lonlat else f"(1 - {u}) * 2 * pi() AS a, {v} * pi() AS b"
    xyz = "cos(b)*sin(a) AS x, sin(b) AS y, cos(b)*cos(a) AS z" if lonlat else "sin(b)*cos(a) AS x, cos(b) AS y, -sin(b)*sin(a) AS z"
    sql = sql_rounded((RASTER_SQL + f", ang AS (SELECT v, u, {at} FROM raster, dims)", f"SELECT v, u, {xyz} FROM ang"), "v, u", ["x", "y", "z"])

    @query(name, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        r = raster(spark, sf)
        center = {"gn2_erp_rays": "span", "gn3_pixel_rays": "edge", "gn4_direction_cache": "half"}[name]
        us, vs = G.fraction(F.col("u"), width(), center), G.fraction(F.col("v"), height(r), center)
        one = F.lit(1.0)
        ray = G.lonlat_ray(*G.lonlat(us, vs, one, one)) if lonlat else G.turn_ray(*G.turn_angles(us, vs, one, one))
        return rounded(r.select("v", "u", *[c.alias(n) for c, n in zip(ray, "xyz")]))


_rays("gn2_erp_rays", "u / (w - 1)", "v / (h - 1)", False)
_rays("gn3_pixel_rays", "u / w", "v / h", True)
_rays("gn4_direction_cache", "(u + 0.5) / w", "(v + 0.5) / h", True)


@query("gn5_horizon_views", """WITH n AS (SELECT unnest([2, 4, 6, 8])::INTEGER AS n), v AS (SELECT n, unnest(range(0, n))::INTEGER AS i FROM n)
SELECT n, i, CASE WHEN n = 4 THEN ['front','right','back','left'][i+1] WHEN n = 2 THEN CASE WHEN i = 0 THEN 'front' ELSE 'back' END
 ELSE 'side_' || lpad(i::VARCHAR, 2, '0') END AS name, round(i*2*pi()/n, 6) + 0.0 AS yaw, round(sin(i*2*pi()/n), 6) + 0.0 AS fx, 0.0::DOUBLE AS fy, round(cos(i*2*pi()/n), 6) + 0.0 AS fz FROM v""")
def gn5(spark, sf):
    return rounded(generators.horizon_views(spark, (2, 4, 6, 8)))


@query("gn7_extraction_layout", """WITH n AS (SELECT unnest([3, 4, 5, 6, 8, 12])::INTEGER AS n), f AS (SELECT n, least(170.0, 360.0/n + 10)::DOUBLE AS fov FROM n),
w AS (SELECT *, greatest(512, round_even(512*fov/(360.0/n), 0)::INTEGER)::INTEGER AS width FROM f)
SELECT n, round(fov, 6) + 0.0 AS fov, width, round((width/2)/tan(radians(fov)/2), 6) + 0.0 AS focal FROM w""")
def gn7(spark, sf):
    return rounded(generators.extraction_layout(spark, 512, (3, 4, 5, 6, 8, 12)))


@query("gn10_camera_rig", "WITH " + RASTER_SQL + """, m AS (SELECT quantile_cont(depth, 0.5) AS median FROM raster WHERE depth > 0),
c AS (SELECT i, j, [0.1, 0.2, 0.3][j + 1] AS fraction FROM range(12) a(i), range(3) b(j))
SELECT (i*3 + j)::INTEGER AS cam_id, (i*30)::DOUBLE AS azimuth_deg, fraction::DOUBLE AS fraction, round(median*fraction*sin(i*2*pi()/12), 6) + 0.0 AS px, 0.0::DOUBLE AS py,
 round(median*fraction*cos(i*2*pi()/12), 6) + 0.0 AS pz FROM c, m""")
def gn10(spark, sf):
    return rounded(generators.camera_rig(raster(spark, sf), "depth"))


@query("gn11_trajectories", """WITH p AS (SELECT unnest(['forward','backward','right','left','s_curve','loop']) AS preset), f AS (SELECT preset, k::INTEGER AS k, k/80.0*2*pi() AS t FROM p, range(81) r(k))
SELECT preset, k AS frame_idx, round(CASE preset WHEN 'right' THEN 0.02*k WHEN 'left' THEN -0.02*k WHEN 's_curve' THEN 0.3*sin(t) WHEN 'loop' THEN 0.5*sin(t) ELSE 0 END, 6) + 0.0 AS tx, 0.0::DOUBLE AS ty,
 round(CASE WHEN preset IN ('forward','s_curve') THEN 0.02*k WHEN preset = 'backward' THEN -0.02*k WHEN preset = 'loop' THEN 0.5*(1-cos(t)) ELSE 0 END, 6) + 0.0 AS tz, k % 4 = 0 AS keyframe FROM f""")
def gn11(spark, sf):
    return rounded(generators.trajectories(spark))


@query("gn14_cube_face", "WITH " + RASTER_SQL + """, ang AS (SELECT v, u, ((u+0.5)/w - 0.5)*2*pi() AS a, (0.5 - (v+0.5)/h)*pi() AS b FROM raster, dims),
r AS (SELECT v, u, cos(b)*sin(a) AS x, sin(b) AS y, cos(b)*cos(a) AS z FROM ang)
SELECT v, u, (CASE WHEN abs(z) >= abs(x) AND abs(z) >= abs(y) THEN CASE WHEN z >= 0 THEN 0 ELSE 2 END WHEN abs(x) >= abs(y) THEN CASE WHEN x >= 0 THEN 1 ELSE 3 END
 WHEN y >= 0 THEN 4 ELSE 5 END)::INTEGER AS face FROM r""")
def gn14(spark, sf):
    r = raster(spark, sf)
    lon, lat = G.lonlat(F.col("u") + 0.5, F.col("v") + 0.5, width(), height(r))
    return r.select("v", "u", G.cube_face(*G.lonlat_ray(lon, lat)).alias("face"))


@query("gn13_cube_faces", """WITH f(face, yaw_deg, pitch_deg) AS (VALUES ('front',0,0),('right',90,0),('back',180,0),('left',270,0),('up',0,90),('down',0,-90)),
r AS (SELECT face, yaw_deg::INTEGER AS yaw_deg, pitch_deg::INTEGER AS pitch_deg, radians(yaw_deg) AS y, radians(pitch_deg) AS p FROM f)
SELECT face, yaw_deg, pitch_deg, round(cos(y),6)+0.0 AS r00, round(sin(y)*sin(p),6)+0.0 AS r01, round(sin(y)*cos(p),6)+0.0 AS r02, 0.0::DOUBLE AS r10, round(cos(p),6)+0.0 AS r11, round(-sin(p),6)+0.0 AS r12,
 round(-sin(y),6)+0.0 AS r20, round(cos(y)*sin(p),6)+0.0 AS r21, round(cos(y)*cos(p),6)+0.0 AS r22 FROM r""")
def gn13(spark, sf):
    return rounded(generators.cube_faces(spark))


DEFAULTS_SQL = RASTER_SQL + """, p AS (SELECT quantile_cont(depth, [0.01, 0.5, 0.95, 0.99]) AS p, COUNT(*) AS n FROM raster WHERE depth > 0.01),
defaults AS (SELECT n, CASE WHEN n < 100 THEN 80.0 ELSE greatest(p[3], p[1] + 1) END AS sky_threshold, CASE WHEN n < 100 THEN 0.1 ELSE greatest(0.01, 0.8*p[1]) END AS depth_min,
 CASE WHEN n < 100 THEN 100.0 ELSE 1.1*p[4] END AS depth_max, CASE WHEN n < 100 THEN 0.5 ELSE greatest(0.05, 0.05*p[2]) END AS orbit FROM p)"""
UNIFORM_SQL = "(('0x' || substr(md5(v || ':' || u), 1, 8))::BIGINT / 4294967296.0)"
CANDIDATES_SQL = DEFAULTS_SQL + f""", kept AS (SELECT r.v, r.u, r.depth FROM raster r, dims, defaults d WHERE NOT depth > sky_threshold*0.9 AND depth > depth_min AND depth < sky_threshold
 AND {UNIFORM_SQL} < least(greatest(sin(v/h*pi()), 0.3), 1.0))"""


@query("ag1_scene_defaults", sql_rounded((DEFAULTS_SQL, "SELECT * FROM defaults"), "n", ["sky_threshold", "depth_min", "depth_max", "orbit"]))
def ag1(spark, sf):
    return rounded(S.scene_defaults(raster(spark, sf)))


def kept_cells(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    r = raster(spark, sf)
    d = S.scene_defaults(r).select("sky_threshold", "depth_min")
    cells = r.join(F.broadcast(d))
    return r, S.candidates(cells, F.col("sky_threshold"), F.col("depth_min"), height(r)).select("v", "u", "depth")


@query("fl5_candidates", f"WITH {CANDIDATES_SQL} SELECT v, u, round(depth, 6) + 0.0 AS depth FROM kept")
def fl5(spark, sf):
    return rounded(kept_cells(spark, sf)[1])


@query("fl1_sky_depth", f"WITH {RASTER_SQL} SELECT v, u, depth > 100*0.3 AS sky FROM raster")
def fl1(spark, sf):
    return raster(spark, sf).select("v", "u", S.is_sky(F.col("depth"), F.lit(100.0), 0.3).alias("sky"))


def _draw_sql(seed: int, bits: int) -> str:
    """The generator's doubles at places k, in 128-bit steps of two halves: a jump for each bit of the place."""
    half = 2**64
    start = np.random.PCG64(seed).state["state"]["state"]
    out = [f"s0 AS (SELECT v, u, v::BIGINT * {WIDTH} + u + 1 AS k, {start // half}::UHUGEINT AS hi, {start % half}::UHUGEINT AS lo FROM raster)"]
    for i, (a, c) in enumerate(randoms.jump_sql(seed, bits)):
        ah, al, ch, cl = a // half, a % half, c // half, c % half
        low, carry = f"((lo * {al}::UHUGEINT) % {half}::UHUGEINT + {cl}::UHUGEINT)", f"((lo * {al}::UHUGEINT) // {half}::UHUGEINT)"
        high = f"((hi * {al}::UHUGEINT) % {half}::UHUGEINT + (lo * {ah}::UHUGEINT) % {half}::UHUGEINT + {carry} + {ch}::UHUGEINT + {low} // {half}::UHUGEINT) % {half}::UHUGEINT"
        out.append(f"s{i + 1} AS (SELECT v, u, k, CASE WHEN (k >> {i}) & 1 = 1 THEN {high} ELSE hi END AS hi, CASE WHEN (k >> {i}) & 1 = 1 THEN {low} % {half}::UHUGEINT ELSE lo END AS lo FROM s{i})")
    turn = "power(2::DOUBLE, (hi >> 58)::INTEGER)::UHUGEINT"
    out.append(f"x AS (SELECT v, u, xor(hi, lo) AS x, {turn} AS t FROM s{bits}), o AS (SELECT v, u, x // t + (x % t) * ({half}::UHUGEINT // t) AS o FROM x), draws AS (SELECT v, u, (o // 2048)::DOUBLE / {2**53}::DOUBLE AS draw FROM o)")
    return ",\n".join(out)


@query("fl3_pole_thinning", f"WITH {RASTER_SQL}, {_draw_sql(42, 21)} SELECT v, u, draw < least(greatest(sin(v/h*pi()), 0.3), 1.0) AS keep FROM draws, dims")
def fl3(spark, sf):
    """The seeded mask over the raster, row by row; its SQL makes the generator's steps itself."""
    r = raster(spark, sf)
    return r.select("v", "u", (randoms.seeded_uniform(F.col("v"), F.col("u"), WIDTH) < S.pole_density(F.col("v"), height(r))).alias("keep"))


@query("fl4_row_stride", f"WITH {RASTER_SQL}, r AS (SELECT DISTINCT v, h FROM raster, dims) SELECT v, least(greatest(round_even(2/least(greatest(sin((v+0.5)/h*pi()), 0.25), 1.0), 0), 2), 8)::INTEGER AS stride FROM r")
def fl4(spark, sf):
    r = raster(spark, sf)
    s = G.clamp(F.sin((F.col("v") + 0.5) / height(r) * math.pi), 0.25, 1.0)
    return r.select("v").distinct().select("v", G.clamp(F.bround(2.0 / s, 0), 2.0, 8.0).cast("int").alias("stride"))


SPLAT_GRID_SQL = CANDIDATES_SQL + """,
kang AS (SELECT v, u, depth, h, w, (1 - (u + 0.5)/w)*2*pi() AS theta, (v + 0.5)/h*pi() AS phi FROM kept, dims)"""


@query("pr1_depth_to_splats", sql_rounded((SPLAT_GRID_SQL, f"""SELECT (v::BIGINT*{WIDTH} + u)::BIGINT AS splat_id, depth*sin(phi)*cos(theta) AS x, depth*cos(phi) AS y, -depth*sin(phi)*sin(theta) AS z,
 depth*(pi()/h)*greatest(sin(phi), 0.05) AS sx, depth*(pi()/h)*0.1 AS sz FROM kang"""), "splat_id", ["x", "y", "z", "sx", "sz"]))
def pr1(spark, sf):
    r, cells = kept_cells(spark, sf)
    return rounded(S.from_depth(cells, height(r), width()).select("splat_id", "x", "y", "z", "sx", "sz"))


@query("pr1_quaternion_norm", f"WITH {SPLAT_GRID_SQL} SELECT (v::BIGINT*{WIDTH} + u)::BIGINT AS splat_id, 1.0::DOUBLE AS norm FROM kang")
def pr1q(spark, sf):
    r, cells = kept_cells(spark, sf)
    q = S.from_depth(cells, height(r), width())
    return rounded(q.select("splat_id", F.sqrt(F.col("qx") ** 2 + F.col("qy") ** 2 + F.col("qz") ** 2 + F.col("qw") ** 2).alias("norm")))


@query("ag21_depth_range", f"WITH {CANDIDATES_SQL} SELECT COUNT(*) AS n, round(MIN(depth), 6) AS nearest, round(MAX(depth), 6) AS farthest FROM kept")
def ag21(spark, sf):
    r, cells = kept_cells(spark, sf)
    d = G.norm(F.col("x"), F.col("y"), F.col("z"))
    return rounded(S.from_depth(cells, height(r), width()).agg(F.count("*").alias("n"), F.min(d).alias("nearest"), F.max(d).alias("farthest")))


def panorama_to_splats(spark: SparkSession, sf: str, strength: float = 0.3, k: int = 16) -> DataFrame:
    """The flagship: thresholds from the raster, kept cells as splats, outliers pruned."""
    r, cells = kept_cells(spark, sf)
    return S.prune_outliers(S.from_depth(cells, height(r), width()), strength, k)


KNN_SQL = lambda k, src="splats": f"""pairs AS (SELECT a.splat_id, b.splat_id AS neighbor, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS dist FROM {src} a JOIN {src} b ON a.splat_id <> b.splat_id),
knn AS (SELECT *, row_number() OVER (PARTITION BY splat_id ORDER BY dist, neighbor) AS rank FROM pairs QUALIFY rank <= {k})"""  # noqa: E731


@query("jn1_knn", f"WITH {SPLATS_SQL}, {KNN_SQL(8)} SELECT splat_id, neighbor, round(dist, 6) + 0.0 AS dist, rank::INTEGER AS rank FROM knn")
def jn1(spark, sf):
    from skyloom.operators.spatial import knn

    return rounded(knn(splats(spark, sf), 8))


@query("fl8_prune_outliers", f"WITH {SPLATS_SQL}, {KNN_SQL(16)}, m AS (SELECT splat_id, AVG(dist) AS near FROM knn GROUP BY 1) SELECT splat_id FROM m WHERE near < (SELECT AVG(near) + stddev_pop(near)*1.75 FROM m)")
def fl8(spark, sf):
    return S.prune_outliers(splats(spark, sf)).select("splat_id")


@query("fl7_prune_sparse", f"WITH {SPLATS_SQL}, {KNN_SQL(8)} SELECT k.splat_id FROM knn k JOIN splats s ON k.splat_id = s.splat_id WHERE dist < least(greatest(greatest(sx, sy, sz)*0.12, 0.001), 100) GROUP BY 1 HAVING COUNT(*) >= 3")
def fl7(spark, sf):
    return S.prune_sparse(splats(spark, sf), multiple=0.12).select("splat_id")


@query("fl10_denoise", f"WITH {SPLATS_SQL}, solid AS (SELECT * FROM splats WHERE opacity >= 0.48), {KNN_SQL(16, 'solid')}, m AS (SELECT splat_id, AVG(dist) AS near FROM knn GROUP BY 1) SELECT splat_id FROM m WHERE near <= (SELECT AVG(near) + stddev_pop(near)*2 FROM m)")
def fl10(spark, sf):
    return S.denoise(splats(spark, sf), least=0.48).select("splat_id")


@query("fl11_view_border", f"WITH {SPLATS_SQL} SELECT splat_id FROM splats WHERE z > 0 AND abs(x) <= z*tan(radians(90)/2) AND abs(y) <= z*tan(radians(100)/2)")
def fl11(spark, sf):
    return S.within_view(splats(spark, sf), 90.0, 100.0).select("splat_id")


@query("fl12_cone", f"WITH {SPLATS_SQL} SELECT splat_id FROM splats WHERE z > 0 AND z >= sqrt(x*x+y*y+z*z)*cos(radians(55))")
def fl12(spark, sf):
    return S.within_cone(splats(spark, sf), 55.0).select("splat_id")


@query("pr9_reorient", sql_rounded((SPLATS_SQL, "SELECT splat_id, x, -y AS y, -z AS z, -qx AS qw, qw AS qx, -qz AS qy, qy AS qz FROM splats"), "splat_id", ["x", "y", "z", "qw", "qx", "qy", "qz"]))
def pr9(spark, sf):
    return rounded(S.reorient(splats(spark, sf)).select("splat_id", "x", "y", "z", "qw", "qx", "qy", "qz"))


@query("pr14_scale", sql_rounded((SPLATS_SQL, "SELECT splat_id, x*2.5 AS x, y*2.5 AS y, z*2.5 AS z, sx*2.5 AS sx FROM splats"), "splat_id", ["x", "y", "z", "sx"]))
def pr14(spark, sf):
    return rounded(S.scaled(splats(spark, sf), F.lit(2.5)).select("splat_id", "x", "y", "z", "sx"))


ROT_SQL = SPLATS_SQL + """, m AS (SELECT *, 1-2*(qy*qy+qz*qz) AS m0, 2*(qx*qy-qw*qz) AS m1, 2*(qx*qz+qw*qy) AS m2, 2*(qx*qy+qw*qz) AS m3, 1-2*(qx*qx+qz*qz) AS m4, 2*(qy*qz-qw*qx) AS m5,
 2*(qx*qz-qw*qy) AS m6, 2*(qy*qz+qw*qx) AS m7, 1-2*(qx*qx+qy*qy) AS m8 FROM splats),
cov AS (SELECT *, m0*m0*sx*sx+m1*m1*sy*sy+m2*m2*sz*sz AS cxx, m0*m3*sx*sx+m1*m4*sy*sy+m2*m5*sz*sz AS cxy, m0*m6*sx*sx+m1*m7*sy*sy+m2*m8*sz*sz AS cxz,
 m3*m3*sx*sx+m4*m4*sy*sy+m5*m5*sz*sz AS cyy, m3*m6*sx*sx+m4*m7*sy*sy+m5*m8*sz*sz AS cyz, m6*m6*sx*sx+m7*m7*sy*sy+m8*m8*sz*sz AS czz FROM m)"""
_COV = ["cxx", "cxy", "cxz", "cyy", "cyz", "czz"]


def with_covariance(d: DataFrame) -> DataFrame:
    c = R.covariance(tuple(F.col(x) for x in ("qw", "qx", "qy", "qz")), tuple(F.col(x) for x in ("sx", "sy", "sz")))
    return d.withColumns({f"c{k}": v for k, v in c.items()})


@query("pr11_covariance", sql_rounded((ROT_SQL, "SELECT * FROM cov"), "splat_id", _COV))
def pr11(spark, sf):
    return rounded(with_covariance(splats(spark, sf)).select("splat_id", *_COV))


@query("pr10_transform", sql_rounded((ROT_SQL, "SELECT splat_id, -y + 1 AS x, x + 2 AS y, 2*z + 3 AS z, cyy AS cxx, -cxy AS cxy, -2*cyz AS cxz, cxx AS cyy, 2*cxz AS cyz, 4*czz AS czz FROM cov"), "splat_id", ["x", "y", "z", *_COV]))
def pr10(spark, sf):
    d = with_covariance(splats(spark, sf))
    return rounded(S.transformed(d, [0, -1, 0, 1, 0, 0, 0, 0, 2], (1.0, 2.0, 3.0)).select("splat_id", "x", "y", "z", *_COV))


@query("pr12_decompose", sql_rounded((ROT_SQL, "SELECT splat_id, cxx + cyy + czz AS trace, greatest(sx, sy, sz) AS largest, least(sx, sy, sz) AS smallest FROM cov"), "splat_id", ["trace", "largest", "smallest"]))
def pr12(spark, sf):
    from skyloom.operators.numeric import decompose

    d = decompose(with_covariance(splats(spark, sf)).select("splat_id", *_COV))
    return rounded(d.select("splat_id", (F.col("s1") ** 2 + F.col("s2") ** 2 + F.col("s3") ** 2).alias("trace"), F.col("s1").alias("largest"), F.col("s3").alias("smallest")))


@query("sf8_matrix_to_quaternion", sql_rounded((SPLATS_SQL, "SELECT splat_id, CASE WHEN qw < 0 THEN -qw ELSE qw END AS w, CASE WHEN qw < 0 THEN -qx ELSE qx END AS x, CASE WHEN qw < 0 THEN -qy ELSE qy END AS y, CASE WHEN qw < 0 THEN -qz ELSE qz END AS z FROM splats"), "splat_id", ["w", "x", "y", "z"]))
def sf8(spark, sf):
    d = splats(spark, sf)
    q = R.from_matrix(R.matrix(tuple(F.col(x) for x in ("qw", "qx", "qy", "qz"))))
    return rounded(d.select("splat_id", *[c.alias(n) for c, n in zip(q, "wxyz")]))


@query("sf9_quaternion_to_matrix", sql_rounded((ROT_SQL, "SELECT * FROM m"), "splat_id", [f"m{i}" for i in range(9)]))
def sf9(spark, sf):
    m = R.matrix(tuple(F.col(x) for x in ("qw", "qx", "qy", "qz")))
    return rounded(splats(spark, sf).select("splat_id", *[c.alias(f"m{i}") for i, c in enumerate(m)]))


@query("sf10_quaternion_product", sql_rounded((SPLATS_SQL, "SELECT splat_id, 0.6*qw - 0.8*qx AS w, 0.6*qx + 0.8*qw AS x, 0.6*qy - 0.8*qz AS y, 0.6*qz + 0.8*qy AS z FROM splats"), "splat_id", ["w", "x", "y", "z"]))
def sf10(spark, sf):
    q = R.product((F.lit(0.6), F.lit(0.8), F.lit(0.0), F.lit(0.0)), tuple(F.col(x) for x in ("qw", "qx", "qy", "qz")))
    return rounded(splats(spark, sf).select("splat_id", *[c.alias(n) for c, n in zip(q, "wxyz")]))


@query("sk1_encode", sql_rounded((SPLATS_SQL, "SELECT splat_id, ln(greatest(sx, 1e-7)) AS sx, ln(least(greatest(opacity,1e-6),1-1e-6)/(1-least(greatest(opacity,1e-6),1-1e-6))) AS opacity, (r-0.5)/0.28209479177387814 AS r FROM splats"), "splat_id", ["sx", "opacity", "r"]))
def sk1(spark, sf):
    return rounded(S.encoded(splats(spark, sf)).select("splat_id", "sx", "opacity", "r"))


@query("sc5_decode", sql_rounded((SPLATS_SQL, "SELECT splat_id, sx, opacity, r FROM splats"), "splat_id", ["sx", "opacity", "r"]))
def sc5(spark, sf):
    return rounded(S.decoded(S.encoded(splats(spark, sf))).select("splat_id", "sx", "opacity", "r"))


_STORED_SQL = ", ".join(["x::FLOAT::DOUBLE AS x", "y::FLOAT::DOUBLE AS y", "z::FLOAT::DOUBLE AS z", *[f"exp(ln(greatest({c}, 1e-7))::FLOAT::DOUBLE) AS {c}" for c in ("sx", "sy", "sz")], *[f"0.5 + 0.28209479177387814 * (({c} - 0.5) / 0.28209479177387814)::FLOAT::DOUBLE AS {c}" for c in "rgb"], *[f"{c}::FLOAT::DOUBLE AS {c}" for c in ("qw", "qx", "qy", "qz")], "1 / (1 + exp(-(ln(least(greatest(opacity, 1e-6), 1 - 1e-6) / (1 - least(greatest(opacity, 1e-6), 1 - 1e-6))))::FLOAT::DOUBLE)) AS opacity"])
_STORED = ["x", "y", "z", "sx", "sy", "sz", "r", "g", "b", "qw", "qx", "qy", "qz", "opacity"]


@query("sc7_ply_parts", sql_rounded((SPLATS_SQL, f"SELECT row_number() OVER (ORDER BY splat_id) - 1 AS splat_id, {_STORED_SQL} FROM splats"), "splat_id", _STORED, 5))
def sc7(spark, sf):
    """The splats written as a folder of PLY files and read back in byte ranges, numbered in their order."""
    folder = shared_folder(spark, "ply")
    ply.write_parts(splats(spark, sf), folder)
    return rounded(ply_table.numbered(ply.read(spark, folder)).select("splat_id", *_STORED), 5)


@query("sc8_ply_headers", f"WITH {SPLATS_SQL} SELECT frame_idx, COUNT(*) AS vertices, true AS has_core_fields, 17::BIGINT AS n_fields, 'linearRGB' AS color_space FROM splats GROUP BY 1")
def sc8(spark, sf):
    """Counts and fields of splat files, one folder of them for each frame, from headers alone."""
    folder = shared_folder(spark, "frames")
    stored = S.encoded(splats(spark, sf)).select("frame_idx", *[F.col(c).cast("float").alias(ply.FIELDS.get(c, c)) for c in ply.FIELDS], *[F.lit(0.0).cast("float").alias(c) for c in ("nx", "ny", "nz")])
    ply_table.save(stored.withColumn("frame_idx", F.col("frame_idx").cast("int")).repartitionByRange("frame_idx"), folder, color_space="linearRGB")
    parts = ply_table.scan(spark, folder, ["path", "frame_idx"]).groupBy("path", "frame_idx").agg(F.count("*").alias("vertices"))
    whole = parts.join(ply.inspect(spark, folder).drop("vertices"), "path")
    inside = whole.groupBy("frame_idx").agg(F.sum("vertices").alias("vertices"), F.min("has_core_fields").alias("has_core_fields"), F.min(F.size("fields") - 1).cast("long").alias("n_fields"), F.min("color_space").alias("color_space"))
    return inside.select(F.col("frame_idx").cast("long").alias("frame_idx"), "vertices", "has_core_fields", "n_fields", "color_space")


@query("sf6_color_spaces", sql_rounded((SPLATS_SQL, "SELECT splat_id, CASE WHEN r <= 0.0031308 THEN r*12.92 ELSE 1.055*pow(r, 1/2.4) - 0.055 END AS srgb, CASE WHEN g <= 0.04045 THEN g/12.92 ELSE pow((g+0.055)/1.055, 2.4) END AS linear FROM splats"), "splat_id", ["srgb", "linear"]))
def sf6(spark, sf):
    return rounded(splats(spark, sf).select("splat_id", E.to_srgb(F.col("r")).alias("srgb"), E.to_linear(F.col("g")).alias("linear")))


@query("sf3_activations", sql_rounded((SPLATS_SQL, """SELECT splat_id, greatest(opacity_logit,0) + ln(1 + exp(-abs(opacity_logit))) AS softplus, sx + ln(1 - exp(-sx)) AS inverse, 0.5 + 0.5*tanh((x-0.5)/0.5) AS soft,
 least(greatest(y/6 + 0.5, 0), 1) AS hard, CASE WHEN x > 0 THEN sqrt(x) ELSE 0 END AS guarded, 0.5*(1 - pow(1-opacity, 2) + pow(opacity, 0.5)) AS opacity FROM splats"""), "splat_id", ["softplus", "inverse", "soft", "hard", "guarded", "opacity"]))
def sf3(spark, sf):
    c = F.col
    return rounded(splats(spark, sf).select("splat_id", E.softplus(c("opacity_logit")).alias("softplus"), E.inverse_softplus(c("sx")).alias("inverse"), E.soft_clamp(c("x"), 0.0, 1.0).alias("soft"), E.hard_sigmoid(c("y")).alias("hard"), E.robust_where(c("x") > 0, F.sqrt, c("x"), 0.0).alias("guarded"), E.pdf_to_opacity(c("opacity"), 1.0).alias("opacity")))


@query("pr23_unit_normals", sql_rounded((SPLATS_SQL, "SELECT splat_id, x/sqrt(x*x+y*y+z*z) AS nx, y/sqrt(x*x+y*y+z*z) AS ny, z/sqrt(x*x+y*y+z*z) AS nz FROM splats"), "splat_id", ["nx", "ny", "nz"]))
def pr23(spark, sf):
    return rounded(splats(spark, sf).select("splat_id", *[c.alias(n) for c, n in zip(G.unit((F.col("x"), F.col("y"), F.col("z"))), ("nx", "ny", "nz"))]))


@query("pr5_radial_to_z", sql_rounded((RASTER_SQL, "SELECT v, u, depth*cos((0.5 - v/h)*pi())*cos((u/w - 0.5)*2*pi()) AS z FROM raster, dims"), "v, u", ["z"]))
def pr5(spark, sf):
    r = raster(spark, sf)
    lon, lat = G.lonlat(F.col("u"), F.col("v"), width(), height(r))
    return rounded(r.select("v", "u", G.radial_to_z(F.col("depth"), lat, lon).alias("z")))


@query("pr6_z_to_euclidean", sql_rounded((RASTER_SQL, "SELECT v, u, depth*sqrt(((u-w/2)/100)**2 + ((v-h/2)/100)**2 + 1) AS d FROM raster, dims"), "v, u", ["d"]))
def pr6(spark, sf):
    r = raster(spark, sf)
    return rounded(r.select("v", "u", G.z_to_euclidean(F.col("depth"), F.col("u"), F.col("v"), 100.0, 100.0, width() / 2, height(r) / 2).alias("d")))


@query("pr7_point_cloud", sql_rounded((RASTER_SQL + ", a AS (SELECT v, u, depth, ((u+0.5)/w - 0.5)*2*pi() AS lo, (0.5 - (v+0.5)/h)*pi() AS la FROM raster, dims)", "SELECT v, u, depth*cos(la)*sin(lo) AS x, depth*sin(la) AS y, depth*cos(la)*cos(lo) AS z FROM a"), "v, u", ["x", "y", "z"]))
def pr7(spark, sf):
    r = raster(spark, sf)
    ray = G.lonlat_ray(*G.lonlat(F.col("u") + 0.5, F.col("v") + 0.5, width(), height(r)))
    return rounded(r.select("v", "u", *[(F.col("depth") * c).alias(n) for c, n in zip(ray, "xyz")]))


@query("pr22_disparity_depth", sql_rounded((RASTER_SQL + ", d AS (SELECT v, u, 1/(abs(depth) + 1e-6) AS d FROM raster), m AS (SELECT quantile_disc(d, 0.5) AS m FROM d)", "SELECT v, u, d*5/m AS d FROM d, m"), "v, u", ["d"]))
def pr22(spark, sf):
    d = raster(spark, sf).select("v", "u", (1.0 / (F.abs("depth") + 1e-6)).alias("d"))
    lower = quantiles(d, "d", [0.5], discrete=True).select(F.col("p")[0]).scalar()
    return rounded(d.select("v", "u", (F.col("d") * 5.0 / lower).alias("d")))


@query("pr27_preview", "WITH " + RASTER_SQL + ", l AS (SELECT v, u, ln(1 + depth) AS l FROM raster), p AS (SELECT quantile_cont(l, 0.01) AS a, quantile_cont(l, 0.99) AS b FROM l) SELECT v, u, trunc(round(least(greatest((l-a)/(b-a), 0), 1)*255, 6))::INTEGER AS shade FROM l, p")
def pr27(spark, sf):
    d = raster(spark, sf).select("v", "u", F.log1p("depth").alias("l"))
    p = quantiles(d, "l", [0.01, 0.99])
    share = G.clamp((F.col("l") - F.col("p")[0]) / (F.col("p")[1] - F.col("p")[0]), 0.0, 1.0)
    return d.join(F.broadcast(p)).select("v", "u", F.round(share * 255, 6).cast("int").alias("shade"))


@query("pr18_poses", """WITH t AS (SELECT k::INTEGER AS frame_idx, y::INTEGER AS yaw FROM range(81) r(k), (SELECT unnest([0, 90, 180, 270]) AS y))
SELECT frame_idx, yaw, round(sin(radians(yaw)), 6) + 0.0 AS lx, 0.0::DOUBLE AS ly, round(0.02*frame_idx + cos(radians(yaw)), 6) + 0.0 AS lz, round(512/(2*tan(radians(90)/2)), 6) AS f FROM t""")
def pr18(spark, sf):
    t = generators.trajectories(spark, ("forward",)).select("frame_idx", "tx", "ty", "tz", F.explode(F.array(*map(F.lit, (0, 90, 180, 270)))).alias("yaw"))
    return rounded(t.select("frame_idx", "yaw", (F.col("tx") + F.sin(F.radians("yaw"))).alias("lx"), F.col("ty").alias("ly"), (F.col("tz") + F.cos(F.radians("yaw"))).alias("lz"), G.focal(512.0, 90.0).alias("f")))


@query("pr19_camera_rt", sql_rounded((SPLATS_SQL + """, f AS (SELECT *, sqrt(x*x + y*y + (1-z)*(1-z)) AS n FROM splats), g AS (SELECT splat_id, x, y, z, -x/n AS fx, -y/n AS fy, (1-z)/n AS fz FROM f),
r AS (SELECT *, -fz/sqrt(fz*fz+fx*fx) AS rx, fx/sqrt(fz*fz+fx*fx) AS rz FROM g)""", "SELECT splat_id, rx, rz, fx, fy, fz, -(rx*x + rz*z) AS tx, -(fx*x + fy*y + fz*z) AS tz FROM r"), "splat_id", ["rx", "rz", "fx", "fy", "fz", "tx", "tz"]))
def pr19(spark, sf):
    zero, one = F.lit(0.0), F.lit(1.0)
    rot, t = G.look_at((F.col("x"), F.col("y"), F.col("z")), (zero, zero, one))
    return rounded(splats(spark, sf).select("splat_id", rot[0].alias("rx"), rot[2].alias("rz"), rot[6].alias("fx"), rot[7].alias("fy"), rot[8].alias("fz"), t[0].alias("tx"), t[2].alias("tz")))


@query("pr26_focal_mm", sql_rounded((SPLATS_SQL, "SELECT splat_id, (30 + 10*x)*sqrt(1920.0*1920 + 1080*1080)/sqrt(36.0*36 + 24*24) AS f FROM splats"), "splat_id", ["f"]))
def pr26(spark, sf):
    return rounded(splats(spark, sf).select("splat_id", G.focal_from_mm(F.lit(1920.0), F.lit(1080.0), 30 + 10 * F.col("x")).alias("f")))


@query("pr21_ray_pixels", sql_rounded((SPLATS_SQL, "SELECT splat_id, (atan2(x, z)/(2*pi()) + 0.5)*2048 - 0.5 AS pu, (0.5 - asin(y/sqrt(x*x+y*y+z*z))/pi())*1024 - 0.5 AS pv FROM splats"), "splat_id", ["pu", "pv"]))
def pr21(spark, sf):
    u, v = G.ray_pixel(F.col("x"), F.col("y"), F.col("z"), F.lit(2048.0), F.lit(1024.0))
    return rounded(splats(spark, sf).select("splat_id", u.alias("pu"), v.alias("pv")))


_FAR = "round({c}, CASE WHEN abs({c}) < 1e5 THEN 4 ELSE 0 END) + 0.0 AS {c}"  # at a quarter turn points lie 1e8 times as far


@query("pr4_unproject", f"""WITH {FRAMES_SQL}, a AS (SELECT frame_idx, v, u, raw, (u/w - 0.5)*2*pi() AS lo, (0.5 - v/h)*pi() AS la FROM frames, dims WHERE raw > 0.01),
r AS (SELECT *, cos(la)*sin(lo) AS rx, sin(la) AS ry, cos(la)*cos(lo) AS rz FROM a), c AS (SELECT frame_idx, v, u, rx*(raw/(rz+1e-8)) AS cx, ry*(raw/(rz+1e-8)) AS cy, rz*(raw/(rz+1e-8)) AS cz FROM r),
p AS (SELECT frame_idx, v, u, 0.96*cx + 0.28*cz + 0.02*frame_idx AS x, cy - 1.5 AS y, 0.96*cz - 0.28*cx + 0.5 AS z FROM c)
SELECT frame_idx, v, u, {', '.join(_FAR.format(c=c) for c in 'xyz')} FROM p""")
def pr4(spark, sf):
    """Every valid cell of every frame as a point of the world, under the pose of its frame."""
    from skyloom.operators.rasters import unproject
    from skyloom.plans.tables import raster as base

    h = height(base(spark, sf))
    one, zero = F.lit(1.0), F.lit(0.0)
    pose = [[F.lit(0.96), zero, F.lit(0.28), 0.02 * F.col("frame_idx")], [zero, one, zero, F.lit(-1.5)], [F.lit(-0.28), zero, F.lit(0.96), F.lit(0.5)]]
    p = unproject(frames(spark, sf), width(), h, "raw", pose=pose)
    near = lambda c: F.when(F.abs(c) < 1e5, F.round(c, 4)).otherwise(F.round(c, 0)) + 0.0
    return p.select("frame_idx", "v", "u", *[near(F.col(c)).alias(c) for c in "xyz"])


@query("flagship_panorama_to_splats", f"""WITH {SPLAT_GRID_SQL}, splats AS (SELECT (v::BIGINT*{WIDTH} + u)::BIGINT AS splat_id, depth*sin(phi)*cos(theta) AS x, depth*cos(phi) AS y, -depth*sin(phi)*sin(theta) AS z FROM kang),
{KNN_SQL(16)}, m AS (SELECT splat_id, AVG(dist) AS near FROM knn GROUP BY 1) SELECT splat_id FROM m WHERE near < (SELECT AVG(near) + stddev_pop(near)*2.25 FROM m)""")
def flagship(spark, sf):
    return panorama_to_splats(spark, sf).select("splat_id")
