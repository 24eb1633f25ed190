"""Queries of pyramids and Poisson's equation over the orders raster cut to bands, of faces and back, and of streams with state."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import functions as F

from skyloom.operators import poisson, projection, pyramids
from skyloom.operators.stencils import along, gaussian_weights
from skyloom.plans.tables import JOBS_SQL, RASTER_SQL, WIDTH, height, query, raster, rounded, width
from skyloom.session import shared_folder
from skyloom.streaming import state

#: Rows of the rasters that the orders raster is cut to.
BAND = 40
BANDS_SQL = f"{RASTER_SQL}, bands AS (SELECT v // {BAND} AS raster_id, v % {BAND} AS v, u, depth FROM raster)"


def bands(spark, sf):
    return raster(spark, sf).select(F.floor(F.col("v") / BAND).cast("int").alias("raster_id"), (F.col("v") % BAND).alias("v"), "u", "depth")


def _mirror_sql(c: str, axis: str) -> str:
    over = f"OVER (PARTITION BY raster_id, {'v' if axis == 'u' else 'u'} ORDER BY {axis})"
    lag, lead = (lambda d: f"lag({c}, {d}) {over}"), (lambda d: f"lead({c}, {d}) {over}")
    far = lambda here, one, there: f"coalesce({here(2)}, CASE WHEN {one(1)} IS NOT NULL THEN {c} END, {there(2)}, {c})"
    parts = [far(lag, lag, lead), f"coalesce({lag(1)}, {lead(1)}, {c})", c, f"coalesce({lead(1)}, {lag(1)}, {c})", far(lead, lead, lag)]
    return " + ".join(f"{k!r} * {p}" for k, p in zip(gaussian_weights(2, 1.0), parts))


def _end_sql(axis: str, size: str, d: int) -> tuple[str, str]:
    at = f"((f.{axis} + 0.5) * ((f.{size} + 1) // 2) / f.{size} - 0.5)"
    return f"least(greatest(floor({at}) + {d}, 0), (f.{size} + 1) // 2 - 1)", f"({at} - floor({at}))" if d else f"(1 - ({at} - floor({at})))"


def fusion_sql(levels: int, mix, **columns: str) -> str:
    """The bands' fusion; ``mix(level, x, y, c)`` picks between detail and coarse, with the confidence where there is one."""
    names = list(columns)
    out = [f"WITH {BANDS_SQL}, g0 AS (SELECT raster_id, v, u, {', '.join(f'{x} AS {c}' for c, x in columns.items())}, MAX(v) OVER (PARTITION BY raster_id) + 1 AS h, MAX(u) OVER (PARTITION BY raster_id) + 1 AS w FROM bands)"]
    for i in range(1, levels):
        out.append(f"r{i} AS (SELECT raster_id, v, u, h, w, {', '.join(f'{_mirror_sql(c, "u")} AS {c}' for c in names)} FROM g{i - 1})")
        out.append(f"b{i} AS (SELECT raster_id, v, u, h, w, {', '.join(f'{_mirror_sql(c, "v")} AS {c}' for c in names)} FROM r{i})")
        out.append(f"g{i} AS (SELECT raster_id, v // 2 AS v, u // 2 AS u, (h + 1) // 2 AS h, (w + 1) // 2 AS w, {', '.join(names)} FROM b{i} WHERE v % 2 = 0 AND u % 2 = 0)")
    out.append(f"x{levels - 1} AS (SELECT *, {mix(levels - 1, 'a', 'b', 'c')} AS x FROM g{levels - 1})")
    for i in range(levels - 2, -1, -1):
        corners = " UNION ALL ".join(f"SELECT f.raster_id, f.v, f.u, {_end_sql('v', 'h', p)[0]} AS i, {_end_sql('u', 'w', q)[0]} AS j, {_end_sql('v', 'h', p)[1]} * {_end_sql('u', 'w', q)[1]} AS k FROM g{i} f" for p in (0, 1) for q in (0, 1))
        out.append(f"u{i} AS (SELECT c.raster_id, c.v, c.u, SUM(k * s.x) / SUM(k) AS x, SUM(k * s.a) / SUM(k) AS a, SUM(k * s.b) / SUM(k) AS b FROM ({corners}) c JOIN x{i + 1} s ON s.raster_id = c.raster_id AND s.v = c.i AND s.u = c.j WHERE k > 0 GROUP BY 1, 2, 3)")
        out.append(f"x{i} AS (SELECT f.*, coalesce({mix(i, 'f.a - u.a', 'f.b - u.b', 'f.c')} + u.x, {mix(i, 'f.a', 'f.b', 'f.c')}) AS x FROM g{i} f LEFT JOIN u{i} u USING (raster_id, v, u))")
    return ",\n".join(out) + " SELECT raster_id, v, u, round(greatest(x, 0), 6) + 0.0 AS value FROM x0"


@query("ud11_laplacian_fusion", fusion_sql(5, lambda level, x, y, _: f"({y if level >= 3 else x})", a="depth", b="greatest(depth, 10)"))
def ud11(spark, sf):
    d = bands(spark, sf).withColumn("coarse", F.greatest("depth", F.lit(10.0)))
    return rounded(pyramids.laplacian_fusion(d, "raster_id", "depth", "coarse"))


@query("ud11_masked_fusion", fusion_sql(4, lambda _, x, y, c: f"({c} * ({x}) + (1 - {c}) * ({y}))", a="depth", b="greatest(depth, 10)", c="least(depth / 50, 1)"))
def ud11_masked(spark, sf):
    """The same with a confidence for the detail in place of a cutoff."""
    d = bands(spark, sf).withColumns({"coarse": F.greatest("depth", F.lit(10.0)), "sure": F.least(F.col("depth") / 50, F.lit(1.0))})
    return rounded(pyramids.laplacian_fusion(d, "raster_id", "depth", "coarse", 4, confidence="sure"))


_NEXT = ["lag(x) OVER (PARTITION BY raster_id, v ORDER BY u)", "lead(x) OVER (PARTITION BY raster_id, v ORDER BY u)", "lag(x) OVER (PARTITION BY raster_id, u ORDER BY v)", "lead(x) OVER (PARTITION BY raster_id, u ORDER BY v)"]


@query("ud12_poisson_fill", f"""WITH RECURSIVE {BANDS_SQL}, it AS (SELECT 0 AS n, raster_id, v, u, CASE WHEN depth > 10 THEN depth END AS fixed, CASE WHEN depth > 10 THEN depth ELSE 0 END AS x FROM bands
UNION ALL SELECT n + 1, raster_id, v, u, fixed, coalesce(fixed, ({' + '.join(f'coalesce({x}, 0)' for x in _NEXT)}) / ({' + '.join(f'CASE WHEN {x} IS NULL THEN 0 ELSE 1 END' for x in _NEXT)})) FROM it WHERE n < 200)
SELECT raster_id, v, u, round(x, 4) + 0.0 AS value FROM it WHERE n = 200""")
def ud12(spark, sf):
    """Cells of small depth filled from those around them; the SQL iterates to the same."""
    d = bands(spark, sf).withColumn("known", (F.col("depth") > 10).cast("int"))
    out = poisson.fill(d, "raster_id", "depth", "known", block=32, rim=8)
    # Means of four prices often end in a five: rounded as doubles, as the SQL does, not as decimals.
    return out.withColumn("value", F.floor(F.col("value") * 10000 + 0.5) / 10000)


@query("ud12_poisson_blend", f"WITH {BANDS_SQL} SELECT raster_id, v, u, round(depth, 6) + 0.0 AS value FROM bands")
def ud12_blend(spark, sf):
    """Every inner cell from the border and the five-point differences alone: what comes out is the raster."""
    d = bands(spark, sf)
    around = [f(F.col("depth")).over(along(axis, ("raster_id",))) for axis in ("u", "v") for f in (F.lag, F.lead)]
    inside = sum((a.isNotNull().cast("int") for a in around), F.lit(0)) == 4
    d = d.withColumn("rhs", F.when(inside, 4 * F.col("depth") - sum(around, F.lit(0.0))))
    d = d.withColumn("border", F.when(F.col("rhs").isNull(), F.col("depth"))).drop("depth")
    return rounded(poisson.bordered(d, "raster_id", "rhs", "border", block=32, rim=12, tolerance=1e-12))


def _icosahedron() -> list[tuple[float, ...]]:
    """Unit middles of the triples of corners at edge distance, from low z, y, x to high."""
    g = (1 + math.sqrt(5)) / 2
    corners = [v for a in (-1, 1) for b in (-g, g) for v in ((0, a, b), (a, b, 0), (b, 0, a))]
    triples = [t for t in itertools.combinations(corners, 3) if all(math.dist(p, q) < 2.1 for p, q in itertools.combinations(t, 2))]
    middles = [tuple(sum(c) / math.hypot(*map(sum, zip(*t))) for c in zip(*t)) for t in triples]
    return sorted(middles, key=lambda m: tuple(round(c, 6) + 0.0 for c in reversed(m)))


def faces_sql(kind: str, size: int) -> str:
    """The raster on each face, ``face_values``, and each cell's place and weight on each face that covers it, ``seen``."""
    rows = [(k, *d, *u) for k, (d, u) in enumerate(projection.CUBE)] if kind == "cube" else [(k, *m, 0, 1, 0) for k, m in enumerate(_icosahedron())]
    fov, overlap = math.radians(projection.field(kind)), projection.OVERLAP[kind]
    inner, reach, last = 1 / (1 + overlap), math.tan(fov / 2), WIDTH - 1
    return f"""{RASTER_SQL}, planes AS (SELECT face, fx::DOUBLE AS fx, fy::DOUBLE AS fy, fz::DOUBLE AS fz, ux::DOUBLE AS ux, uy::DOUBLE AS uy, uz::DOUBLE AS uz FROM (VALUES {', '.join(map(str, rows))}) t(face, fx, fy, fz, ux, uy, uz)),
g1 AS (SELECT *, uy*fz - uz*fy AS ax, uz*fx - ux*fz AS ay, ux*fy - uy*fx AS az FROM planes), g2 AS (SELECT face, fx, fy, fz, ax/sqrt(ax*ax + ay*ay + az*az) AS ax, ay/sqrt(ax*ax + ay*ay + az*az) AS ay, az/sqrt(ax*ax + ay*ay + az*az) AS az FROM g1),
g AS (SELECT *, ay*fz - az*fy AS bx, az*fx - ax*fz AS "by", ax*fy - ay*fx AS bz FROM g2),
t AS (SELECT g.*, i::INTEGER AS "row", j::INTEGER AS col, {-reach!r} + j*{2 * reach / (size - 1)!r} AS p, {-reach!r} + i*{2 * reach / (size - 1)!r} AS q FROM g, range({size}) y(i), range({size}) x(j)),
d AS (SELECT face, "row", col, fx + p*ax + q*bx AS x, fy + p*ay + q*"by" AS y, fz + p*az + q*bz AS z FROM t), n AS (SELECT face, "row", col, x/m AS x, y/m AS y, z/m AS z FROM (SELECT *, sqrt(x*x + y*y + z*z) AS m FROM d)),
e AS (SELECT face, "row", col, (2 - (CASE WHEN atan2(-z, x) < 0 THEN atan2(-z, x) + 2*pi() ELSE atan2(-z, x) END)/pi())/2*{last} AS pu, acos(least(greatest(y, -1), 1))/pi()*(h - 1) AS pv, h FROM n, dims),
k AS (SELECT face, "row", col, least(greatest(floor(pv) + b, 0), h - 1)::INTEGER AS v, ((floor(pu)::INTEGER + a) % {WIDTH} + {WIDTH}) % {WIDTH} AS u, (CASE a WHEN 1 THEN pu - floor(pu) ELSE 1 - pu + floor(pu) END)*(CASE b WHEN 1 THEN pv - floor(pv) ELSE 1 - pv + floor(pv) END) AS k FROM (SELECT face, "row", col, least(greatest(pu, 0), {last}) AS pu, pv, h FROM e), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b)),
face_values AS (SELECT face, "row", col, SUM(k*depth) AS value FROM k JOIN raster USING (v, u) GROUP BY 1, 2, 3),
rays AS (SELECT v, u, sin(v/(h - 1)*pi())*cos((1 - u/{last}.0)*2*pi()) AS x, cos(v/(h - 1)*pi()) AS y, -sin(v/(h - 1)*pi())*sin((1 - u/{last}.0)*2*pi()) AS z FROM raster, dims),
s1 AS (SELECT face, v, u, x*fx + y*fy + z*fz AS d, x*ax + y*ay + z*az AS a, x*bx + y*"by" + z*bz AS b FROM rays, g), s2 AS (SELECT face, v, u, d, a/greatest(d, 0.1)/{reach!r} AS a, b/greatest(d, 0.1)/{reach!r} AS b FROM s1),
seen AS (SELECT face, v, u, (a + 1)/2*{size - 1} AS pc, (b + 1)/2*{size - 1} AS pr, exp(-(acos(greatest(least(d, 1), -1))**2)/{fov * fov / 4!r})*cos(greatest(least((greatest(abs(a), abs(b)) - {inner!r})/{1 - inner!r}, 1), 0)*pi()/2)**2 AS w FROM s2 WHERE d > 0.1 AND abs(a) <= 1 AND abs(b) <= 1),
c AS (SELECT face, v, u, w, floor(pc)::INTEGER + i AS col, floor(pr)::INTEGER + j AS "row", (CASE i WHEN 1 THEN pc - floor(pc) ELSE 1 - pc + floor(pc) END)*(CASE j WHEN 1 THEN pr - floor(pr) ELSE 1 - pr + floor(pr) END) AS k FROM seen, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j) WHERE w > 0)"""


def _reprojected(name: str, kind: str, size: int) -> None:
    @query(name, f"WITH {faces_sql(kind, size)} SELECT c.v, c.u, round(SUM(w*k*coalesce(value, 0))/greatest(SUM(w*k), 1e-6), 4) + 0.0 AS depth, round(SUM(w*k), 4) + 0.0 AS weight FROM c LEFT JOIN face_values f USING (face, \"row\", col) GROUP BY 1, 2")
    def run(spark, sf):
        """The depth raster on all faces, and back as the weighted mean of the faces that cover a cell."""
        r = raster(spark, sf)
        planes, fov = projection.faces(spark, kind), projection.field(kind)
        values = projection.project(r, "depth", planes, size, fov, WIDTH, height(r))
        return rounded(projection.reproject(values, "depth", planes, r.select("v", "u"), size, fov, projection.OVERLAP[kind], width(), height(r)), 4)


_reprojected("ag25_reprojected_cube", "cube", 24)
_reprojected("ag25_reprojected_icosahedron", "icosahedron", 16)


@query("sr2_expired_stream", f"WITH {JOBS_SQL}, n AS (SELECT MAX(last_updated) AS now FROM jobs) SELECT job_id, status FROM jobs, n WHERE status IN ('complete', 'error') AND epoch_us(now) - epoch_us(last_updated) > 7200000000")
def sr2(spark, sf):
    """The events as a stream of job updates; closed sessions give out the finished jobs that have been still for two hours."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state.use_state_store(spark)
    try:
        found = spark.readStream.schema("event_id long, ts timestamp, event_type string").parquet(f"{sf}/events*.parquet")
        status = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "queued").otherwise("processing")
        updates = found.select(F.col("event_id").alias("job_id"), status.alias("status"), F.col("ts").alias("last_updated"))
        folder = shared_folder(spark, "expired")
        return state.run_to_end(state.expired_stream(updates), f"{folder}/out", f"{folder}/state").select("job_id", "status")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
