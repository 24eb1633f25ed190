"""Table functions: grids, rays, view layouts, camera rigs and trajectories."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import geometry as G
from skyloom.operators.quantiles import quantiles

PRESETS = ("forward", "backward", "right", "left", "s_curve", "loop")
FRAMES, KEYFRAME_STEP = 81, 4


def cells(spark: SparkSession, height: int, width: int, stride: int = 1) -> DataFrame:
    """(row, col, v, u): whole strides that fit; (v, u) is the middle of the stride cell."""
    rows, cols = height // stride, width // stride
    i = F.col("id")
    return spark.range(rows * cols).select(F.floor(i / cols).cast("int").alias("row"), (i % cols).cast("int").alias("col")).select("row", "col", (F.col("row") * stride + stride / 2).alias("v"), (F.col("col") * stride + stride / 2).alias("u"))


def with_grid(df: DataFrame, v: Column, u: Column, height: Column, width: Column) -> DataFrame:
    """Adds theta, phi, the ray (rx, ry, rz) and the tangent frame (ax …, bx …) of the grid convention."""
    theta, phi = G.turn_angles(u, v, width, height)
    df = df.withColumns({"theta": theta, "phi": phi})
    df = df.withColumns(dict(zip(("rx", "ry", "rz"), G.turn_ray(F.col("theta"), F.col("phi")))))
    right, up = G.tangent_frame((F.col("rx"), F.col("ry"), F.col("rz")))
    return df.withColumns(dict(zip(("ax", "ay", "az", "bx", "by", "bz"), (*right, *up))))


def horizon_views(spark: SparkSession, counts: tuple[int, ...]) -> DataFrame:
    """(n, i, name, yaw, forward axis): n views around the horizon for each n; four are named by direction."""
    two = F.when(F.col("i") == 0, "front").otherwise("back")
    base = spark.createDataFrame([(n,) for n in counts], "n int").select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    base = base.withColumns({"name": F.when(F.col("n") == 4, F.get(F.array(*map(F.lit, ("front", "right", "back", "left"))), F.col("i"))).when(F.col("n") == 2, two).otherwise(F.format_string("side_%02d", "i")), "yaw": F.col("i") * (2 * math.pi) / F.col("n")})
    return base.select("n", "i", "name", "yaw", F.sin("yaw").alias("fx"), F.lit(0.0).alias("fy"), F.cos("yaw").alias("fz"))


def extraction_layout(spark: SparkSession, face: int, counts: tuple[int, ...], overlap: float = 10.0, most_fov: float = 170.0) -> DataFrame:
    """(n, fov, width, focal): n horizon views whose fields of view overlap; width keeps the angular resolution."""
    d = spark.createDataFrame([(n,) for n in counts], "n int")
    d = d.withColumn("fov", F.least(F.lit(most_fov), 360.0 / F.col("n") + overlap))
    d = d.withColumn("width", F.greatest(F.lit(face), F.bround(face * F.col("fov") / (360.0 / F.col("n")), 0).cast("int")))
    return d.withColumn("focal", (F.col("width") / 2) / F.tan(F.radians("fov") / 2))


def camera_rig(depths: DataFrame, depth: str, directions: int = 12, fractions: tuple[float, ...] = (0.1, 0.2, 0.3)) -> DataFrame:
    """(cam_id, azimuth_deg, fraction, px, py, pz): cameras moved off the origin by a share of the median depth."""
    median = quantiles(depths.where(F.col(depth) > 0), depth, [0.5]).select(F.col("p")[0].alias("median"))
    d = median.select("median", F.explode(F.sequence(F.lit(0), F.lit(directions - 1))).alias("i"))
    d = d.select("median", "i", F.posexplode(F.array(*map(F.lit, fractions))).alias("j", "fraction"))
    a = F.col("i") * (2 * math.pi / directions)
    r = F.col("median") * F.col("fraction")
    return d.select((F.col("i") * len(fractions) + F.col("j")).cast("int").alias("cam_id"), (F.col("i") * (360.0 / directions)).alias("azimuth_deg"), "fraction", (r * F.sin(a)).alias("px"), F.lit(0.0).alias("py"), (r * F.cos(a)).alias("pz"))


def trajectories(spark: SparkSession, presets: tuple[str, ...] = PRESETS, step: float = 0.02, amplitude: float = 0.3, radius: float = 0.5, frames: int = FRAMES) -> DataFrame:
    """(preset, frame_idx, tx, ty, tz, keyframe): eye paths that start at the origin; every fourth frame is a key."""
    if bad := set(presets) - set(PRESETS):
        raise ValueError(f"unknown presets: {sorted(bad)}")
    d = spark.createDataFrame([(p,) for p in presets], "preset string").select("preset", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("frame_idx"))
    k, p = F.col("frame_idx"), F.col("preset")
    t = k / float(max(frames - 1, 1)) * (2 * math.pi)
    x = F.when(p == "right", step * k).when(p == "left", -step * k).when(p == "s_curve", amplitude * F.sin(t)).when(p == "loop", radius * F.sin(t)).otherwise(0.0)
    z = F.when(p.isin("forward", "s_curve"), step * k).when(p == "backward", -step * k).when(p == "loop", radius * (1 - F.cos(t))).otherwise(0.0)
    return d.select("preset", "frame_idx", x.alias("tx"), F.lit(0.0).alias("ty"), z.alias("tz"), (k % KEYFRAME_STEP == 0).alias("keyframe"))


def cube_faces(spark: SparkSession) -> DataFrame:
    """(face, yaw_deg, pitch_deg, r00 … r22): six faces, rotation about x then y."""
    faces = [("front", 0, 0), ("right", 90, 0), ("back", 180, 0), ("left", 270, 0), ("up", 0, 90), ("down", 0, -90)]
    d = spark.createDataFrame(faces, "face string, yaw_deg int, pitch_deg int")
    y, p = F.radians("yaw_deg"), F.radians("pitch_deg")
    m = [F.cos(y), F.sin(y) * F.sin(p), F.sin(y) * F.cos(p), F.lit(0.0), F.cos(p), -F.sin(p), -F.sin(y), F.cos(y) * F.sin(p), F.cos(y) * F.cos(p)]
    return d.select("*", *[c.alias(f"r{i // 3}{i % 3}") for i, c in enumerate(m)])


def pole_views(spark: SparkSession, poles: tuple[str, ...] = ("zenith", "nadir")) -> DataFrame:
    """(name, right, down and forward axes) of the views along the vertical; ValueError for another name."""
    rows = {"zenith": (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0), "nadir": (1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, -1.0, 0.0)}
    if bad := set(poles) - set(rows):
        raise ValueError(f"unknown poles: {sorted(bad)}")
    return spark.createDataFrame([(p, *rows[p]) for p in poles], "name string, " + ", ".join(f"{a}{x} double" for a in "rdf" for x in "xyz"))


def cap_layout(spark: SparkSession, face: int, fovs: tuple[float, ...], most_fov: float = 170.0) -> DataFrame:
    """(fov, width, height, focal): square views of the caps."""
    d = spark.createDataFrame([(float(f),) for f in fovs], "asked double").withColumn("fov", F.least(F.col("asked"), F.lit(most_fov)))
    return d.select("fov", F.lit(face).alias("width"), F.lit(face).alias("height"), ((face / 2) / F.tan(F.radians("fov") / 2)).alias("focal"))


def icosahedral_faces(spark: SparkSession) -> DataFrame:
    """(face, cx, cy, cz): unit centres of the twenty faces, from the triples of vertices at edge distance."""
    g = (1 + math.sqrt(5)) / 2
    corners = [v for a in (-1, 1) for b in (-g, g) for v in ((0, a, b), (a, b, 0), (b, 0, a))]
    v = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(corners)], "i int, x double, y double, z double")
    near = lambda a, b: sum(((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) ** 2 for c in "xyz"), F.lit(0.0)) < 4.1
    t = v.alias("a").join(v.alias("b"), (F.col("a.i") < F.col("b.i")) & near("a", "b")).join(v.alias("c"), (F.col("b.i") < F.col("c.i")) & near("a", "c") & near("b", "c"))
    s = t.select(*[(F.col(f"a.{c}") + F.col(f"b.{c}") + F.col(f"c.{c}")).alias(c) for c in "xyz"])
    u = G.unit((F.col("x"), F.col("y"), F.col("z")))
    return s.select(u[0].alias("cx"), u[1].alias("cy"), u[2].alias("cz"))


def eye_paths(spark: SparkSession, offset: Column | float = 0.1, steps: int = 60) -> DataFrame:
    """(kind, step, ex, ey, ez): eyes that swipe, shake, rotate, and rotate while moving forward."""
    d = spark.createDataFrame([("swipe",), ("shake",), ("rotate",), ("rotate_forward",)], "kind string").select("kind", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    k, o = F.col("kind"), G.lit(offset)
    t = F.col("step") / float(steps - 1)
    a = t * (2 * math.pi)
    x = F.when(k == "swipe", o * (2 * t - 1)).when(k == "shake", F.when(t < 0.5, o * F.sin(2 * a)).otherwise(0.0)).otherwise(o * F.sin(a))
    y = F.when(k == "swipe", 0.0).when(k == "shake", F.when(t < 0.5, 0.0).otherwise(o * F.sin(2 * a))).when(k == "rotate", o * F.cos(a)).otherwise(0.0)
    z = F.when(k == "rotate_forward", o * (1 - F.cos(a)) / 2).otherwise(0.0)
    return d.select("kind", "step", x.alias("ex"), y.alias("ey"), z.alias("ez"))


def tiles(spark: SparkSession, size: int, tile: int, overlap: float) -> DataFrame:
    """(row, col, top, left): square tiles that cover ``size`` pixels, neighbours sharing a part of their edge."""
    step = int(tile * (1 - overlap))
    n = max(1, math.ceil((size - tile) / step) + 1)
    at = lambda c: F.least(F.col(c) * step, F.lit(max(size - tile, 0))).cast("int")
    return spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col")).select("row", "col", at("row").alias("top"), at("col").alias("left"))
