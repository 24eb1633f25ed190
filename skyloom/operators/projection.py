"""Panoramas on planes that touch the sphere, and back: each ray meets the few faces whose field covers it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions import geometry as G
from skyloom.operators import cameras, generators
from skyloom.session import cut

#: Directions and ups of the six faces of a cube.
CUBE = (((1, 0, 0), (0, 1, 0)), ((-1, 0, 0), (0, 1, 0)), ((0, 1, 0), (0, 0, -1)), ((0, -1, 0), (0, 0, 1)), ((0, 0, 1), (0, 1, 0)), ((0, 0, -1), (0, 1, 0)))
#: Overlap of neighbouring faces, as a share of their field, by kind.
OVERLAP = {"cube": 0.55, "icosahedron": 0.3}
#: Edge of the buckets of directions, in a cube around the unit sphere.
EDGE = 0.25

_DIRECTION = "face int, fx double, fy double, fz double, ux double, uy double, uz double"


def field(kind: str, overlap: float | None = None) -> float:
    """Field of view of a face in degrees, overlap included."""
    base = math.pi / 2 if kind == "cube" else 2 * math.atan(1 / math.sqrt(5))
    return math.degrees(base * (1 + (OVERLAP[kind] if overlap is None else overlap)))


def faces(spark: SparkSession, kind: str) -> DataFrame:
    """(face, fx..fz, ux..uz): six faces of a cube, or the twenty of an icosahedron from low z, y, x to high."""
    if kind == "cube":
        return spark.createDataFrame([(k, *map(float, d), *map(float, u)) for k, (d, u) in enumerate(CUBE)], _DIRECTION)
    order = Window.orderBy(*[F.round(c, 6) for c in ("cz", "cy", "cx")])  # twenty rows
    up = [F.lit(float(k)).alias(c) for c, k in (("ux", 0), ("uy", 1), ("uz", 0))]
    return generators.icosahedral_faces(spark).select((F.row_number().over(order) - 1).alias("face"), *[F.col(f"c{a}").alias(f"f{a}") for a in "xyz"], *up)


def project(raster: DataFrame, value: str, planes: DataFrame, size: int, fov: float, width: int, height: Column) -> DataFrame:
    """(face, row, col, value): a panorama on each plane."""
    return cameras.tangent_faces(planes, raster, value, size, fov, width, height)


def covering(rays: DataFrame, planes: DataFrame, fov: float, edge: float = EDGE) -> DataFrame:
    """``rays(x, y, z, ...)``, unit ones, with each plane of ``cameras.axes`` whose field may cover them.

    Rays and planes meet in buckets of directions. A plane is in the buckets that a cone around its field touches, so
    none is missed and few are tried in vain. The table of planes and buckets is as long as the planes are many, at some
    hundred buckets each, and is broadcast only if they are a thousand at most.
    """
    cone = math.atan(math.sqrt(2) * math.tan(math.radians(fov) / 2))  # to a corner
    slack = math.asin(min(1.0, edge * math.sqrt(3) / 2 / (1 - edge * math.sqrt(3) / 2)))  # half a bucket, seen from the centre
    n = math.ceil(1 / edge)
    steps = F.sequence(F.lit(-n), F.lit(n))
    b = planes
    for a in "xyz":
        b = b.withColumn(f"b{a}", F.explode(steps))
    middle = tuple((F.col(f"b{a}") + 0.5) * edge for a in "xyz")
    b = b.where(F.abs(G.norm(*middle) - 1) <= edge * math.sqrt(3) / 2 + 1e-9)
    b = b.where(G.dot(middle, tuple(F.col(f"f.{a}") for a in "xyz")) / G.norm(*middle) >= math.cos(min(math.pi, cone + slack + 1e-6)))
    if planes.limit(1001).count() <= 1000:
        b = F.broadcast(b)
    keys = [f"b{a}" for a in "xyz"]
    return rays.withColumns({f"b{a}": F.floor(F.col(a) / edge).cast("int") for a in "xyz"}).join(b, keys).drop(*keys)


def reproject(values: DataFrame, value: str, planes: DataFrame, cells: DataFrame, size: int, fov: float, overlap: float, width: Column, height: Column) -> DataFrame:
    """(v, u, value, weight) at ``cells(v, u)`` of a panorama: the mean over the faces that cover a cell, each bilinear.

    Weights are those of ``cameras.face_weight``; pixels that a face lacks count as zero. Cells that no face covers have
    no row. A cell meets only faces of its bucket, and the four pixels of each by an equi-join.
    """
    one = F.lit(1.0)
    ray = G.turn_ray(*G.turn_angles(G.fraction(F.col("u"), width, "span"), G.fraction(F.col("v"), height, "span"), one, one))
    met = covering(cells.select("v", "u", *[c.alias(a) for c, a in zip(ray, "xyz", strict=True)]), cut(cameras.axes(planes)), fov)
    a, b, w = cameras.axes_weight(*[tuple(F.col(f"{n}{c}") for c in "xyz") for n in ("", "f.", "r.", "a.")], fov, overlap)
    met = met.select("v", "u", "face", ((a + 1) / 2 * (size - 1)).alias("pc"), ((b + 1) / 2 * (size - 1)).alias("pr"), w.alias("w")).where("w > 0")
    c0, r0 = F.floor("pc"), F.floor("pr")
    near = lambda p, p0, d: p - p0 if d else 1 - p + p0
    corner = lambda i, j: F.struct((c0 + i).cast("int").alias("col"), (r0 + j).cast("int").alias("row"), (near(F.col("pc"), c0, i) * near(F.col("pr"), r0, j)).alias("k"))
    asks = met.select("v", "u", "face", "w", F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])).alias("c")).select("v", "u", "face", "w", "c.col", "c.row", "c.k")
    found = asks.join(values.select("face", "row", "col", F.col(value).alias("_value")), ["face", "row", "col"], "left")
    k = F.col("w") * F.col("k")
    sums = found.groupBy("v", "u").agg(F.sum(k * F.coalesce("_value", F.lit(0.0))).alias("_s"), F.sum(k).alias("weight"))
    return sums.select("v", "u", (F.col("_s") / F.greatest("weight", F.lit(1e-6))).alias(value), "weight")
