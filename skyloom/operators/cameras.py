"""Pinhole cameras, homogeneous coordinates, cube maps and tangent planes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import geometry as G
from skyloom.operators import rasters as R
from skyloom.operators import stencils as S
from skyloom.session import cut

#: Yaw and pitch of the faces of a cube, in the numbering of ``geometry.cube_face``.
CUBE = ((0.0, 0.0), (90.0, 0.0), (180.0, 0.0), (270.0, 0.0), (0.0, 90.0), (0.0, -90.0))


def unprojection(extrinsic: np.ndarray, intrinsic: np.ndarray, width: int, height: int) -> np.ndarray:
    """The 4x4 matrix from device coordinates (-1 to 1 across the image) to the world."""
    device = np.array([[2 / width, 0, -1, 0], [0, 2 / height, -1, 0], [0, 0, 1, 0], [0, 0, 0, 1]], np.float64)
    return np.linalg.inv(device @ intrinsic @ extrinsic)


def moved(df: DataFrame, m: np.ndarray) -> DataFrame:
    """Points under the upper three rows of an affine matrix."""
    row = lambda i: sum((F.lit(float(m[i, j])) * F.col(a) for j, a in enumerate("xyz")), F.lit(float(m[i, 3])))
    return df.withColumns({a: row(i) for i, a in enumerate("xyz")})


def rigid_inverse(rotation: list[Column], t: G.Vec) -> tuple[list[Column], G.Vec]:
    """The inverse of a rotation (row-major) followed by a translation."""
    back = [rotation[3 * j + i] for i in range(3) for j in range(3)]
    x, y, z = G.rotate(back, t)
    return back, (-x, -y, -z)


def field_of_view(focal: Column, size: Column) -> Column:
    """In degrees."""
    return F.degrees(2.0 * F.atan(size / (2.0 * focal)))


def pixel_ray(u: Column, v: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> G.Vec:
    """Camera coordinates of a pixel at depth 1."""
    return (u - cx) / fx, (v - cy) / fy, F.lit(1.0)


def to_pixel(p: G.Vec, fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """Pixel of a point in camera coordinates; null at depth 0."""
    z = F.nullif(p[2], F.lit(0.0))
    return fx * p[0] / z + cx, fy * p[1] / z + cy


def dehomogenised(x: Column, y: Column, z: Column, w: Column) -> G.Vec:
    n = F.nullif(w, F.lit(0.0))
    return x / n, y / n, z / n


def largest_offset(near: Column, width: int, height: int, focal: float, disparity: float, zoom: float) -> tuple[Column, Column]:
    """(sideways, forward): how far a camera may move with the scene's nearest depth at ``near``."""
    diagonal = math.hypot(width / focal, height / focal)
    return disparity * diagonal * near, zoom * near


def screen_size(width: Column, height: Column) -> tuple[Column, Column]:
    """Halved above 3,000 rows, then made even."""
    half = lambda c: F.when(height > 3000, F.floor(c / 2)).otherwise(c)
    even = lambda c: (c + c % 2).cast("int")
    return even(half(width)), even(half(height))


#: The colour map "jet": where each channel bends, as (position, value).
JET = {
    "r": ((0.0, 0.0), (0.35, 0.0), (0.66, 1.0), (0.89, 1.0), (1.0, 0.5)),
    "g": ((0.0, 0.0), (0.125, 0.0), (0.375, 1.0), (0.64, 1.0), (0.91, 0.0), (1.0, 0.0)),
    "b": ((0.0, 0.5), (0.11, 1.0), (0.34, 1.0), (0.65, 0.0), (1.0, 0.0)),
}


def colourise(value: Column, low: float, high: float, bends: dict[str, tuple] = JET) -> dict[str, Column]:
    """Bytes r, g, b of a value between ``low`` and ``high`` on a map of straight pieces, in 256 steps."""
    share = G.clamp((value - low) / (high - low), 0.0, 1.0)
    x = F.least(F.floor(share * 256), F.lit(255)) / 255.0

    def channel(points: tuple) -> Column:
        out = F.lit(points[-1][1])
        for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
            out = F.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
        return F.floor(G.clamp(out, 0.0, 1.0) * 255 + 1e-9).cast("int")

    return {c: channel(p) for c, p in bends.items()}


def base_layers(raster: DataFrame, stride: int, width: Column, height: Column, layers: int = 1, scale: float = 1.0, depth: str = "depth") -> DataFrame:
    """(layer, v, u, x_ndc, y_ndc, disparity, size, opacity): one start splat for each stride x stride cells and layer.

    The first layer lies on the nearest depth of its cells, further ones at evenly falling disparities of it.
    """
    cells = raster.where(F.col(depth) > 0).groupBy(F.floor(F.col("v") / stride).cast("int").alias("v"), F.floor(F.col("u") / stride).cast("int").alias("u")).agg(F.max(1 / F.col(depth)).alias("near"))
    each = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(layers - 1))).alias("layer"))
    disparity = F.col("near") * (1 - F.col("layer") / layers)
    ndc = lambda i, n: 2 * (F.col(i) * stride + 0.5 * stride) / n - 1.0
    return each.select("layer", "v", "u", ndc("u", width).alias("x_ndc"), ndc("v", height).alias("y_ndc"), disparity.alias("disparity"), (2 * scale * stride / width / disparity).alias("size"), F.lit(min(1.0 / layers, 0.5)).alias("opacity"))


def to_cube(spark, raster: DataFrame, value: str, size: int, width: Column, height: Column) -> DataFrame:
    """(face, row, col, value): the six 90 degree faces of a panorama."""
    views = spark.createDataFrame([(k, yaw, pitch) for k, (yaw, pitch) in enumerate(CUBE)], "face int, yaw_deg double, pitch_deg double")
    return R.perspective_view(views, raster, value, size, 90.0, width, height, "face")


def cropped(faces: DataFrame, size: int, fov_deg: float) -> tuple[DataFrame, int]:
    """Faces wider than 90 degrees without their overlap, and their size."""
    if fov_deg <= 90:
        return faces, size
    crop = round(size / math.tan(math.radians(fov_deg / 2)))
    start = (size - crop) // 2
    inside = (F.col("row") >= start) & (F.col("row") < start + crop) & (F.col("col") >= start) & (F.col("col") < start + crop)
    return faces.where(inside).withColumns({"row": F.col("row") - start, "col": F.col("col") - start}), crop


def from_cube(faces: DataFrame, cells: DataFrame, value: str, size: int, width: Column, height: Column) -> DataFrame:
    """(v, u, value) at ``cells(v, u)`` of a panorama, bilinear within the face that a cell's ray meets, clamped at its border."""
    lon, lat = G.lonlat(F.col("u") + 0.5, F.col("v") + 0.5, width, height)
    d = cells.select("v", "u", *[c.alias(a) for c, a in zip(G.lonlat_ray(lon, lat), "xyz")])
    d = d.withColumn("face", G.cube_face(F.col("x"), F.col("y"), F.col("z")))
    x, y, z = (F.col(a) for a in "xyz")
    side = {0: (x, y, z), 1: (-z, y, x), 2: (-x, y, -z), 3: (z, y, -x), 4: (x, -z, y), 5: (x, z, -y)}
    pick = lambda k: F.coalesce(*[F.when(F.col("face") == f, s[k]) for f, s in side.items()])
    right, up, ahead = (pick(k) for k in range(3))
    half = size / 2
    d = d.select("v", "u", "face", G.clamp(right / ahead * half + half - 0.5, 0.0, size - 1.0).alias("pc"), G.clamp(-up / ahead * half + half - 0.5, 0.0, size - 1.0).alias("pr"))
    c0, r0 = F.floor("pc"), F.floor("pr")
    corner = lambda a, b: F.struct(F.least(c0 + a, F.lit(size - 1)).cast("int").alias("col"), F.least(r0 + b, F.lit(size - 1)).cast("int").alias("row"), ((F.col("pc") - c0 if a else 1 - F.col("pc") + c0) * (F.col("pr") - r0 if b else 1 - F.col("pr") + r0)).alias("k"))
    corners = d.select("v", "u", "face", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("c")).select("v", "u", "face", "c.col", "c.row", "c.k")
    return corners.join(faces.select("face", "row", "col", F.col(value).alias("_value")), ["face", "row", "col"]).groupBy("v", "u").agg(F.sum(F.col("k") * F.col("_value")).alias(value))


def axes(planes: DataFrame, key: str = "face") -> DataFrame:
    """(key, f, r, a): unit axes ahead, right and above of each plane, made once for each and not for each ray."""
    ahead = planes.select(key, F.struct(*[c.alias(n) for c, n in zip(G.unit(tuple(F.col(f"f{a}") for a in "xyz")), "xyz", strict=True)]).alias("f"), *[f"u{a}" for a in "xyz"])
    f = tuple(F.col(f"f.{a}") for a in "xyz")
    right = ahead.select(key, "f", F.struct(*[c.alias(n) for c, n in zip(G.unit(G.cross(tuple(F.col(f"u{a}") for a in "xyz"), f)), "xyz", strict=True)]).alias("r"))
    above = G.cross(tuple(F.col(f"r.{a}") for a in "xyz"), f)
    return right.select(key, "f", "r", F.struct(*[c.alias(n) for c, n in zip(above, "xyz", strict=True)]).alias("a"))


def tangent_faces(planes: DataFrame, raster: DataFrame, value: str, size: int, fov_deg: float, width: int, height: Column, key: str = "face") -> DataFrame:
    """(key, row, col, value) on planes that touch the sphere at ``planes(key, fx..fz, ux..uz)``: gnomonic, corner to corner.

    The grid's convention holds: azimuth from +x towards -z, columns clamped at the seam, as a border-padded sampler does.
    """
    reach = math.tan(math.radians(fov_deg) / 2)
    d = F.sequence(F.lit(0), F.lit(size - 1))
    px = cut(axes(planes, key)).select("*", F.explode(d).alias("row")).select("*", F.explode(d).alias("col"))
    at = lambda c: -reach + F.col(c) * (2 * reach / max(size - 1, 1))
    px = px.select(key, "row", "col", *[(F.col(f"f.{c}") + at("col") * F.col(f"r.{c}") + at("row") * F.col(f"a.{c}")).alias(f"_{c}") for c in "xyz"])
    x, y, z = (F.col(f"_{c}") for c in "xyz")
    y = y / G.norm(x, y, z)
    theta = F.pmod(F.atan2(-z, x), F.lit(2 * math.pi))
    pu = (1.0 - theta / math.pi + 1) / 2 * (width - 1)
    pv = F.acos(G.clamp(y, -1.0, 1.0)) / math.pi * (height - 1)
    return S.bilinear(px.withColumns({"pu": G.clamp(pu, 0.0, width - 1.0), "pv": pv}), raster, value, value, width, height, [key, "row", "col"])


def interpolated(points: DataFrame, grid: DataFrame, value: str, columns: int, rows: int, by: list[str], keys: list[str]) -> DataFrame:
    """``grid(by, cy, cx, value)`` at grid positions (gx, gy) of ``points``: bilinear between cell centres, clamped."""
    x0 = G.clamp(F.floor("gx"), 0, columns - 1)
    y0 = G.clamp(F.floor("gy"), 0, rows - 1)
    wx, wy = (G.clamp(F.col(c) - o, 0.0, 1.0) for c, o in (("gx", x0), ("gy", y0)))
    corner = lambda a, b: F.struct(F.least(x0 + a, F.lit(columns - 1)).cast("int").alias("cx"), F.least(y0 + b, F.lit(rows - 1)).cast("int").alias("cy"), ((wx if a else 1 - wx) * (wy if b else 1 - wy)).alias("k"))
    corners = points.select(*by, *keys, F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("c")).select(*by, *keys, "c.cx", "c.cy", "c.k")
    return corners.join(grid, [*by, "cy", "cx"]).groupBy(*by, *keys).agg(F.sum(F.col("k") * F.col(value)).alias(value))


def face_weight(ray: G.Vec, ahead: G.Vec, up: G.Vec, fov_deg: float, overlap: float = 0.25) -> tuple[Column, Column, Column]:
    """(place right, place up, weight) of a ray on a face: a Gaussian of the angle to its centre times a squared cosine
    that falls from the face proper to the end of its overlap; 0 behind and outside."""
    forward = G.unit(ahead)
    right = G.unit(G.cross(up, forward))
    return axes_weight(ray, forward, right, G.cross(right, forward), fov_deg, overlap)


def axes_weight(ray: G.Vec, forward: G.Vec, right: G.Vec, above: G.Vec, fov_deg: float, overlap: float = 0.25) -> tuple[Column, Column, Column]:
    """``face_weight`` by the unit axes of a face."""
    along = G.dot(ray, forward)
    reach, fov = math.tan(math.radians(fov_deg) / 2), math.radians(fov_deg)
    a, b = (G.dot(ray, side) / F.greatest(along, F.lit(0.1)) / reach for side in (right, above))
    inner = 1.0 / (1.0 + overlap)
    edge = G.clamp((F.greatest(F.abs(a), F.abs(b)) - inner) / max(1 - inner, 1e-6), 0.0, 1.0)
    angle = F.acos(G.clamp(along, -1.0, 1.0))
    seen = (along > 0.1) & (F.abs(a) <= 1) & (F.abs(b) <= 1)
    return a, b, F.when(seen, F.exp(-(angle**2) / (fov**2 / 4)) * F.cos(edge * (math.pi / 2)) ** 2).otherwise(0.0)
