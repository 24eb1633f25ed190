"""Angles, rays and camera algebra as column expressions.

Two azimuth conventions are kept apart by name: *turn* angles fall from left to right (grid convention) and
*longitudes* grow from left to right (camera convention). ``center`` names the four rules for pixel centres.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi
Vec = tuple[Column, Column, Column]


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, lit(low)), lit(high))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def fraction(i: Column, n: Column, center: str = "half") -> Column:
    """Place of cell i of n: ``half`` (i + .5)/n, ``edge`` i/n, ``span`` i/(n-1)."""
    if center == "half":
        return (i + 0.5) / n
    return i / n if center == "edge" else i / F.greatest(n - 1, F.lit(1))


def turn_angles(u: Column, v: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """(theta, phi) of grid position (u, v) in pixels: theta falls from 2 pi to 0, phi grows from the north pole."""
    return (1.0 - u / w) * (2 * PI), v / h * PI


def turn_ray(theta: Column, phi: Column) -> Vec:
    return F.sin(phi) * F.cos(theta), F.cos(phi), -F.sin(phi) * F.sin(theta)


def lonlat(u: Column, v: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """(longitude, latitude) of pixel position (u, v): zero at the middle of the panorama."""
    return (u / w - 0.5) * (2 * PI), (0.5 - v / h) * PI


def lonlat_ray(lon: Column, lat: Column) -> Vec:
    return F.cos(lat) * F.sin(lon), F.sin(lat), F.cos(lat) * F.cos(lon)


def ray_pixel(x: Column, y: Column, z: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """(u, v) in pixels, centres at whole numbers, where a camera-convention ray meets the panorama."""
    lon, lat = F.atan2(x, z), F.asin(clamp(y / F.nullif(norm(x, y, z), F.lit(0.0)), -1.0, 1.0))
    return (lon / (2 * PI) + 0.5) * w - 0.5, (0.5 - lat / PI) * h - 0.5


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def unit(v: Vec, eps: float = 1e-12) -> Vec:
    n = F.greatest(norm(*v), F.lit(eps))
    return v[0] / n, v[1] / n, v[2] / n


def tangent_frame(ray: Vec) -> tuple[Vec, Vec]:
    """(right, up) of the plane that faces the origin; near the poles z is the reference instead of y."""
    steep = F.abs(ray[1]) > 0.99
    up = (F.lit(0.0), F.when(steep, 0.0).otherwise(1.0), F.when(steep, 1.0).otherwise(0.0))
    inward = (-ray[0], -ray[1], -ray[2])
    right = unit(cross(up, inward))
    return right, cross(inward, right)


def rotate(m: list[Column], v: Vec) -> Vec:
    """A row-major 3x3 matrix times a vector."""
    return tuple(m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3))  # type: ignore[return-value]


def look_at(eye: Vec, target: Vec, up: Vec | None = None) -> tuple[list[Column], Vec]:
    """(rotation, translation) of an OpenCV camera: rows right, -up, forward; t = -R * eye."""
    up = up or (F.lit(0.0), F.lit(1.0), F.lit(0.0))
    forward = unit(tuple(t - e for t, e in zip(target, eye)))  # type: ignore[arg-type]
    right = unit(cross(forward, up))
    true_up = cross(right, forward)
    rows = [*right, *(-c for c in true_up), *forward]
    t = rotate(rows, eye)
    return rows, (-t[0], -t[1], -t[2])


def focal(height, fov_deg) -> Column:
    """Focal length in pixels of a vertical field of view."""
    return lit(height) / (2.0 * F.tan(F.radians(lit(fov_deg)) / 2.0))


def focal_from_mm(w: Column, h: Column, mm: Column) -> Column:
    """Pixels from a focal length on 36 x 24 mm film, by diagonals."""
    return mm * F.sqrt(w * w + h * h) / math.sqrt(36.0**2 + 24.0**2)


def radial_to_z(r: Column, lat: Column, lon: Column) -> Column:
    return r * F.cos(lat) * F.cos(lon)


def z_to_euclidean(z: Column, u: Column, v: Column, fx, fy, cx, cy) -> Column:
    a, b = (u - lit(cx)) / lit(fx), (v - lit(cy)) / lit(fy)
    return z * F.sqrt(a * a + b * b + 1.0)


def cube_face(x: Column, y: Column, z: Column) -> Column:
    """Face that a ray leaves a cube by: 0 +z, 1 +x, 2 -z, 3 -x, 4 +y, 5 -y; ties go to the first."""
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    side = F.when((az >= ax) & (az >= ay), F.when(z >= 0, 0).otherwise(2)).when(ax >= ay, F.when(x >= 0, 1).otherwise(3))
    return F.coalesce(side, F.when(y >= 0, 4).otherwise(5)).cast("int")
