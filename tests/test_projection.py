"""Rays meet all the faces that cover them, and few others; faces and back against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import cameras, projection


def axes_of(planes):
    out = {}
    for p in planes.collect():
        f, u = np.array([p.fx, p.fy, p.fz]), np.array([p.ux, p.uy, p.uz])
        f = f / np.linalg.norm(f)
        r = np.cross(u, f) / np.linalg.norm(np.cross(u, f))
        out[p.face] = f, r, np.cross(r, f)
    return out


@pytest.mark.parametrize("kind, edge", [("cube", 0.25), ("icosahedron", 0.25), ("icosahedron", 0.1), ("cube", 0.5)])
def test_no_covering_face_is_missed(spark, kind, edge):
    fov, planes = projection.field(kind), projection.faces(spark, kind)
    r = np.random.default_rng(1).normal(size=(400, 3))
    r = np.concatenate([r, np.eye(3), -np.eye(3), np.sign(r[:50])])
    r /= np.linalg.norm(r, axis=1)[:, None]
    rays = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(r)], "i int, x double, y double, z double")
    met = {(x.i, x.face) for x in projection.covering(rays, cameras.axes(planes), fov, edge).select("i", "face").collect()}
    axes, reach = axes_of(planes), math.tan(math.radians(fov) / 2)
    inside = {(i, k) for k, (f, a, b) in axes.items() for i, p in enumerate(r) if p @ f > 0 and abs(p @ a) <= reach * (p @ f) and abs(p @ b) <= reach * (p @ f)}
    assert inside <= met and len(met) < 0.9 * len(r) * len(axes)
    assert len(axes) == {"cube": 6, "icosahedron": 20}[kind]


def test_back_to_the_panorama_equals_numpy(spark):
    size, h, w, kind = 6, 7, 12, "cube"
    fov, overlap, planes = projection.field(kind), projection.OVERLAP[kind], projection.faces(spark, kind)
    faces = np.random.default_rng(2).uniform(1, 9, (6, size, size))
    values = spark.createDataFrame([(k, i, j, float(faces[k, i, j])) for k, i, j in np.ndindex(faces.shape)], "face int, row int, col int, x double")
    cells = spark.createDataFrame([(v, u) for v in range(h) for u in range(w)], "v int, u int")
    got = {(r.v, r.u): (r.x, r.weight) for r in projection.reproject(values, "x", planes, cells, size, fov, overlap, F.lit(float(w)), F.lit(float(h))).collect()}
    reach, inner = math.tan(math.radians(fov) / 2), 1 / (1 + overlap)
    for v, u in np.ndindex(h, w):
        t, p = (1 - u / (w - 1)) * 2 * math.pi, v / (h - 1) * math.pi
        ray, top, total = np.array([math.sin(p) * math.cos(t), math.cos(p), -math.sin(p) * math.sin(t)]), 0.0, 0.0
        for k, (f, a, b) in axes_of(planes).items():
            d = ray @ f
            x, y = ray @ a / max(d, 0.1) / reach, ray @ b / max(d, 0.1) / reach
            if d > 0.1 and abs(x) <= 1 and abs(y) <= 1:
                edge = min(max((max(abs(x), abs(y)) - inner) / (1 - inner), 0), 1)
                weight = math.exp(-math.acos(min(1, d)) ** 2 / (math.radians(fov) ** 2 / 4)) * math.cos(edge * math.pi / 2) ** 2
                c, r = (x + 1) / 2 * (size - 1), (y + 1) / 2 * (size - 1)
                at = lambda i, j: faces[k, i, j] if i < size and j < size else 0.0  # noqa: B023, E731
                c0, r0 = math.floor(c), math.floor(r)
                top += weight * sum(at(r0 + j, c0 + i) * abs(1 - i - c + c0) * abs(1 - j - r + r0) for i in (0, 1) for j in (0, 1))
                total += weight
        assert got[v, u] == pytest.approx((top / max(total, 1e-6), total), rel=1e-9)


def test_one_value_stays(spark):
    planes = projection.faces(spark, "icosahedron")
    values = planes.select("face", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("col"), F.lit(7.5).alias("x"))
    cells = spark.range(300).select(F.floor(F.col("id") / 20).cast("int").alias("v"), (F.col("id") % 20).cast("int").alias("u"))
    out = projection.reproject(values, "x", planes, cells, 8, projection.field("icosahedron"), 0.3, F.lit(20.0), F.lit(15.0))
    assert out.where("abs(x - 7.5) > 1e-9").count() == 0 and out.count() > 250
