"""Masks, filters and resampling of rasters, and lookups between splats and rasters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.quantiles import combined, quantiles
from skyloom.session import cut as lineage_cut
from skyloom.functions import geometry as G
from skyloom.operators import stencils as S


def sky_by_gradient(raster: DataFrame, most: float, ratio: float = 0.7, gradient_pct: float = 0.3, radius: int = 16, variance_pct: float = 0.2) -> DataFrame:
    """Adds ``sky``: far cells whose depth gradient is among the lowest of far cells and whose surroundings vary little."""
    d = raster.withColumns({"gu": S.central_difference(F.col("depth"), "u", "one_sided"), "gv": S.central_difference(F.col("depth"), "v", "one_sided"), "d2": F.col("depth") * F.col("depth")})
    d = d.withColumn("gradient", F.sqrt(F.col("gu") ** 2 + F.col("gv") ** 2))
    d = S.box_means(d, {"depth": "m1", "d2": "m2"}, radius)
    d = d.withColumns({"variance": F.greatest(F.col("m2") - F.col("m1") ** 2, F.lit(0.0)), "far": F.col("depth") > most * ratio})
    d = lineage_cut(d)
    far = d.where("far")
    cut = combined([quantiles(far, c, [p]).select(F.col("p")[0].alias(n)) for c, p, n in (("gradient", gradient_pct, "g"), ("variance", variance_pct, "s"))])
    out = d.join(F.broadcast(cut)).withColumn("sky", F.coalesce(F.col("far") & (F.col("gradient") < F.col("g")) & (F.col("variance") < F.col("s")), F.lit(False)))
    return out.select(*raster.columns, "sky")


def sky_hsv(r: Column, g: Column, b: Column, v: Column, height: Column) -> Column:
    """Bright, unsaturated and in the upper half."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    saturation = F.when(high > 0, (high - low) / F.when(high > 0, high)).otherwise(0.0)
    return (high > 0.75) & (saturation < 0.25) & (v < height / 2)


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def specular(df: DataFrame, value: str, out: str = "specular", size: int = 9) -> DataFrame:
    """Bright and close to its own blur."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    d = S.weighted(df, value, "_blur", S.gaussian_weights(size // 2, sigma))
    return d.withColumn(out, (F.col(value) > 0.85) & (F.abs(F.col(value) - F.col("_blur")) < 0.02)).drop("_blur")


def validity(df: DataFrame, far: float, out: str = "valid") -> DataFrame:
    """Opaque, near, neither sky nor glare, no steep relative gradient, and so in the whole 3 x 3 square.

    Reads alpha, depth, sky and specular.
    """
    d = df.withColumns({"_gu": S.central_difference(F.col("depth"), "u", "one_sided"), "_gv": S.central_difference(F.col("depth"), "v", "one_sided")})
    steep = F.sqrt(F.col("_gu") ** 2 + F.col("_gv") ** 2) / F.greatest(F.col("depth"), F.lit(1e-6))
    d = d.withColumn("_ok", (F.col("alpha") >= 0.9) & (F.col("depth") < 0.95 * far) & ~F.col("sky") & ~F.col("specular") & (steep < 0.15))
    return S.erode(d, "_ok", out).drop("_gu", "_gv", "_ok")


def edge_mask(raster: DataFrame, absolute: float = 0.1, relative: float = 0.1) -> DataFrame:
    """Adds ``keep``: false for both cells of a neighbouring pair whose depths jump in both senses."""
    d = F.col("depth")

    def jump(axis: str, shift: int) -> Column:
        other = (F.lead(d, 1) if shift > 0 else F.lag(d, 1)).over(S.along(axis))
        gap = F.abs(other - d)
        return F.coalesce((gap > absolute) & (gap > relative * F.least(other, d)), F.lit(False))

    bad = jump("u", 1) | jump("u", -1) | jump("v", 1) | jump("v", -1)
    return raster.withColumn("keep", ~bad)


def pixel_of(x: Column, y: Column, z: Column, width: Column, height: Column, mirrored: bool = False) -> tuple[Column, Column]:
    """(v, u) of the cell that a splat in the grid convention came from; ``mirrored`` keeps the azimuth as it is."""
    theta = F.pmod(F.atan2(-z, x), F.lit(2 * math.pi))
    share = theta / (2 * math.pi)
    share = share if mirrored else 1.0 - share
    r = G.norm(x, y, z)
    phi = F.acos(G.clamp(y / F.greatest(r, F.lit(1e-12)), -1.0, 1.0))
    u = F.pmod(F.floor(share * width).cast("int"), width.cast("int"))
    return G.clamp(F.floor(phi / math.pi * height).cast("int"), 0, height.cast("int") - 1).cast("int"), u.cast("int")


def prune_grazing(splats: DataFrame, raster: DataFrame, width: Column, height: Column, max_deg: float = 80.0, stride: int = 1, mirrored: bool = False) -> DataFrame:
    """Keeps splats whose relative depth gradient at their cell is below tan(angle) * pi / H * stride; both axes wrap."""
    g = raster.select("v", "u", (F.sqrt(S.central_difference(F.col("depth"), "u") ** 2 + S.central_difference(F.col("depth"), "v") ** 2) / F.greatest(F.col("depth"), F.lit(1e-6))).alias("_slope"))
    v, u = pixel_of(F.col("x"), F.col("y"), F.col("z"), width, height, mirrored)
    limit = math.tan(math.radians(max_deg)) * math.pi * stride / height
    return splats.withColumns({"v": v, "u": u}).join(g, ["v", "u"]).where(F.col("_slope") < limit).select(splats.columns)


def hole_mode(alpha: Column, candidate: Column, rendered: Column, scale: Column, margin: float = 0.02) -> Column:
    """``alpha`` below 0.3, ``disoccl`` below 0.9 where nearer than what is rendered, else null."""
    return F.when(alpha < 0.3, "alpha").when((alpha < 0.9) & nearer(candidate, rendered, scale, margin), "disoccl")


def nearer(candidate: Column, rendered: Column, scale: Column, margin: float = 0.02) -> Column:
    return candidate < rendered - margin * scale


def z_buffer(points: DataFrame, keys: list[str], depth: str, values: list[str], order: str) -> DataFrame:
    """The nearest point of each cell, of equally near ones the first by ``order``, and how many hit it.

    A coverage approximation of rendering, not alpha compositing.
    """
    best = F.min_by(F.struct(*values), F.struct(depth, order)).alias("_best")
    return points.groupBy(*keys).agg(best, F.min(depth).alias("depth"), F.count("*").alias("hits")).select(*keys, "depth", "hits", *[F.col(f"_best.{c}").alias(c) for c in values])


def weighted_scatter(points: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean and number of samples of each cell."""
    total = F.sum(weight)
    return points.groupBy(*keys).agg((F.sum(F.col(weight) * F.col(value)) / F.nullif(total, F.lit(0.0))).alias("value"), F.count("*").alias("samples"))


def unproject(df: DataFrame, width: Column, height: Column, z: str, least: float = 0.01, pose: list[list[Column]] | None = None) -> DataFrame:
    """Points of z-depths along camera rays through pixel corners: ray * (z / ray_z), where z exceeds ``least``.

    ``pose`` has the three rows (rotation, translation) that take the camera to the world; without it they stay there.
    """
    lon, lat = G.lonlat(F.col("u"), F.col("v"), width, height)
    ray = G.lonlat_ray(lon, lat)
    k = F.col(z) / (ray[2] + 1e-8)
    points = df.where(F.col(z) > least).withColumns({"x": ray[0] * k, "y": ray[1] * k, "z": ray[2] * k})
    if pose is None:
        return points
    return points.withColumns({a: row[0] * F.col("x") + row[1] * F.col("y") + row[2] * F.col("z") + row[3] for a, row in zip("xyz", pose, strict=True)})


def perspective_rays(size: int, fov_deg: float, yaw_deg: Column, pitch_deg: Column, i: Column, j: Column) -> G.Vec:
    """Camera-convention ray through pixel (row i, column j) of a square view."""
    f = size / 2 / math.tan(math.radians(fov_deg) / 2)
    x, y, z = (j + 0.5 - size / 2) / f, -(i + 0.5 - size / 2) / f, F.lit(1.0)
    p, w = F.radians(pitch_deg), F.radians(yaw_deg)
    y, z = y * F.cos(p) + z * F.sin(p), z * F.cos(p) - y * F.sin(p)
    return x * F.cos(w) + z * F.sin(w), y, z * F.cos(w) - x * F.sin(w)


def perspective_view(views: DataFrame, raster: DataFrame, value: str, size: int, fov_deg: float, width: int | Column, height: int | Column, key: str = "view_id") -> DataFrame:
    """(key, row, col, value): ``raster`` sampled bilinearly through views with yaw_deg and pitch_deg."""
    d = F.sequence(F.lit(0), F.lit(size - 1))
    px = views.select(key, "yaw_deg", "pitch_deg", F.explode(d).alias("row")).select("*", F.explode(d).alias("col"))
    w, h = (F.lit(x) if isinstance(x, int) else x for x in (width, height))
    pu, pv = G.ray_pixel(*perspective_rays(size, fov_deg, F.col("yaw_deg"), F.col("pitch_deg"), F.col("row"), F.col("col")), w, h)
    return S.bilinear(px.withColumns({"pu": pu, "pv": pv}), raster, value, value, w, h, [key, "row", "col"])


def column_bands(views: DataFrame, share: str, azimuth: str, width: int, least: float = 0.03) -> DataFrame:
    """(u): columns within 45 degrees of a view whose share of holes is large enough; bands go round the seam."""
    a = F.col(azimuth)
    start, end = ((a - 45.0) / 360.0 * width).cast("int"), ((a + 45.0) / 360.0 * width).cast("int")
    span = views.where(F.col(share) >= least).select(F.explode(F.sequence(start, end - 1)).alias("u"))
    return span.select(F.pmod("u", F.lit(width)).cast("int").alias("u")).distinct()
