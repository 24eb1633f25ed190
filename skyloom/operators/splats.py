"""From depth rasters to splats, and row-wise maps and filters of splat tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import encoding as E
from skyloom.functions import geometry as G
from skyloom.functions import rotations as R
from skyloom.operators.generators import with_grid
from skyloom.operators.quantiles import quantiles
from skyloom.operators.spatial import knn

COLUMNS = ["splat_id", "x", "y", "z", "sx", "sy", "sz", "qx", "qy", "qz", "qw", "r", "g", "b", "opacity"]


def none(spark: SparkSession) -> DataFrame:
    """The splat table without rows."""
    return spark.createDataFrame([], "splat_id long, " + ", ".join(f"{c} double" for c in COLUMNS[1:]))


def min_neighbours(strength: Column) -> Column:
    """How many near neighbours a splat needs at a pruning strength of 0 to 1."""
    return F.greatest(F.lit(1), (1 + 5 * strength).cast("int"))


def seeded(seeds: DataFrame, log_scale: float = -5.0) -> DataFrame:
    """Stored form of seeds at their opacity: grey, unturned, of one size."""
    grey = {c: F.lit(0.5) for c in "rgb"}
    turn = {"qw": F.lit(1.0), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.lit(0.0)}
    return seeds.withColumns(grey | {"log_scale": F.lit(log_scale)} | turn | {"opacity_logit": E.logit(F.col("opacity"))}).drop("opacity")


def assert_z_depth(df: DataFrame, depth: str, reference: str, by: list[str], most: float = 1.5) -> DataFrame:
    """(by, ratio) of the greatest depths, NaN left out; an error where a ratio says that ``depth`` is radial. A coarse guard."""
    top = lambda c: F.max(F.when(~F.isnan(c), F.col(c)))
    ratios = df.groupBy(*by).agg((top(depth) / (top(reference) + 1e-8)).alias("ratio"))
    return ratios.withColumn("ratio", F.when(F.col("ratio") > most, F.raise_error(F.concat(F.lit("depth is radial, not z: ratio "), F.col("ratio").cast("string"))).cast("double")).otherwise(F.col("ratio")))


def scene_defaults(raster: DataFrame, depth: str = "depth") -> DataFrame:
    """One row: sky_threshold, depth_min, depth_max, orbit, decay_rows base p50, from exact percentiles of valid depths."""
    d = F.when((F.col(depth) > 0.01) & G.finite(F.col(depth)), F.col(depth))
    p = quantiles(raster, d, [0.01, 0.5, 0.95, 0.99])
    at = lambda i: F.col("p")[i]
    few = F.col("n") < 100
    pick = lambda fallback, value: F.when(few, F.lit(fallback)).otherwise(value)
    return p.select(
        "n", pick(80.0, F.greatest(at(2), at(0) + 1.0)).alias("sky_threshold"), pick(0.1, F.greatest(F.lit(0.01), 0.8 * at(0))).alias("depth_min"),
        pick(100.0, 1.1 * at(3)).alias("depth_max"), pick(0.5, F.greatest(F.lit(0.05), 0.05 * at(1))).alias("orbit"),
    )


def uniform(*keys: Column) -> Column:
    """A reproducible number in [0, 1) for a cell: the first 32 bits of the md5 of its keys."""
    text = F.concat_ws(":", *keys)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def pole_density(v: Column, height: Column, floor: float = 0.3) -> Column:
    """Share of cells to keep in a row: falls toward the poles as rows shrink."""
    return G.clamp(F.sin(v / height * math.pi), floor, 1.0)


def is_sky(depth: Column, most: Column, ratio: float = 0.9) -> Column:
    return depth > most * ratio


def candidates(raster: DataFrame, sky_threshold: Column, depth_min: Column, height: Column, depth: str = "depth") -> DataFrame:
    """Cells that become splats: not sky, nearer than the sky threshold, farther than the minimum, kept by pole thinning."""
    d = F.col(depth)
    return raster.where(~is_sky(d, sky_threshold) & (d > depth_min) & (d < sky_threshold) & (uniform(F.col("v"), F.col("u")) < pole_density(F.col("v"), height)))


def from_depth(cells: DataFrame, height: Column, width: Column, stride: int = 1, depth: str = "depth") -> DataFrame:
    """Splats of kept cells: p = depth * ray; scales follow the cell's size on the sphere; opacity 0.9."""
    mid = stride / 2
    g = with_grid(cells, F.col("v") + mid, F.col("u") + mid, height, width)
    d = F.col(depth)
    base = d * (math.pi / height) * stride
    side = base * F.greatest(F.sin("phi"), F.lit(0.05))
    right, up, ray = [tuple(F.col(f"{a}{x}") for x in "xyz") for a in "abr"]
    q = R.from_matrix([c for row in zip(right, up, tuple(-c for c in ray)) for c in row])
    return g.select(
        (F.col("v").cast("long") * width + F.col("u")).cast("long").alias("splat_id"), *[(d * c).alias(a) for a, c in zip("xyz", ray)],
        side.alias("sx"), side.alias("sy"), (base * 0.1).alias("sz"), q[1].alias("qx"), q[2].alias("qy"), q[3].alias("qz"), q[0].alias("qw"),
        *[F.col(c) if c in cells.columns else F.lit(0.5).alias(c) for c in "rgb"], F.lit(0.9).alias("opacity"),
    )


def prune_outliers(splats: DataFrame, strength: float = 0.5, k: int = 16) -> DataFrame:
    """Keeps splats whose mean distance to k neighbours is below mean + (3 - 2.5 strength) deviations of all of them."""
    if strength <= 0 or splats.limit(k + 1).count() < k + 1:
        return splats
    means = knn(splats, k).groupBy("splat_id").agg(F.avg("dist").alias("near"))
    bound = means.agg((F.avg("near") + F.stddev_pop("near") * (3.0 - 2.5 * strength)).alias("bound"))
    kept = means.join(F.broadcast(bound)).where("near < bound").select("splat_id")
    return splats.join(kept, "splat_id", "left_semi")


def prune_sparse(splats: DataFrame, at_least: int = 3, multiple: float = 3.0, k: int = 8) -> DataFrame:
    """Keeps splats with enough of their k nearest within a multiple of their own size."""
    if splats.limit(k + 1).count() < k + 1:
        return splats
    reach = G.clamp(F.greatest("sx", "sy", "sz") * multiple, 0.001, 100.0)
    near = knn(splats, k).join(splats.select("splat_id", reach.alias("reach")), "splat_id").where("dist < reach")
    kept = near.groupBy("splat_id").agg(F.count("*").alias("n")).where(F.col("n") >= at_least).select("splat_id")
    return splats.join(kept, "splat_id", "left_semi")


def denoise(splats: DataFrame, logit: str = "opacity_logit", least: float = 0.05, k: int = 16, sigmas: float = 2.0) -> DataFrame:
    """Drops faint splats, then those whose mean distance to k of the rest exceeds mean + sigmas deviations."""
    solid = splats.where(E.sigmoid(F.col(logit)) >= least)
    if solid.limit(k + 1).count() < k + 1:
        return solid
    means = knn(solid, k).groupBy("splat_id").agg(F.avg("dist").alias("near"))
    bound = means.agg((F.avg("near") + F.stddev_pop("near") * sigmas).alias("bound"))
    kept = means.join(F.broadcast(bound)).where("near <= bound").select("splat_id")
    return solid.join(kept, "splat_id", "left_semi")


def within_view(df: DataFrame, h_deg: float, v_deg: float | None = None) -> DataFrame:
    """In front of the camera and inside the view's borders; from 179 degrees on a border is no limit."""
    keep = F.col("z") > 0
    for axis, deg in (("x", h_deg), ("y", v_deg)):
        if deg is not None and deg < 179:
            keep = keep & (F.abs(axis) <= F.col("z") * math.tan(math.radians(deg) / 2))
    return df.where(keep)


def within_cone(df: DataFrame, half_deg: float) -> DataFrame:
    return df.where((F.col("z") > 0) & (F.col("z") >= G.norm(F.col("x"), F.col("y"), F.col("z")) * math.cos(math.radians(half_deg))))


def reorient(df: DataFrame) -> DataFrame:
    """Half a turn about x: (x, -y, -z), and the same for the quaternion."""
    q = {c: F.col(c) for c in ("qw", "qx", "qy", "qz")}
    return df.withColumns({"y": -F.col("y"), "z": -F.col("z"), "qw": -q["qx"], "qx": q["qw"], "qy": -q["qz"], "qz": q["qy"]})


def scaled(df: DataFrame, factor: Column) -> DataFrame:
    return df.withColumns({c: F.col(c) * factor for c in ("x", "y", "z", "sx", "sy", "sz")})


def transformed(df: DataFrame, m: list[float], t: tuple[float, float, float]) -> DataFrame:
    """Affine map of the means; covariance entries cxx … czz become L C L^T."""
    col = F.col
    c = [[col("cxx"), col("cxy"), col("cxz")], [col("cxy"), col("cyy"), col("cyz")], [col("cxz"), col("cyz"), col("czz")]]
    entry = lambda i, j: sum((F.lit(m[3 * i + a] * m[3 * j + b]) * c[a][b] for a in range(3) for b in range(3)), F.lit(0.0))
    p = [sum((F.lit(m[3 * i + a]) * col(x) for a, x in enumerate("xyz")), F.lit(t[i])) for i in range(3)]
    names = {"cxx": (0, 0), "cxy": (0, 1), "cxz": (0, 2), "cyy": (1, 1), "cyz": (1, 2), "czz": (2, 2)}
    return df.withColumns(dict(zip("xyz", p)) | {n: entry(*ij) for n, ij in names.items()})


def encoded(df: DataFrame) -> DataFrame:
    """Stored form: log scales, logit opacity, spherical-harmonic colour."""
    return df.withColumns({c: E.encode_scale(F.col(c)) for c in ("sx", "sy", "sz")} | {"opacity": E.logit(F.col("opacity"))} | {c: E.rgb_to_sh(F.col(c)) for c in "rgb"})


def decoded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.exp(c) for c in ("sx", "sy", "sz")} | {"opacity": E.sigmoid(F.col("opacity"))} | {c: E.sh_to_rgb(F.col(c)) for c in "rgb"})


#: What becomes of cells of sky.
SKY_MODES = ("skip", "background_sphere", "low_opacity")


def with_sky(splats: DataFrame, sky: DataFrame, height: Column, width: Column, mode: str, depth_max: float = 100.0, sky_radius: float = 200.0, opacity: float = 0.15) -> DataFrame:
    """``splats`` and a flat splat for each cell of ``sky(v, u, splat_id, r, g, b)``, on a sphere around the camera.

    The sphere's radius is ``sky_radius`` (background_sphere) or half as much again as ``depth_max`` (low_opacity); skip
    leaves the splats as they are. Columns that only splats have are null for the sky, those that only the sky has go.
    """
    if mode not in SKY_MODES:
        raise ValueError(f"sky mode {mode!r} is none of {SKY_MODES}")
    if mode == "skip":
        return splats
    r = sky_radius if mode == "background_sphere" else 1.5 * depth_max
    theta, phi = F.col("v") / height * math.pi, F.col("u") / width * (2 * math.pi)
    at = {"x": r * F.sin(theta) * F.cos(phi), "y": r * F.cos(theta), "z": -r * F.sin(theta) * F.sin(phi)}
    flat = {"sx": 0.04 * sky_radius, "sy": 0.04 * sky_radius, "sz": 0.0004 * sky_radius, "qw": 1.0, "qx": 0.0, "qy": 0.0, "qz": 0.0, "opacity": opacity}
    made = sky.withColumns(at | {c: F.lit(v) for c, v in flat.items()})
    return splats.unionByName(made.select(*[c for c in made.columns if c in splats.columns]), allowMissingColumns=True)


def merged(parts: list[DataFrame], order: str = "part") -> DataFrame:
    """Bag union with the ordinal of the part."""
    out = parts[0].withColumn(order, F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn(order, F.lit(i)), allowMissingColumns=True)
    return out


def scale_constants(low: float, high: float) -> tuple[float, float]:
    """Slope and offset that make the scale's sigmoid 1 with slope 1 at a change of 0."""
    share = (1 - low) / (high - low)
    return (high - low) / (1 - low) / (high - 1), math.log(share / (1 - share))


def composed(df: DataFrame, factor: dict[str, float], low: float = 0.0, high: float = 10.0) -> DataFrame:
    """Base values and predicted changes as splats: z by a softplus of the disparity, sizes, colours and opacity by sigmoids.

    Bases: x_ndc, y_ndc, disparity, size, qw..qz, r, g, b, opacity; changes have the same names with a leading d_ (d_z for
    the disparity). ``factor`` weighs the changes of xy, z, scale, quaternion, color, opacity.
    """
    c, d = F.col, lambda n, kind: F.col(f"d_{n}") * factor[kind]
    z = 1.0 / (E.softplus(E.inverse_softplus(c("disparity")) + d("z", "z")) + 1e-3)
    slope, offset = scale_constants(low, high)
    size = c("size") * ((high - low) * E.sigmoid(slope * d("size", "scale") + offset) + low)
    bound = {n: G.clamp(c(n), 0.01, 0.99) for n in "rgb"}
    colours = {n: E.sigmoid(F.ln(x / (1 - x)) + d(n, "color")) for n, x in bound.items()}
    opacity = E.sigmoid(F.ln(c("opacity") / (1 - c("opacity"))) + d("opacity", "opacity"))
    turn = {q: c(q) + d(q, "quaternion") for q in ("qw", "qx", "qy", "qz")}
    return df.withColumns({"z": z, "x": z * (c("x_ndc") + d("x", "xy")), "y": z * (c("y_ndc") + d("y", "xy")), "size": size} | turn | colours | {"opacity": opacity})


def metric_depth(raw: Column, log_depth: bool, least: float, most: float, scale: Column, ray_factor: Column, sky: Column) -> Column:
    """A depth head's output in metres along the ray: bounded, out of its logarithm, scaled, from z to distance, and
    blended in the logarithm towards the greatest depth where ``sky`` (0 to 1) says so."""
    bounded = F.exp(G.clamp(raw, math.log(least), math.log(most))) if log_depth else G.clamp(raw, least, most)
    distance = bounded * scale * ray_factor
    return F.exp((1.0 - sky) * F.ln(F.greatest(distance, F.lit(1e-6))) + sky * F.ln(most * scale))
