"""Robust fits and image metrics as grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.quantiles import quantiles
from skyloom.session import cut


def _fit(by: list[str], df: DataFrame, w: Column, shift: bool) -> DataFrame:
    x, y = F.col("_x"), F.col("_y")
    s = df.groupBy(*by).agg(*[F.sum(c).alias(n) for n, c in {"sw": w, "sx": w * x, "sy": w * y, "sxx": w * x * x, "sxy": w * x * y}.items()])
    c = {n: F.col(n) for n in ("sw", "sx", "sy", "sxx", "sxy")}
    det = c["sxx"] * c["sw"] - c["sx"] * c["sx"]
    if shift:
        a = F.when(det > 0, (c["sw"] * c["sxy"] - c["sx"] * c["sy"]) / F.when(det > 0, det)).otherwise(0.0)
        b = F.when(det > 0, (c["sxx"] * c["sy"] - c["sx"] * c["sxy"]) / F.when(det > 0, det)).otherwise(0.0)
    else:
        a, b = F.coalesce(c["sxy"] / F.nullif(c["sxx"], F.lit(0.0)), F.lit(0.0)), F.lit(0.0)
    return s.select(*by, a.alias("scale"), b.alias("shift"))


def scale_and_shift(df: DataFrame, x: str, y: str, by: list[str], shift: bool = True) -> DataFrame:
    """Least-squares y = scale * x + shift for each group; zeros where the system is singular."""
    return _fit(by, df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")), F.lit(1.0), shift)


def irls(df: DataFrame, x: str, y: str, by: list[str], rounds: int = 10, shift: bool = True, delta_share: float = 0.05) -> DataFrame:
    """Huber fit by reweighting: by, scale, shift, inlier_count, inlier_fraction, residual_median, residual_p95, converged.

    The Huber width is a share of the median of y; inliers lie within it. A fit is accepted with a fifth of inliers
    and a 95th percentile of residuals below a quarter of the median of y; fewer than ten points never are.
    """
    d = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    d = cut(d)
    mid = quantiles(d, "_y", [0.5], by).select(*by, F.col("p")[0].alias("_median"), F.col("n").alias("_n"))
    d = cut(d.join(mid, by))
    fit = _fit(by, d, F.lit(1.0), shift)
    delta = F.greatest(delta_share * F.col("_median"), F.lit(1e-12))
    for k in range(rounds):
        res = F.abs(F.col("scale") * F.col("_x") + F.col("shift") - F.col("_y"))
        w = F.when(res <= delta, 1.0).otherwise(delta / F.greatest(res, F.lit(1e-12)))
        fit = _fit(by, d.join(fit, by).withColumn("_w", w), F.col("_w"), shift)
        fit = cut(fit)  # a row for each group
    out = d.join(fit, by).withColumn("_res", F.abs(F.col("scale") * F.col("_x") + F.col("shift") - F.col("_y")))
    good = F.sum((F.col("_res") <= delta).cast("long"))
    out = cut(out)
    g = out.groupBy(*by, "scale", "shift").agg(good.alias("inlier_count"), (good / F.count("*")).alias("inlier_fraction"), F.max("_n").alias("_n"), F.max("_median").alias("_m"))
    g = g.join(quantiles(out, "_res", [0.5, 0.95], by).select(*by, F.col("p")[0].alias("residual_median"), F.col("p")[1].alias("residual_p95")), by)
    ok = (F.col("_n") >= 10) & (F.col("inlier_fraction") >= 0.2) & (F.col("residual_p95") < 0.25 * F.col("_m"))
    return g.select(*by, "scale", "shift", "inlier_count", "inlier_fraction", "residual_median", "residual_p95", ok.alias("converged"))


def depth_metrics(df: DataFrame, pred: str, truth: str, by: list[str], valid: Column | None = None) -> DataFrame:
    """abs_rel, sq_rel, rmse and delta1 over valid cells."""
    p, t = F.col(pred), F.col(truth)
    d = df.where(valid) if valid is not None else df
    ratio = F.greatest(p / t, t / p)
    return d.groupBy(*by).agg(F.avg(F.abs(p - t) / t).alias("abs_rel"), F.avg((p - t) ** 2 / t).alias("sq_rel"), F.sqrt(F.avg((p - t) ** 2)).alias("rmse"), F.avg((ratio < 1.25).cast("int")).alias("delta1"))


def normal_metrics(df: DataFrame, a: tuple[str, str, str], b: tuple[str, str, str], by: list[str]) -> DataFrame:
    """Angles between unit vectors in degrees: mean, mean square, shares below 5 and 22.5."""
    cosine = sum((F.col(x) * F.col(y) for x, y in zip(a, b)), F.lit(0.0))
    angle = F.degrees(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))))
    d = df.withColumn("_angle", angle)
    return d.groupBy(*by).agg(F.avg("_angle").alias("mean"), F.avg(F.col("_angle") ** 2).alias("mse"), F.avg((F.col("_angle") < 5).cast("int")).alias("delta_5"), F.avg((F.col("_angle") < 22.5).cast("int")).alias("delta_22_5"))


def psnr(mse: Column) -> Column:
    """10 log10(1 / mse), at most 100."""
    return F.when(mse < 1e-10, 100.0).otherwise(10.0 * F.log10(1.0 / F.greatest(mse, F.lit(1e-10))))


def trimmed_median(df: DataFrame, value: str, by: list[str], low: float, high: float, at_least: int = 1) -> DataFrame:
    """(by, median, n): the median of what lies between two percentiles of each group of enough rows.

    The rows are written once and read back, so that a value computed anew, as a sum in another order, is not held
    against a percentile that was itself.
    """
    df = cut(df.select(*by, value))
    p = quantiles(df, value, [low, high], by).select(*by, F.col("p").alias("_p"), "n").where(F.col("n") >= at_least)
    joined = df.join(p, by) if by else df.join(F.broadcast(p))
    kept = joined.where((F.col(value) >= F.col("_p")[0]) & (F.col(value) <= F.col("_p")[1])).drop("_p", "n")
    middle = quantiles(kept, value, [0.5], by).select(*by, F.col("p")[0].alias("median"))
    return middle.join(p.drop("_p"), by) if by else middle.join(F.broadcast(p.drop("_p")))


def minmax(df: DataFrame, value: str, by: list[str], out: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Value between two percentiles of its group, clamped to [0, 1]; 0 where they are equal."""
    p = quantiles(df, value, [low, high], by).select(*by, F.col("p").alias("_p"))
    share = (F.col(value) - F.col("_p")[0]) / F.nullif(F.col("_p")[1] - F.col("_p")[0], F.lit(0.0))
    return df.join(p, by).withColumn(out, F.coalesce(F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)), F.lit(0.0))).drop("_p")
