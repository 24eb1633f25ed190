"""Gap analysis, selection and validation of views."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions.text import DIRECTIONS, direction


def gap_directions(spark: SparkSession, masks: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(ordinal, direction, fraction) for all four directions from ``masks(cam_id, azimuth, hole)``; 0 without a view."""
    per_mask = masks.groupBy("cam_id", "azimuth").agg(F.avg(F.col("hole").cast("double")).alias("share"))
    by = per_mask.groupBy(direction(F.col("azimuth")).alias("direction")).agg(F.avg("share").alias("fraction"))
    all_ = spark.createDataFrame(list(enumerate(DIRECTIONS)), "ordinal int, direction string")
    return all_.join(by, "direction", "left").select("ordinal", "direction", F.coalesce("fraction", F.lit(0.0)).alias("fraction"))


def gap_report(spark: SparkSession, masks: DataFrame, threshold: float = 0.05) -> DataFrame:
    """One row: average share, shares by direction, worst direction, recommended ones, and whether gaps are closed."""
    by = gap_directions(spark, masks, threshold)
    average = masks.groupBy("cam_id", "azimuth").agg(F.avg(F.col("hole").cast("double")).alias("share")).agg(F.avg("share").alias("average"))
    ranked = F.sort_array(F.collect_list(F.when(F.col("fraction") >= threshold, F.struct((-F.col("fraction")).alias("s"), "ordinal", "direction"))))
    worst = F.min_by("direction", F.struct(-F.col("fraction"), "ordinal"))
    parts = by.agg(worst.alias("worst"), F.transform(ranked, lambda x: x["direction"]).alias("recommended"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("direction", "fraction")))).alias("by_direction"))
    return parts.join(average).select(F.coalesce("average", F.lit(0.0)).alias("average"), "by_direction", "worst", "recommended", (F.coalesce("average", F.lit(0.0)) < threshold).alias("converged"))


def top_views(views: DataFrame, score: str, id: str, least: float, most: int) -> DataFrame:
    """At least ``least``, best first, ties in order of id, at most ``most``."""
    return views.where(F.col(score) >= least).orderBy(F.desc(score), F.asc(id)).limit(most)


def anchor_indices(views: DataFrame, score: str, id: str, share: float = 0.34) -> DataFrame:
    """The ids of the lowest max(1, min(n - 1, round(share * n))) scores, in order of id."""
    n = F.count("*").over(Window.partitionBy())
    ranked = views.withColumns({"_rank": F.row_number().over(Window.orderBy(score, id)), "_n": n})
    k = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.bround(share * F.col("_n"), 0)))
    return ranked.where(F.col("_rank") <= k).select(id).orderBy(id)


def coverage(masks: DataFrame) -> DataFrame:
    """One row: mean share of cells without hole over views; 1 without views."""
    per = masks.groupBy("cam_id").agg((1.0 - F.avg(F.col("hole").cast("double"))).alias("c"))
    return per.agg(F.coalesce(F.avg("c"), F.lit(1.0)).alias("coverage"))


def anchor_passes(base: Column, current: Column, floor: float = 25.0, most_drop: float = 1.0) -> Column:
    return (current >= floor) & (F.greatest(base - current, F.lit(0.0)) <= most_drop)


def at_scales(df: DataFrame, low: float, high: float, n: int, scale: str = "s") -> DataFrame:
    """Each row at ``n`` scales, evenly spread over the logarithms of ``low`` to ``high``; ValueError unless 0 < low < high."""
    if not 0 < low < high or n < 1:
        raise ValueError(f"no scales from {low} to {high} in {n}")
    a, b = math.log10(low), math.log10(high)
    return df.select("*", F.explode(F.array(*[F.lit(10 ** (a + (b - a) * k / max(n - 1, 1))) for k in range(n)])).alias(scale))


def best_scale(renders: DataFrame, scale: str, a: str, b: str, least: float = 0.3) -> DataFrame:
    """One row: the scale whose renders are closest to the reference by cosine, the first of equal ones; 1 below ``least``."""
    x, y = F.col(a), F.col(b)
    cosine = F.sum(x * y) / F.nullif(F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y)), F.lit(0.0))
    per = renders.groupBy(scale).agg(F.coalesce(cosine, F.lit(0.0)).alias("cosine"))
    best = per.agg(F.max_by(scale, F.struct("cosine", -F.col(scale))).alias("scale"), F.max("cosine").alias("cosine"))
    return best.select(F.when(F.col("cosine") >= least, F.col("scale")).otherwise(1.0).alias("scale"), "cosine")


def weighted_l1(df: DataFrame, a: str, b: str, mask: str, weight: float = 1.0) -> DataFrame:
    m = F.col(mask).cast("double")
    return df.agg(F.coalesce(weight * F.sum(F.abs(F.col(a) - F.col(b)) * m) / F.nullif(F.sum(m), F.lit(0.0)), F.lit(0.0)).alias("loss"))
