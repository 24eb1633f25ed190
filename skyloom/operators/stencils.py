"""Neighbourhoods of raster cells (v, u): windows along rows and columns, never one over the whole raster."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def along(axis: str, by: tuple[str, ...] = ()) -> Window:
    """Cells of one row in column order (axis u), or of one column in row order (axis v)."""
    return Window.partitionBy(*by, "v" if axis == "u" else "u").orderBy(axis)


def central_difference(value: Column, axis: str, edge: str = "wrap", by: tuple[str, ...] = ()) -> Column:
    """(next - previous) / 2; at the ends across the seam (``wrap``) or one-sided with full step (``one_sided``)."""
    w = along(axis, by)
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    if edge == "wrap":
        return (F.coalesce(after, F.first(value).over(all_)) - F.coalesce(before, F.last(value).over(all_))) / 2
    return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - value).when(after.isNull(), value - before).otherwise((after - before) / 2)


def cyclic_jump(value: Column, axis: str, by: tuple[str, ...] = ()) -> Column:
    """|next - own|; columns go round, the last row has none."""
    w = along(axis, by)
    after = F.lead(value).over(w)
    if axis == "u":
        after = F.coalesce(after, F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return F.abs(after - value)


def separable(df: DataFrame, value: str, out: str, pick: Callable[[Column], Column], radius: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``pick`` (min, max, sum, avg …) over 2 radius + 1 cells of the row, then of the column; windows end at the border."""
    first = df.withColumn("_line", pick(F.col(value)).over(along("u", by).rowsBetween(-radius, radius)))
    return first.withColumn(out, pick(F.col("_line")).over(along("v", by).rowsBetween(-radius, radius))).drop("_line")


def box_means(df: DataFrame, outs: dict[str, str], radius: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Means of several values over the box clipped at the border: all sums along rows, then all along columns."""
    values = [*outs, "_one"]
    df = df.withColumn("_one", F.lit(1))
    for axis in ("u", "v"):
        w = along(axis, by).rowsBetween(-radius, radius)
        df = df.withColumns({f"_s_{c}": F.sum(c if axis == "u" else f"_s_{c}").over(w) for c in values})
    return df.withColumns({out: F.col(f"_s_{c}") / F.col("_s__one") for c, out in outs.items()}).drop("_one", *[f"_s_{c}" for c in values])


def box_sum_mean(df: DataFrame, value: str, out: str, radius: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over the box clipped at the border."""
    return box_means(df, {value: out}, radius, by)


def weighted(df: DataFrame, value: str, out: str, weights: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """Separable blur with symmetric ``weights``; weights beyond the border go to the cells that are there."""
    r = len(weights) // 2

    def blur(c: Column, axis: str) -> Column:
        w = along(axis, by)
        cells = [(F.lag(c, -d) if d < 0 else F.lead(c, d)).over(w) for d in range(-r, r + 1)]
        return sum((F.coalesce(x * k, F.lit(0.0)) for x, k in zip(cells, weights)), F.lit(0.0)) / sum((F.when(x.isNotNull(), F.lit(k)).otherwise(0.0) for x, k in zip(cells, weights)), F.lit(0.0))

    return df.withColumn("_line", blur(F.col(value), "u")).withColumn(out, blur(F.col("_line"), "v")).drop("_line")


def gaussian_weights(radius: int, sigma: float) -> list[float]:
    import math

    w = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def erode(df: DataFrame, mask: str, out: str, radius: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """True where the whole square is true; cells beyond the border count as false."""
    df = separable(df.withColumn("_m", F.col(mask).cast("int")), "_m", "_sum", F.sum, radius, by)
    return df.withColumn(out, F.col("_sum") == (2 * radius + 1) ** 2).drop("_m", "_sum")


def dilate(df: DataFrame, mask: str, out: str, radius: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    df = separable(df.withColumn("_m", F.col(mask).cast("int")), "_m", "_max", F.max, radius, by)
    return df.withColumn(out, F.col("_max") == 1).drop("_m", "_max")


def integral(df: DataFrame, value: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum over all cells above and to the left, own included."""
    run = lambda axis: along(axis, by).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_line", F.sum(value).over(run("u"))).withColumn(out, F.sum("_line").over(run("v"))).drop("_line")


def median(df: DataFrame, value: str, out: str, radius: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the median over the square around each cell, of the cells that are there; null values do not count.

    Values go to the 2 radius + 1 columns around theirs, where a column's windows gather and sort what lies in them: one
    shuffle by cell and one by column, no pairs. Rows that share a cell all count and all come out.
    """
    key = [*by, "v", "u"]
    cells = df.groupBy(*key).agg(F.collect_list(value).alias("_values"), F.collect_list(F.struct(*[c for c in df.columns if c not in key])).alias("_rows"))
    none = F.array().cast(cells.schema["_rows"].dataType)
    spread = cells.select("*", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("_d"))
    lines = spread.groupBy(*by, "v", (F.col("u") + F.col("_d")).alias("u")).agg(F.flatten(F.collect_list("_values")).alias("_line"), F.flatten(F.collect_list(F.when(F.col("_d") == 0, F.col("_rows")).otherwise(none))).alias("_rows"))
    box = lines.withColumn("_box", F.array_sort(F.flatten(F.collect_list("_line").over(along("v", by).rangeBetween(-radius, radius)))))
    n = F.size("_box")
    middle = F.when(n > 0, (F.col("_box")[F.floor((n - 1) / 2).cast("int")] + F.col("_box")[F.floor(n / 2).cast("int")]) / 2)
    return box.select(*key, F.explode("_rows").alias("_row"), middle.alias(out)).select(*[c if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns], out)


def bilinear(points: DataFrame, raster: DataFrame, value: str, out: str, width: int | Column, height: int | Column, keys: list[str]) -> DataFrame:
    """``raster`` at fractional pixel positions (pu, pv): columns go round, rows stop at the border."""
    u0, v0 = F.floor("pu"), F.floor("pv")
    fu, fv = F.col("pu") - u0, F.col("pv") - v0
    w, h = (F.lit(x) if isinstance(x, int) else x for x in (width, height))
    corner = lambda du, dv: F.struct(F.pmod(u0 + du, w).cast("int").alias("u"), F.least(F.greatest(v0 + dv, F.lit(0)), h - 1).cast("int").alias("v"), ((fu if du else 1 - fu) * (fv if dv else 1 - fv)).alias("k"))
    corners = points.select(*keys, F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("c")).select(*keys, "c.u", "c.v", "c.k")
    return corners.join(raster.select("v", "u", F.col(value).alias("_value")), ["v", "u"]).groupBy(*keys).agg(F.sum(F.col("k") * F.col("_value")).alias(out))


def pool(df: DataFrame, value: str, stride: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Minimum, maximum and mean of stride x stride cells."""
    key = [F.floor(F.col(c) / stride).cast("int").alias(c) for c in ("v", "u")]
    return df.groupBy(*by, *key).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))
