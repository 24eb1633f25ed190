"""Image pyramids as tables: levels are blurred and halved by windows, and grown again by a join of pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.stencils import along, gaussian_weights
from skyloom.session import cut


def _mirrored(c: Column, axis: str, by: tuple[str, ...], kernel: list[float]) -> Column:
    """Five weights along an axis; places beyond an end are mirrored at the last cell, which counts once."""
    w = along(axis, by)
    at = lambda d: F.lag(c, -d).over(w) if d < 0 else F.lead(c, d).over(w)
    before, after = at(-1), at(1)
    # two before the first but one is itself, before the first the third; a row of two or of one stays inside
    second = lambda here, one, there: F.coalesce(here, F.when(one.isNotNull(), c), there, c)
    parts = [second(at(-2), before, at(2)), F.coalesce(before, after, c), c, F.coalesce(after, before, c), second(at(2), after, at(-2))]
    return sum((p * k for p, k in zip(parts, kernel, strict=True)), F.lit(0.0))


def blurred(df: DataFrame, values: list[str], by: tuple[str, ...] = (), sigma: float = 1.0) -> DataFrame:
    """Values after a Gaussian of five taps along rows, then columns."""
    kernel = gaussian_weights(2, sigma)
    for axis in ("u", "v"):
        df = df.withColumns({c: _mirrored(F.col(c), axis, by, kernel) for c in values})
    return df


def halved(df: DataFrame, values: list[str], by: tuple[str, ...] = (), sigma: float = 1.0) -> DataFrame:
    """The next level of rows (by, h, w, v, u, values): blurred, then every second cell of every second row."""
    even = blurred(df, values, by, sigma).where("v % 2 = 0 and u % 2 = 0")
    half = {c: F.floor(F.col(c) / 2).cast("int") for c in ("v", "u")} | {c: F.floor((F.col(c) + 1) / 2).cast("int") for c in ("h", "w")}
    return even.withColumns(half)


def grown(small: DataFrame, cells: DataFrame, values: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """``values`` of a level at the cells of the level before, bilinear with the pixels' middles aligned.

    Places beyond the border take the border's cell. Where cells are missing, those that are there share their weight.
    """

    def ends(axis: str, size: str) -> tuple[Column, Column]:
        n = F.floor((F.col(size) + 1) / 2)
        at = (F.col(axis) + 0.5) * n / F.col(size) - 0.5
        low = F.floor(at)
        end = lambda d: F.least(F.greatest(low + d, F.lit(0)), n - 1).cast("int")
        return F.array(*[F.struct(end(d).alias("i"), (at - low if d else 1 - (at - low)).alias("k")) for d in (0, 1)]), n

    key = [*by, "v", "u"]
    asks = cells.select(*key, F.explode(ends("v", "h")[0]).alias("a"), ends("u", "w")[0].alias("b")).select(*key, "a", F.explode("b").alias("b"))
    asks = asks.select(*by, F.col("v").alias("_v"), F.col("u").alias("_u"), F.col("a.i").alias("v"), F.col("b.i").alias("u"), (F.col("a.k") * F.col("b.k")).alias("_k"))
    met = asks.where("_k > 0").join(small.select(*key, *values), key)
    sums = met.groupBy(*by, F.col("_v").alias("v"), F.col("_u").alias("u")).agg(*[(F.sum(F.col("_k") * F.col(c)) / F.sum("_k")).alias(c) for c in values])
    return sums


def pyramid(df: DataFrame, values: list[str], levels: int, by: tuple[str, ...] = ()) -> list[DataFrame]:
    """Levels (by, h, w, v, u, values) of each raster, the finest first."""
    size = df.groupBy(*by).agg((F.max("v") + 1).cast("int").alias("h"), (F.max("u") + 1).cast("int").alias("w"))
    base = df.select(*by, "v", "u", *[F.col(c).cast("double").alias(c) for c in values])
    out = [cut(base.join(size, list(by)) if by else base.join(F.broadcast(size)))]
    while len(out) < levels:
        out.append(cut(halved(out[-1], values, by)))
    return out


def laplacian_fusion(rasters: DataFrame, by: str, detail: str, coarse: str, levels: int = 5, cutoff: int = 2, confidence: str | None = None) -> DataFrame:
    """(by, v, u, value): the coarsest ``cutoff`` bands of one raster with the finer bands of another, not below zero.

    With ``confidence`` (0 to 1) each band is a mean instead, weighted for the detail by the blurred confidence. A band is
    a level less what the next one grows to; growing is a join of a cell with four of the next level, so a raster lies
    in as many tasks as its pixels fill. Rasters without rows have none; cells that are missing stay so.
    """
    a, b, c = "_a", "_b", "_c"
    values = [a, b, *([c] if confidence else [])]
    named = rasters.select(F.col(by), "v", "u", F.col(detail).alias(a), F.col(coarse).alias(b), *([F.col(confidence).alias(c)] if confidence else []))
    gs = pyramid(named, values, levels, (by,))
    mix = lambda level, x, y: F.col(c) * x + (1 - F.col(c)) * y if confidence else y if level >= levels - cutoff else x
    now = gs[-1].withColumn("_x", mix(levels - 1, F.col(a), F.col(b)))
    for level in range(levels - 2, -1, -1):
        up = grown(now, gs[level], ["_x", a, b], (by,)).withColumnsRenamed({x: f"{x}_up" for x in ("_x", a, b)})
        met = gs[level].join(up, [by, "v", "u"], "left")
        band = mix(level, F.col(a) - F.col(f"{a}_up"), F.col(b) - F.col(f"{b}_up"))
        now = cut(met.withColumn("_x", F.coalesce(band + F.col("_x_up"), mix(level, F.col(a), F.col(b)))).select(*gs[level].columns, "_x"))
    return now.select(by, "v", "u", F.greatest("_x", F.lit(0.0)).alias("value"))
