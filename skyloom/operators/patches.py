"""Overlapping square patches of rasters: cells sent to each patch that covers them, and patches joined again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def step(patch: int, overlap: float) -> int:
    return int(patch * (1 - overlap))


def split(cells: DataFrame, patch: int, overlap: float = 0.25, by: tuple[str, ...] = ()) -> DataFrame:
    """``cells(by, v, u, ...)`` with row, col (of the patch) and i, j (within it): a row for each patch that covers a cell.

    Patches begin every ``int(patch * (1 - overlap))`` cells until the raster is covered; those at its end may be short.
    A cell is copied to four patches at most while the overlap is no more than half.
    """
    stride = step(patch, overlap)
    size = cells.groupBy(*by).agg(F.max("v").alias("_v"), F.max("u").alias("_u"))
    sized = cells.join(size, list(by)) if by else cells.join(F.broadcast(size))

    def covering(at: str, last: str) -> Column:
        steps = F.greatest(F.ceil((F.col(last) + 1 - patch) / stride), F.lit(0))
        first = F.greatest(F.ceil((F.col(at) - patch + 1) / stride), F.lit(0))
        return F.sequence(first, F.least(F.floor(F.col(at) / stride), steps)).cast("array<int>")

    out = sized.withColumn("row", F.explode(covering("v", "_v"))).withColumn("col", F.explode(covering("u", "_u"))).drop("_v", "_u")
    return out.withColumns({"i": (F.col("v") - F.col("row") * stride).cast("int"), "j": (F.col("u") - F.col("col") * stride).cast("int")})


def merge(patches: DataFrame, patch: int, padding: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Patches ``(by, row, col, i, j, ...)`` side by side as cells (by, v, u, ...), each less ``padding`` where another follows.

    The first row and column of patches keep their outer edge, the last theirs. Where ``padding`` is half of what patches
    share, this undoes ``split``.
    """
    ends = patches.groupBy(*by).agg(F.max("row").alias("_row"), F.max("col").alias("_col"))
    p = patches.join(ends, list(by)) if by else patches.join(F.broadcast(ends))
    kept = lambda i, n, last: ((F.col(n) == 0) | (F.col(i) >= padding)) & ((F.col(n) == F.col(last)) | (F.col(i) < patch - padding))
    at = lambda i, n: F.when(F.col(n) == 0, F.col(i)).otherwise(patch - padding + (F.col(n) - 1) * (patch - 2 * padding) + F.col(i) - padding).cast("int")
    placed = p.where(kept("i", "row", "_row") & kept("j", "col", "_col")).withColumns({"v": at("i", "row"), "u": at("j", "col")})
    return placed.drop("row", "col", "i", "j", "_row", "_col")
