"""The seams for models: any function from an image to a depth raster and a mask, or to splats."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Predict = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray | None]]


def predict_depth(pixels: DataFrame, predict: Predict, by: str = "origin") -> DataFrame:
    """(by, v, u, depth, mask) of each image of ``pixels(by, v, u, r, g, b)``; an image is one call of the model."""
    kind = pixels.schema[by].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["v"].max()) + 1, int(pdf["u"].max()) + 1
        image = np.zeros((h, w, 3))
        image[pdf["v"], pdf["u"]] = pdf[["r", "g", "b"]].to_numpy()
        depth, mask = predict(image)
        v, u = np.indices((h, w))
        return pd.DataFrame({by: pdf[by].iloc[0], "v": v.ravel().astype(np.int32), "u": u.ravel().astype(np.int32), "depth": depth.ravel().astype(float), "mask": np.ones(h * w, bool) if mask is None else mask.ravel().astype(bool)})

    return pixels.groupBy(by).applyInPandas(run, f"{by} {kind}, v int, u int, depth double, mask boolean")


#: What a splat model gives for each splat.
SPLAT_COLUMNS = ("x", "y", "z", "sx", "sy", "sz", "qw", "qx", "qy", "qz", "r", "g", "b", "opacity")


def predict_splats(pixels: DataFrame, predict: Callable[[np.ndarray, float], dict[str, np.ndarray]], focal: str = "focal_px", by: str = "origin") -> DataFrame:
    """(by, splat_id, SPLAT_COLUMNS) of each image of ``pixels(by, v, u, r, g, b, focal)``; an image is one call of the model.

    ``predict(image, focal)`` gives an array for each column, all of one length; splat_id is the place in them. A model
    that leaves out a column is a KeyError; one that finds nothing gives no rows.
    """
    kind = pixels.schema[by].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((int(pdf["v"].max()) + 1, int(pdf["u"].max()) + 1, 3))
        image[pdf["v"], pdf["u"]] = pdf[["r", "g", "b"]].to_numpy()
        found = predict(image, float(pdf[focal].iloc[0]))
        if missing := [c for c in SPLAT_COLUMNS if c not in found]:
            raise KeyError(f"the model gives no {missing}")
        n = len(found["x"])
        return pd.DataFrame({by: np.full(n, pdf[by].iloc[0], object), "splat_id": np.arange(n), **{c: np.asarray(found[c], np.float64) for c in SPLAT_COLUMNS}})

    return pixels.groupBy(by).applyInPandas(run, f"{by} {kind}, splat_id long, " + ", ".join(f"{c} double" for c in SPLAT_COLUMNS))


def brightness_depth(pixels: DataFrame) -> DataFrame:
    """The stand-in model as columns: depth 5 + 10 * brightness, at least 0.1; a mask of what is not bright."""
    light = (F.col("r") + F.col("g") + F.col("b")) / 3
    return pixels.withColumns({"depth": F.greatest(5.0 + 10.0 * light, F.lit(0.1)), "mask": light < 0.9})


def outdoor_share(scores: DataFrame, by: str, score: str, threshold: float = 0.5) -> DataFrame:
    """(by, p_outdoor, outdoor): the mean of a classifier's scores over the faces of each image."""
    return scores.groupBy(by).agg(F.avg(score).alias("p_outdoor")).withColumn("outdoor", F.col("p_outdoor") >= threshold)
