"""Seeded draws, medians of squares and overlapping patches against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.operators import patches, randoms, stencils


@pytest.mark.parametrize("width, seed", [(1, 0), (7, 42), (64, 42), (1001, 3), (200, 2**70)])
def test_draws_equal_the_generator(spark, width, seed):
    rows = 9
    want = np.random.default_rng(seed).random((rows, width))
    d = spark.range(rows * width).select((F.col("id") % width).alias("u"), F.floor(F.col("id") / width).alias("v")).repartition(5)
    got = d.select("v", "u", randoms.seeded_uniform(F.col("v"), F.col("u"), width, seed).alias("x")).toPandas()
    assert (got["x"].to_numpy() == want[got["v"], got["u"]]).all()


def test_draws_far_down_the_stream(spark):
    row, width = 10**9, 4096  # the place is 4e12 draws in; no row before it is made
    bits = np.random.PCG64(42)
    bits.advance(row * width)
    want = np.random.Generator(bits).random(width)
    d = spark.createDataFrame([(row, 5, width), (row, 4095, width), (None, 1, width), (0, 2, 3)], "v long, u long, w long")
    got = [r.x for r in d.select(randoms.seeded_uniform(F.col("v"), F.col("u"), F.col("w")).alias("x")).collect()]
    assert got == [want[5], want[4095], None, np.random.default_rng(42).random(3)[2]]


def raster(spark, a, mask=None):
    v, u = np.indices(a.shape)
    p = pd.DataFrame({"v": v.ravel().astype(np.int32), "u": u.ravel().astype(np.int32), "x": a.ravel(), "keep": 7})
    return spark.createDataFrame(p[mask.ravel()] if mask is not None else p)


@pytest.mark.parametrize("radius", [1, 2])
@pytest.mark.parametrize("holes", [0.0, 0.5])
def test_median_equals_numpy(spark, radius, holes):
    r = np.random.default_rng(radius)
    a = r.integers(0, 20, (13, 17)).astype(float)
    there = r.uniform(size=a.shape) >= holes
    got = stencils.median(raster(spark, a, there), "x", "m", radius).toPandas()
    assert len(got) == there.sum() and (got["keep"] == 7).all()
    for v, u, x, m in zip(got["v"], got["u"], got["x"], got["m"]):
        box = (slice(max(0, v - radius), v + radius + 1), slice(max(0, u - radius), u + radius + 1))
        assert m == np.median(a[box][there[box]]) and x == a[v, u]


def test_median_with_nulls_and_repeated_cells(spark):
    d = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 0, 5.0), (0, 0, 1, None), (1, 0, 0, 9.0), (1, 5, 5, None)], "g int, v int, u int, x double")
    got = sorted((r.g, r.v, r.u, r.x is None, r.m) for r in stencils.median(d, "x", "m", 1, ("g",)).collect())
    assert got == [(0, 0, 0, False, 3.0), (0, 0, 0, False, 3.0), (0, 0, 1, True, 3.0), (1, 0, 0, False, 9.0), (1, 5, 5, True, None)]
    assert stencils.median(d.where("false"), "x", "m", 1, ("g",)).count() == 0


def plain_patches(a, patch, stride):
    steps = [max(0, -(-(n - patch) // stride)) + 1 for n in a.shape]
    return {(r, c): a[r * stride : r * stride + patch, c * stride : c * stride + patch] for r in range(steps[0]) for c in range(steps[1])}


@pytest.mark.parametrize("shape, patch, overlap", [((30, 50), 16, 0.25), ((48, 48), 16, 0.25), ((10, 9), 16, 0.25), ((33, 40), 12, 0.5), ((7, 20), 4, 0.0)])
def test_patches_equal_slices(spark, shape, patch, overlap):
    a = np.random.default_rng(1).uniform(size=shape)
    stride = patches.step(patch, overlap)
    cut = patches.split(raster(spark, a), patch, overlap)
    got = cut.toPandas()
    want = plain_patches(a, patch, stride)
    assert len(got) == sum(p.size for p in want.values())
    for (r, c), g in got.groupby(["row", "col"]):
        out = np.full(want[r, c].shape, np.nan)
        out[g["i"], g["j"]] = g["x"]
        assert (out == want[r, c]).all()
    if (patch - stride) % 2 == 0:
        back = patches.merge(cut.drop("v", "u"), patch, (patch - stride) // 2).toPandas()
        out = np.full(shape, np.nan)
        out[back["v"], back["u"]] = back["x"]
        assert len(back) == a.size and (out == a).all()


def test_patches_of_many_rasters(spark):
    a, b = np.arange(60.0).reshape(6, 10), np.arange(12.0).reshape(3, 4)
    d = raster(spark, a).withColumn("g", F.lit(1)).union(raster(spark, b).withColumn("g", F.lit(2)))
    cut = patches.split(d, 4, 0.5, ("g",))
    back = patches.merge(cut.drop("v", "u"), 4, 1, ("g",)).toPandas()
    for g, want in ((1, a), (2, b)):
        own = back[back["g"] == g]
        out = np.full(want.shape, np.nan)
        out[own["v"], own["u"]] = own["x"]
        assert len(own) == want.size and (out == want).all()
    assert patches.split(d.where("false"), 4, 0.5, ("g",)).count() == 0
