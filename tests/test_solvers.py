"""Pyramids and Poisson's equation over many blocks, against plain numpy."""

import numpy as np
import pandas as pd
import pytest

from skyloom.operators import poisson, pyramids
from skyloom.operators.stencils import gaussian_weights


def long(spark, **arrays):
    """Rasters of one shape as rows; each name holds (raster, v, u)."""
    k, h, w = next(iter(arrays.values())).shape
    i, v, u = (x.ravel() for x in np.indices((k, h, w)))
    return spark.createDataFrame(pd.DataFrame({"raster_id": i, "v": v.astype(np.int32), "u": u.astype(np.int32)} | {n: a.ravel() for n, a in arrays.items()}))


def square(df):
    p = df.toPandas().sort_values(["raster_id", "v", "u"])
    return p["value"].to_numpy().reshape(p["raster_id"].nunique(), p["v"].max() + 1, p["u"].max() + 1)


def blur(a):
    for axis in (0, 1):
        n = a.shape[axis]
        pad = [(2, 2) if k == axis else (0, 0) for k in (0, 1)]
        index = np.arange(-2, n + 2)
        while n > 1 and ((index < 0) | (index >= n)).any():  # mirrored at the last cell, again if need be
            index = np.where(index < 0, -index, index)
            index = np.where(index >= n, 2 * (n - 1) - index, index)
        p = np.take(a, index if n > 1 else np.zeros(5, int), axis)
        assert p.shape[axis] == a.shape[axis] + pad[axis][0] * 2
        a = sum(k * np.take(p, range(d, d + n), axis) for d, k in enumerate(gaussian_weights(2, 1.0)))
    return a


def grow(s, shape):
    def line(n, m):
        at = (np.arange(n) + 0.5) * m / n - 0.5
        low = np.floor(at).astype(int)
        out = np.zeros((n, m))
        for d, k in ((0, 1 - (at - low)), (1, at - low)):
            np.add.at(out, (np.arange(n), np.clip(low + d, 0, m - 1)), k)
        return out

    return line(shape[0], s.shape[0]) @ s @ line(shape[1], s.shape[1]).T


def levels(a, n):
    g = [a]
    while len(g) < n:
        g.append(blur(g[-1])[::2, ::2])
    return g


def fused(a, b, n, cutoff, c=None):
    ga, gb, gc = levels(a, n), levels(b, n), levels(c if c is not None else a, n)
    band = lambda g, i: g[i] - grow(g[i + 1], g[i].shape) if i < n - 1 else g[i]
    mix = [gc[i] * band(ga, i) + (1 - gc[i]) * band(gb, i) if c is not None else band(gb if i >= n - cutoff else ga, i) for i in range(n)]
    out = mix[-1]
    for m in reversed(mix[:-1]):
        out = m + grow(out, m.shape)
    return np.maximum(out, 0)


@pytest.mark.parametrize("shape, n", [((21, 34), 4), ((16, 16), 5), ((3, 7), 3), ((1, 5), 3), ((2, 2), 4), ((40, 9), 1)])
def test_fusion_equals_plain(spark, shape, n):
    r = np.random.default_rng(n)
    a, b, c = r.uniform(0, 9, (2, *shape)), r.uniform(0, 9, (2, *shape)), r.uniform(0, 1, (2, *shape))
    d = long(spark, a=a, b=b, c=c)
    got = square(pyramids.laplacian_fusion(d, "raster_id", "a", "b", n, 2))
    assert np.allclose(got, [fused(x, y, n, 2) for x, y in zip(a, b)], atol=1e-9)
    got = square(pyramids.laplacian_fusion(d, "raster_id", "a", "b", n, confidence="c"))
    assert np.allclose(got, [fused(x, y, n, 0, z) for x, y, z in zip(a, b, c)], atol=1e-9)


def test_bands_give_the_raster_back(spark):
    a = np.random.default_rng(0).uniform(0, 9, (1, 37, 50))
    assert np.allclose(square(pyramids.laplacian_fusion(long(spark, a=a), "raster_id", "a", "a", 5, 2)), a, atol=1e-12)
    assert pyramids.laplacian_fusion(long(spark, a=a).where("false"), "raster_id", "a", "a", 3).count() == 0


def direct(there, free, rhs, fixed):
    """All unknown cells of one raster at once, by a dense solver."""
    h, w = there.shape
    a, b = np.eye(h * w), np.where(free, rhs, fixed).ravel()
    for v, u in zip(*np.nonzero(free & there)):
        row = v * w + u
        a[row, row] = 0
        for y, x in ((v - 1, u), (v + 1, u), (v, u - 1), (v, u + 1)):
            if 0 <= y < h and 0 <= x < w and there[y, x]:
                a[row, row] += 1
                a[row, y * w + x] -= 1
    return np.linalg.solve(a, b).reshape(h, w)


@pytest.mark.parametrize("block, rim", [(16, 6), (64, 24)])
def test_poisson_over_blocks_equals_direct(spark, block, rim):
    """Irregular holes, a free border and sources; every unknown against a dense solve, to the stated residual."""
    r = np.random.default_rng(block)
    value, rhs = r.uniform(1, 5, (2, 33, 41)), r.normal(size=(2, 33, 41))
    known = r.uniform(size=value.shape) < 0.03
    known[:, 0, 0] = True
    known[0, 10:25, 5:30] = False
    d = long(spark, rhs=rhs, fixed=np.where(known, value, np.nan)).replace(float("nan"), None)
    out = poisson.solve(d, block=block, rim=rim, tolerance=1e-9)
    got = square(out)
    for i in range(2):
        want = direct(np.ones((33, 41), bool), ~known[i], rhs[i], np.where(known[i], value[i], 0))
        assert np.abs(got[i] - want).max() < 1e-5


def test_poisson_with_missing_cells(spark):
    """Cells that are not there are a free border; blocks may hold none."""
    r = np.random.default_rng(5)
    there = r.uniform(size=(1, 30, 30)) < 0.9
    there[0, :16, 16:] = False
    known = r.uniform(size=there.shape) < 0.3
    value = r.uniform(1, 5, there.shape)
    d = long(spark, there=there, rhs=np.zeros(there.shape), fixed=np.where(known, value, np.nan)).replace(float("nan"), None).where("there")
    got = poisson.solve(d, block=8, rim=3).toPandas()
    free = ~known[0]
    p = np.zeros((32, 32))
    p[got["v"] + 1, got["u"] + 1] = got["value"]
    n = np.pad(there[0], 1).astype(int)
    around = lambda a: a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:]
    left = around(n) * p[1:-1, 1:-1] - around(p)
    assert len(got) == there.sum() and np.abs(left[there[0] & free]).max() < 1e-7
    assert np.allclose(p[1:-1, 1:-1][there[0] & known[0]], value[0][there[0] & known[0]])


def test_poisson_border_alone(spark):
    """The hard case: one raster of many blocks whose inside follows from its border across all of them."""
    a = np.random.default_rng(1).uniform(0, 50, (1, 50, 80))
    p = np.pad(a[0], 1)
    rhs = 4 * a[0] - p[:-2, 1:-1] - p[2:, 1:-1] - p[1:-1, :-2] - p[1:-1, 2:]
    out = poisson.bordered(long(spark, rhs=rhs[None], border=a), "raster_id", "rhs", "border", block=16, rim=6, tolerance=1e-9)
    assert np.abs(square(out)[0] - a[0]).max() < 1e-4


def test_poisson_without_an_answer_raises(spark):
    d = spark.createDataFrame([(0, 0, 0, 1.0, None), (0, 0, 1, 1.0, None)], "raster_id int, v int, u int, rhs double, fixed double")
    with pytest.raises(RuntimeError, match="residual"):
        poisson.solve(d, rounds=2).count()
    assert poisson.solve(d.where("false")).count() == 0
    assert [r.value for r in poisson.solve(d.withColumn("rhs", d["rhs"] * 0)).collect()] == [0.0, 0.0]


def test_enclosed_cells_are_exact_means(spark):
    """A cell between known ones is the mean of its neighbours to the last bit, as the SQL of the fill has it (F7)."""
    r = np.random.default_rng(7)
    a = np.round(r.uniform(10, 50, (2, 40, 50)), 6)
    k = np.ones(a.shape, int)
    k[:, 1:-1:3, 1:-1:3] = 0
    got = square(poisson.fill(long(spark, depth=a, known=k), "raster_id", "depth", "known", block=16, rim=4))
    want = a.copy()
    want[:, 1:-1, 1:-1] = (a[:, 1:-1, :-2] + a[:, 1:-1, 2:] + a[:, :-2, 1:-1] + a[:, 2:, 1:-1]) / 4
    assert np.array_equal(got, np.where(k == 1, a, want))


@pytest.mark.parametrize("group", [1, 2])
def test_poisson_over_groups_of_blocks(spark, group):
    """Rasters of one group and of many in one table, one of them in parts of which only one sees the other (F2)."""
    r = np.random.default_rng(group)
    there = np.ones((3, 20, 31), bool)
    there[1, 9:] = there[1, :, 11:] = there[2, :, 8:16] = False
    value, rhs = r.uniform(1, 5, there.shape), r.normal(size=there.shape)
    known = r.uniform(size=there.shape) < 0.1
    known[:, 0, 0] = known[:, 0, 16] = True
    d = long(spark, there=there, rhs=rhs, fixed=np.where(known, value, np.nan)).replace(float("nan"), None).where("there")
    got = poisson.solve(d, block=8, rim=3, tolerance=1e-7, group=group).toPandas()
    assert len(got) == there.sum() and not got.duplicated(["raster_id", "v", "u"]).any()
    want = np.array([direct(*x) for x in zip(there, ~known, rhs, np.where(known, value, 0))])
    assert np.abs(got["value"] - want[got["raster_id"], got["v"], got["u"]]).max() < 1e-4


def test_poisson_of_a_group_takes_no_rounds(spark, monkeypatch):
    """Small rasters of many blocks are done at the first checkpoint, to the same tolerance (F2)."""
    cuts = []
    monkeypatch.setattr(poisson, "cut", lambda df, cut=poisson.cut: cuts.append(1) or cut(df))
    a = np.random.default_rng(3).uniform(0, 50, (2, 20, 50))
    p = np.pad(a, ((0, 0), (1, 1), (1, 1)))
    rhs = 4 * a - p[:, :-2, 1:-1] - p[:, 2:, 1:-1] - p[:, 1:-1, :-2] - p[:, 1:-1, 2:]
    out = poisson.bordered(long(spark, rhs=rhs, border=a), "raster_id", "rhs", "border", block=16, rim=6, tolerance=1e-12)
    assert np.abs(square(out) - a).max() < 1e-8
    assert len(cuts) == 1
